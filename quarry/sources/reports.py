"""Composed reports as HTML, their sample rows, and a log that goes to the console and a file."""

from __future__ import annotations

import html
import json
import logging
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import profile
from quarry.sources.store import per_document
from quarry.sources.tables import stored


def _page(title: str, parts: Iterable[str]) -> str:
    return "\n".join([f"<html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>", *parts, "</body></html>"])


def _table(head: Iterable[str], rows: Iterable[Iterable]) -> str:
    cells = lambda tag, row: "".join(f"<{tag}>{html.escape(str(v))}</{tag}>" for v in row)
    return f"<table><tr>{cells('th', head)}</tr>" + "".join(f"<tr>{cells('td', r)}</tr>" for r in rows) + "</table>"


def chunk_flags(chunks: DataFrame, least: int = 200, most: int = 4000) -> DataFrame:
    """One row: how many chunks there are and how many raise each flag. Chunks are read once: their ids, digests and flags are written,
    and three counts read those."""
    n, whole = F.length(T.text("text")), T.strip(T.text("text"))
    tests = {
        "empty": whole == "", "too_short": n < least, "too_long": n > most, "unknown_clause": F.upper(T.text("clause_id")) == "UNKNOWN",
        "definitions": F.col("is_definition") == 1, "normative": F.col("is_normative") == 1,
    }
    rows = stored(chunks.select("chunk_id", T.text_hash(whole).alias("digest"), *[test.alias(name) for name, test in tests.items()]))
    flags = rows.agg(F.count(F.lit(1)).alias("chunks"), *[F.coalesce(F.sum(F.col(name).cast("bigint")), F.lit(0)).alias(name) for name in tests])
    one = lambda df, n: df.agg(F.coalesce(F.sum(n), F.lit(0)).alias("x"))
    ids = one(profile.duplicate_ids(rows, "chunk_id"), F.col("extra")).withColumnRenamed("x", "duplicate_ids")
    texts = one(profile.duplicate_texts(rows.where("not empty"), "digest"), F.least(F.col("n"), F.lit(10))).withColumnRenamed("x", "repeated_texts")
    return flags.join(F.broadcast(ids)).join(F.broadcast(texts))  # one-row frames


def chunk_samples(chunks: DataFrame, k: int = 20, least: int = 200, most: int = 4000) -> DataFrame:
    """bucket, chunk_id, doc_id, clause_id, preview: the first k chunks of each flag."""
    n = F.length(T.text("text"))
    flags = {"empty": T.strip(T.text("text")) == "", "too_short": n < least, "too_long": n > most, "unknown_clause": F.upper(T.text("clause_id")) == "UNKNOWN"}
    named = F.explode(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in flags.items()])))
    rows = chunks.select("chunk_id", "doc_id", "clause_id", F.left(T.text("text"), F.lit(800)).alias("preview"), named.alias("flag"))
    return profile.samples(rows, F.col("flag"), "chunk_id", k).select("bucket", "place", "chunk_id", "doc_id", "clause_id", "preview")


def chunk_report(chunks: DataFrame, title: str = "Chunks") -> str:
    """Counters, length and line statistics, flags with their shares, the most frequent values, clauses with many chunks."""
    flags = chunk_flags(chunks).first().asDict()
    stats = [(name, profile.summary(chunks, value).first()) for name, value in (("characters", F.length(T.text("text")).cast("bigint")), ("lines", T.line_count(F.col("text")).cast("bigint")))]
    share = lambda x: f"{100 * x / max(1, flags['chunks']):.2f} %"
    parts = ["<h2>Lengths</h2>", _table(["of", *stats[0][1].asDict()], ([name, *row] for name, row in stats)), "<h2>Flags</h2>", _table(["flag", "n", "share"], ([k, v, share(v)] for k, v in flags.items()))]
    tops = {"Documents": per_document(chunks).orderBy(F.desc("n"), "doc_id").limit(15), "Clauses": profile.top_values(chunks, "clause_id"), "Clauses with many chunks": profile.exploded_clauses(chunks).limit(50)}
    for name, df in tops.items():
        parts += [f"<h2>{name}</h2>", _table(df.columns, df.collect())]  # a few dozen rows each
    return _page(title, parts)


def audit_report(questions: DataFrame, rows: DataFrame, summary: DataFrame, title: str = "Retrieval audit", most: int = 500) -> str:
    """The summary and, for up to `most` questions, a table of each list. questions: query_id, question; rows: as
    evaluate.audit_rows gives them."""
    asked = {r["query_id"]: r["question"] for r in questions.select("query_id", "question").orderBy("query_id").limit(most).collect()}
    found: dict = {}
    for r in rows.where(F.col("query_id").isin(list(asked))).orderBy("query_id", "list", "rank").collect():
        found.setdefault((r["query_id"], r["list"]), []).append((r["rank"], r["score"], f"{r['doc_id']} | {r['clause_id']}", r["snippet"]))
    parts = ["<h2>Summary</h2><pre>" + html.escape(json.dumps(summary.first().asDict(), indent=2)) + "</pre>"]
    for i, question in asked.items():
        parts += [f"<h2>{i}</h2><pre>{html.escape(question or '')}</pre>"]
        for name in ("fused", "reranked"):
            parts += [f"<h3>{name}</h3>", _table(["rank", "score", "document, clause", "snippet"], found.get((i, name), []))]
    return _page(title, parts)


def tee(path: str, name: str = "quarry.run") -> logging.Logger:
    """A logger whose lines, with the time, go to the console and to the end of a file."""
    log = logging.getLogger(f"{name}:{path}")
    if not log.handlers:
        log.setLevel(logging.INFO)
        log.propagate = False
        for handler in (logging.StreamHandler(), logging.FileHandler(path, encoding="utf-8")):
            handler.setFormatter(logging.Formatter("[%(asctime)s] %(message)s"))
            log.addHandler(handler)
    return log


def joined_logs(paths: Iterable[str], out: str) -> None:
    """The workers' logs one after the other, each under its name."""
    with open(out, "w", encoding="utf-8") as to:
        for path in paths:
            with open(path, encoding="utf-8") as f:
                to.write(f"===== {path} =====\n{f.read()}\n")
