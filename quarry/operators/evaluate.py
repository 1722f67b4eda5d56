"""Scores of answered questions: by split, micro over splits, merged over shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import answers as A
from quarry.operators import profile
from quarry.sources.tables import stored


def shard(examples: DataFrame, shard_id: int, shards: int, index: str = "global_i") -> DataFrame:
    return examples.where(F.col(index) % shards == shard_id)


def ranged(examples: DataFrame, start: int, n: int, index: str = "global_i") -> DataFrame:
    """The rows numbered start to start + n - 1 (from 0); at least one is asked for, and a start beyond the end is the last row."""
    last = examples.agg(F.max(index).alias("last"))
    at = F.least(F.lit(max(0, start)), F.col("last"))
    return examples.join(F.broadcast(last)).where((F.col(index) >= at) & (F.col(index) < at + max(1, n))).drop("last")  # one row


def scored(rows: DataFrame) -> DataFrame:
    """rows (split, global_i, gold, answer, citations) with pred_num, acc, citations_count; a gold that is no number is matched as text."""
    number = F.col("gold").rlike(r"^\s*\d+\s*$")
    return rows.withColumns({"pred_num": A.option_number(F.col("answer")), "citations_count": F.size("citations")}).withColumn("acc", F.when(number, A.exact_match(F.col("pred_num"), F.col("gold"))).otherwise(A.exact_match(F.col("answer"), F.col("gold"))))


def _mean(sum_: Column, n: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(sum_, n), F.lit(0.0)), 6)


def by_split(rows: DataFrame, *more: str) -> DataFrame:
    g = rows.groupBy("split", *more).agg(F.count(F.lit(1)).alias("n"), F.sum("acc").alias("e_s"), F.sum("citations_count").alias("e_c"))
    return g.select("split", *more, "n", _mean(F.col("e_s"), F.col("n")).alias("acc"), _mean(F.col("e_c").cast("double"), F.col("n")).alias("avg_citations"))


def micro(rows: DataFrame) -> DataFrame:
    """split, n, acc, avg_citations of every split and, under 'ALL', of all rows: one rollup."""
    g = rows.rollup("split").agg(F.count(F.lit(1)).alias("n"), F.sum("acc").alias("e_s"), F.sum("citations_count").alias("e_c"))
    return g.select(F.coalesce("split", F.lit("ALL")).alias("split"), "n", _mean(F.col("e_s"), F.col("n")).alias("acc"), _mean(F.col("e_c").cast("double"), F.col("n")).alias("avg_citations"))


def merged(shards: DataFrame) -> DataFrame:
    """Summaries of shards (split, n, acc, avg_citations) weighted by n, per split and under 'ALL'."""
    g = shards.rollup("split").agg(F.sum("n").alias("n"), F.sum(F.col("acc") * F.col("n")).alias("e_s"), F.sum(F.col("avg_citations") * F.col("n")).alias("e_c"))
    return g.select(F.coalesce("split", F.lit("ALL")).alias("split"), "n", _mean(F.col("e_s"), F.col("n")).alias("acc"), _mean(F.col("e_c"), F.col("n")).alias("avg_citations"))


def missing_rate(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("pred_num") == "", 1.0).otherwise(0.0)), 6).alias("missing_rate"))


def audit_rows(fused: DataFrame, reranked: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, list (fused or reranked), rank, score, doc_id, clause_id, snippet and overlap (share of the question's
    keywords in the snippet). questions: query_id, question; chunks: doc_id, clause_id, text; a hit that chunks lacks keeps
    null and an overlap of 0."""
    hits = fused.select(F.lit("fused").alias("list"), "query_id", "rank", "score", "doc_id").unionByName(reranked.select(F.lit("reranked").alias("list"), "query_id", "rank", "score", "doc_id"))
    own = chunks.join(hits.select("doc_id").distinct(), "doc_id", "left_semi")  # texts that no hit has go where they are read
    rows = hits.join(questions.select("query_id", "question"), "query_id").join(own.select("doc_id", "clause_id", T.strip(T.snippet(F.col("text"))).alias("snippet")), "doc_id", "left")
    overlap = F.round(T.overlap_ratio(T.keywords(F.col("question")), T.keywords(F.col("snippet"))), 6)
    return rows.select("query_id", "list", "rank", "score", "doc_id", "clause_id", "snippet", overlap.alias("overlap"))


def audit(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """One row of audit_rows: the questions, means and medians of score and overlap of both lists, and how many fused hits
    have no clause (unknown_rate) or aren't among the chunks (missing). An empty list has 0 everywhere."""
    rows = stored(rows.select("list", "score", "overlap", "clause_id"))  # read twice
    fused = F.col("list") == "fused"
    own = F.when(fused, "fused").otherwise("rerank")
    values = rows.select(F.explode(F.array(F.struct(own.alias("series"), F.col("score").alias("v")), F.struct(F.concat(own, F.lit("_overlap")).alias("series"), F.col("overlap").alias("v")))).alias("x")).select("x.*")
    stats = profile.ranked(values, {"low": profile.LOW, "high": profile.HIGH}).select("series", (F.col("total") / F.col("n")).alias("mean"), ((F.col("low") + F.col("high")) / 2).alias("median"))
    one = [F.round(F.coalesce(F.max(F.when(F.col("series") == name, F.col(stat))), F.lit(0.0)), 6).alias(f"{name}_{stat}") for name in ("fused", "fused_overlap", "rerank", "rerank_overlap") for stat in ("mean", "median")]
    unknown = F.round(F.coalesce(F.avg(F.when(fused, (T.text("clause_id") == "UNKNOWN").cast("double"))), F.lit(0.0)), 6)
    missing = F.coalesce(F.sum((fused & F.col("clause_id").isNull()).cast("bigint")), F.lit(0))
    counts = rows.agg(unknown.alias("unknown_rate"), missing.alias("missing"))
    return stats.agg(*one).join(F.broadcast(counts)).join(F.broadcast(questions.agg(F.count(F.lit(1)).alias("questions"))))  # one-row frames


def outcomes(parsed: DataFrame) -> DataFrame:
    """mode, n, empty (no answer), cited (with citations)."""
    return parsed.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("answer") == "").cast("int")).alias("empty"), F.sum((F.size("citations") > 0).cast("int")).alias("cited"))


def parser_report(parsed: DataFrame, raw: str = "raw") -> DataFrame:
    """One row about parsed outputs (raw, answer, citations, mode): total, schema_ok, schema_fail, one count a mode, empty_raw,
    answer_missing and the rates of the first and the last."""
    count = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    out = F.to_json(F.struct(F.col("answer"), F.col("citations")), {"ignoreNullFields": "false"})
    ok = A.schema_fault(out) == "ok"
    n = F.greatest(F.lit(1), F.count(F.lit(1)))
    missing = count(T.strip(T.text("answer")) == "")
    return parsed.agg(
        F.count(F.lit(1)).alias("total"), count(ok).alias("schema_ok"), count(~ok).alias("schema_fail"), *[count(F.col("mode") == m).alias(m) for m in ("clean", "extracted_or_fixed", "salvaged")],
        count(T.strip(T.text(raw)) == "").alias("empty_raw"), missing.alias("answer_missing"), F.round(count(ok) / n, 6).alias("schema_ok_rate"), F.round(missing / n, 6).alias("answer_missing_rate"),
    )


def breakdown(rows: DataFrame, cited: int = 2) -> DataFrame:
    """split, n, correct, failed, well_cited (citations_count of `cited` or more) and citations (a map of count to answers),
    for each split and, under 'ALL', all rows."""
    per = rows.groupBy("split", "citations_count").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("acc") == 1).cast("bigint")).alias("correct"))
    every = per.unionByName(per.groupBy("citations_count").agg(F.sum("n").alias("n"), F.sum("correct").alias("correct")).withColumn("split", F.lit("ALL")))
    out = every.groupBy("split").agg(F.sum("n").alias("n"), F.sum("correct").alias("correct"), F.sum(F.when(F.col("citations_count") >= cited, F.col("n")).otherwise(0)).alias("well_cited"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("citations_count", "n")))).alias("citations"))
    return out.select("split", "n", "correct", (F.col("n") - F.col("correct")).alias("failed"), "well_cited", "citations")
