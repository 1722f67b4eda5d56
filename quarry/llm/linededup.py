"""Substring dedup (4): line hashing.

Units are the sentences of each line, so a line of one sentence is one unit, and of any length. A unit is normalised (lower
case, runs of anything but letters and digits become one space) and digested to 128 bits. Digests are grouped globally: the
earliest occurrence by (id, text hash, position) is the first, all others are repeats and go, whatever their length; neighbours
go as one span. A caller who would rather leave greetings and license lines that many documents share passes `passage_words`:
then a run of neighbouring repeats goes only if it has that many words or more. What a copied passage's first or last sentence
has in common with another is not found where it runs into the text around it without a sentence's end. What goes is told in
offsets of the original text.

Only ids, offsets and digests are shuffled until the end. Repeated digests are counted on the map side. Those that are over
1 / `HOT` of all units, at most `HOT` by the pigeonhole principle, are broadcast to their occurrences; all others are joined in
a shuffle in which no key has more than that share. What is gathered per document is its own repeats.

Defined cases: null text stays null and has no units, as has an empty one; a null id ranks after all others; of rows
that repeat an id and a text (which of them, where their other columns differ, isn't fixed) one comes first and keeps what is
not found earlier, all units of the others are repeats; ties within a text go to the first position;
an empty table gives no rows; a very long text is one document like any other; an input column `removed` gives way to the
output's, all others stay as they are, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import rowed, stored

PASSAGE_WORDS, HOT = 0, 1000
_LINE = re.compile(r"[^\n]+")
_SENTENCE = re.compile(r"\S.*?(?:[.!?…]+(?=\s)|\Z)", re.S)
_OTHER = re.compile(r"[\W_]+")


def units(text: str | None) -> Iterator[tuple[int, int, str]]:
    """start, end and normalised form of each unit of a text."""
    for line in _LINE.finditer(text or ""):
        at = line.start()
        for s in _SENTENCE.finditer(line[0]):
            if norm := _OTHER.sub(" ", s[0].lower()).strip():
                yield at + s.start(), at + s.end(), norm


def passages(repeats: list[tuple[int, int, int, int]], passage_words: int = PASSAGE_WORDS) -> list[tuple[int, int]]:
    """Start and end of each run of neighbours in repeats (number of the unit, start, end, words) with words enough."""
    out, run = [], [-2, 0, 0, 0]
    for no, a, b, words in [*sorted(repeats), (-1, 0, 0, 0)]:
        if no == run[0] + 1:
            run = [no, run[1], b, run[3] + words]
        else:
            if run[0] >= 0 and run[3] >= passage_words:
                out.append((run[1], run[2]))
            run = [no, a, b, words]
    return out


def cleaned(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the spans; a line that loses all its words goes with its line end."""
    gone = np.zeros(len(text) + 1, bool)
    for a, b in spans:
        gone[a:b] = True
    lines, i = [], 0
    for line in text.split("\n"):
        left = "".join(c for c, g in zip(line, gone[i : i + len(line)]) if not g) if gone[i : i + len(line)].any() else line
        if left is line or left.strip():
            lines.append(left if left is line else left.strip())
        i += len(line) + 1
    return "\n".join(lines)


def _found(documents: DataFrame) -> DataFrame:
    """doc_id, h, no, a, b, words, d1, d2: every unit of every row, with its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                row, no, a, b, words, digest = [], [], [], [], [], []
                for i, text in enumerate(batch.column(2)):
                    for k, (start, end, norm) in enumerate(units(text.as_py())):
                        row.append(i)
                        no.append(k)
                        a.append(start)
                        b.append(end)
                        words.append(norm.count(" ") + 1)
                        digest.append(xxhash.xxh3_128_digest(norm.encode("utf-8", "surrogatepass")))
                d = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
                ids = [batch.column(c).take(pa.array(row, pa.int64())) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ids, *(pa.array(x, pa.int32()) for x in (no, a, b, words)), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy())], ["doc_id", "h", "no", "a", "b", "words", "d1", "d2"])

    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("h"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id bigint, h bigint, no int, a int, b int, words int, d1 bigint, d2 bigint")


def _repeats(found: DataFrame) -> DataFrame:
    """doc_id, h and r, the units that occur earlier: an array of struct(no, a, b, words)."""
    digest, rank = ["d1", "d2"], F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h", "no")
    first = stored(found.groupBy(*digest).agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    hot = F.col("n") * HOT > found.count()
    most = F.broadcast(first.where(hot).select(*digest, "first"))  # HOT rows at most
    rest = found.join(F.broadcast(first.where(hot).select(*digest)), digest, "left_anti").join(first.where(~hot).select(*digest, "first"), digest)
    gone = found.join(most, digest).unionByName(rest).where(rank != F.col("first"))
    return gone.groupBy("doc_id", "h").agg(F.collect_set(F.struct("no", "a", "b", "words")).alias("r"))


def deduplicated(documents: DataFrame, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """documents' columns with the text cleaned, and removed: an array of struct(start, end) in the original text."""

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def removed(repeats: pa.Array) -> pa.Array:
        found = [passages([tuple(x.values()) for x in r], passage_words) for r in repeats.to_pylist()]
        return pa.array([[{"start": a, "end": b} for a, b in f] for f in found], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

    @F.arrow_udf("string")
    def clean(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([t if t is None or not s else cleaned(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(texts.to_pylist(), spans.to_pylist())], pa.string())

    @F.arrow_udf("array<struct<no:int,a:int,b:int,words:int>>")
    def every(texts: pa.Array) -> pa.Array:
        found = [[{"no": i, "a": a, "b": b, "words": norm.count(" ") + 1} for i, (a, b, norm) in enumerate(units(t))] for t in texts.to_pylist()]
        return pa.array(found, pa.list_(pa.struct([(c, pa.int32()) for c in ("no", "a", "b", "words")])))

    found = stored(_found(documents))
    spans = _repeats(found).where(F.aggregate("r", F.lit(0), lambda n, x: n + x["words"]) >= passage_words).select(F.col("doc_id").alias("i"), F.col("h").alias("j"), removed("r").alias("x"))
    rows = rowed(documents, doc_id=documents["doc_id"].cast("bigint"), h=F.xxhash64(documents["text"].cast("string")))
    same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("j"))
    twice = stored(found.where("no = 0").groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("i"), F.col("h").alias("j")))
    # rows alike in id and text: numbered where they are stored, so that the same one is the first in both joins, which have no hot key
    alike = stored(rows.join(twice, same, "left_semi").withColumn("nth", F.monotonically_increasing_id()))
    first = alike.groupBy("doc_id", "h").agg(F.min("nth").alias("nth")).select("nth")
    rows = rows.join(twice, same, "left_anti").unionByName(alike.join(first, "nth", "left_semi").drop("nth"))
    rows = rows.join(spans, same, "left").withColumn("x", F.coalesce("x", F.array().cast("array<struct<start:int,end:int>>"))).select("row", "x")
    rows = rows.unionByName(alike.join(first, "nth", "left_anti").select("row", removed(every(F.col("row.text").cast("string"))).alias("x")))
    text = clean(F.col("row.text").cast("string"), "x")
    return rows.select(*[text.alias(f.name) if f.name.lower() == "text" else F.col("row").getField(f.name).alias(f.name) for f in rows.schema["row"].dataType if f.name.lower() != "removed"], F.col("x").alias("removed"))
