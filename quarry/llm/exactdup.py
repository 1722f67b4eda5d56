"""Exact dedup: rows are grouped by a 128-bit hash of their text, one row of each text stays, bytes are compared inside groups.

The hash, the SHA-256 of the result and a row number are written once to the shared folder: from there on rows of some 60 bytes are
grouped and joined, not texts. A group's rows stand for one text if their bytes are the same. Texts are read again for that, those of
groups with more than one row only, and combined before they are shuffled, so that a text with a million copies travels once a task.
A group whose bytes differ is split by SHA-256; should two different texts agree in both hashes, the run stops with an error rather
than drop one.

A class that holds a thousandth of all rows or more is joined to its rows by broadcast (there can't be more than a thousand of those),
all others in a shuffle.

Defined cases: a null text counts as empty; a null id comes after all others, so it stays only where all ids of a text are null; of
rows that share id and text, the first one by number (`marked`) or by a digest of the other columns (`deduplicated`) stays, one in any
case; an empty table gives an empty one; texts of any length are hashed and compared whole; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import fields, rowed, stored, text_or_empty

#: So many hashes of repeated texts are broadcast at most (16 bytes each); beyond, they are joined in a shuffle.
MOST = 1 << 20
#: A class of total / HOT rows or more is joined by broadcast.
HOT = 1000


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _sha(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def compare_bytes(texts: DataFrame, repeated: DataFrame, most: int = MOST) -> DataFrame:
    """h, s, n of the classes (hash and SHA-256) that hold more than one text. texts: h, text; repeated: h, distinct."""
    few = repeated.limit(most + 1).count() <= most
    copies = texts.join(F.broadcast(repeated) if few else repeated, "h", "left_semi")
    distinct = copies.groupBy("h", "text").agg(F.count(F.lit(1)).alias("c")).select("h", _sha(F.col("text")).alias("s"))
    return distinct.groupBy("h", "s").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def _told_apart(texts: DataFrame, repeated: DataFrame, most: int) -> None:
    if not compare_bytes(texts, repeated, most).isEmpty():
        raise ValueError("different texts agree in both hashes")


def marked(docs: DataFrame, key: str = "doc_id", body: str = "text", largest: bool = True, digest: Callable[[Column], Column] = content_hash, most: int = MOST) -> DataFrame:
    """One row per document: the key, keep_id (the key of the row that stays), group_size, kept, text_sha256. largest: whether the
    row with the largest key stays or the one with the smallest."""
    text = text_or_empty(F.col(body))
    texts = docs.select(digest(text).alias("h"), text.alias("text"))
    # the row number comes from the stored table, so it's the same whenever that is read
    rows = stored(docs.select(F.col(key).alias("id"), digest(text).alias("h"), _sha(text).alias("s"), F.monotonically_increasing_id().alias("n")))
    first = F.max(F.struct(F.col("id"), (-F.col("n")).alias("o"))) if largest else F.min(F.struct(F.col("id").isNull().alias("z"), F.col("id"), F.col("n").alias("o")))
    grouped = rows.groupBy("h", "s").agg(F.count(F.lit(1)).alias("group_size"), first.alias("x"))
    classes = stored(grouped.select("h", "s", "group_size", F.col("x.id").alias("keep_id"), F.abs("x.o").alias("keep_n")))
    _told_apart(texts, classes.where("group_size > 1").select("h").distinct(), most)
    hot = F.col("group_size") * HOT >= rows.count()
    large = F.broadcast(classes.where(hot))  # HOT rows at most
    some = rows.join(large, ["h", "s"])
    rest = rows.join(large.select("h", "s"), ["h", "s"], "left_anti").join(classes.where(~hot), ["h", "s"])
    return some.unionByName(rest).select(F.col("id").alias(key), "keep_id", "group_size", (F.col("n") == F.col("keep_n")).alias("kept"), F.lower(F.hex("s")).alias("text_sha256"))


def deduplicated(docs: DataFrame, key: str = "doc_id", body: str = "text", largest: bool = True, digest: Callable[[Column], Column] = content_hash, most: int = MOST) -> DataFrame:
    """docs without the rows whose text another row has that stays; all columns."""
    rows = rowed(docs)
    text, id_ = text_or_empty(F.col("row").getField(body)), F.col("row").getField(key)
    others = [F.col("row").getField(f.name).alias(f"c{i}") for i, f in enumerate(rows.schema["row"].dataType) if f.name != body]
    tie = F.xxhash64(F.to_json(F.struct(*others)))
    hashed = rows.select("row", digest(text).alias("h"), _sha(text).alias("s"), F.struct(*([] if largest else [id_.isNull().alias("z")]), id_.alias("id"), tie.alias("t")).alias("o"))
    counts = hashed.groupBy("h").agg(F.count(F.lit(1)).alias("c"))
    _told_apart(rows.select(digest(text).alias("h"), text.alias("text")), counts.where("c > 1").select("h"), most)
    out = hashed.groupBy("h", "s").agg((F.max_by if largest else F.min_by)("row", "o").alias("row"))
    return out.select(*fields(out))
