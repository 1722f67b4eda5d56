"""Profiles of a corpus: length statistics, top values, quality buckets, duplicates, coverage, self-retrieval."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.sources.tables import stored


def ranked(values: DataFrame, ranks: dict[str, Callable[[Column], Column]], ranges: int | None = None) -> DataFrame:
    """series, n, total, least, most and the value at each of the ranks, which are functions of n and count from 0. values: series,
    v; nulls don't count, and a series without values has no row.

    Distinct values with their counts are dealt in ranges and written; counts of ranges tell which one holds a rank, and only that
    one is sorted.
    """
    n = ranges or int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = values.where("v is not null").groupBy("series", "v").agg(F.count(F.lit(1)).alias("c"))
    seen = stored(counted.repartitionByRange(n, "series", "v").withColumn("p", F.spark_partition_id()))
    per = seen.groupBy("series", "p").agg(F.sum("c").alias("rows"), F.sum(F.col("v") * F.col("c")).alias("total"), F.min("v").alias("least"), F.max("v").alias("most"))
    along = Window.partitionBy("series").orderBy("p")  # a row for each range
    placed = per.withColumns({"before": F.sum("rows").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows"), "n": F.sum("rows").over(Window.partitionBy("series"))})
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), f(F.col("n")).cast("bigint").alias("rank")) for name, f in ranks.items()]))
    wanted = placed.select("series", "p", "before", "rows", asked.alias("w")).where((F.col("w.rank") >= F.col("before")) & (F.col("w.rank") < F.col("before") + F.col("rows")))
    wanted = wanted.select("series", "p", "w.name", (F.col("w.rank") - F.col("before")).alias("skip"))
    upto = F.sum("c").over(Window.partitionBy("series", "name").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    hits = seen.join(wanted, ["series", "p"]).withColumn("last", upto).where("last > skip")
    found = hits.groupBy("series").agg(*[F.min(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in ranks])
    return per.groupBy("series").agg(F.sum("rows").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most")).join(found, "series", "left")


LOW, HIGH = (lambda n: F.floor((n - 1) / 2)), (lambda n: F.ceil((n - 1) / 2))


def summary(df: DataFrame, value: Column) -> DataFrame:
    """One row: n, avg, med, p10, p90, minv, maxv. Percentiles are the value at rank rint((n - 1) * p) from 0."""
    r = ranked(df.select(F.lit(0).alias("series"), value.alias("v")), {"low": LOW, "high": HIGH, "p10": lambda n: F.rint((n - 1) * 0.1), "p90": lambda n: F.rint((n - 1) * 0.9)})
    zero = lambda c: F.coalesce(F.max(c), F.lit(0))
    return r.agg(
        zero("n").alias("n"), F.round(F.coalesce(F.max(F.col("total") / F.col("n")), F.lit(0.0)), 6).alias("avg"), F.coalesce(F.max((F.col("low") + F.col("high")) / 2.0), F.lit(0.0)).alias("med"),
        zero("p10").alias("p10"), zero("p90").alias("p90"), zero("least").alias("minv"), zero("most").alias("maxv"),
    )


def top_values(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(n)


def buckets(df: DataFrame, body: str = "text", least: int = 200, most: int = 4000) -> DataFrame:
    n = F.length(T.text(body))
    count = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("total"), count(n == 0).alias("empty"), count((n > 0) & (n < least)).alias("too_short"), count(n > most).alias("too_long"), F.round(100 * count((n > 0) & (n < least)) / F.greatest(F.lit(1), F.count(F.lit(1))), 6).alias("too_short_pct"))


def samples(df: DataFrame, bucket: Column, order: str, k: int = 20) -> DataFrame:
    """The first k rows of each bucket; rows whose bucket is null are in none."""
    w = Window.partitionBy("bucket").orderBy(order)
    return df.withColumn("bucket", bucket).where("bucket is not null").withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    """Ids that occur more than once, and how often after the first."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key, "n", (F.col("n") - 1).alias("extra"))


def duplicate_texts(df: DataFrame, body: str = "text", least: int = 3) -> DataFrame:
    return df.groupBy(T.text_hash(T.strip(T.text(body))).alias("hash")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def duplicate_samples(df: DataFrame, key: str, body: str = "text", least: int = 3, k: int = 10) -> DataFrame:
    """hash, key, place: the first k of each group of equal texts. A row_number up to k keeps k rows a group on the map side."""
    hashed = df.select(key, T.text_hash(T.strip(T.text(body))).alias("hash"))
    groups = hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("hash")
    place = F.row_number().over(Window.partitionBy("hash").orderBy(key))
    return hashed.withColumn("place", place).where(F.col("place") <= k).join(groups, "hash", "left_semi")


def exploded_clauses(chunks: DataFrame, least: int = 40) -> DataFrame:
    return chunks.where("clause_id != 'UNKNOWN'").groupBy("clause_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "clause_id")


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """side, key of the ids that only one side has."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").select(F.lit("left_only").alias("side"), key).unionByName(b.join(a, key, "left_anti").select(F.lit("right_only").alias("side"), key))


def coverage_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: left_rows, right_rows, missing (ids of left that right lacks) and extra (those of right that left lacks)."""
    side = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    both = side(left.where(F.col(key).isNotNull()), "l").join(side(right.where(F.col(key).isNotNull()), "r"), key, "full")
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return both.agg(n("l").alias("left_rows"), n("r").alias("right_rows"), n(F.col("r").isNull().cast("int")).alias("missing"), n(F.col("l").isNull().cast("int")).alias("extra"))


def sampled(df: DataFrame, key: str, k: int, seed: int = 7) -> DataFrame:
    """k rows, the same on every run: those whose seeded digest is least."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(k)


def self_retrieval(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: queries, hit_rate, mean_rank. hits: query_id, doc_id, rank; a query should find its own id."""
    own = hits.where(F.col("query_id") == F.col("doc_id")).groupBy("query_id").agg(F.min("rank").alias("rank"))
    found = queries.select("query_id").join(own, "query_id", "left")
    return found.agg(F.count(F.lit(1)).alias("queries"), F.round(F.coalesce(F.avg(F.col("rank").isNotNull().cast("double")), F.lit(0.0)), 6).alias("hit_rate"), F.round(F.coalesce(F.avg("rank"), F.lit(0.0)), 6).alias("mean_rank"))


def self_retrieval_with(search: Callable[[DataFrame, DataFrame], DataFrame], docs: DataFrame, queries: DataFrame) -> DataFrame:
    return self_retrieval(search(docs, queries), queries)
