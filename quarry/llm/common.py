"""What the corpus operators share: the word rule, rows as structs, shared-folder tables, worker-side caches."""

from __future__ import annotations

import sys
import tempfile
import threading
import types
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Maximal runs of characters other than space and U+0009-U+000D; null gives none."""
    return F.filter(F.split(text_or_empty(text), SPACE, -1), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body).getItem(0)


def computed(value: Column) -> Column:
    """value, behind a generator: filters on it aren't moved below, where they would repeat how it is computed."""
    return F.explode(F.array(value))


def rowed(df: DataFrame, **columns: Column) -> DataFrame:
    """One struct column `row` of all of df's columns, and the columns given, expressions over df: no name of df's can clash with an operator's own."""
    return df.select(F.struct("*").alias("row"), *[c.alias(name) for name, c in columns.items()])


def fields(df: DataFrame, but: tuple[str, ...] = ()) -> list[Column]:
    """The columns in df's struct `row`, without those named in `but` in whatever case."""
    return [F.col("row").getField(f.name).alias(f.name) for f in df.schema["row"].dataType if f.name.lower() not in but]


_MADE = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none, one of our own in local mode; elsewhere that's an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder: its lineage is cut there, and any executor can read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _MADE.paths = [*getattr(_MADE, "paths", ()), path]
    return spark.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, key: tuple[str, ...], more: int) -> DataFrame:
    """rows, a stored table, with `repeat`: null, but 1 to n in each group of n > `more` rows alike in the columns `key`.

    The rows of a group are numbered by file blocks, whose counts tell where each block's numbers begin, so that no task takes
    more of one group than a block holds. Where all of a group's rows are alike, the result doesn't depend on the blocks.
    """
    if set(key) & {"repeat", "block_"}:
        raise ValueError("repeat and block_ are numbered()'s own columns")
    many = stored(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n_")).where(F.col("n_") > more).select(*[F.col(k).alias(f"{k}_") for k in key]))

    def same(names: tuple[str, ...]) -> Column:
        return reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in names])

    blocked = rows.select(*rows.columns, F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start")).alias("block_"))
    alike = blocked.join(many, same(key), "left_semi")
    sizes = alike.groupBy(*key, "block_").agg(F.count(F.lit(1)).alias("size_"))
    earlier = Window.partitionBy(*key).orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select(*[F.col(k).alias(f"{k}_") for k in (*key, "block_")], F.coalesce(F.sum("size_").over(earlier), F.lit(0)).alias("begin_"))
    own = F.row_number().over(Window.partitionBy(*key, "block_").orderBy("block_"))
    alike = alike.withColumn("own_", own).join(begins, same((*key, "block_"))).select(*rows.columns, (F.col("begin_") + F.col("own_")).cast("bigint").alias("repeat"))
    return rows.join(many, same(key), "left_anti").withColumn("repeat", F.lit(None).cast("bigint")).unionByName(alike)


def stored_alone(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """make()'s result, stored; the tables stored on the way to it are deleted."""
    before = len(getattr(_MADE, "paths", ()))
    out = stored(make())
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in _MADE.paths[before:-1]:
        at = hadoop.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _MADE.paths = [*_MADE.paths[:before], _MADE.paths[-1]]
    return out


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, across its tasks."""
    home = sys.modules.setdefault("_quarry_worker_cache", types.ModuleType("_quarry_worker_cache"))
    return home.__dict__.setdefault(name, {})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
