"""The chunk store: a Parquet folder of versions, created, upserted and looked up by id, document or section."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources import tables


@dataclass(frozen=True)
class Store:
    """A table of chunks under path/v=N; the highest finished N is read, so a reader never sees half an upsert."""

    spark: SparkSession
    path: str
    schema: str = tables.CHUNK_SCHEMA

    def _versions(self) -> list[int]:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        done = [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        return sorted(int(p.getName()[2:]) for p in done if p.getName().startswith("v=") and fs.exists(hadoop.Path(p, "_SUCCESS")))

    def _write(self, chunks: DataFrame, version: int) -> None:
        chunks.write.mode("overwrite").parquet(f"{self.path}/v={version}")

    def create(self, anew: bool = False) -> Store:
        """An empty table where there is none; with `anew` also where there is one."""
        versions = self._versions()
        if anew or not versions:
            self._write(self.spark.createDataFrame([], self.schema), versions[-1] + 1 if versions else 0)
        return self

    def read(self) -> DataFrame:
        versions = self._versions()
        if not versions:
            raise FileNotFoundError(self.path)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={versions[-1]}")

    def upsert(self, chunks: DataFrame, order: Column | None = None) -> Store:
        """Rows of chunks take the place of those with their chunk_id; of several with one id the last by order stays, or
        the greatest row where no order is given."""
        own = chunks.select(*self.read().columns)
        if order is None:
            own = own.groupBy("chunk_id").agg(F.max(F.struct(*own.columns)).alias("x")).select("x.*")
            merged = tables.upsert(self.read(), own, "chunk_id")
        else:
            merged = tables.upsert(self.read(), chunks, "chunk_id", order).select(*own.columns)
        self._write(merged, self._versions()[-1] + 1)
        return self

    def ids(self) -> DataFrame:
        return self.read().select("chunk_id")

    def counts(self) -> DataFrame:
        """doc_id, n: chunks of each document."""
        return per_document(self.read())


def per_document(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def by_id(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (chunk_id and any others) with the chunk's columns and missing, whether there is none."""
    found = chunks.withColumn("missing", F.lit(False))
    return wanted.join(found, "chunk_id", "left").withColumn("missing", F.coalesce("missing", F.lit(True)))


def in_sections(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """The chunks of the sections (section_path) asked for."""
    return chunks.join(sections.select("section_path").distinct(), "section_path", "left_semi")
