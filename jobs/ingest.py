"""Keeps a chunk table up to date with a growing folder of documents.

    python -m jobs.ingest SOURCE OUTPUT CHECKPOINT [--config jobs/ingest.json]

SOURCE is a folder (or one file) of Parquet with a key, a text (form feeds between pages) and a group per document. Its files are read
as a stream: the checkpoint holds which were read, so a run takes only the files that have come since the last one, in batches of
`files_per_batch`, and ends when there are none left. Each batch writes

    OUTPUT/chunks/batch=N/wg=.../    the chunks of its documents, by group
    OUTPUT/documents/batch=N/        doc_id and digest of the documents it took, which is what makes the batch count

A batch that is run again after a failure replaces its own folders, so no row is written twice. A document that comes again with its
old text and group is passed over; with another one its chunks take the place of the old ones (`current`), even if it has no chunk
any more. Nothing is ever rewritten: what a batch costs depends on the batch, and on a scan of the digests.

Defined cases: a document without key is known by the digest of its text; of several in one batch with one key, the one with the
greatest text (then group) counts; a null text has no chunks; a null group is UNKNOWN; other columns aren't read.
"""

from __future__ import annotations

import argparse
import logging
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs import config
from quarry.operators import segment
from quarry.sources.tables import CHUNK_SCHEMA

log = logging.getLogger("jobs.ingest")

DOCUMENTS = "doc_id string, digest string, batch bigint"


@dataclass(frozen=True)
class Settings:
    key: str = "doc_id"
    text: str = "text"
    group: str = "source"
    version: str = "v1"
    files_per_batch: int = 64
    min_chunk_chars: int = segment.LEAST
    max_chunk_chars: int = segment.MOST
    last_toc_page: int = 30


def _taken(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(DOCUMENTS).parquet(f"{output}/documents")


def _latest(taken: DataFrame) -> DataFrame:
    """doc_id, batch, digest: what each document is known by now."""
    return taken.groupBy("doc_id").agg(F.max(F.struct("batch", "digest")).alias("x")).select("doc_id", "x.batch", "x.digest")


def current(spark: SparkSession, output: str) -> DataFrame:
    """The chunk table as it stands: the chunks of each document's last batch."""
    chunks = spark.read.schema(f"{CHUNK_SCHEMA}, batch bigint").parquet(f"{output}/chunks")
    return chunks.join(_latest(_taken(spark, output)).select("doc_id", "batch"), ["doc_id", "batch"], "left_semi").select(*[c.split()[0] for c in CHUNK_SCHEMA.split(", ")])


def _documents(rows: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, text, wg, digest, one row a document."""
    text = F.coalesce(F.col(settings.text).cast("string"), F.lit(""))
    key: Column = F.coalesce(F.col(settings.key).cast("string"), F.concat(F.lit("text-"), F.md5(text)))
    wg = F.coalesce(F.col(settings.group).cast("string"), F.lit("UNKNOWN"))
    one = rows.select(key.alias("doc_id"), F.struct(text.alias("text"), wg.alias("wg")).alias("x")).groupBy("doc_id").agg(F.max("x").alias("x"))
    return one.select("doc_id", "x.text", "x.wg", F.md5(F.concat_ws("\n", "x.wg", "x.text")).alias("digest"))


def chunked(documents: DataFrame, settings: Settings) -> DataFrame:
    """The chunk table of documents (doc_id, text, wg)."""
    pages = documents.select("doc_id", F.posexplode(F.split("text", "\f", -1)).alias("p", "text")).select("doc_id", (F.col("p") + 1).alias("page_num"), "text")
    names = documents.select("doc_id", F.lit(settings.version).alias("version"), "wg")
    return segment.corpus(pages, names, least=settings.min_chunk_chars, most=settings.max_chunk_chars, last_toc_page=settings.last_toc_page)


def _arrivals(spark: SparkSession, source: str, settings: Settings) -> DataFrame:
    """The stream of source's files. A stream reads a folder or what a pattern fits, not one file by its name, so source is given
    as a pattern that fits itself only; partition folders in it are found from its parent."""
    path = source.rstrip("/")
    rows = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", settings.files_per_batch)
    return rows.option("basePath", path.rpartition("/")[0] + "/").parquet(f"{path[:-1]}[{path[-1]}]")


def run(spark: SparkSession, source: str, output: str, checkpoint: str, settings: Settings = Settings()) -> dict[str, int]:
    """Takes what is new in source; gives how many batches ran, and the rows read and written."""
    done = {"batches": 0, "rows_read": 0, "documents": 0, "chunks": 0}

    def take(rows: DataFrame, batch: int) -> None:
        session = rows.sparkSession
        read, fresh, written = Observation(), Observation(), Observation()
        count = F.count(F.lit(1)).alias("n")
        own = _documents(rows.select(settings.key, settings.text, settings.group).observe(read, count), settings)
        if batch:  # only what earlier batches took: those of a batch that is run again may be there already
            known = _latest(_taken(session, output).where(F.col("batch") < batch)).select("doc_id", "digest")
            own = own.join(known, ["doc_id", "digest"], "left_anti")
        own = own.persist()
        try:
            chunks = chunked(own, settings).observe(written, count)
            chunks.write.mode("overwrite").partitionBy("wg").parquet(f"{output}/chunks/batch={batch}")
            own.select("doc_id", "digest").observe(fresh, count).write.mode("overwrite").parquet(f"{output}/documents/batch={batch}")
        finally:
            own.unpersist()
        numbers = {"batches": 1, "rows_read": read.get["n"], "documents": fresh.get["n"], "chunks": written.get["n"]}
        for k, v in numbers.items():
            done[k] += v
        log.info("batch %d: read %d rows of %s, wrote %d chunks of %d new or changed documents to %s", batch, numbers["rows_read"], source, numbers["chunks"], numbers["documents"], output)

    query = _arrivals(spark, source, settings).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("%s: %d batches, %d rows read, %d chunks written", source, done["batches"], done["rows_read"], done["chunks"])
    return done


def main(arguments: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="python -m jobs.ingest", description="Keeps a chunk table up to date with a growing folder of documents.")
    for name in ("source", "output", "checkpoint"):
        p.add_argument(name)
    p.add_argument("--config", help="a JSON file of settings")
    a = p.parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format="[%(asctime)s] %(name)s: %(message)s")
    spark = SparkSession.builder.appName("ingest").getOrCreate()
    try:
        run(spark, a.source, a.output, a.checkpoint, config.read(Settings, a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
