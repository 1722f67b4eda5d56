"""Each job as a named query with its DuckDB statement: run twice into one new folder, then what it wrote is read back."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from jobs import audit, ingest
from quarry.functions import text as T
from quarry.plans import catalog
from quarry.sources import tables


def job1_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk table of all documents; the second run finds nothing new."""
    at = tables.scratch(spark)
    for _ in range(2):
        ingest.run(spark, f"{sf_dir}/documents.parquet", f"{at}/out", f"{at}/checkpoint")
    return ingest.current(spark, f"{at}/out")


def job2_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of all benchmark questions; the second run overwrites them with the same."""
    at = tables.scratch(spark)
    for _ in range(2):
        audit.run(spark, *[f"{sf_dir}/{t}.parquet" for t in ("documents", "benchmark", "embeddings")], at)
    return audit.read(spark, at)


QUERIES = {f.__name__: f for f in (job1_ingest, job2_audit)}

_PLAIN = rf"""raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
spec AS (SELECT doc_id, 1 AS page_num, i AS line_no, l2 AS line FROM (SELECT doc_id, i, regexp_replace(l, '\s+$', '') AS l2 FROM raw) WHERE l2 <> '' AND NOT regexp_matches(l2, '{T.TOC}'))"""

ORACLE_SQL = {
    # the catalogue's statement for chunks, over the documents' own lines and with their sources as groups
    "job1_ingest": f"WITH {catalog._CHUNKS_FULL.replace(catalog._SPEC, _PLAIN)} SELECT c.* REPLACE (coalesce(d.source, 'UNKNOWN') AS wg) FROM full_chunks c JOIN documents d ON d.doc_id::VARCHAR = c.doc_id",
    "job2_audit": re.sub(r"cl AS \(SELECT .*?\),\n", "cl AS (SELECT doc_id, coalesce(source, 'UNKNOWN') AS clause_id, trim(left(replace(text, chr(10), chr(32)), 700)) AS snippet FROM documents),\n", catalog._AUDIT, flags=re.S)
    + " SELECT query_id, list, rank, score, doc_id, clause_id AS source, snippet, overlap FROM audited",
}
