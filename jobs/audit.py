"""Audits retrieval over a set of questions: what both lists find, how the reranker orders it, and where it falls short.

    python -m jobs.audit DOCUMENTS QUESTIONS VECTORS OUTPUT [--config jobs/audit.json]

DOCUMENTS (doc_id, text, source, lang), QUESTIONS (item_id, text) and VECTORS (vec_id, embedding; those of a question and of a document
have their ids) are Parquet. The job writes

    OUTPUT/hits/list=.../       every hit of the fused and of the reranked list with its source, snippet and keyword overlap
    OUTPUT/questions/           per question: best score, whether it falls below the gate, how many hits each list gave it
    OUTPUT/sources/             per source of documents: how many hits it has, and its share of documents
    OUTPUT/summary/             one row of JSON: means and medians over all

Each part is overwritten whole, and all follow from the tables alone, so a run that failed is started again, and a second run gives the
same rows. Texts are joined to hits, a few dozen a question, not to scores.

Defined cases: a question without a vector has the lexical list alone; without any hit it falls below the gate with no best score; rows
without an id, and questions without text, take no part; a document without source counts as UNKNOWN.
"""

from __future__ import annotations

import argparse
import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import config
from quarry.functions import text as T
from quarry.operators import evaluate, fuse, lexical, vector

log = logging.getLogger("jobs.audit")


@dataclass(frozen=True)
class Settings:
    lexical_topk: int = 80
    dense_topk: int = 80
    fused_topk: int = 60
    rerank_topk: int = 12
    rrf_k: int = 60
    weight_lexical: float = 1.0
    weight_dense: float = 1.0
    least_score: float = 0.25
    filters: dict[str, str] = field(default_factory=dict)


def _fused(documents: DataFrame, questions: DataFrame, vectors: DataFrame, s: Settings) -> DataFrame:
    where = T.matches(s.filters, documents.columns) if s.filters else None
    lists = {"bm25": lexical.search(documents, questions.select("query_id", F.col("question").alias("text")), s.lexical_topk, where)}
    own = vectors.select(F.col("vec_id").alias("doc_id"), "embedding")
    if where is not None:
        own = own.join(documents.where(where).select("doc_id"), "doc_id", "left_semi")
    asked = questions.select("query_id").join(vectors.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id")
    lists["dense"] = vector.search(own, asked, s.dense_topk)
    return fuse.rrf(lists, s.rrf_k, {"bm25": s.weight_lexical, "dense": s.weight_dense}, top=s.fused_topk)


def run(spark: SparkSession, documents: str, questions: str, vectors: str, output: str, settings: Settings = Settings()) -> dict[str, int]:
    """Writes the four parts to output; gives the rows read and written."""
    s = settings
    docs = spark.read.parquet(documents).select("doc_id", "text", "source", "lang").where("doc_id is not null")
    asked = spark.read.parquet(questions).select(F.col("item_id").alias("query_id"), F.col("text").alias("question")).where("query_id is not null and question is not null")
    rows = spark.read.parquet(vectors).where("vec_id is not null and embedding is not null")
    done = {"documents": docs.count(), "questions": asked.count(), "vectors": rows.count()}
    log.info("read %d documents of %s, %d questions of %s, %d vectors of %s", done["documents"], documents, done["questions"], questions, done["vectors"], vectors)
    fused = _fused(docs, asked, rows, s).persist()  # a few dozen rows a question, for the reranking and the hits
    try:
        fused.count()  # held before the next is planned, so that its size is known: hits are broadcast, texts aren't shuffled
        reranked = fuse.rerank(fused, asked, docs.select("doc_id", F.col("text").alias("body")), s.rerank_topk).persist()
        reranked.count()
        chunks = docs.select("doc_id", F.coalesce("source", F.lit("UNKNOWN")).alias("clause_id"), "text")
        hits = evaluate.audit_rows(fused, reranked, asked, chunks).withColumnRenamed("clause_id", "source")
        hits.repartitionByRange("list", "query_id").sortWithinPartitions("list", "query_id", "rank").write.mode("overwrite").partitionBy("list").parquet(f"{output}/hits")
        reranked.unpersist()
    finally:
        fused.unpersist()
    found = read(spark, output)  # all that follows comes from what is written
    best = fuse.gate(found.where("list = 'reranked'"), asked, s.least_score)
    counts = found.groupBy("query_id").agg(*[F.sum((F.col("list") == n).cast("bigint")).alias(n) for n in ("fused", "reranked")])
    per = best.join(counts, "query_id", "left").select("query_id", "best", "fallback", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("fused", "reranked")])
    per.write.mode("overwrite").parquet(f"{output}/questions")
    share = docs.groupBy(F.coalesce("source", F.lit("UNKNOWN")).alias("source")).agg(F.count(F.lit(1)).alias("documents"))
    used = found.where("list = 'fused'").groupBy("source").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("doc_id").alias("found"))
    share.join(used, "source", "left").select("source", "documents", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("hits", "found")]).write.mode("overwrite").parquet(f"{output}/sources")
    evaluate.audit(found.withColumnRenamed("source", "clause_id"), asked).write.mode("overwrite").json(f"{output}/summary")
    done |= {"hits": found.count(), "below_gate": spark.read.parquet(f"{output}/questions").where("fallback").count()}
    log.info("wrote %d hits of %d questions, %d of them below the gate, to %s", done["hits"], done["questions"], done["below_gate"], output)
    return done


def read(spark: SparkSession, output: str) -> DataFrame:
    """The hits: query_id, list, rank, score, doc_id, source, snippet, overlap."""
    return spark.read.parquet(f"{output}/hits").select("query_id", "list", "rank", "score", "doc_id", "source", "snippet", "overlap")


def main(arguments: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="python -m jobs.audit", description="Audits retrieval over a set of questions.")
    for name in ("documents", "questions", "vectors", "output"):
        p.add_argument(name)
    p.add_argument("--config", help="a JSON file of settings")
    a = p.parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format="[%(asctime)s] %(name)s: %(message)s")
    spark = SparkSession.builder.appName("audit").getOrCreate()
    try:
        run(spark, a.documents, a.questions, a.vectors, a.output, config.read(Settings, a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
