"""Reciprocal-rank fusion and reranking of ranked lists (query_id, source, doc_id, rank)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.lexical import topk


def rrf(lists: dict[str, DataFrame], k: int = 60, weights: dict[str, float] | None = None, caps: dict[str, int] | None = None, top: int = 60) -> DataFrame:
    """query_id, doc_id, score, rank: the sum of weight / (k + rank) over the lists; a cap of 0 or less takes nothing."""
    parts = []
    for name, hits in lists.items():
        cap = (caps or {}).get(name)
        kept = hits if cap is None else hits.where(F.col("rank") <= max(0, cap))
        parts.append(kept.select("query_id", "doc_id", ((weights or {}).get(name, 1.0) / (F.lit(float(k)) + F.col("rank"))).alias("part")))
    # a union and one sum instead of a full outer join: one shuffle
    fused = reduce(DataFrame.unionByName, parts).groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 9).alias("score"))
    return topk(fused, top)


def lexical_scorer(pairs: DataFrame) -> DataFrame:
    """The offline scorer: share of the question's keywords that the candidate's snippet has. pairs: question, body."""
    return pairs.withColumn("score", F.round(T.overlap_ratio(T.keywords(F.col("question")), T.keywords(T.snippet(F.col("body")))), 6))


def model_scorer(make: Callable[[], object], question: str = "question", body: str = "body") -> Callable[[DataFrame], DataFrame]:
    """A scorer from a pair model, made once per task: make() gives an object with score(list of (question, text)) -> floats.
    Pairs go to it in Arrow batches; scores are rounded to six decimals."""

    def scorer(pairs: DataFrame) -> DataFrame:
        schema = pairs.select("query_id", "doc_id", F.lit(0.0).alias("score")).schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = make()
            for batch in batches:
                asked = list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([round(float(x), 6) for x in model.score(asked)] if asked else [], pa.float64())], ["query_id", "doc_id", "score"])

        return pairs.select("query_id", "doc_id", T.text(question).alias("q"), T.text(body).alias("b")).mapInArrow(run, schema)

    return scorer


def definition_first(filters: dict[str, str] | None = None) -> dict[str, str]:
    """A hook for filters that prefer definitions: hands them on as they are."""
    return filters or {}


def rerank(hits: DataFrame, questions: DataFrame, bodies: DataFrame, top: int = 12, scorer: Callable[[DataFrame], DataFrame] | None = lexical_scorer) -> DataFrame:
    """query_id, doc_id, score, rank of hits by the scorer; without one, the first `top` of hits as they are.

    questions: query_id, question; bodies: doc_id, body. Bodies are joined to the few hits, not to all scores, and to those first: hits
    that are known to be small (written, or held) are broadcast, and no text is shuffled.
    """
    if scorer is None:
        return hits.where(F.col("rank") <= top).select("query_id", "doc_id", "score", "rank")
    pairs = hits.select("query_id", "doc_id").join(bodies, "doc_id").join(questions, "query_id")
    return topk(scorer(pairs).select("query_id", "doc_id", "score"), top)


def gate(reranked: DataFrame, queries: DataFrame, least: float) -> DataFrame:
    """query_id, best, fallback: whether a query has no hit or its best score is below `least`."""
    best = reranked.groupBy("query_id").agg(F.max("score").alias("best"))
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", "best", F.coalesce(F.col("best") < least, F.lit(True)).alias("fallback"))


def numbered(hits: DataFrame) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(order))
