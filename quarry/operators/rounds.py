"""The gate's loop over many questions: those whose hits are too poor are asked again in other words, the others are done."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import fuse
from quarry.sources.tables import stored


@dataclass(frozen=True)
class Rounds:
    """Of each question's last round: fused and seeds, its hits (query_id, doc_id, score, rank) before and after reranking; gates
    (query_id, best, fallback); asked (query_id, round, query)."""

    fused: DataFrame
    seeds: DataFrame
    gates: DataFrame
    asked: DataFrame


def gated(
    questions: DataFrame,
    retrieve: Callable[[DataFrame], DataFrame],
    rerank: Callable[[DataFrame, DataFrame], DataFrame],
    least: float,
    rewrite: Callable[[DataFrame], DataFrame] | None = None,
    most: int = 1,
) -> Rounds:
    """questions: query_id (unique, not null), question and any more columns, which each round sees.

    A question whose best hit scores below `least`, or that has none, is open: rewrite gets it in its first wording, with `round`,
    the number of the round to come, and gives query_id, question. Where it gives no row, or a null, the first wording is asked again.
    A round retrieves for open questions only and writes only what it found for them; hits of questions that are done are never read
    again. The loop ends with no question open, or after `most` rounds; what is still open then keeps its last hits with fallback
    true. Without questions all tables are empty.
    """
    found: list[tuple[DataFrame, DataFrame, DataFrame, DataFrame]] = []
    now = questions
    for i in range(1, max(1, most) + 1):
        fused = stored(retrieve(now))
        seeds = stored(rerank(now, fused))
        gates = stored(fuse.gate(seeds, now, least))
        asked = now.select("query_id", F.lit(i).alias("round"), F.col("question").alias("query"))
        failed = gates.where("fallback").select("query_id")
        if rewrite is None or i >= most or failed.isEmpty():
            found.append((fused, seeds, gates, asked))
            break
        done = gates.where("not fallback").select("query_id")
        found.append(tuple(t.join(done, "query_id", "left_semi") for t in (fused, seeds, gates, asked)))
        again = questions.join(failed, "query_id", "left_semi")
        worded = rewrite(again.withColumn("round", F.lit(i + 1))).select("query_id", F.col("question").alias("reworded"))
        now = stored(again.join(worded, "query_id", "left").withColumn("question", F.coalesce("reworded", "question")).drop("reworded"))
    return Rounds(*(reduce(DataFrame.unionByName, tables) for tables in zip(*found)))
