"""Mixing sources to target weights (1): balanced sampling by the cube method.

Each source's target is its share, by weight, of all words, but no more than `most` times its own; the excess goes to
the rest by weight. A source whose target is r times its size is taken floor(r) times whole, and its documents once more
with probability r - floor(r). Those probabilities are moved by the cube method: within blocks of about `block` documents
they walk through the null space of two constraints (words and documents) until at most two of a block are still
fractional, besides `RESERVE` of all sizes that are held back. Those few are blocked and walked again, level by level, until
one block of each source is left; there the last twelve land on the 0s and 1s that miss the source's words by least.

Blocks are dealt by a hash of id and text, and of a number where more than `ALIKE` rows are alike in both, so no task holds more
than a few blocks however large a source is and however often a row is repeated; each level leaves about one in 85, so 10 billion documents take five. The result depends on the rows alone, not on their partitions.
One row a source, its sizes and target, goes through a single task; nothing else does.

Defined cases: null or empty text has size 0 and takes 0; a null source is a source of its own, last in the order;
repeated rows are separate documents, also where their id is null, and may be taken a different number of times; ties are
broken by id and text hash; an empty table gives no rows; a very long text counts its words like any other and may make its
source miss its target by as much; extra columns aren't read by plan(), and mix() hands all of them on, whatever their names.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import numbered, rowed, stored, words

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
BLOCK = 1024
RESERVE = 10
#: So many rows with one id and text may share a block without a number of their own.
ALIKE = 256


def targets(sizes: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """For (source, size) rows: source, n_docs, source_size, target. One row a source goes through a single task."""
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    per = per.withColumn("i", F.row_number().over(order) - 1).withColumn("w", weight).withColumn("cap", most * F.col("source_size"))
    # The sources that reach their cap first are those with the least cap for their weight: cap such a prefix.
    fill = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("i"))
    before, everything = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    per = per.withColumns({"level": left / rest, "nth": F.row_number().over(fill)})
    level = F.min(F.when(F.col("cap") > F.col("level") * F.col("w"), F.struct("nth", "level"))).over(everything)["level"]
    target = F.least(F.col("cap"), F.coalesce(F.col("w") * level, F.col("cap")))
    return per.select("source", "n_docs", "source_size", target.alias("target"))


def walk(p: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Flight phase: moves probabilities p, in the order given, until at most two are not 0 or 1. Sums of p and p * size hold."""
    draw, p = random.Random(seed), p.astype(float).tolist()
    size = size.astype(float).tolist()
    live: list[int] = []
    for j in range(len(p)):
        if not 1e-9 < p[j] < 1 - 1e-9:
            p[j] = float(round(p[j]))
            continue
        live.append(j)
        if len(live) < 3:
            continue
        a, b, c = live
        # null space of the rows (1, 1, 1) and (size) over three units
        u = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for k, v in zip(live, u):
            if v:
                to1, to0 = (1 - p[k]) / abs(v), p[k] / abs(v)
                up, down = (min(up, to1), min(down, to0)) if v > 0 else (min(up, to0), min(down, to1))
        step = up if draw.random() < down / (up + down) else -down
        for k, v in zip(live, u):
            p[k] += step * v
            if p[k] < 1e-9 or p[k] > 1 - 1e-9:
                p[k] = float(round(p[k]))
        live = [k for k in live if 0 < p[k] < 1]
    return np.array(p)


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The few fractional units become 0 or 1 so that words, then documents, are missed by least."""
    left = np.flatnonzero((p > 0) & (p < 1))
    takes = (np.arange(2 ** len(left))[:, None] >> np.arange(len(left))) & 1
    missed = np.abs(takes @ size[left].astype(float) - (p[left] * size[left]).sum()) + 1e-6 * np.abs(takes.sum(axis=1) - p[left].sum())
    out = p.copy()
    out[left] = takes[int(np.argmin(missed))] if len(left) else 0
    return out


def _level(df: DataFrame, last: bool) -> DataFrame:
    """One walk of each (source_no, b) block; with `last` its rest lands."""

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_id", "h", "repeat"], ascending=[False, True, True, True], na_position="last", kind="stable")
        p, size = rows["p"].to_numpy(float).copy(), rows["size"].to_numpy()
        # some of all sizes stay as they are, so that the last landing has fine steps
        stay = np.unique(np.linspace(0, len(p) - 1, RESERVE).astype(int))
        go = np.setdiff1d(np.arange(len(p)), stay)
        p[go] = walk(p[go], size[go], int(rows["source_no"].iloc[0]) * 1_000_003 + int(rows["b"].iloc[0]))
        return rows.assign(p=land(p, size) if last else p)

    return df.groupBy("source_no", "b").applyInPandas(block, df.schema)


def _copies(rows: DataFrame, per: DataFrame, block: int) -> DataFrame:
    """rows (source_no, size, doc_id, h, repeat and any others) with copies, the whole number of times each is taken."""
    keep = rows.columns
    per = per.select("source_no", (F.try_divide("target", "source_size")).alias("r"))
    df = rows.join(per, "source_no").withColumn("r", F.coalesce("r", F.lit(0.0)))
    whole = F.floor(F.col("r") + 1e-9)
    df = df.withColumns({"base": whole.cast("int"), "p": F.greatest(F.lit(0.0), F.col("r") - whole)}).drop("r")
    still = (F.col("p") > 0) & (F.col("p") < 1)
    out, left = df.where("p = 0"), df.where("p > 0")
    while True:
        counts = stored(left.groupBy("source_no").agg(F.count(F.lit(1)).alias("n")))  # a row a source
        last = (counts.agg(F.max("n")).first()[0] or 0) <= block
        blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / block))
        walked = stored(_level(left.join(counts, "source_no").withColumn("b", F.pmod(F.xxhash64("h", "doc_id", "repeat", F.lit("block")), blocks).cast("int")).drop("n"), last))
        out = out.unionByName(walked.drop("b") if last else walked.where(~still).drop("b"))
        if last:
            return out.select(*keep, (F.col("base") + F.col("p").cast("int")).cast("int").alias("copies"))
        left = walked.where(still).drop("b")


def _plan(sized: DataFrame, weights, most: float, block: int) -> DataFrame:
    """The columns of sized, a stored table (source, size, doc_id, h and any others), source_size, target and copies."""
    # a row a source, stored: Spark broadcasts it while it measures small, and splits hot sources in a join of two shuffles else
    per = stored(targets(sized, weights, most).withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))))
    rows = numbered(sized, ("source", "doc_id", "h"), ALIKE)
    rows = rows.join(per.select("source_no", F.col("source").alias("s")), F.col("source").eqNullSafe(F.col("s"))).drop("s", "source")
    return _copies(rows, per, block).join(per, "source_no").select(*sized.columns, "source_size", F.col("target").cast("double").alias("target"), "copies")


def _sized(documents: DataFrame) -> dict:
    text = documents["text"]
    return {"doc_id": documents["doc_id"].cast("bigint"), "h": F.xxhash64(text.cast("string")), "source": documents["source"].cast("string"), "size": F.size(words(text)).cast("bigint")}


def plan(documents: DataFrame, weights=WEIGHTS, most: float = MOST, block: int = BLOCK) -> DataFrame:
    """doc_id, h (hash of the text), source, size, source_size, target, copies and taken for every row of documents."""
    sized = stored(documents.select(*[c.alias(n) for n, c in _sized(documents).items()]))  # the words of each text are counted once
    return _plan(sized, weights, most, block).withColumn("taken", (F.col("size") * F.col("copies")).cast("bigint"))


def mix(documents: DataFrame, weights=WEIGHTS, most: float = MOST, block: int = BLOCK) -> DataFrame:
    """The mixed documents themselves, each as many times as it is taken, with documents' columns.

    The rows are stored with a number each, so that the plan finds every one of them again: no key of that join is shared.
    """
    rows = stored(rowed(documents, no=F.monotonically_increasing_id(), **_sized(documents)))
    taken = _plan(rows.drop("row"), weights, most, block).where("copies > 0").select("no", "copies")
    return rows.select("no", "row").join(taken, "no").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
