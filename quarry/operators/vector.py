"""Exact inner-product search: a stated query set against all rows, in blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.lexical import topk

#: So many numbers (32 MB) of queries are broadcast.
MOST_NUMBERS = 4_000_000
#: So many numbers (8 MB) a block of vectors or queries holds where both sides are dealt in blocks.
BLOCK_NUMBERS = 1_000_000


def unit(v: Column) -> Column:
    """v scaled to length 1; a zero vector stays."""
    norm = lambda d: F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    # what a lambda reads from outside is computed for each of its elements: the norm is bound first
    return T.let(v.cast("array<double>"), lambda d: T.let(norm(d), lambda n: F.transform(d, lambda x: F.when(n == 0, x).otherwise(x / n))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def hashed(docs: DataFrame, dims: int = 64, body: str = "text") -> DataFrame:
    """doc_id, embedding: a deterministic stand-in for a model's embedding. Each token adds 1 or -1 in a place that its digest
    tells; the sum is scaled to length 1. A text without tokens has no row.

    Tokens don't leave their task: a batch's distinct ones are digested once and its rows of one id are summed there, so that what
    is shuffled is one short list a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                part = whole.slice(at, 256)
                tokens, docs = part.column(1), part.column(0).dictionary_encode(null_encoding="encode")
                terms = tokens.flatten().dictionary_encode()
                h = np.array([int(md5(t.encode()).hexdigest()[:7], 16) for t in terms.dictionary.to_pylist()], np.int64)
                place, sign = h % dims, 1 - 2 * (h >> 20 & 1)
                n, j = tokens.value_lengths().to_numpy(), terms.indices.to_numpy()
                row = docs.indices.to_numpy()
                sums = np.bincount(np.repeat(row, n) * dims + place[j], sign[j], len(docs.dictionary) * dims).astype(np.int64).reshape(-1, dims)
                held = np.flatnonzero(np.bincount(row, n, len(docs.dictionary)))
                x = pa.ListArray.from_arrays(np.arange(len(held) + 1, dtype=np.int32) * dims, pa.array(sums[held].ravel()))
                yield pa.RecordBatch.from_arrays([docs.dictionary.take(pa.array(held)), x], ["doc_id", "x"])

    tokens = docs.select("doc_id", T.domain_tokens(F.col(body)).alias("t"))
    sums = tokens.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<bigint>").groupBy("doc_id").agg(F.collect_list("x").alias("l"))
    whole = F.when(F.size("l") == 1, F.get("l", F.lit(0))).otherwise(F.aggregate(F.slice("l", 2, F.size("l")), F.get("l", F.lit(0)), lambda a, x: F.zip_with(a, x, lambda p, q: p + q)))
    return sums.select("doc_id", unit(whole).alias("embedding"))


def encoded(docs: DataFrame, make: Callable[[], object], body: str = "text") -> DataFrame:
    """doc_id, embedding by a model, made once per task: make() gives an object with encode(texts) -> rows of numbers; rows are
    scaled to length 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for whole in batches:
            for at in range(0, len(whole), 64):
                part = whole.slice(at, 64)
                x = np.asarray(model.encode(part.column(1).to_pylist()), float)
                x = x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) > 0, n, 1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "embedding"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), T.text(body).alias("text")).mapInArrow(run, "doc_id bigint, embedding array<double>")


def _best(names: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> list[pa.Array]:
    """Columns query_id, doc_id, score of the k best rows of x for each row of q, ties to the smaller id."""
    out: list[list[np.ndarray]] = [[], [], []]
    for at in range(0, len(q), 256):
        s = (q[at : at + 256] @ x.T).round(6) + 0.0
        best = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
        for to, values in zip(out, (np.repeat(names[at : at + 256], best.shape[1]), ids[best].ravel(), np.take_along_axis(s, best, axis=1).ravel())):
            to.append(values)
    return [pa.array(np.concatenate(o)) for o in out]


def _matrix(rows: pa.Array | pa.ChunkedArray) -> np.ndarray:
    rows = pa.concat_arrays(rows.chunks) if isinstance(rows, pa.ChunkedArray) and rows.num_chunks else rows
    if isinstance(rows, pa.Array) and len(rows) and not rows.null_count and len(widths := rows.value_lengths().unique()) == 1:
        return rows.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), widths[0].as_py())
    return np.array(rows.to_pylist(), float)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, where: Column | None = None, most_numbers: int = MOST_NUMBERS, block_numbers: int = BLOCK_NUMBERS) -> DataFrame:
    """query_id, doc_id, score (six decimals), rank. vectors: doc_id, embedding; queries: query_id, embedding.

    While the queries hold at most `most_numbers` numbers, counted beforehand, they are broadcast as one matrix and each block
    of vectors gives its k best per query. Beyond that both sides are dealt in blocks of `block_numbers` numbers, whatever may be
    broadcast, and pairs of blocks are dealt over the tasks. What is shuffled in the end is k rows per query and 4096 vectors.
    """
    if where is not None:
        vectors = vectors.where(where)
    out = "query_id bigint, doc_id bigint, score double"
    asked = queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("embedding").cast("array<double>").alias("q")).where("query_id is not null and q is not null")
    rows = vectors.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("embedding").cast("array<double>").alias("v"))
    n, width = asked.agg(F.count(F.lit(1)), F.max(F.size("q"))).first()
    if n * (width or 0) <= most_numbers:
        table = asked.toArrow()
        shared = vectors.sparkSession.sparkContext.broadcast((table.column("query_id").to_numpy(), _matrix(table.column("q"))))

        def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            for whole in batches:
                for at in range(0, len(whole) if len(names) else 0, 4096):
                    part = whole.slice(at, 4096)
                    yield pa.RecordBatch.from_arrays(_best(names, q, part.column(0).to_numpy(), _matrix(part.column(1)), k), ["query_id", "doc_id", "score"])

        return topk(rows.mapInArrow(block, out), k)
    size = max(1, block_numbers // (width or 1))
    qs, vs = -(-n // size), max(1, -(-rows.count() // size))
    left = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(vs)).alias("vb"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(qs - 1).cast("bigint"))).alias("qb"), "doc_id", "v")
    right = asked.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(vs - 1).cast("bigint"))).alias("vb"), F.pmod(F.xxhash64("query_id"), F.lit(qs)).alias("qb"), "query_id", "q")

    def pair(v: pa.Table, q: pa.Table) -> pa.Table:
        if not len(v) or not len(q):
            return pa.table({c: pa.array([], t) for c, t in (("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64()))})
        names, asked = q.column("query_id").to_numpy(), _matrix(q.column("q"))
        parts = [v.slice(at, 4096) for at in range(0, len(v), 4096)]
        return pa.concat_tables(pa.table(_best(names, asked, p.column("doc_id").to_numpy(), _matrix(p.column("v")), k), ["query_id", "doc_id", "score"]) for p in parts)

    return topk(left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInArrow(pair, out), k)
