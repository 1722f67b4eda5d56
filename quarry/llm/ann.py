"""Approximate nearest neighbours (7): inverted file, product-quantised residuals, asymmetric distances, exact reranking.

Coarse centroids and codebooks are fitted on a sample of at most `FIT_ROWS` vectors (those with the smallest hash of their
id, so reruns agree). Every vector is indexed under its `SPILL` nearest cells, with the codes of its residual in each. A query
probes as many of the best cells as `ASKED` of the real queries need for `RECALL` of their true neighbours among all rows, found by
one scan of the index with those queries; the rest of the index isn't read for it, and nothing else is scored. In a probed cell,
scores come from the query's table of inner products with the codebooks (asymmetric distances); the best `RERANK` of each block of
a cell, and what ties with them, are scored exactly on the original vectors, and the best of all probed blocks are returned.

The rows farthest from every centroid (one in 50, at most about `FAR`) are what the sample doesn't tell of: codes cut them short, and
an inner product takes the largest of them for many queries. They are a cell of their own, which every query probes and whose scores
are exact. The fit is made on vectors scaled by a power of two, a query's tables by another, so that no size of number overflows.

The best cells of a query are searched first (one in `FIRST` of those it probes); the k-th best score found there is the bound
for the others, from which only what reaches it comes out. A cell is dealt in blocks of at most about `VECTORS` vectors and
`QUERIES` queries, so a cell that holds a third of all rows is spread like any other. The sample, the codebooks and one count a
cell, with the neighbours of `ASKED` queries, are what reaches the driver and is broadcast: bounded by parameters, whatever the input.

Vectors without any structure are the worst case of an inverted file: the neighbours of a query are spread over many cells.
Entering each vector twice brings the share of cells that must be probed down by half for the same recall.

Defined cases: vectors that are null, empty, zero, of another length than most of the sample, or hold a null or a
non-finite component take no part, neither as queries nor as candidates, nor do rows with a null id; candidates with the
query's own id are its own row; repeated candidates all count; a repeated query id counts once, with its least vector; ties go
to the smaller id; an empty table gives no rows; long vectors only need a cell's block in memory; other columns than vec_id and
embedding aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import stored

FIT_ROWS, RECALL, RERANK, SPILL, FIRST = 16384, 0.96, 64, 2, 16
ASKED, SEEN, FAR, FAR_SHARE = 256, 65536, 16384, 0.02
VECTORS, QUERIES, MOST_CELLS = 4096, 1024, 8192


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    r = np.random.RandomState(seed)
    k = min(k, len(x))
    c = x[r.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        order, n = np.argsort(near, kind="stable"), np.bincount(near, minlength=k)
        sums = np.add.reduceat(x[order], np.minimum(np.cumsum(n) - n, len(x) - 1), axis=0)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[r.randint(0, len(x), k)])
    return c


def coarse(x: np.ndarray, k: int) -> np.ndarray:
    """About k centroids; many of them in two levels, so that fitting takes k ** 1.5 steps instead of k ** 2."""
    if k <= 512:
        return kmeans(x, k)
    top = kmeans(x, round(k**0.5))
    near = nearest(x, top)
    return np.concatenate([kmeans(x[near == i], max(1, round(k * int((near == i).sum()) / len(x)))) for i in range(len(top)) if (near == i).any()])


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[i : i + 512] @ c.T - half, axis=1) for i in range(0, len(x), 512)]) if len(x) else np.zeros(0, np.int64)


def several(x: np.ndarray, c: np.ndarray, m: int) -> np.ndarray:
    """rows x m: the m nearest centroids of each row, nearest first."""
    half, m = (c * c).sum(axis=1) / 2, min(m, len(c))
    return np.concatenate([np.argsort(half - x[i : i + 512] @ c.T, axis=1, kind="stable")[:, :m] for i in range(0, len(x), 512)]) if len(x) else np.zeros((0, m), np.int64)


@dataclass
class Index:
    centroids: np.ndarray  # cells x d
    books: np.ndarray  # parts x codes x d / parts
    probes: int
    scale: float = 1.0  # a power of two by which vectors come to numbers of about 1
    far: float = np.inf  # rows whose scaled distance from the nearest centroid, squared, is beyond this are a cell of their own

    def scaled(self) -> Index:
        return Index(self.centroids * self.scale, self.books * self.scale, self.probes, self.scale, self.far)

    def encode(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        parts, _, width = self.books.shape
        rest = (x - self.centroids[cell]).reshape(len(x), parts, width)
        return np.stack([nearest(np.ascontiguousarray(rest[:, m]), self.books[m]) for m in range(parts)], axis=1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """queries x parts x codes: inner products of a query's parts with the codebooks."""
        parts, _, width = self.books.shape
        return np.einsum("qmw,mcw->qmc", q.reshape(len(q), parts, width), self.books)

    def cells(self, q: np.ndarray) -> np.ndarray:
        """The cells a query probes: that of the far rows, which has no centroid, then others, best first."""
        best = np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")[:, : self.probes]
        return np.concatenate([np.full((len(q), 1), len(self.centroids)), best], axis=1)


def exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.add.reduce(vectors * query, axis=1)


def valid(df: DataFrame) -> DataFrame:
    """vec_id and v, the vector as doubles, of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = df.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where((F.size("v") > 0) & F.coalesce(fine, F.lit(False)) & F.exists("v", lambda x: x != 0))


def scale(x: np.ndarray) -> np.ndarray:
    """The powers of two that bring the largest number of each row to about 1."""
    return np.exp2(-np.clip(np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1], -1000, 1000).astype(float))


def matrix(rows: pa.Array, width: int) -> np.ndarray:
    return rows.flatten().to_numpy().reshape(len(rows), width)


def reduced(x: np.ndarray, by: float) -> np.ndarray:
    """x scaled, numbers far beyond those of the sample cut: their rows are far anyway."""
    with np.errstate(over="ignore"):
        return np.clip(x * by, -1e100, 1e100)


def distances(vectors: DataFrame, c: np.ndarray, by: float) -> DataFrame:
    """off: the squared distance of each row of v from its nearest centroid, both scaled."""
    shared = vectors.sparkSession.sparkContext.broadcast(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = reduced(matrix(batch.column(0), shared.value.shape[1]), by)
            yield pa.RecordBatch.from_arrays([pa.array(((x - shared.value[nearest(x, shared.value)]) ** 2).sum(axis=1))], ["off"])

    return vectors.select("v").mapInArrow(run, "off double")


def truth(vectors: DataFrame, names: np.ndarray, q: np.ndarray, k: int) -> pa.Table:
    """i, v: the vectors of the k nearest of all rows for each query, by one scan; for few queries."""
    width, shared = q.shape[1], vectors.sparkSession.sparkContext.broadcast((names, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = shared.value
        for whole in batches:
            for at in range(0, len(whole), 4096):
                batch = whole.slice(at, 4096)
                ids, x = batch.column(0).to_numpy(), matrix(batch.column(1), width)
                s = q @ x.T
                s[names[:, None] == ids] = -np.inf
                best = np.argpartition(-s, k - 1, axis=1)[:, :k] if len(ids) > k else np.repeat(np.arange(len(ids))[None], len(s), axis=0)
                i, b = np.repeat(np.arange(len(q)), best.shape[1]), best.ravel()
                fine = np.isfinite(s[i, b])
                i, b = i[fine], b[fine]
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(ids[b]), batch.column(1).take(pa.array(b)), pa.array(s[i, b])], ["i", "vec_id", "v", "score"])

    rows = vectors.mapInArrow(run, "i bigint, vec_id bigint, v array<double>, score double")
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("i", "v").toArrow()


def fit(vectors: DataFrame, k: int, fit_rows: int = FIT_ROWS, recall: float = RECALL, parts: int | None = None, queries: DataFrame | None = None) -> Index | None:
    """vectors: vec_id, v. queries: the same, whose neighbours tell how many cells are probed; those of vectors if none are given."""
    n = vectors.count()
    h = F.xxhash64("vec_id")
    some = vectors.where(F.pmod(h, F.lit(max(1, n))) < 2 * fit_rows)  # so that few rows are sorted
    sample = some.orderBy(h, "vec_id", "v").limit(fit_rows).toArrow()
    rows = sample.column("v").combine_chunks()
    if not len(rows):
        return None
    long = pc.list_value_length(rows).to_numpy()
    width = int(np.bincount(long).argmax())
    x = matrix(rows.filter(pa.array(long == width)), width)
    by = float(scale(x.reshape(1, -1))[0, 0])
    x = x * by
    c = coarse(x, int(np.clip(round(6 * n**0.5), 1, min(MOST_CELLS, max(1, len(x) // 3)))))
    rest = x - c[nearest(x, c)]
    parts = parts or next(p for p in (width // 4, width // 3, width // 2, width) if p and width % p == 0)
    w = width // parts
    books = [kmeans(np.ascontiguousarray(rest[:8192, m * w : (m + 1) * w]), 256, 5) for m in range(parts)]
    codes = max(map(len, books))
    books = np.stack([np.concatenate([b, np.repeat(b[:1], codes - len(b), axis=0)]) for b in books])
    # the quantile of distances beyond which rows are far: more rows than the fit has tell it, as that is closer to its own
    fitting = vectors.where(F.size("v") == width)
    seen = fitting.where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(max(1, n))) < SEEN)
    far = distances(seen, c, by).agg(F.percentile_approx("off", max(1 - FAR_SHARE, 1 - FAR / n), 100_000)).first()[0]
    far = np.inf if far is None else far
    # probes: how deep in their order of cells queries find their true neighbours
    few = (vectors if queries is None else queries).where(F.size("v") == width).orderBy(h, "vec_id", "v").limit(ASKED).toArrow()
    q = matrix(few.column("v").combine_chunks(), width)
    q = q * scale(q)
    found = truth(fitting, few.column("vec_id").to_numpy(), q, k)
    probes = 1
    if len(found):
        v, asked = reduced(matrix(found.column("v").combine_chunks(), width), by), found.column("i").to_numpy()
        homes = several(v, c, SPILL)
        place = np.argsort(np.argsort(-(q @ c.T), axis=1, kind="stable"), axis=1)
        at = np.where(((v - c[homes[:, 0]]) ** 2).sum(axis=1) > far, -1, np.stack([place[asked, own] for own in homes.T]).min(axis=0))
        at = np.sort(at)
        probes = max(1, int(at[min(len(at) - 1, int(np.ceil(recall * len(at))))]) + 1)
    return Index(c / by, books / by, min(len(c), probes), by, far)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, fit_rows: int = FIT_ROWS, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each query, by inner product. Both frames: vec_id, embedding."""
    spark = vectors.sparkSession
    vectors, queries = valid(vectors), valid(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    index = fit(vectors, k, fit_rows, recall, None, queries)
    if index is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    index = index.scaled()
    width, shared = index.centroids.shape[1], spark.sparkContext.broadcast(tuple(vars(index).values()))  # bounded by MOST_CELLS
    raw = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
    far, first = len(index.centroids), 2 + index.probes // FIRST

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = Index(*shared.value)
        for batch in batches:
            x = matrix(batch.column(1), width)
            z = reduced(x, ix.scale)
            homes = several(z, ix.centroids, SPILL)
            own = ((z - ix.centroids[homes[:, 0]]) ** 2).sum(axis=1) > ix.far
            for j in range(homes.shape[1]):
                cell = np.where(own, far, homes[:, j]).astype(np.int32)
                rows = pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.full(len(x), j, np.int32)), pa.array(cell), raw(ix.encode(z, homes[:, j])), raw(x)], ["vec_id", "h", "via", "cell", "codes", "x"])
                yield rows.filter(pa.array(~own)) if j else rows

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = Index(*shared.value)
        for whole in batches:
            for at in range(0, len(whole), 1024):
                batch = whole.slice(at, 1024)
                q = matrix(batch.column(1), width)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ix.cells(q * scale(q)).astype(np.int32).tolist(), pa.list_(pa.int32())), raw(q)], ["query_id", "cells", "q"])

    fits = F.size("v") == width
    coded = stored(vectors.where(fits).select("vec_id", "v", F.xxhash64("v").alias("h")).mapInArrow(encode, "vec_id bigint, h bigint, via int, cell int, codes binary, x binary"))
    asked = stored(queries.where(fits).mapInArrow(probe, "query_id bigint, cells array<int>, q binary"))
    sizes = stored(coded.groupBy("cell").agg(F.count(F.lit(1)).alias("n")))  # MOST_CELLS rows at most

    def score(vs: pa.Table, qs: pa.Table) -> pa.Table:
        ix, out = Index(*shared.value), []
        if len(vs) and len(qs):
            vs = vs.sort_by([("vec_id", "ascending"), ("h", "ascending")])
            ids, h, via = (vs.column(c).to_numpy() for c in ("vec_id", "h", "via"))
            x = np.frombuffer(b"".join(vs.column("x").to_pylist())).reshape(len(vs), width)
            codes = np.frombuffer(b"".join(vs.column("codes").to_pylist()), np.uint8).reshape(len(vs), -1)
            q, names, bound = np.frombuffer(b"".join(qs.column("q").to_pylist())).reshape(len(qs), width), qs.column("query_id").to_numpy(), qs.column("bound").to_numpy()
            cell = vs.column("cell")[0].as_py()
            most = max(RERANK, k + 1)
            for at in range(0, len(q), 64):
                some = q[at : at + 64] * scale(q[at : at + 64])
                if cell == far:
                    near = some @ x.T
                else:
                    table = ix.tables(some).astype(np.float32)
                    near = np.repeat((some @ ix.centroids[cell])[:, None].astype(np.float32), len(ids), axis=1)
                    for m in range(codes.shape[1]):
                        near += table[:, m][:, codes[:, m]]
                near[names[at : at + 64, None] == ids] = -np.inf  # a query's own row
                least = np.partition(near, -most, axis=1)[:, -most] if len(ids) > most else np.full(len(near), -np.inf)
                for i, (own, low) in enumerate(zip(near, least), at):
                    b = np.flatnonzero((own >= low) & (own > -np.inf))
                    s = exact(x[b], q[i])
                    fine = s >= bound[i]
                    b, s = b[fine], s[fine]
                    take = np.lexsort((ids[b], -s))[:k]
                    out.append((np.full(len(take), names[i]), ids[b][take], h[b][take], via[b][take], s[take]))
        cols = [np.concatenate([o[c] for o in out]) if out else np.zeros(0) for c in range(5)]
        return pa.table({n: pa.array(c.astype(t)) for n, c, t in zip(("query_id", "vec_id", "h", "via", "score"), cols, (np.int64, np.int64, np.int64, np.int32, float))})

    def scanned(probed: DataFrame) -> DataFrame:
        """query_id, vec_id, h, via, score: the best of each block of the cells asked for. probed: query_id, cell, bound, q."""
        probed = stored(probed)
        # how many blocks each cell is dealt in, for vectors and for queries: one row a cell
        counts = sizes.join(probed.groupBy("cell").agg(F.count(F.lit(1)).alias("m")), "cell").select("cell", F.ceil(F.col("n") / VECTORS).cast("int").alias("vs"), F.ceil(F.col("m") / QUERIES).cast("int").alias("qs"))
        counts = F.broadcast(stored(counts))  # MOST_CELLS rows at most
        left = coded.join(counts, "cell").select("*", F.pmod(F.xxhash64("vec_id"), F.col("vs")).cast("int").alias("vb"), F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("qb"))
        right = probed.join(counts, "cell").select("*", F.explode(F.sequence(F.lit(0), F.col("vs") - 1)).alias("vb"), F.pmod(F.xxhash64("query_id"), F.col("qs")).cast("int").alias("qb"))
        key, out = ["cell", "vb", "qb"], "query_id bigint, vec_id bigint, h bigint, via int, score double"
        return left.select(*key, "vec_id", "h", "via", "codes", "x").groupBy(*key).cogroup(right.select(*key, "query_id", "bound", "q").groupBy(*key)).applyInArrow(score, out)

    def ranked(found: DataFrame) -> DataFrame:
        """query_id, rank, vec_id, h, score: the k best; a vector found in several of its cells counts once, its copies each."""
        same = ["query_id", "vec_id", "h", "score"]
        rows = found.groupBy(*same, "via").agg(F.count(F.lit(1)).alias("n")).groupBy(*same).agg(F.max("n").alias("n"))
        rows = rows.select(*same, F.explode(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n").cast("int")))))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return rows.select("query_id", rank.alias("rank"), "vec_id", "h", "score").where(F.col("rank") <= k)

    known = stored(ranked(scanned(asked.select("query_id", F.explode(F.slice("cells", 1, first)).alias("cell"), F.lit(float("-inf")).alias("bound"), "q"))))
    bounds = known.where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
    rest = asked.where(F.size("cells") > first).join(bounds, "query_id", "left").select("query_id", F.explode(F.slice("cells", first + 1, index.probes)).alias("cell"), F.coalesce("bound", F.lit(float("-inf"))).alias("bound"), "q")
    return ranked(scanned(rest).unionByName(known.select("query_id", "vec_id", "h", F.lit(-1).alias("via"), "score"))).select("query_id", "rank", "vec_id", "score")
