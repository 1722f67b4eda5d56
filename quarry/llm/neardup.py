"""MinHash near-dedup (5): a multi-index Hamming join of minhash signatures, confirmed on whole shingle sets.

1. Each text becomes the set of its word shingles as 64-bit hashes, and a signature of `slots` 16-bit minhash values.
   Texts with one set are one class, which goes on once.
2. Two sets with similarity t differ in (1 - t) * slots positions on average. The radius is that plus 4.8 standard
   deviations, so a true pair lies outside it once in about a million. The signature is split into radius // 2 + 1
   chunks: by the pigeonhole principle a pair within the radius differs in at most one position of some chunk. The
   allowed error is enumerated: a chunk of n positions gives n keys, each with one position left out. So every pair
   within the radius shares a key.
3. Classes that share a key are linked in rounds. First each member is paired with its key's smallest class only; the links
   that hold make components. Second, each class outside its key's largest component is paired with one member of that,
   another one for each key. Then only keys whose members are still in several components count, and in them only pairs from
   different components that may be linked by how many of their rarest shingles they share: the prefix of each set, its
   rarest shingles, bounds how large their intersection can be. Keys of up to `SMALL` classes are joined; larger ones are
   cut into blocks of `SIDE` classes and compared as matrices inside a task, from which only pairs come out that are within
   the radius and whose bound allows the link, each under one key. Pages of one template, alike but not linked, are
   compared there, which takes time in the square of such a key, in blocks; but next to none of their pairs come out.
   Nothing is capped: a link between different texts is either confirmed or was superfluous, because its ends were
   connected already.
4. Every pair within the radius is confirmed on the whole sets before it counts.

Components are found by joining the smaller label over links and following labels (no more than about log n rounds), with
each round's table in the shared folder.

Defined cases: null, empty and blank texts have an empty set, are linked with nothing and form components of their own;
so do rows with a null id, whose component is null and which groups() keeps; deduplicated() drops those whose set of shingles
another row has. Rows that repeat an id are documents of their own: each is linked by its own text. Of ties the smaller id
stays. Very long texts have their sets whole. An empty table gives no rows. Only doc_id and text are read; deduplicated()
hands all columns on as they are, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import rowed, stored, stored_alone, worker_cache

SLOTS = 64
SMALL = 8
SIDE = 512


def radius_of(percent: int, slots: int = SLOTS) -> int:
    q = 1 - percent / 100
    return min(slots - 1, math.ceil(slots * q + 4.8 * math.sqrt(slots * q * (1 - q))))


def chunks_of(radius: int, slots: int = SLOTS) -> list[tuple[int, int]]:
    """Start and end of each of the chunks, one of which has at most one error."""
    n = min(slots, radius // 2 + 1)
    edges = [round(i * slots / n) for i in range(n + 1)]
    return list(zip(edges, edges[1:]))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, k: int, hashes: dict | None = None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's k-word shingles; of the whole sequence if it is shorter."""
    hashes = _Hashes() if hashes is None else hashes
    # bytes.lower() changes A-Z only, and bytes.split() cuts at the space and U+0009-U+000D only
    w = np.array([hashes[x] for x in (text or "").encode("utf-8", "surrogatepass").lower().split()], dtype=np.uint64)
    if not len(w):
        return w
    k = min(k, len(w))
    h = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - k + 1 + i] + np.uint64(i + 1))
    return np.unique(h)


def _family(slots: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.RandomState(97)
    return tuple(r.randint(0, 2**32, slots, dtype=np.uint64).astype(np.uint32) | np.uint32(1) for _ in range(2))


def signature(hashes: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """16 bits of the least value of each of `slots` hash functions over a set; a function weighs the two halves of a hash."""
    a, b = _family(slots)
    least = np.full(slots, 0xFFFFFFFF, np.uint32)
    low, high = hashes.astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(hashes), 256):  # a block that stays in the processor's cache
        v = low[at : at + 256] * a[:, None]
        v += high[at : at + 256] * b[:, None]
        np.minimum(least, v.min(axis=1), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2")


def _arrow(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*values, np.zeros(0, np.uint64)]).view(np.int64)))


def _class_of(h: np.ndarray) -> int | None:
    return int.from_bytes(xxhash.xxh3_64_digest(h.tobytes()), "little", signed=True) if len(h) else None


def _signed(documents: DataFrame, k: int, slots: int) -> DataFrame:
    """doc_id, n (set size), cid (64-bit hash of the set, null for an empty one), sig (bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = worker_cache("words").setdefault("h", _Hashes())
        for batch in batches:
            n, cids, sigs = [], [], []
            for text in batch.column(1):
                h = shingle_hashes(text.as_py(), k, hashes)
                n.append(len(h))
                cids.append(_class_of(h))
                sigs.append(signature(h, slots).tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(cids, pa.int64()), pa.array(sigs, pa.binary())], ["doc_id", "n", "cid", "sig"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, n bigint, cid bigint, sig binary")


def _keyed(classes: DataFrame, radius: int, slots: int) -> DataFrame:
    """key, id, owner: every key of every class, with the number of the position it leaves out."""
    cut = chunks_of(radius, slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 2048):
                batch = whole.slice(at, 2048)
                sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(len(batch), slots).astype(np.uint64)
                for a, b in cut:
                    for left_out in range(a, b):
                        h = np.full(len(sig), (left_out + 1) * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
                        for s in range(a, b):
                            if s != left_out:
                                h = _mix(h * np.uint64(0xD6E8FEB86659FD93) + sig[:, s] + np.uint64(1))
                        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(0), pa.array(np.full(len(h), left_out, np.int32))], ["key", "id", "owner"])

    return classes.select("id", "sig").mapInArrow(run, "key bigint, id bigint, owner int")


def _near(pairs: DataFrame, classes: DataFrame, percent: int, radius: int, slots: int) -> DataFrame:
    """a, b, na, nb, far (positions that differ) of the pairs (a, b) within the radius whose sizes allow the similarity."""
    sized = lambda x: classes.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}"))
    pairs = pairs.join(sized("a"), "a").join(sized("b"), "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sa, sb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, slots) for i in (4, 5))
            far = (sa != sb).sum(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(far)], ["a", "b", "na", "nb", "far"]).filter(pa.array(far <= radius))

    return pairs.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(distances, "a bigint, b bigint, na bigint, nb bigint, far int")


def _sets(members: DataFrame, classes: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """id, x: the whole shingle set of every class that shares a key with another."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = worker_cache("words").setdefault("h", _Hashes())
        for batch in batches:
            for at in range(0, len(batch), 64):
                found = [h for t in batch.slice(at, 64).column(1) if len(h := shingle_hashes(t.as_py(), k, hashes))]
                yield pa.RecordBatch.from_arrays([pa.array([_class_of(h) for h in found], pa.int64()), _arrow(found)], ["id", "x"])

    rows = classes.join(members.select("id").distinct(), "id", "left_semi").select(F.col("doc_id").alias("d")).distinct()
    texts = documents.select(F.col("doc_id").cast("bigint").alias("d"), F.col("text").cast("string").alias("t")).join(rows, "d", "left_semi")
    return stored(texts.mapInArrow(sets, "id bigint, x array<bigint>").dropDuplicates(["id"]))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of `pairs` (a, b, na, nb) whose whole sets have the similarity asked for."""
    pairs = pairs.join(sets.select(F.col("id").alias("a"), F.col("x").alias("xa")), "a").join(sets.select(F.col("id").alias("b"), F.col("x").alias("xb")), "b")
    both = F.size(F.array_intersect("xa", "xb"))
    return stored(pairs.where(both * 100 >= (F.col("na") + F.col("nb") - both) * percent).select("a", "b"))


def components(links: DataFrame) -> DataFrame:
    """id, label (the smallest id connected with it) for the ids of links (a, b): large-star and small-star in turn, until
    every id hangs under one that hangs under none."""
    edges = stored(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while True:
        ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("over"), F.lit(0).alias("under")).unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("over"), F.lit(1).alias("under")))
        if not ends.groupBy("x").agg(F.max("over").alias("over"), F.sum("under").alias("under")).where("over + under > 1").limit(1).count():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("x"), F.col("m").alias("y"))
        up = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(up, "x").select(F.col("y").alias("x"), "m").where("x != m").unionByName(up)
        edges = stored(small.select(F.col("m").alias("a"), F.col("x").alias("b")).distinct())
    return stored(edges.select(F.col("b").alias("id"), F.col("a").alias("label")).unionByName(edges.select(F.col("a").alias("id"), F.col("a").alias("label")).distinct()))


def _split(members: DataFrame, labels: DataFrame) -> DataFrame:
    """key, id, owner, label and members (their number) of the keys whose classes are in several components."""
    rows = members.join(labels, "id", "left").select("key", "id", "owner", F.coalesce("label", "id").alias("label"))
    split = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("members")).where("lo != hi").select("key", "members")
    return stored(rows.join(split, "key"))


def _to_majority(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b): each key's classes outside its largest component, with one member of it, another one for each key."""
    rows = _split(members, labels)
    largest = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("key", "id").alias("h"), "id")).alias("c")).groupBy("key").agg(F.max(F.struct("n", "label", "c.id")).alias("m")).select("key", "m.label", F.col("m.id").alias("c"))
    others = rows.join(largest.withColumnRenamed("label", "most"), "key").where("label != most")
    return others.select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b")).distinct()


def _prefixes(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """id, n, prefix of the classes in rows that may have a link: the rarest shingles of each with their count, rarest first,
    as many as a class that lacks all of them couldn't be linked with it; of those that no other class has, the number only
    (`alone`), as they come first.

    Rarity is counted among these classes. A class all of whose prefix is its own has no link to any of them.
    """
    tokens = rows.select("id").distinct().join(sets, "id").select("id", F.explode("x").alias("t"))
    df = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    ranked = tokens.join(df, "t").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("r")).withColumn("n", F.size("r"))
    first = ranked.select("id", "n", F.slice("r", 1, (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")).alias("r"))
    shared = first.select("id", "n", F.size("r").alias("size"), F.filter("r", lambda x: x["df"] > 1).alias("prefix")).where(F.size("prefix") > 0)
    return shared.select("id", "n", (F.col("size") - F.size("prefix")).alias("alone"), F.transform("prefix", lambda x: x["df"]).alias("df"), F.transform("prefix", lambda x: x["t"]).alias("prefix"))


def may_link(left: np.ndarray, right: np.ndarray, alone: np.ndarray, size: np.ndarray, df: list[np.ndarray], prefix: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of the classes left and right may have the similarity, by their prefixes, as a matrix.

    The order (count, shingle) is the same for all. Up to where the shorter of two prefixes ends, all their common shingles are
    among those both hold; beyond it they can't share more than the smaller rest.
    """
    ends = np.cumsum([0, *map(len, prefix)])
    flat, counts = np.concatenate(prefix), np.concatenate(df)
    order = np.lexsort((flat, counts))
    new = np.append(True, (np.diff(flat[order]) != 0) | (np.diff(counts[order]) != 0))
    rank = np.empty(len(flat), np.int64)
    rank[order] = np.cumsum(new) - 1
    rows = np.repeat(np.arange(len(prefix)), np.diff(ends))
    held = np.bincount(rank) > 1  # others are in one prefix only
    column = np.where(held[rank], (np.cumsum(held) - 1)[rank], -1)
    both = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(held.sum()), 8192):  # a block of shingles at a time
        own = (column >= at) & (column < at + 8192)
        block = np.zeros((len(prefix), 8192), np.float32)
        block[rows[own], column[own] - at] = 1
        both += block[left] @ block[right].T
    last, full = rank[ends[1:] - 1], alone + np.diff(ends)

    def rest(one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """How many shingles of each of one lie beyond where its prefix or that of each of other ends."""
        upto = np.stack([alone[x] + np.searchsorted(rank[ends[x] : ends[x + 1]], last[other], "right") for x in one])
        return size[one][:, None] - np.where(last[one][:, None] <= last[other], full[one][:, None], upto)

    most = both + np.minimum(rest(left, right), rest(right, left).T)
    return most * (100 + percent) >= percent * (size[left][:, None] + size[right])


def _apart(members: DataFrame, labels: DataFrame, sets: DataFrame, classes: DataFrame, percent: int, radius: int, slots: int) -> DataFrame:
    """Pairs within the radius that share a key, are in different components and may be linked: a, b, na, nb, far."""
    prefixes = stored(_prefixes(_split(members, labels), sets, percent))
    rows = _split(members.join(prefixes.select("id"), "id", "left_semi"), labels)
    few = rows.where(F.col("members") <= SMALL).join(prefixes.select("id", "n", (F.col("n") - F.col("alone") - F.size("prefix")).alias("rest"), "prefix"), "id")
    one, two = (few.select("key", F.col("id").alias(x), F.col("label").alias(f"l{x}"), *[F.col(c).alias(c + x) for c in ("n", "rest", "prefix")]) for x in "ab")
    most = F.size(F.array_intersect("prefixa", "prefixb")) + F.greatest("resta", "restb")
    may = most * (100 + percent) >= (F.col("na") + F.col("nb")) * percent
    pairs = one.join(two, (one["key"] == two["key"]) & (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & may).select("a", "b")
    many = rows.where(F.col("members") > SMALL)
    if many.limit(1).count():
        n, cut = F.ceil(F.col("members") / SIDE).cast("int"), chunks_of(radius, slots)
        many = many.join(classes.select("id", "sig"), "id").join(prefixes, "id").withColumns({"cells": n, "cell": F.pmod(F.xxhash64("id"), n).cast("int")})
        dealt = many.withColumn("w", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).select("key", "owner", "id", "label", "sig", "n", "alone", "df", "prefix", "cell", F.least("cell", "w").alias("i"), F.greatest("cell", "w").alias("j"))

        def compare(rows: pa.Table) -> pa.Table:
            ids, label, cell, size, alone = (rows.column(c).to_numpy() for c in ("id", "label", "cell", "n", "alone"))
            sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), "<u2").reshape(len(ids), slots)
            df, prefix = ([np.asarray(x.values) for x in rows.column(c)] for c in ("df", "prefix"))
            i, j, owner = (rows.column(c)[0].as_py() for c in ("i", "j", "owner"))
            chunk = next(c for c, (a, b) in enumerate(cut) if a <= owner < b)
            starts, first = [a for a, _ in cut], owner == cut[chunk][0]
            names, n = np.unique(label, return_counts=True)
            minor = label != names[np.argmax(n)]  # of two classes from different components at least one is
            left, right = np.flatnonzero(cell == i), np.flatnonzero(cell == j)
            may = may_link(left, right, alone, size, df, prefix, percent)
            found = []
            for x, may_x in zip(left, may):
                to = right[may_x & (label[right] != label[x]) & (minor[x] | minor[right])]
                if i == j:
                    to = to[to > x]
                if not len(to):
                    continue
                unlike = sig[to] != sig[x]
                errors = np.add.reduceat(unlike, starts, axis=1, dtype=np.int16)
                # a pair comes out under the first of its keys only
                own = (np.argmax(errors <= 1, axis=1) == chunk) & np.where(errors[:, chunk] == 0, first, unlike[:, owner])
                found += [sorted((ids[x], y)) for y in ids[to[own & (errors.sum(axis=1) <= radius)]]]
            return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

        pairs = pairs.unionByName(dealt.groupBy("key", "i", "j").applyInArrow(compare, "a bigint, b bigint"))
    return _near(pairs.distinct(), classes, percent, radius, slots)


def groups(documents: DataFrame, k: int = 5, percent: int = 80, slots: int = SLOTS) -> DataFrame:
    """For every row of documents: doc_id, n_shingles, cid (of its set of shingles), component_id and kept."""
    radius = radius_of(percent, slots)
    signed = stored(_signed(documents, k, slots))
    classes = stored(signed.where("cid is not null and doc_id is not null").groupBy(F.col("cid").alias("id")).agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sig").alias("sig")))
    keys = _keyed(classes, radius, slots)
    shared = keys.groupBy("key").agg(F.min("id").alias("c"), F.max("id").alias("d")).where("c != d").select("key", "c")
    members = stored(keys.join(shared, "key"))
    star = members.where("id != c").select(F.col("c").alias("a"), F.col("id").alias("b")).distinct()
    sets = _sets(members, classes, documents, k)
    links = _confirmed(_near(star, classes, percent, radius, slots), sets, percent)
    labels = components(links)
    links = links.unionByName(_confirmed(_near(_to_majority(members, labels), classes, percent, radius, slots), sets, percent))
    labels = components(links)
    more = _confirmed(_apart(members, labels, sets, classes, percent, radius, slots), sets, percent)
    if more.limit(1).count():
        labels = components(links.unionByName(more))
    at = classes.join(labels, "id", "left").select("id", "doc_id", F.coalesce("label", "id").alias("label"))
    least = at.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    at = at.join(least, "label").select(F.col("id").alias("cid"), "component_id")
    out = signed.select("doc_id", F.col("n").alias("n_shingles"), "cid").join(at, "cid", "left")
    component = F.when(F.col("doc_id").isNull() | F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", "cid", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents kept, one of each group, with documents' columns. Of rows that repeat an id and a text one is kept."""
    spark = documents.sparkSession
    found = stored_alone(spark, lambda: groups(documents, k, percent))
    odd = stored(found.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id"))
    gone = stored(found.where("not kept").select("doc_id").unionByName(odd).distinct())
    ids = rowed(documents, doc_id=documents["doc_id"].cast("bigint"), text=documents["text"].cast("string"))
    rest = ids.where("doc_id is not null").join(gone, "doc_id", "left_anti").select("row")
    # rows without an id are told by their sets: one of those that no row with an id has
    nameless = found.where("doc_id is null and cid is not null").limit(1).count()
    without = ids.where("doc_id is null")
    if nameless:
        without = without.select("row", _cid(k)("text").alias("cid"))
        bare = without.where("cid is not null").join(found.where("doc_id is not null").select("cid").distinct(), "cid", "left_anti").groupBy("cid").agg(F.first("row").alias("row"))
        without = without.where("cid is null").select("row").unionByName(bare.select("row"))
    rest = rest.unionByName(without.select("row"))
    if odd.limit(1).count():
        # an id with several rows: its texts are told apart by their sets
        lost = found.where("not kept").join(odd, "doc_id", "left_semi").select("doc_id", "cid").distinct()
        some = ids.join(odd, "doc_id", "left_semi").select("row", "doc_id", _cid(k)("text").alias("cid"))
        some = stored(some.join(lost, ["doc_id", "cid"], "left_anti"))
        once = some.where("cid is not null").groupBy("doc_id", "cid").agg(F.first("row").alias("row"))
        rest = rest.unionByName(once.select("row")).unionByName(some.where("cid is null").select("row"))
    return rest.select("row.*")


def _cid(k: int):
    @F.arrow_udf("bigint")
    def cid(texts: pa.Array) -> pa.Array:
        return pa.array([_class_of(shingle_hashes(t.as_py(), k)) for t in texts], pa.int64())

    return cid
