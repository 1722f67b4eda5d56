"""Packing (2): lexical retrieval packing into fixed windows.

A document's token ids fill whole windows of its own as far as they go; what remains of it (less than a window) is packed
with the remains of other documents. The documents are dealt by lexical closeness into shards of about `shard` documents:
each has a sketch of its BM25 weights, and a tree of median cuts, fitted on at most `SAMPLE` sketches, tells the shard; a
leaf that holds over one and a half shards by its share of the sample is cut by a hash of id and text, and of a number where more
than `ALIKE` rows are alike in both. A seed sees the documents of its own shard only: comparing it with all
others would take time in the square of the corpus. Each shard builds a BM25 inverted index of its documents' words; the seed of a window is the first document with tokens left, and the
index returns its unused neighbours, best first, which fill the window greedily. A neighbour that doesn't fit is cut, and
its rest starts the next window. What is left at a shard's end is cut into sequences of powers of two, so nothing is padded.

Term statistics are those of the whole corpus: document frequencies are counted over all documents by hashed term, in a
table of `TERMS` counters, which is also the bound of what is broadcast (4 bytes each). A shard holds, per document, less
than a window of token ids, a checksum per whole window and the counts of its distinct words: it grows with `shard`, not
with the corpus.

Defined cases: null text is empty and has the end id only; repeated rows are separate documents; ties between neighbours
go to the smaller doc_id, then the smaller text hash; a null id comes last; a very long text is tokenized whole and fills
windows of its own; an empty table gives no rows; columns but doc_id and text aren't read, whatever their names.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import numbered, stored, worker_cache

WINDOW = 1024
SHARD = 2048
#: Length of a sketch, sketches the tree is fitted on, least number of them in a leaf.
SKETCH, SAMPLE, LEAF = 128, 16384, 16
TERMS = 2**20
K1, B = 1.2, 0.75
#: So many neighbours are sorted before all others.
NEAREST = 24
#: So many rows with one id and text may share a shard without a number of their own.
ALIKE = 256
#: Texts whose words aren't parted by one space or line end each, or that may hold a special token, are tokenized whole.
_WHOLE = r"[ \n][ \n]|[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n]\z|<\||\x00"
_BATCH_BYTES = 6_000_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """texts -> their ids, as the tokenizer file gives them.

    Byte-level BPE merges nothing across the gap before a space or a line end between two words, so a word with the white
    space before it has the same ids everywhere: each distinct one of a batch is encoded once. That is done from the file's
    own merge table, where its ids follow the order of its merges; other files go through the tokenizers library throughout.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            raw = json.load(f)
        self.fast = None
        kind, model = raw.get("pre_tokenizer") or {}, raw["model"]
        if kind.get("type") == "ByteLevel" and kind.get("use_regex") and not kind.get("add_prefix_space") and raw.get("normalizer") is None and model.get("type", "BPE") == "BPE" and not model.get("dropout") and not model.get("ignore_merges"):
            special = {t["content"] for t in raw["added_tokens"]}
            plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
            table = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(plain))}
            merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
            ranks = {bytes(table[c] for c in k): v for k, v in model["vocab"].items() if k not in special}
            if all(model["vocab"][x + y] == 256 + i for i, (x, y) in enumerate(merges)) and len(ranks) == 256 + len(merges):
                import tiktoken

                pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # the byte-level split, a fixed value
                self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
                self.starts = np.zeros(max(ranks.values()) + 1, bool)
                self.starts[[v for k, v in ranks.items() if k[:1] in (b" ", b"\n")]] = True

    def whole(self, text: str) -> np.ndarray:
        if self.fast is None or "<|" in text:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text).astype("<u4")

    def words(self, forms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all forms in a row, and where each form's begin (and the last one's end). Each form is one white space and
        a word without any."""
        if not len(forms):
            return np.zeros(0, "<u4"), np.zeros(1, np.int32)
        ids = self.fast.encode_to_numpy(_bytes(forms)[1].tobytes().decode()).astype("<u4")
        begin = np.flatnonzero(self.starts[ids])
        if len(begin) != len(forms):
            raise ValueError("the tokenizer's words don't begin with their white space")
        return ids, np.append(begin, len(ids)).astype(np.int32)


def _bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins in the bytes of all (and the last one ends), and those bytes."""
    words = words.cast(pa.large_binary())
    o = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    return o - o[0], np.frombuffer(words.buffers()[2] or b"", np.uint8)[o[0] : o[-1]]


def _led(words: pa.Array) -> np.ndarray:
    """Which words begin with a space or a line end."""
    o, data = _bytes(words)
    return (np.diff(o) > 0) & np.isin(np.append(data, 0)[o[:-1]], (32, 10))


def hashed_words(words: pa.Array) -> np.ndarray:
    """The term number of each word, A-Z as a-z, without a space or line end before it; -1 for empty ones."""
    if not len(words):
        return np.zeros(0, np.int32)
    o, data = _bytes(words)
    begin = o[:-1] + _led(words)
    low = np.where((data >= 65) & (data <= 90), data + np.uint8(33), data + np.uint8(1)).astype(np.uint64)
    at = np.arange(len(data)) - np.repeat(begin, np.diff(o))
    power = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
    part = low * power[at & 4095]
    part[at < 0] = 0
    sums = np.concatenate([[np.uint64(0)], np.cumsum(part, dtype=np.uint64)])
    h = sums[o[1:]] - sums[o[:-1]]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.where(o[1:] > begin, ((h >> np.uint64(32)) % np.uint64(TERMS)).astype(np.int32), np.int32(-1))


def read_texts(texts: list[str], encoder: Encoder) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """For each text: its ids, its distinct terms in order, and how often each occurs."""
    ids: list = [None] * len(texts)
    column = pa.array(texts, pa.large_string())
    odd = np.ones(len(texts), bool) if encoder.fast is None else pc.match_substring_regex(column, _WHOLE).to_numpy(zero_copy_only=False)
    whole, rest = np.flatnonzero(odd), np.flatnonzero(~odd)
    for i in whole:
        ids[i] = encoder.whole(texts[i])
    doc, term = [], []
    if len(rest):
        cut = pc.split_pattern(pc.replace_substring(pc.replace_substring(column.take(pa.array(rest)), " ", "\0 "), "\n", "\0\n"), "\0")
        coded = cut.flatten().dictionary_encode()
        index, led = coded.indices.to_numpy(), _led(coded.dictionary)
        # a text's first word has no white space before it; it is encoded by itself
        flat, ends = encoder.words(coded.dictionary.filter(pa.array(led)))
        own = [encoder.whole(f) for f in coded.dictionary.filter(pa.array(~led)).to_pylist()]
        first, size = np.zeros(len(led), np.int32), np.zeros(len(led), np.int32)
        first[led], size[led] = ends[:-1], np.diff(ends)
        size[~led] = [len(x) for x in own]
        first[~led] = len(flat) + np.cumsum(size[~led]) - size[~led]
        flat = np.concatenate([flat, *own])
        n = size[index]
        upto = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        at = np.repeat(first[index] - upto[:-1], n)
        at += np.arange(upto[-1], dtype=np.int32)
        every = flat[at]
        bounds = cut.offsets.to_numpy()
        for k, i in enumerate(rest):
            ids[i] = every[upto[bounds[k]] : upto[bounds[k + 1]]]
        doc.append(np.repeat(rest, np.diff(bounds)))
        term.append(hashed_words(coded.dictionary)[index])
    for i in whole:
        own = hashed_words(pa.array(texts[i].encode("utf-8", "surrogatepass").split(), pa.binary()))
        doc.append(np.full(len(own), i))
        term.append(own)
    doc, term = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (doc, term))
    key, count = np.unique((doc * TERMS + term)[term >= 0], return_counts=True)
    at = np.searchsorted(key, np.arange(len(texts) + 1) * TERMS)
    term = (key % TERMS).astype(np.int32)
    return ids, [term[a:b] for a, b in zip(at, at[1:])], [count[a:b] for a, b in zip(at, at[1:])]


def packed_counts(counts: np.ndarray) -> bytes:
    """Two bytes a count; four, after one byte more, where a count needs them."""
    return counts.astype("<u2").tobytes() if not len(counts) or counts.max() < 65536 else b"\1" + counts.astype("<u4").tobytes()


def counts_of(b: bytes) -> np.ndarray:
    return np.frombuffer(b, "<u2") if len(b) % 2 == 0 else np.frombuffer(b[1:], "<u4")


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """batch in parts of about _BATCH_BYTES of text, or of one row."""
    size, at = np.cumsum([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(column)]), 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + _BATCH_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


def corpus_statistics(read: DataFrame) -> tuple[int, float, np.ndarray]:
    """Number of documents, mean number of words, and document frequency of each hashed term, over all documents.

    read: terms, counts. Each task sums its own rows first; at most `TERMS` counters a task are shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(TERMS, np.int64), 0, 0
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4"), minlength=TERMS)
            n, total = n + len(batch), total + sum(int(counts_of(b).sum(dtype=np.int64)) for b in batch.column(1).to_pylist())
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *seen], pa.int32()), pa.array([n, total, *df[seen]], pa.int64())], ["t", "n"])

    rows = read.select("terms", "counts").mapInArrow(count, "t int, n bigint").groupBy("t").agg(F.sum("n").alias("n")).toArrow()  # TERMS + 2 rows at most
    t, n = rows.column("t").to_numpy(), rows.column("n").to_numpy()
    df = np.zeros(TERMS, np.int64)
    df[t[t >= 0]] = n[t >= 0]
    docs, total = int(n[t == -2].sum()), int(n[t == -1].sum())
    return docs, total / max(1, docs), df


def sketches(terms: list[np.ndarray], counts: list[np.ndarray], idf: np.ndarray, mean: float) -> np.ndarray:
    """A row of SKETCH numbers and length 1 for each document: its BM25 weights, added up under hashed places and signs."""
    n = len(terms)
    doc, term = np.repeat(np.arange(n), [len(t) for t in terms]), np.concatenate([*terms, np.zeros(0, np.int32)])
    tf = np.concatenate([*counts, np.zeros(0, np.int64)]).astype(float)
    weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * np.bincount(doc, tf, n)[doc] / max(mean, 1e-9)))
    h = term.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    place, sign = ((h >> np.uint64(40)) % np.uint64(SKETCH)).astype(np.int64), 1 - 2 * ((h >> np.uint64(20)) & np.uint64(1)).astype(float)
    x = np.bincount(doc * SKETCH + place, weight * sign, n * SKETCH).reshape(n, SKETCH)
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)


class Tree:
    """Cuts of sketches in halves (or in proportion to the leaves on either side) along their main direction."""

    def __init__(self, x: np.ndarray, leaves: int):
        self.along, self.cut, self.next, self.leaves = [], [], [], 0

        def grow(rows: np.ndarray, leaves: int) -> int:
            if leaves < 2:
                self.leaves += 1
                return -self.leaves
            y = x[rows] - x[rows].mean(0)
            a = y[int(np.argmax((y * y).sum(1)))]
            for _ in range(8):
                a = y.T @ (y @ a)
                a /= max(float(np.linalg.norm(a)), 1e-12)
            at = x[rows] @ a
            order = np.argsort(at, kind="stable")
            k = len(rows) * (leaves // 2) // leaves
            own = len(self.next)
            self.along.append(a)
            self.cut.append(float(at[order[k - 1]] + at[order[k]]) / 2)
            self.next.append([0, 0])
            self.next[own] = [grow(rows[order[:k]], leaves // 2), grow(rows[order[k:]], leaves - leaves // 2)]
            return own

        self.root = grow(np.arange(len(x)), leaves)
        self.along, self.cut, self.next = np.array(self.along, np.float32).reshape(-1, x.shape[1]), np.array(self.cut, np.float32), np.array(self.next, np.int64).reshape(-1, 2)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at = np.full(len(x), self.root)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            at[inner] = self.next[node, ((x[inner] * self.along[node]).sum(1) > self.cut[node]).astype(int)]
        return -1 - at


def _parts(n: int) -> list[int]:
    """n as powers of two, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class ShardIndex:
    """BM25 over the documents of one shard; documents leave it when they are used."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray], idf: np.ndarray, mean: float):
        self.terms, self.n = terms, len(terms)
        doc = np.repeat(np.arange(self.n), [len(t) for t in terms])
        term = np.concatenate([*terms, np.zeros(0, np.int32)])
        tf = np.concatenate([*counts, np.zeros(0, np.int64)]).astype(float)
        length = np.bincount(doc, tf, self.n)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / max(mean, 1e-9)))
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        own, self.at = np.unique(term, return_inverse=True)
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(self.at, minlength=len(own)))])
        self.first = np.concatenate([[0], np.cumsum([len(t) for t in terms])])

    def neighbours(self, seed: int) -> np.ndarray:
        """All documents of the shard by their score for the seed's words, best first; ties by number."""
        return np.argsort(-self.scores(seed), kind="stable")

    def unused(self, seed: int, free: np.ndarray) -> Iterator[int]:
        """The documents marked free, in the order of neighbours(): the first few are sorted, the rest only if they are asked for."""
        score = np.where(free, self.scores(seed), -1.0)
        first = np.zeros(0, np.int64)
        if self.n > 4 * NEAREST:
            first = np.flatnonzero(score > np.partition(score, -NEAREST)[-NEAREST])
            first = first[np.argsort(-score[first], kind="stable")]
            yield from first.tolist()
            score[first] = -1.0
        rest = np.flatnonzero(score >= 0)
        yield from rest[np.argsort(-score[rest], kind="stable")].tolist()

    def scores(self, seed: int) -> np.ndarray:
        rows = self.at[self.first[seed] : self.first[seed + 1]]
        starts, sizes = self.ends[rows], self.ends[rows + 1] - self.ends[rows]
        total = int(sizes.sum())
        if not total:
            return np.zeros(self.n)
        postings = np.arange(total) + np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        return np.bincount(self.doc[postings], self.weight[postings], self.n)

    def keep(self, free: np.ndarray) -> None:
        """Drops the postings of all other documents."""
        kept = free[self.doc]
        self.doc, self.weight = self.doc[kept], self.weight[kept]
        self.ends = np.concatenate([[0], np.cumsum(kept)])[self.ends]


def pack_shard(left: list[int], index: ShardIndex | None, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, offset in what was left of it, length) for documents with left[i] < window tokens."""
    used, free = [0] * len(left), np.array(left, np.int64) > 0
    live = len(left)
    sequences, seed = [], 0
    while True:
        while seed < len(left) and used[seed] == left[seed]:
            seed += 1
        if seed == len(left):
            break
        pieces, room = [], window

        def put(i: int) -> None:
            nonlocal room
            n = min(room, left[i] - used[i])
            if n:
                pieces.append((i, used[i], n))
                used[i] += n
                room -= n
                free[i] = used[i] < left[i]

        start = cut if (cut := next((i for s in sequences[-1:] for i, o, n in s[-1:] if used[i] < left[i]), None)) is not None else seed
        put(start)
        if room:
            if index and (n := int(free.sum())) * 4 < live * 3:
                live = n
                index.keep(free)
            for i in index.unused(start, free) if index else np.flatnonzero(free).tolist():
                put(i)
                if not room:
                    break
        sequences.append(pieces)
    if sequences and (n := sum(p[2] for p in sequences[-1])) < window:
        pieces, out = list(sequences.pop()), []
        for size in _parts(n):
            row, room = [], size
            while room:
                i, o, length = pieces.pop(0)
                take = min(room, length)
                row.append((i, o, take))
                room -= take
                if take < length:
                    pieces.insert(0, (i, o + take, length - take))
            out.append(row)
        sequences += out
    return sequences


def pack(documents: DataFrame, tokenizer: str | None = None, end: int = 0, window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """One row a piece: doc_id, text_hash, start, length, ids_crc32, doc_tokens, sequence_id, offset, shard."""
    path = tokenizer or default_tokenizer()
    last = np.array([end], "<u4")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home = worker_cache("encoders")
        encoder = home.get(path) or home.setdefault(path, Encoder(path))
        for whole in batches:
            for batch in _slices(whole, 1):
                n, crcs, rest, found, counts = [], [], [], [], []
                for ids, t, c in zip(*read_texts([t or "" for t in batch.column(1).to_pylist()], encoder)):
                    ids = np.concatenate([ids, last])
                    full = len(ids) // window
                    n.append(len(ids))
                    crcs.append(np.array([zlib.crc32(ids[window * i : window * (i + 1)]) for i in range(full)], "<u4").tobytes())
                    tail = ids[window * full :]
                    rest.append(tail.astype("<u2").tobytes() if not len(tail) or tail.max() < 65536 else b"\1" + tail.tobytes())
                    found.append(t.astype("<i4").tobytes())
                    counts.append(packed_counts(c))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (crcs, rest, found, counts))], ["doc_id", "h", "n", "crcs", "rest", "terms", "counts"])

    h = F.xxhash64(F.col("text").cast("string"))
    read = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), h.alias("h"))
    read = stored(read.mapInArrow(tokens, "doc_id bigint, h bigint, n bigint, crcs binary, rest binary, terms binary, counts binary"))
    docs, mean, df = corpus_statistics(read)
    idf = documents.sparkSession.sparkContext.broadcast(np.log1p((docs - df + 0.5) / (df + 0.5)).astype(np.float32))  # TERMS floats

    def sketched(batch: pa.RecordBatch) -> np.ndarray:
        t, c = batch.column("terms").to_pylist(), batch.column("counts").to_pylist()
        return sketches([np.frombuffer(b, "<i4") for b in t], [counts_of(b) for b in c], idf.value, mean)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([x.tobytes() for x in sketched(batch)], pa.binary())], ["doc_id", "h", "repeat", "drawn", "x"])

    read = numbered(read, ("doc_id", "h"), ALIKE)
    drawn = F.pmod(F.xxhash64("doc_id", "h", "repeat", F.lit("sample")), F.lit(max(1, docs)))
    # about SAMPLE rows, as long as no more than ALIKE are drawn together; the limit is the bound of what the driver holds
    some = read.where(drawn < SAMPLE).select("doc_id", "h", "repeat", drawn.alias("drawn"), "terms", "counts")
    some = some.mapInArrow(sampled, "doc_id bigint, h bigint, repeat bigint, drawn bigint, x binary").orderBy("drawn", "doc_id", "h", "repeat").limit(2 * SAMPLE).select("doc_id", "h", "x").toArrow().sort_by([("doc_id", "ascending"), ("h", "ascending")])
    x = np.frombuffer(b"".join(some.column("x").to_pylist()), np.float32).reshape(-1, SKETCH)
    tree = documents.sparkSession.sparkContext.broadcast(Tree(x, max(1, min(-(-docs // shard), len(x) // LEAF))))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.value.leaf(sketched(batch)), pa.int64())], [*batch.schema.names, "leaf"])

    # how many shards a leaf is cut in, by its share of the sample
    share = np.bincount(tree.value.leaf(x), minlength=tree.value.leaves) / max(1, len(x))
    cuts = [max(1, round(docs * s / shard)) for s in share.tolist()]

    def tail_of(b: bytes) -> np.ndarray:
        return np.frombuffer(b, "<u2").astype("<u4") if len(b) % 2 == 0 else np.frombuffer(b[1:], "<u4")

    def pack_one(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("h", "ascending")])
        col = {c: rows.column(c).to_pylist() for c in rows.column_names}
        base, out, no = (col["s"][0] if len(rows) else 0) << 32, [], 0
        rest = [tail_of(b) for b in col["rest"]]
        for i, crcs in enumerate(col["crcs"]):
            for j, crc in enumerate(np.frombuffer(crcs, "<u4").tolist()):
                out.append((col["doc_id"][i], col["h"][i], j * window, window, crc, col["n"][i], base + no, 0))
                no += 1
        index = ShardIndex([np.frombuffer(b, "<i4") for b in col["terms"]], [counts_of(b) for b in col["counts"]], idf.value, mean)
        for pieces in pack_shard([len(r) for r in rest], index, window):
            offset = 0
            for i, o, n in pieces:
                out.append((col["doc_id"][i], col["h"][i], len(col["crcs"][i]) // 4 * window + o, n, zlib.crc32(rest[i][o : o + n].tobytes()), col["n"][i], base + no, offset))
                offset += n
            no += 1
        names = ("doc_id", "text_hash", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
        return pa.table({k: pa.array([x[i] for x in out], pa.int64()) for i, k in enumerate(names)})

    names = "doc_id bigint, h bigint, n bigint, crcs binary, rest binary, terms binary, counts binary"
    dealt = read.mapInArrow(leaves, f"{names}, repeat bigint, leaf bigint")
    parts = F.coalesce(F.get(F.array(*[F.lit(c) for c in cuts]), F.col("leaf").cast("int")), F.lit(1))
    dealt = dealt.withColumn("s", F.col("leaf") * 2**20 + F.pmod(F.xxhash64("doc_id", "h", "repeat", F.lit("shard")), parts)).drop("leaf", "repeat")
    return dealt.groupBy("s").applyInArrow(pack_one, "doc_id bigint, text_hash bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
