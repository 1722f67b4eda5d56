"""Quality classifier (10): a weak-label model and a hashed linear scorer.

Overlapping heuristic labellers vote bad, good or nothing on each document, from statistics of its whole text. How often each
combination of votes occurs is counted over all documents (at most 3 ** labellers rows). Expectation-maximisation estimates
from those counts, without any gold label, how accurate each labeller is for bad and for good documents, and gives each
combination its posterior. The posteriors label a sample of at most `FIT_ROWS` documents (those with the smallest hash of
their id), on which a linear scorer over hashed word shapes and hashed words is trained. It scores every document.

The texts are read once: votes and hashed features (a few dozen numbers a document) are kept in the shared folder.

Defined cases: null and empty texts have no features and are scored by the labellers' posterior alone, as are all documents
where the sample is empty; a null id takes no part in the sample; repeated rows get the same score; of rows with one id the
sample takes them by votes, then features; a statistic that equals a labeller's bound is beyond it; a very long text is read
whole, a row at a time; input columns that share a name with an output column give way to it, all others stay as they are;
an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import fields, stored, worker_cache

FIT_ROWS, SHAPES, SLOTS, KEEP = 4096, 2048, 4096, 0.5
SYMBOLS = "#*$%&|<>"
#: labeller: votes bad from here, votes good up to here (or the other way round where the first is smaller); None: never good
LABELLERS: dict[str, tuple[float, float | None]] = {
    "symbols per character": (0.03, None),
    "capital words": (0.35, None),
    "bars per word": (0.1, None),
    "exclamation marks per word": (0.25, None),
    "words equal to the one before": (0.2, 0.02),
    "distinct words": (0.15, 0.4),
    "lines equal to one before": (0.4, None),
    "plain words": (0.7, 0.9),
}
_PLAIN = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*[.,;:!?)]?")


def statistics(text: str, words: list[str], plain: dict) -> tuple[float, ...]:
    n, chars = max(1, len(words)), max(1, sum(map(len, words)))
    lines = [x for x in text.split("\n") if x.strip()]
    return (
        sum(map(text.count, SYMBOLS)) / chars,
        sum(map(str.isupper, words)) / n,
        text.count("|") / n,
        text.count("!") / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        len(set(words)) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        sum(plain[w] for w in words) / n,
    )


def votes(values: tuple[float, ...]) -> str:
    """One character a labeller: b (bad), g (good) or - (no vote)."""
    out = ""
    for x, (bad, good) in zip(values, LABELLERS.values()):
        up = good is None or bad > good
        out += "b" if (x >= bad if up else x <= bad) else "g" if good is not None and (x <= good if up else x >= good) else "-"
    return out


def estimate(counts: dict[str, int], rounds: int = 100) -> tuple[dict[str, float], np.ndarray, float]:
    """Posterior of bad for each combination of votes; labellers x (good, bad) x (b, g, -) probabilities; share of bad.

    A labeller's accuracy is its own for good and for bad documents: one that knows a single defect says nothing, or good,
    of most bad documents. It starts from: bad where any labeller says so.
    """
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    v = np.array([["bg-".index(c) for c in p] for p in patterns]).reshape(len(patterns), len(LABELLERS))
    post, table, share = np.where((v == 0).any(axis=1), 0.9, 0.01), np.zeros((len(LABELLERS), 2, 3)), 0.5
    for _ in range(rounds):
        share = float(np.clip((n @ post + 1) / (n.sum() + 2), 1e-3, 0.5))
        for j in range(len(LABELLERS)):
            for y, w in ((0, n * (1 - post)), (1, n * post)):
                c = np.bincount(v[:, j], w, 3) + 0.1
                table[j, y] = c / c.sum()
        odds = np.log(share / (1 - share)) + sum(np.log(table[j, 1, v[:, j]] / table[j, 0, v[:, j]]) for j in range(len(LABELLERS)))
        post = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
    return dict(zip(patterns, post.tolist())), table, share


_UPPER, _LOWER, _DIGIT = re.compile(r"[^\W\d_a-zß-öø-ÿ]+"), re.compile(r"[a-zß-öø-ÿ]+"), re.compile(r"\d+")


class _Shapes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        shape = _UPPER.sub("A", _LOWER.sub("a", _DIGIT.sub("9", word)))
        s = self[word] = xxhash.xxh3_64_intdigest(re.sub(r"(.)\1+", r"\1", shape).encode("utf-8", "surrogatepass")) % (SHAPES - 64)
        return s


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        s = self[word] = SHAPES + xxhash.xxh3_64_intdigest(word.lower().encode("utf-8", "surrogatepass")) % (SLOTS - SHAPES)
        return s


class _Plain(dict):
    def __missing__(self, word: str) -> bool:
        if len(self) > 300_000:
            self.clear()
        p = self[word] = bool(_PLAIN.fullmatch(word))
        return p


def features(words: list[str], values: tuple[float, ...], shapes: dict, own: dict) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values: shares of the hashed word shapes and of the hashed words, and between them three statistics."""
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    slots, n = np.unique([*(shapes[w] for w in words), *(own[w] for w in words)], return_counts=True)
    return np.concatenate([slots, [SHAPES - 3 - min(20, len(words).bit_length()), SHAPES - 2, SHAPES - 1]]).astype("<i4"), np.concatenate([n / len(words), [0.2, 1 - values[5], values[4]]]).astype("<f4")


def train(x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 4.0, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by gradient steps with momentum; both kinds weigh the same."""
    w, b, vw, vb = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1], np.float32), 0.0
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    weight = (y * 0.5 / share + (1 - y) * 0.5 / (1 - share)).astype(np.float32)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        g = (p - y) * weight / len(y)
        vw, vb = 0.9 * vw - rate * (x.T @ g + decay * w), 0.9 * vb - rate * float(g.sum())
        w, b = w + vw, b + vb
    return w, b


def classified(documents: DataFrame, carry: list[str] | None = None, fit_rows: int = FIT_ROWS, keep: float = KEEP) -> DataFrame:
    """The columns `carry` of documents (all if None) and votes, posterior (of bad, by the labellers), score (of good, by the
    scorer) and kept."""
    doc, text = documents["doc_id"].cast("bigint"), documents["text"].cast("string")
    rows = documents.select(F.struct(*(carry or ["*"])).alias("row"), F.xxhash64(doc).alias("h"), doc.alias("id"), text.alias("t"))
    schema = rows.select("row", "h", "id", F.col("t").alias("votes"), F.lit(b"").alias("s"), F.lit(b"").alias("v")).schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes, own, plain = (worker_cache("words").setdefault(k.__name__, k()) for k in (_Shapes, _Words, _Plain))
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch, out = whole.slice(at, 256), []
                for text in batch.column(3):
                    text = text.as_py() or ""
                    words = text.split()
                    values = statistics(text, words, plain)
                    out.append((votes(values), *(x.tobytes() for x in features(words, values, shapes, own))))
                more = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.binary(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], schema.names)

    seen = stored(rows.mapInArrow(read, schema))
    counts = {r["votes"]: r["n"] for r in seen.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}  # 3 ** labellers rows at most
    posterior = estimate(counts)[0] if counts else {}
    some = seen.where("id is not null").select("h", "id", "votes", "s", "v").orderBy("h", "id", "votes", "s", "v").limit(fit_rows).toArrow()
    x, y = np.zeros((len(some), SLOTS), np.float32), np.array([posterior[v] for v in some.column("votes").to_pylist()], np.float32)
    for i, (s, v) in enumerate(zip(some.column("s").to_pylist(), some.column("v").to_pylist())):
        x[i, np.frombuffer(s, "<i4")] = np.frombuffer(v, "<f4")
    w, b = train(x, y) if len(y) else (np.zeros(SLOTS, np.float32), 0.0)
    model = documents.sparkSession.sparkContext.broadcast((w, b, posterior))

    @F.arrow_udf("struct<posterior:double,score:double>")
    def judged(slots: pa.Array, shares: pa.Array, votes: pa.Array) -> pa.Array:
        w, b, posterior = model.value
        out = []
        for s, v, p in zip(slots.to_pylist(), shares.to_pylist(), votes.to_pylist()):
            p = posterior[p]
            z = float(w[np.frombuffer(s, "<i4")].astype(float) @ np.frombuffer(v, "<f4").astype(float)) + b if s and w.any() else math.log(max(p, 1e-9) / max(1 - p, 1e-9))
            out.append({"posterior": p, "score": 1 / (1 + math.exp(min(30.0, max(-30.0, z))))})
        return pa.array(out, pa.struct([("posterior", pa.float64()), ("score", pa.float64())]))

    out = seen.select("row", "votes", judged("s", "v", "votes").alias("j"))
    return out.select(*fields(out, ("votes", "posterior", "score", "kept")), "votes", "j.posterior", "j.score", (F.col("j.score") >= keep).alias("kept"))
