"""Fill-in-middle transformation: a text is cut in prefix, middle and suffix, which are put in another order behind marks.

Cuts are counted in code points, texts are stored in bytes. A text is stored with its runs: maximal stretches of characters of one
class, the class being how many bytes a character takes, each with the counts of characters and bytes before it. A cut is found by
binary search for its run, and its byte is start + (cut - characters before) * width. Runs depend on the text alone: `encoded` keeps
them as a column, and a text can be cut again, with another seed say, without being decoded. Searches of a batch are one vectorised
call.

Cuts and form follow from the SHA-256 of seed and id, so they are the same on every run and need no shuffle.

Defined cases: a null text counts as empty, an empty one is plain; a null id is hashed as no digits; rows that are alike give results
that are alike; a text that contains a mark is plain, so that the marks of all others can be told; texts of any length are cut whole,
batches in parts of about 4 MB; an empty table gives an empty one; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import fields, rowed, text_or_empty

PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
RUNS = "array<struct<chars:bigint,bytes:bigint,width:int>>"
_BATCH_BYTES = 4_000_000


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes on end, and where each begins, the end last."""
    texts = texts.cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    return np.frombuffer(data if data is not None else b"", np.uint8)[at[0] : at[-1]], at - at[0]


def encode(texts: pa.Array) -> pa.ListArray:
    """The runs of each text: chars and bytes before it, width."""
    data, at = _bytes_of(texts)
    lead = np.flatnonzero((data & 0xC0) != 0x80)  # the byte that each character begins with
    b = data[lead]
    width = (1 + (b >= 0xC0).astype(np.int32) + (b >= 0xE0) + (b >= 0xF0)).astype(np.int32)
    row = np.searchsorted(lead, at)  # the character that each text begins with
    begins = np.ones(len(lead), bool)
    begins[1:] = width[1:] != width[:-1]
    begins[row[row < len(lead)]] = True
    run = np.flatnonzero(begins)
    first = np.searchsorted(run, row)
    own = np.repeat(np.arange(len(texts)), np.diff(first))
    found = pa.StructArray.from_arrays([pa.array(run - row[own], pa.int64()), pa.array(lead[run] - at[own], pa.int64()), pa.array(width[run], pa.int32())], ["chars", "bytes", "width"])
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), found)


def bytes_at(sizes: np.ndarray, runs: pa.ListArray, *cuts: np.ndarray) -> list[np.ndarray]:
    """The byte of each text, from its own start, at each of the cuts (in characters). sizes: bytes of the texts."""
    first = runs.offsets.to_numpy() - runs.offsets[0].as_py()
    flat = runs.flatten()
    if not len(flat):
        return [np.zeros(len(sizes), np.int64) for _ in cuts]
    chars, starts, width = (flat.field(i).to_numpy() for i in range(3))
    some, last = first[1:] > first[:-1], np.maximum(first[1:] - 1, 0)
    n = np.where(some, chars[last] + (sizes - starts[last]) // width[last], 0)
    base = np.concatenate([[0], np.cumsum(n)[:-1]])
    along = chars + np.repeat(base, np.diff(first))  # characters before each run in the whole batch, increasing
    out = []
    for cut in cuts:
        r = np.minimum(np.searchsorted(along, base + cut, "right") - 1, last)
        out.append(np.where(some, starts[r] + (cut - chars[r]) * width[r], 0))
    return out


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """batch in parts of about _BATCH_BYTES of text, or of one row."""
    _, at = _bytes_of(batch.column(column))
    i = 0
    while i < len(batch):
        j = max(i + 1, int(np.searchsorted(at, at[i] + _BATCH_BYTES, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def encoded(docs: DataFrame, body: str = "text", runs: str = "runs") -> DataFrame:
    """docs' columns, those named `runs` apart, and the runs of each text."""
    keep = fields(rows := rowed(docs), (runs.lower(),))
    rows = rows.select(F.struct(*keep).alias("row"), text_or_empty(F.col("row").getField(body)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _parts(whole, 1):
                yield pa.RecordBatch.from_arrays([batch.column(0), encode(batch.column(1))], ["row", "runs"])

    out = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, runs {RUNS}")
    return out.select(*fields(out), F.col("runs").alias(runs))


def _draws(key: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 from seed and key."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


OWN = ("n", "form", "prefix_chars", "middle_chars", "output")


def transformed(docs: DataFrame, key: str = "doc_id", body: str = "text", seed: int = 1, percent: int = 90, spm_percent: int = 20, runs: str | None = None) -> DataFrame:
    """docs' columns, those named as the new ones apart, and n (code points), form (plain, psm or spm), prefix_chars, middle_chars
    (null if plain), output. percent: of texts that are cut; spm_percent: of those in the order suffix, prefix, middle. runs: the
    column of `encoded`, if docs has it."""
    keep = fields(rows := rowed(docs), OWN)
    field = F.col("row").getField
    h = _draws(field(key), seed)
    text = text_or_empty(field(body))
    rows = rows.select(F.struct(*(keep or [F.lit(0)])).alias("row"), text.alias("text"), *[x.alias(f"h{i}") for i, x in enumerate(h)], *([field(runs).alias("runs")] if runs else []), F.length(text).cast("bigint").alias("n"))
    marked = (F.col("text") == "") | F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    form = F.when(marked | (F.col("h2") % 100 >= percent), "plain").when(F.col("h3") % 100 < spm_percent, "spm").otherwise("psm")
    a, b = F.col("h0") % (F.col("n") + 1), F.col("h1") % (F.col("n") + 1)
    cut = rows.select("row", "text", "n", form.alias("form"), F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), *(["runs"] if runs else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _parts(whole, 1):
                data, at = _bytes_of(batch.column(1))
                found = batch.column(6) if runs else encode(batch.column(1))
                i, j = bytes_at(np.diff(at), found, *(batch.column(c).to_numpy() for c in (4, 5)))
                data, outs = data.tobytes(), []
                for form, start, x, y, end in zip(batch.column(3).to_pylist(), at.tolist(), (at[:-1] + i).tolist(), (at[:-1] + j).tolist(), at[1:].tolist()):
                    prefix, middle, suffix = data[start:x], data[x:y], data[y:end]
                    if form == "plain":
                        outs.append(data[start:end])
                    elif form == "psm":
                        outs.append(b"<P>%b<S>%b<M>%b" % (prefix, suffix, middle))
                    else:
                        outs.append(b"<S>%b<P>%b<M>%b" % (suffix, prefix, middle))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (0, 2, 3, 4, 5)), pa.array(outs, pa.binary()).cast(pa.string())], ["row", "n", "form", "a", "b", "output"])

    kind = rows.schema["row"].dataType.simpleString()
    out = cut.mapInArrow(run, f"row {kind}, n bigint, form string, a bigint, b bigint, output string")
    whole = F.col("form") != "plain"
    return out.select(*(fields(out) if keep else []), "n", "form", F.when(whole, F.col("a")).alias("prefix_chars"), F.when(whole, F.col("b") - F.col("a")).alias("middle_chars"), "output")


def restored(output: Column, form: Column) -> Column:
    """The text that output was made of."""
    body = F.substr(output, F.lit(4))
    after = lambda s, head: F.substr(s, F.length(head) + 4)

    def text(first: str, order) -> Column:
        one = F.substring_index(body, first, 1)
        two = F.substring_index(after(body, one), MIDDLE, 1)
        return order(one, two, after(after(body, one), two))

    psm = text(SUFFIX, lambda prefix, suffix, middle: F.concat(prefix, middle, suffix))
    spm = text(PREFIX, lambda suffix, prefix, middle: F.concat(prefix, middle, suffix))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
