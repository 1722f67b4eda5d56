"""Exact dedup and fill-in-middle against brute force: nulls, empty and long texts, ties, repeated rows, hash collisions, clashing columns."""

import hashlib
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import exactdup, infill

from .test_corpus import SCHEMA, docs, empty, invented, texts  # noqa: F401 (fixtures)


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def weak(text):
    """A hash of two bits: nearly all groups hold several texts."""
    return F.unhex(F.lpad(F.hex(F.crc32(text) % 4), 2, "0"))


# ---- 11 -------------------------------------------------------------------------------------------------------------


def brute_marked(rows, largest):
    """doc_id, keep_id, group_size, text_sha256 of each row, and how many rows of each text are kept."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = Counter()
    for t, ids in groups.items():
        real = [i for i in ids if i is not None]
        keep = (max if largest else min)(real) if real else None
        out.update((i, keep, len(ids), sha(t)) for i in ids)
    return out, len(groups)


@pytest.mark.parametrize("digest", [exactdup.content_hash, weak])
@pytest.mark.parametrize("largest", [True, False])
@pytest.mark.parametrize("most", [exactdup.MOST, 0])
def test_marked(spark, docs, digest, largest, most):  # noqa: F811
    want, n = brute_marked([(r["doc_id"], r["text"]) for r in docs.collect()], largest)
    got = exactdup.marked(docs, largest=largest, digest=digest, most=most).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in kept}) == n and all(r["doc_id"] == r["keep_id"] for r in kept)


@pytest.mark.parametrize("hot", [1000, 3])
def test_marked_shares(spark, monkeypatch, hot):
    """Classes above and below the share that is broadcast; a third of the rows are one text with a null id."""
    monkeypatch.setattr(exactdup, "HOT", hot)
    rows = [(None, "same")] * 300 + [(i, f"text {i % 400}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    want, n = brute_marked(rows, True)
    got = exactdup.marked(df).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want and sum(r["kept"] for r in got) == n


@pytest.mark.parametrize("digest", [exactdup.content_hash, weak])
@pytest.mark.parametrize("largest", [True, False])
def test_deduplicated(spark, docs, digest, largest):  # noqa: F811
    rows = docs.collect()
    wide = docs.withColumns({c: F.lit(f"own {c}") for c in ("row", "h", "s", "n", "o", "t", "kept", "keep_id", "x", "C0")})
    got = exactdup.deduplicated(wide, largest=largest, digest=digest)
    assert got.columns == wide.columns
    found = got.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r["text"] or ""].append(r["doc_id"])
    assert len(found) == len(groups) and {r["text"] or "" for r in found} == set(groups)
    for r in found:
        real = [i for i in groups[r["text"] or ""] if i is not None]
        assert r["doc_id"] == ((max if largest else min)(real) if real else None) and r["h"] == "own h" and r["C0"] == "own C0"
    assert sorted(map(repr, found)) == sorted(map(repr, exactdup.deduplicated(wide.repartition(7), largest=largest, digest=digest).collect()))


def test_same_hashes_stop_the_run(spark, docs, monkeypatch):  # noqa: F811
    """Two texts that agree in both hashes aren't taken for one."""
    monkeypatch.setattr(exactdup, "_sha", weak)
    for f in (exactdup.marked, exactdup.deduplicated):
        with pytest.raises(ValueError, match="both hashes"):
            f(docs, digest=weak)


def test_copies_of_empty_tables(spark, empty):  # noqa: F811
    assert exactdup.marked(empty).count() == exactdup.deduplicated(empty).count() == 0


def test_string_keys_and_long_texts(spark):
    long = "ä word " * 200_000
    df = spark.createDataFrame([("b", long), ("a", long), ("c", long + "."), ("d", None), ("e", "")], "id string, body string")
    got = {r["id"]: (r["keep_id"], r["kept"]) for r in exactdup.marked(df, "id", "body", largest=False).collect()}
    assert got == {"a": ("a", True), "b": ("a", False), "c": ("c", True), "d": ("d", True), "e": ("d", False)}


def test_copies_plan_has_no_python(spark, docs):  # noqa: F811
    for df in (exactdup.marked(docs), exactdup.deduplicated(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "InArrow", "CartesianProduct"))


# ---- 12 -------------------------------------------------------------------------------------------------------------

MIXED = ["", "plain ascii", "über", "日本語のテキスト", "a😀b😀😀c", "ß", "😀", "mixed 日本 and ünïcode 😀 end", "a<P", "<S", ">", "has <M> in it", "<P><S>"]


def brute_infill(i, text, seed=1, percent=90, spm_percent=20):
    t = text or ""
    hexes = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(hexes[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(t)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(m in t for m in infill.MARKS) or h[2] % 100 >= percent:
        return i, n, "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    if h[3] % 100 < spm_percent:
        return i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def many(spark, texts):  # noqa: F811
    r = random.Random(3)
    rows = [(i, t) for i, t in enumerate(MIXED + texts)]
    rows += [(1000 + i, "".join(r.choice("ab äß日本😀\n<>PSM") for _ in range(r.randint(0, 60)))) for i in range(400)]
    rows += [(None, None), (None, "no id"), (3, "日本語のテキスト"), (5000, "ä" * 400_000 + "x" * 400_000 + "😀" * 50_000), (5001, "aä" * 300_000)]
    return rows


@pytest.mark.parametrize("percent,spm_percent,seed", [(90, 20, 1), (100, 0, 2), (100, 100, 3), (0, 50, 4)])
def test_transformed(spark, many, percent, spm_percent, seed):
    df = spark.createDataFrame(many, "doc_id bigint, text string").repartition(3)
    for given in (df, infill.encoded(df, runs="stored")):
        out = infill.transformed(given, percent=percent, spm_percent=spm_percent, seed=seed, runs="stored" if "stored" in given.columns else None)
        got = out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", infill.restored(F.col("output"), F.col("form")).alias("again"), "text").collect()
        assert Counter(tuple(r)[:6] for r in got) == Counter(brute_infill(i, t, seed, percent, spm_percent) for i, t in many)
        assert all(r["again"] == (r["text"] or "") for r in got)
        assert {r["form"] for r in got} == {(90, 20): {"plain", "psm", "spm"}, (100, 0): {"plain", "psm"}, (100, 100): {"plain", "spm"}, (0, 50): {"plain"}}[percent, spm_percent]


def test_runs():
    """Runs are maximal, and each cut's byte is that of Python's own encoding; slices of a batch too."""
    r = random.Random(8)
    rows = MIXED + ["".join(r.choice("abcä日😀") for _ in range(r.randint(0, 30))) for _ in range(300)]
    whole = pa.array(rows)
    for texts_, array in ((rows, whole), (rows[17:90], whole.slice(17, 73)), (rows[:1], whole.slice(0, 1)), ([], whole.slice(0, 0))):
        found = infill.encode(array)
        for t, runs in zip(texts_, found.to_pylist()):
            want, width = [], None
            for k, c in enumerate(t):
                if len(c.encode()) != width:
                    width = len(c.encode())
                    want.append({"chars": k, "bytes": len(t[:k].encode()), "width": width})
            assert runs == want
        cuts = [r.randint(0, len(t)) for t in texts_]
        ends, zero = [len(t) for t in texts_], [0] * len(texts_)
        import numpy as np

        at = infill.bytes_at(np.array([len(t.encode()) for t in texts_], np.int64), found, *(np.array(c, np.int64) for c in (cuts, ends, zero)))
        for c, a in zip((cuts, ends, zero), at):
            assert a.tolist() == [len(t[:k].encode()) for t, k in zip(texts_, c)]


def test_infill_keeps_columns(spark, empty):  # noqa: F811
    own = ["row", "h0", "a", "b", "runs", "form", "output", "N", "h"]
    df = spark.createDataFrame([(i, invented(random.Random(i), 20)) for i in range(20)], "doc_id bigint, text string").select("*", *[F.lit(f"own {c}").alias(c) for c in own])
    out = infill.transformed(df)
    kept = [c for c in own if c.lower() not in infill.OWN]
    assert out.columns == ["doc_id", "text", *kept, *infill.OWN]
    assert all(r[c] == f"own {c}" for r in out.collect() for c in kept)
    assert infill.encoded(df).columns == [c for c in df.columns if c != "runs"] + ["runs"]
    assert infill.transformed(empty).count() == infill.encoded(empty).count() == 0


# ---- 8 --------------------------------------------------------------------------------------------------------------


def test_slashes_at_the_end_of_tags():
    """A slash closes no HTML element, least of all one that ends a value without quotes."""
    from quarry.llm.htmltext import extract

    body = "".join(f"<p>Sentence number {i} of the article, which is long enough to count as text.</p>" for i in range(6))
    want = extract(f"<body><article>{body}</article></body>")
    assert want.count("\n") == 5
    for odd in (
        "<script src=//cdn/x/>var a = 1;</script>", "<script src='x'/>var a = 1;</script>", "<style media=all/>p {}</style>", "<svg viewBox='0 0 1 1'/>", "<math/>", "<iframe src=/a/></iframe>",
        "<nav data-u=/a/><a href=/b/>Home</a> <a href=/c/>News</a></nav>", "<script src='never-closed'/>", "<br/>", "<hr />", "<img src=/a/b/>",
    ):
        assert extract(f"<body>{odd}<article>{body}</article></body>") == want, odd
        assert extract(f"<body><article>{body}{odd}</article></body>") == want, odd
    assert extract(f"<body><article>{body}<div class=comments data-u=/c/><p>A reader's comment that isn't part of it.</p></div></article></body>") == want
    assert extract(f"<body>{'<script a/>' * 20000}<article>{body}</article></body>") == want
