"""Each operator against a brute-force version on small fixtures with nulls, empty and long texts, ties, repeated rows,
empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import ann, htmltext, linededup, mixing, neardup, packing, pii, rules, urls, weaklabel

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def invented(r: random.Random, n: int) -> str:
    out = []
    for i in range(n):
        out.append("".join(r.choice(["an", "the", "or", "ti", "ou", "re", "ß", "éa"]) for _ in range(r.randint(1, 4))))
        if r.random() < 0.1:
            out[-1] += ".\n" if r.random() < 0.3 else "."
    return " ".join(out)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    base = [invented(r, n) for n in (3, 12, 40, 90, 200, 400, 700, 1500, 60, 75)]
    out = [None, "", " \n\t ", "one", "One TWO", "one two three", "  lead and  double   spaces \n\n  x", base[3] + "<|endoftext|> tail"]
    out += base + base[:4] + [base[4]] * 5
    for t in base[3:8]:
        w = t.split(" ")
        for k in (1, 2, 5):
            v = list(w)
            for _ in range(k):
                v[r.randrange(len(v))] = "changed"
            out.append(" ".join(v))
    out.append("a a a a a a a a a a " * 30)
    out.append("x" * 50_000)
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", None if i % 9 == 8 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[12], rows[12], (None, texts[12], "en", "s1", 1), (None, None, None, None, None), (12, texts[13], "en", "s1", 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- 1 --------------------------------------------------------------------------------------------------------------


def test_mixing(docs, empty):
    rows = mixing.plan(docs).collect()
    assert len(rows) == docs.count()
    size = defaultdict(int)
    for r in rows:
        assert r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 3
        size[r["source"]] += r["size"]
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, cap, target, free = sum(size.values()), {s: 3 * n for s, n in size.items()}, {}, set(names)
    while True:
        left, w = total - sum(cap[s] for s in set(names) - free), sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / w > cap[s]}
        if not over:
            break
        free -= over
    target = {s: cap[s] if s not in free else left * weight[s] / w for s in names}
    taken = Counter()
    for r in rows:
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
        taken[r["source"]] += r["taken"]
    again = mixing.plan(docs.repartition(7)).collect()
    assert Counter((r["doc_id"], r["h"], r["copies"]) for r in rows) == Counter((r["doc_id"], r["h"], r["copies"]) for r in again)
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.agg(F.sum(F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")))).first()[0] == sum(taken.values())


def test_cube_walk_balances():
    r = np.random.RandomState(1)
    size = r.randint(1, 5000, 500)
    p = mixing.walk(np.full(500, 0.37), size, 3)
    assert ((p > 0) & (p < 1)).sum() <= 2 and abs(p.sum() - 185) < 1e-6 and abs((p * size).sum() - 0.37 * size.sum()) < 1e-3
    mean = np.mean([mixing.land(mixing.walk(np.full(60, 0.3), size[:60], s), size[:60]) for s in range(400)], axis=0)
    assert abs(mean.mean() - 0.3) < 0.02 and mean.min() > 0.1  # inclusion probabilities hold
    assert mixing.land(np.array([0.5, 1.0]), np.array([0, 5])).tolist() in ([0.0, 1.0], [1.0, 1.0])


def test_mixing_hits_targets(spark):
    r = random.Random(2)
    rows = [(i, " ".join(["w"] * r.randint(1, 900)), "en", f"s{i % 5}", 0) for i in range(1500)]
    got = mixing.plan(spark.createDataFrame(rows, SCHEMA), block=64).groupBy("source", "target").agg(F.sum("taken").alias("t")).collect()
    assert all(abs(g["t"] - g["target"]) <= 0.002 * g["target"] + 2 for g in got)


def test_mixing_takes_as_many_levels_as_it_needs(spark):
    """Blocks of 40 leave more than a block for three levels; the targets are still met, and repeated rows without an id count."""
    r = random.Random(3)
    rows = [(i, " ".join(["w"] * r.randint(1, 60)), "en", f"s{i % 2}", 0) for i in range(6000)] + [(None, "a b c", "en", "s0", 0)] * 200
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.plan(docs, block=40)
    assert got.count() == 6200
    assert all(abs(g["t"] - g["target"]) <= 0.002 * g["target"] + 2 for g in got.groupBy("source", "target").agg(F.sum("taken").alias("t")).collect())
    taken = got.agg(F.sum("taken")).first()[0]
    assert mixing.mix(docs, block=40).agg(F.sum(F.size(F.split("text", " ")))).first()[0] == taken


# ---- 2 --------------------------------------------------------------------------------------------------------------


def test_packing_round_trip(docs, texts, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    rows = packing.pack(docs, shard=16).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"], r["text_hash"]].append(r)
        sequences[r["sequence_id"]].append(r)
    want = Counter()
    for d, t in [(r["doc_id"], r["text"]) for r in docs.collect()]:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want[d, len(ids)] += 1
    for (d, _), found in pieces.items():
        t = next(t for t in {r["text"] for r in docs.where(F.col("doc_id").eqNullSafe(d)).collect()} if len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 == found[0]["doc_tokens"])
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        copies = want[d, len(ids)]
        assert sum(f["length"] for f in found) == copies * len(ids)
        for f in found:
            assert zlib.crc32(ids[f["start"] : f["start"] + f["length"]].tobytes()) == f["ids_crc32"]
    for found in sequences.values():
        at = 0
        for f in sorted(found, key=lambda f: f["offset"]):
            assert f["offset"] == at
            at += f["length"]
        assert at == 1024 or at < 1024 and at & (at - 1) == 0
    assert packing.pack(empty).count() == 0


def test_retrieval_orders_neighbours():
    t = [np.array(x, np.int32) for x in ([1, 2, 3], [4, 5], [1, 2, 9], [3])]
    index = packing.ShardIndex(t, [np.ones(len(x)) for x in t], np.ones(16, np.float32), 2.0)
    score = lambda i: sum(2.2 / (1 + 1.2 * (0.25 + 0.75 * len(t[i]) / 2)) for x in t[i] if x in t[0])
    assert index.neighbours(0).tolist() == sorted(range(4), key=lambda i: (-score(i), i))
    assert packing.pack_shard([600, 10, 600, 300], index)[0] == [(0, 0, 600), (2, 0, 424)]


def test_packing_deals_by_closeness(spark):
    """Documents of one topic share a shard, so that a window holds neighbours."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"topic{i % 4}word{w}" for w in rng.integers(0, 60, 80))) for i in range(256)]
    found = defaultdict(set)
    for r in packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string"), shard=64).collect():
        found[r["sequence_id"] >> 32].add(r["doc_id"])
    assert sorted(len(x) for x in found.values()) == [64] * 4
    assert all(len({i % 4 for i in x}) == 1 for x in found.values())


def test_encoder_equals_tokenizer(texts):
    from tokenizers import Tokenizer

    tokenizer, encoder = Tokenizer.from_file(packing.default_tokenizer()), packing.Encoder(packing.default_tokenizer())
    assert encoder.fast is not None
    odd = ["a  b", "a \n b", "\n a", "a\n", " a ", "é ü", "it's I'LL 12 3!?", "a\u00a0 b", "\u3000x y", "a\tb c", "\0 a", "x\n", "\nx y", "x\x1c y", "x\x85y"]
    every = [t or "" for t in texts] + odd
    for t, ids, terms, counts in zip(every, *packing.read_texts(every, encoder)):
        assert ids.tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t[:50]
        want = Counter(packing.hashed_words(pa.array(re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()), pa.binary())).tolist())
        assert dict(zip(terms.tolist(), counts.tolist())) == want


def test_rows_alike_are_dealt(spark, monkeypatch):
    """Repeats of one id and text: no block and no shard is larger for them, and the numbers don't depend on the files."""
    text = "these words are repeated in very many rows of one table " * 4
    n, few = 20_000, [(i, f"word{i} of document {i} with some more words {i % 7}") for i in range(500)]
    rows = spark.range(n).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(text).alias("text")).unionByName(spark.createDataFrame(few, "doc_id bigint, text string")).withColumn("source", F.lit("one"))
    sizes, level = [], mixing._level
    monkeypatch.setattr(mixing, "_level", lambda df, last: sizes.append(df.groupBy("source_no", "b").count().agg(F.max("count")).first()[0]) or level(df, last))
    weights = (5.0, 2.0)
    both = rows.unionByName(rows.withColumn("source", F.lit("two")))
    got = mixing.plan(both, weights).groupBy("source", "doc_id", "copies").count().collect()
    assert max(sizes) <= 2048 and sum(r["count"] for r in got) == 2 * (n + 500)
    assert sorted(map(str, got)) == sorted(map(str, mixing.plan(both.repartition(7), weights).groupBy("source", "doc_id", "copies").count().collect()))
    shards = packing.pack(rows).where("start + length = doc_tokens").withColumn("shard", F.expr("shiftright(sequence_id, 32)")).groupBy("shard").count()
    counts = [r["count"] for r in shards.collect()]
    assert sum(counts) == n + 500 and max(counts) <= 2 * packing.SHARD


def test_packing_counts_beyond_two_bytes():
    """A word that occurs 70,000 times keeps its count and its text's length."""
    text = "again " * 70_000 + "end"
    _, terms, counts = packing.read_texts([text, ""], packing.Encoder(packing.default_tokenizer()))
    assert sorted(counts[0].tolist()) == [1, 70_000]
    assert [packing.counts_of(packing.packed_counts(c)).tolist() for c in counts] == [c.tolist() for c in counts]


# ---- 3 --------------------------------------------------------------------------------------------------------------


def test_urls(spark):
    r = random.Random(3)
    list_ = [None, "", "no scheme", "http://EXAMPLE.com/en/1", "https://www.example.com/en/x?y", "ftp://a.b.net/es/", "x://net/fr/q#z", "http://com", "http://notexample.com/en/", "a://b://c.net/es/1", "http://h.org?x=/es/", "http://É.net/de/", "http://a\nb.net/es/ü"]
    list_ += [f"http://bad.org/{i}" for i in range(40)] + [f"http://good.org/{i}" for i in range(40)]
    pages = spark.createDataFrame([(i, u, "host") for i, u in enumerate(list_)], "page_id bigint, url string, host string")
    outcomes = spark.createDataFrame([(i, None if i == 20 else int("good" in (u or "") or r.random() < 0.02)) for i, u in enumerate(list_) if i > 12] + [(None, 1), (10_000, 1)], "page_id bigint, good int")
    got = {x["page_id"]: x for x in urls.judge(pages, outcomes).collect()}
    assert len(got) == len(list_)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, u in enumerate(list_):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = host.translate(lower)
        fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        x = got[i]
        assert (x["host"], x["path"]) == (host, path)
        assert x["rule"] == (max(fits)[1] if fits else None)
        if fits:
            assert x["verdict"] == max(fits)[2]
    assert {got[i]["verdict"] for i in range(13, 53)} == {"block"} and {got[i]["verdict"] for i in range(53, 93)} == {"allow"}
    none = outcomes.limit(0)
    assert {x["verdict"] for x in urls.judge(pages, none).where("rule is null").collect()} == {"allow"}
    assert urls.judge(pages.limit(0), none).count() == 0


# ---- 4 --------------------------------------------------------------------------------------------------------------


def test_line_dedup(spark, empty):
    passage = "this passage of many words is found in several documents and should stay in one of them only, since it is long enough to be a passage"
    short = "a greeting that many share"
    rows = [(3, f"own words here first\n{passage}\nlast words of three"), (1, f"{passage}\n{passage}\nanother line of document one"), (2, None), (4, ""), (5, f"A start that is its own sentence of nine words. {passage[0].upper() + passage[1:]}. And an end that is its own sentence as well.")]
    rows += [(None, f"null id has it too\n{passage}"), (6, f"{short}\n\nwith its empty line"), (7, f"{short}\n{short}\nand its own end")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("removed", F.lit("clash"))
    got = {r["doc_id"]: r for r in linededup.deduplicated(docs, passage_words=20).collect()}
    assert got[1]["text"] == f"{passage}\nanother line of document one" and [tuple(s) for s in got[1]["removed"]] == [(len(passage) + 1, 2 * len(passage) + 1)]
    assert got[3]["text"] == "own words here first\nlast words of three" and got[2]["text"] is None and got[4]["text"] == ""
    assert got[5]["text"].split() == rows[4][1].replace(passage[0].upper() + passage[1:] + ".", "").split()
    assert got[None]["text"] == "null id has it too" and got[6]["text"] == rows[6][1] and got[7]["text"] == rows[7][1]
    assert linededup.deduplicated(empty).count() == 0
    for s in got[3]["removed"]:
        assert rows[0][1][s["start"] : s["end"]] == passage
    every = {r["doc_id"]: r["text"] for r in linededup.deduplicated(docs).collect()}
    assert every[6] == rows[6][1] and every[7] == "and its own end" and every[3] == got[3]["text"]


def test_line_dedup_of_rows_alike(spark):
    """Rows that repeat an id and a text: one keeps its units, null ids too; an earlier document's text takes all of them."""
    two = "First line of both.\nSecond line of both."
    rows = [(None, two, "x")] * 3 + [(7, "A line of seven.", "y")] * 2 + [(8, "A line of seven.", "z")] * 2 + [(9, "--- ...", "q")] * 2 + [(5, None, "n")] * 2
    got = linededup.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string, row string").repartition(3)).collect()
    texts = sorted((str(r["doc_id"]), r["row"], str(r["text"]), [tuple(s) for s in r["removed"]]) for r in got)
    want = [("None", "x", two, [])] + [("None", "x", "", [(0, len(two))])] * 2 + [("7", "y", "A line of seven.", [])] + [(i, c, "", [(0, 16)]) for i, c in (("7", "y"), ("8", "z"), ("8", "z"))]
    assert texts == sorted(want + [("9", "q", "--- ...", [])] * 2 + [("5", "n", "None", [])] * 2)


def test_line_dedup_inside_lines(spark):
    """Passages inside longer lines: a whole line elsewhere, short sentences only, across lines; nothing is lost."""
    line = "This single sentence of well over twenty words is a whole line elsewhere, and stands in the middle of a longer one in another document."
    short = "Five short words stand here. Then four more come. Three words follow. And again five more words. Two remain. And so it ends."
    rows = [(1, line), (2, f"An own sentence of document two that is long enough. {line} Own words after it."), (3, f"Own words of document three before it. {short} Own end of three, in a few words more.")]
    rows += [(4, f"Document four begins in another way than three. {short.replace('. Then', '.' + chr(10) + 'Then')} Its end differs as well."), (6, "Yes we can. Yes we can. Yes we can."), (7, "One sentence of eight words or even more. ... - !")]
    got = {r["doc_id"]: r["text"] for r in linededup.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string"), passage_words=20).collect()}
    assert all(got[i] == dict(rows)[i] for i in (1, 3, 6, 7))
    assert got[2].split() == rows[1][1].replace(line, "").split()
    assert got[4].split() == "Document four begins in another way than three. Its end differs as well.".split()


@pytest.mark.parametrize("hot, least", [(1000, 20), (3, 20), (1000, 0), (3, 0)])
def test_line_dedup_against_brute_force(docs, hot, least):
    rows = sorted({(r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in docs.select("doc_id", "text").collect() if r["text"]})
    hashed = {(r["doc_id"], r["text"]): r["h"] for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda x: (x[0], x[1], hashed[None if x[0] else x[1], x[2]]))
    seen, want = set(), {}
    for null, d, t in order:
        spans, run, words = [], None, 0
        for a, b, norm in [*linededup.units(t), (0, 0, None)]:
            if norm in seen and norm is not None:
                run, words = (run[0] if run else a, b), words + len(norm.split())
            else:
                if run and words >= least:
                    spans.append(run)
                run, words = None, 0
            seen.add(norm)
        want[None if null else d, linededup.cleaned(t, spans) if spans else t] = spans
    assert any(want.values())
    old, linededup.HOT = linededup.HOT, hot
    try:
        got = linededup.deduplicated(docs.dropDuplicates(["doc_id", "text"]), passage_words=least).where("text is not null and text != ''").collect()
    finally:
        linededup.HOT = old
    for r in got:
        assert [tuple(s) for s in r["removed"]] == want.get((r["doc_id"], r["text"]), None)


# ---- 5 --------------------------------------------------------------------------------------------------------------


def brute_components(rows: list[tuple], k: int, percent: int):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(lower))
        n = min(k, len(w))
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if rows[i][0] is not None and rows[j][0] is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(s), least.get(find(i)) if d is not None else None) for i, ((d, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, empty, k, percent):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = neardup.groups(docs, k, percent).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows, k, percent)
    assert neardup.groups(empty).count() == 0
    kept = neardup.deduplicated(docs, k, percent)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None and (r["text"] or "").strip()]
    assert sorted(ids) == sorted(c for d, n, c in brute_components(rows, k, percent) if n and d is not None and d == c)


def test_many_near_copies(spark):
    """Groups larger than SMALL in which few members link with the smallest one, and blocks of several cells."""
    r = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(160):
        v = list(base)
        for _ in range(r.choice([1, 2, 4, 5])):
            v[r.randrange(len(v))] = f"x{r.randrange(10_000)}"
        rows.append((i, " ".join(v)))
    old = neardup.SIDE
    neardup.SIDE = 40
    try:
        got = neardup.groups(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 85).collect()
    finally:
        neardup.SIDE = old
    assert Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got) == brute_components(rows, 3, 85)


def test_pages_of_one_template(spark):
    """Alike, but next to none linked: the pairs that come out to be confirmed don't grow with the square of the pages."""
    r = random.Random(1)
    base, at = [f"w{i}" for i in range(300)], r.sample(range(300), 14)
    old, seen = neardup._apart, []
    neardup._apart = lambda *a: seen.append(neardup.stored(old(*a))) or seen[-1]
    try:
        for m in (200, 400, 800):
            rows = []
            for i in range(m):
                v = list(base)
                for k, p in enumerate(at):
                    v[p] = f"f{k}v{r.randrange(30)}"
                rows.append((i, " ".join(v)))
            got = neardup.groups(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), 3, 85).collect()
            assert seen[-1].count() <= m / 20
            if m == 200:
                assert Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got) == brute_components(rows, 3, 85)
    finally:
        neardup._apart = old


def test_prefixes_keep_every_link():
    """No pair that has the similarity is ruled out by the bound of its prefixes."""
    r = random.Random(7)
    for _ in range(30):
        common = [r.randrange(10**6) for _ in range(r.randint(5, 60))]
        sets = [sorted({*(x for x in common if r.random() < 0.93), *(r.randrange(10**6) for _ in range(r.randint(0, 6)))} or {1}) for _ in range(24)]
        df = Counter(x for s in sets for x in s)
        ranked = [sorted((df[x], x) for x in s) for s in sets]
        first = [x[: len(x) - -(-len(x) * 85 // 100) + 1] for x in ranked]
        own = [i for i, x in enumerate(first) if x[-1][0] > 1]
        alone = np.array([sum(d == 1 for d, _ in first[i]) for i in own])
        counts, prefix = [np.array([d for d, _ in first[i] if d > 1]) for i in own], [np.array([x for d, x in first[i] if d > 1]) for i in own]
        if len(own) < 4:
            continue
        left, right = np.arange(len(own) // 2), np.arange(len(own) // 2, len(own))
        may = neardup.may_link(left, right, alone, np.array([len(sets[i]) for i in own]), counts, prefix, 85)
        for x in left:
            for y in right:
                a, b = set(sets[own[x]]), set(sets[own[y]])
                assert may[x, y - right[0]] or 100 * len(a & b) < 85 * len(a | b)


def test_near_duplicates_without_an_id(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text), (None, text), (3, text), (None, "only here " + text[:60]), (None, "only here " + text[:60]), (None, None), (None, "")]
    kept = neardup.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter([(3, text), (None, rows[3][1]), (None, None), (None, "")])


def test_pigeonhole():
    radius = neardup.radius_of(85)
    cut = neardup.chunks_of(radius)
    assert cut[0][0] == 0 and cut[-1][1] == neardup.SLOTS and radius < 2 * len(cut)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (101, 102)], "a bigint, b bigint")
    got = {r["id"]: r["label"] for r in neardup.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


# ---- 6 --------------------------------------------------------------------------------------------------------------

PII = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(d: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_pii(t: str) -> list:
    out = []
    for k, (kind, p) in enumerate(PII.items()):
        for m in p.finditer(t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 12 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]():
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def test_personal_data(spark):
    r = random.Random(4)
    fixed = [None, "", "mail a.b+c@x-y.example.com. and _d@e.f_g@h.i", "a@b.c@d.e", "x@y", "1.2.3.4.5 256.1.1.1 001.02.3.0255 1.2.3.4", "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111111", "+1 (988) 555-2485 +49.30.1234567 +1 2 +123456789012", "iban DE89 3704 0044 0532 0130 00 and GB29NWBK60161331926819 not DE88370400440532013000", "ssn 123-45-6789 or 123-45-6788 social", "call (212) 555-0199 now; 212-555-0198 is a version", "ü" * 30 + " é@x.de ß a@b.de", "1 " * 3000, "a." * 3000 + "@", "5." * 5000, "+1" + " 2" * 4000, ("a@b.cd " * 700)]
    alphabet = ["1", "2", "9", "4", " ", "-", ".", "+", "@", "a", "B", "_", "é", "(", ")", "\n", "12", "255", "4111111111111111"]
    rows = fixed + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 120))) for _ in range(400)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(rows)], "doc_id bigint, text string, pii string")
    got = {x["doc_id"]: x["pii"] for x in pii.find(df).collect()}
    for i, t in enumerate(rows):
        assert [(s["start"], s["k"], s["end"], s["kind"]) for s in got[i] if s["k"] < 4] == brute_pii(t), (t or "")[:200]
        for s in got[i]:
            assert t[s["start"] : s["end"]] == s["match"]
    assert [s["kind"] for s in got[8]] == ["iban", "iban"] and [s["kind"] for s in got[9]] == ["ssn", "ssn"] and [s["kind"] for s in got[10] if s["kind"] == "local_phone"] == ["local_phone"]
    clean = {x["doc_id"]: x["text"] for x in pii.redact(df).collect()}
    for i, t in enumerate(rows):
        spans, want, at = got[i], "", 0
        for s in spans:
            if s["start"] >= at:
                want += t[at : s["start"]] + f"<{s['kind'].upper()}>"
            at = max(at, s["end"])
        assert clean[i] == (None if t is None else want + t[at:])
    assert pii.find(df.limit(0)).count() == 0


# ---- 7 --------------------------------------------------------------------------------------------------------------


def test_neighbours(spark):
    r = np.random.RandomState(0)
    x = r.randn(900, 16)
    x[300:600] = x[300]  # a third of all rows is one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (1004, []), (1005, [1.0, 2.0]), (None, x[0].tolist()), (1006, [float("inf")] * 16), (5, x[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(5)
    old = ann.VECTORS, ann.QUERIES
    ann.VECTORS, ann.QUERIES = 64, 8
    try:
        got = ann.search(df, df.where("vec_id % 20 = 0"), 20, fit_rows=256).collect()
    finally:
        ann.VECTORS, ann.QUERIES = old
    ids, all_ = np.array([*range(900), 5]), np.vstack([x, x[5:6]])
    by, hit, total = defaultdict(list), 0, 0
    for g in got:
        by[g["query_id"]].append(g)
    assert set(by) == set(range(0, 900, 20))
    for q, found in by.items():
        found.sort(key=lambda g: g["rank"])
        assert [g["rank"] for g in found] == list(range(1, 21))
        s = (all_ * x[q]).sum(axis=1)
        want = [i for i in np.lexsort((ids, -s.round(12))) if ids[i] != q][:20]
        hit += sum((Counter(g["vec_id"] for g in found) & Counter(ids[want].tolist())).values())
        total += 20
        assert all(abs(g["score"] - x[g["vec_id"]] @ x[q]) < 1e-9 for g in found)
        assert [(-round(g["score"], 12), g["vec_id"]) for g in found] == sorted((-round(g["score"], 12), g["vec_id"]) for g in found)
    assert hit / total >= 0.9
    index = ann.fit(ann.valid(df), 20, fit_rows=256)
    assert not {"sample", "sample_ids"} & set(vars(index)) and len(index.centroids) <= 256 // 3
    assert ann.search(df.limit(0), df.limit(0)).count() == 0
    few = ann.search(df.where("vec_id < 5"), df.where("vec_id = 0"), 20).collect()
    assert [g["vec_id"] for g in few if True].__len__() == 4


def test_neighbours_through_the_index(spark):
    """More rows than the sample: recall holds though most cells aren't probed, and what isn't probed isn't found."""
    r = np.random.RandomState(1)
    centres = r.randn(60, 24) * 2
    x = centres[r.randint(0, 60, 4000)] + r.randn(4000, 24)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(8)
    index = ann.fit(ann.valid(df), 20, fit_rows=1024)
    assert index.probes <= len(index.centroids) / 3
    found = defaultdict(list)
    for g in ann.search(df, df.where("vec_id % 20 = 0"), 20, fit_rows=1024).collect():
        found[g["query_id"]].append(g["vec_id"])
    hit = 0
    for q in range(0, 4000, 20):
        s = (x * x[q]).sum(axis=1)
        hit += len(set(found[q]) & set([i for i in np.lexsort((np.arange(4000), -s)) if i != q][:20]))
    assert hit / (200 * 20) >= 0.9
    old = ann.fit
    ann.fit = lambda *a: ann.Index(index.centroids, index.books, 1)
    try:
        few = Counter(g["query_id"] for g in ann.search(df, df.where("vec_id % 20 = 0"), 4000, fit_rows=1024).collect())
    finally:
        ann.fit = old
    homes, best = ann.several(x, index.centroids, ann.SPILL), np.argmax(x @ index.centroids.T, axis=1)
    assert all(few[q] == min(ann.VECTORS, sum((homes == best[q]).any(axis=1)) - (best[q] in homes[q])) for q in range(0, 4000, 20))


def test_neighbours_of_rows_unlike_the_sample(spark):
    """A few rows far longer than the others, most of them outside the sample, and numbers beyond single precision."""
    r = np.random.RandomState(2)
    long, large = r.randn(4000, 16), r.randn(600, 16) * 1e30
    long[r.permutation(4000)[:30]] *= 50
    for x in (long, large):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(4)
        found = defaultdict(set)
        for g in ann.search(df, df.where("vec_id % 20 = 0"), 20, fit_rows=512).collect():
            found[g["query_id"]].add(g["vec_id"])
        hit = 0
        for q in range(0, len(x), 20):
            s = (x * x[q]).sum(axis=1)
            hit += len(found[q] & set([i for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:20]))
        assert hit / len(x) >= 0.9  # 20 neighbours for a query in 20 rows


def test_neighbours_of_a_repeated_query_and_ties(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), *[(i, [1.0, 1.0]) for i in range(1, 9)], (9, [2.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id bigint, embedding array<double>, h int, via int, cell int")
    got = ann.search(df, df.where("vec_id = 0"), 5).orderBy("rank").collect()
    assert [(g["vec_id"], g["score"]) for g in got] == [(i, 1.0) for i in range(1, 6)]


# ---- 8 --------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x}</style><script>var a="</p>";</script></head><body>
<header class="site-header"><a href="/">Home</a><h2>Site name</h2></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class="cookie-notice">We use cookies to make this site better for you and for us.</div><aside class="sidebar"><p>Related pages that many people read today.</p></aside>
<article><header><h1>The  title &amp; more</h1></header><p><b>First paragraph, with &eacute; and &#8212; dashes.<br><p>Second
 one   here.</p><div class="ad">Buy now!</div><ul><li>item one<li>item two</ul><p>Short.</p><form><input><label>Mail</label></form>
<table><tr><td>cell</td><td>next</td></tr></table><section id="comments"><p>A comment by a reader which is quite long and not wanted at all.</p></section></article>
<footer>&copy; example</footer></body></html>"""


def test_html(spark):
    assert htmltext.extract(PAGE) == "The title & more\nFirst paragraph, with é and — dashes.\nSecond one here.\nitem one\nitem two\nShort.\ncell\nnext"
    assert htmltext.extract(None) == htmltext.extract("") == htmltext.extract("<html></html>") == ""
    assert htmltext.extract("plain &lt;text&gt; only") == "plain <text> only"
    div = "<body><div id=menu><a>x</a> <a>y</a></div><div class=content><p>" + "words of the text. " * 20 + "</p><p>short</p><p>" + "more words. " * 20 + "</p></div><div class=footer>foot</div></body>"
    assert [b[:5] for b in htmltext.extract(div).split("\n")] == ["words", "short", "more "]
    assert htmltext.extract("<p>" * 3000 + "deep" + "<div>" * 3000 + "x").replace("\n", "") == "deepx"
    assert htmltext.extract("<article><p>cut off <a href='x") == "cut off"
    df = spark.createDataFrame([(1, "u", PAGE, "clash"), (1, "u", PAGE, "clash"), (None, None, None, None)], "page_id bigint, url string, html string, text string")
    got = htmltext.extracted(df).collect()
    assert len(got) == 3 and got[0]["text"] == got[1]["text"] and {g["text"] for g in got} == {htmltext.extract(PAGE), ""}
    assert htmltext.extracted(df.limit(0)).count() == 0


def test_html_sibling_sections():
    """All sections of a plain div are main text, with the headings between them; a list of links beside them isn't."""
    for link in ("", "<a href=x>link</a>"):
        text = f"<p>{'word ' * 100}{link}</p>"
        links = "<ul>" + "<li><a href=x>some other page</a></li>" * 8 + "</ul>"
        for tag in ("section", "div"):
            got = htmltext.extract(f"<body><div><h2>Head</h2><{tag}>{text * 5}</{tag}><h2>Mid</h2><{tag}>{text * 4}</{tag}></div>{links}</body>").split("\n")
            assert [b[:4] for b in got] == ["Head", *["word"] * 5, "Mid", *["word"] * 4] and all(b.endswith("word" + (" link" if link else "")) for b in got if b[:4] == "word")


def test_html_wrappers_with_listed_names():
    """A wrapper's class or id doesn't take the page's text with it."""
    article, para = f"<article><p>{'word ' * 50}</p></article>", f"<p>{'word ' * 50}</p>"
    side = '<div class="sidebar"><p>Something else to read.</p></div>'
    for names in ('class="layout has-sidebar"', 'class="no-sidebar"', 'class="with_left_sidebar"', 'id="search-results"', 'class="single-related content"', 'class="post comments-open"'):
        for body in (article, para):
            assert htmltext.extract(f"<body><div {names}>{body}{side}</div></body>") == ("word " * 50).strip(), names
    assert htmltext.extract(f'<body><main><h1>Title</h1><div class="single-related">{para}</div></main></body>').split() == ["Title", *["word"] * 50]
    comments = '<div id="comments">' + "<article><p>A comment by a reader.</p></article>" * 20 + "</div>"
    assert htmltext.extract(f"<body>{article}{comments}</body>") == ("word " * 50).strip()
    assert htmltext.extract(f"<body><div>{para}</div><div id=comments>{para}{para}</div></body>") == ("word " * 50).strip()
    assert htmltext.extract(f'<body><div class="ad">{para}{para}</div><article><p>Short.</p></article></body>') == "Short."


def test_html_names_inside_articles():
    """Words that may name an article's own parts, forms around the page, and pages where nothing else is left."""
    para = f"<p>{'word ' * 50}</p>"
    assert htmltext.extract(f"<body><article><div class='entry-header'><h1>Title</h1></div>{para}</article></body>").startswith("Title\nword")
    assert "legal words" in htmltext.extract(f"<body><article>{para}<p class='legal'>Some legal words.</p>{para}</article></body>")
    assert "Discussion" in htmltext.extract(f"<body><article>{para}<section id='discussion'><h2>Discussion</h2>{para}</section></article></body>")
    assert htmltext.extract(f"<body><div id='search-results-page'><main>{para}</main></div></body>") == ("word " * 50).strip()
    assert htmltext.extract(f"<body><form><nav><a>x</a></nav><article>{para}</article></form></body>") == ("word " * 50).strip()
    assert htmltext.extract(f"<body><article>{para}<form><p>Your mail</p></form></article></body>") == ("word " * 50).strip()
    assert htmltext.extract("<body><div class='widget'>a b</div><div class='promo'>c d</div></body>").split() == ["a", "b", "c", "d"]


def test_html_takes_linear_time():
    import time

    for page in ("<div>" * 20_000 + "</span>" * 20_000, "<div>" * 20_000 + "<li>x" * 20_000, "<span>" * 20_000 + "<div>x</div>" * 5_000, "<b>x" * 20_000, "<b>" * 20_000 + "x<header>" * 3_000):
        began = time.time()
        htmltext.extract("<body>" + page)
        assert time.time() - began < 3


def test_html_density_by_a_second_parser():
    """Densities and their sums against a plain recursive computation on the standard library's parser."""
    import math
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.root = self.now = ["", [], None]

        def handle_starttag(self, tag, attrs):
            node = [tag, [], self.now]
            self.now[1].append(node)
            if tag not in htmltext.VOID:
                self.now = node

        def handle_endtag(self, tag):
            self.now = self.now[2]

        def handle_data(self, data):
            self.now[1].append(data)

    def count(node):
        chars = tags = lc = lt = 0
        for x in node[1]:
            if isinstance(x, str):
                chars += len(x) if x.strip() else 0
            else:
                c, t, a, b = count(x)
                chars, tags = chars + c, tags + t + 1
                lc, lt = (lc + c, lt + b + 1) if x[0] == "a" else (lc + a, lt + b)
        return chars, tags, lc, lt

    def density(node, body):
        c, t, lc, lt = count(node)
        if not c:
            return 0.0
        bc, _, blc, _ = count(body)
        base = max(math.log(c / max(1, c - lc) * lc + blc / max(1, bc) * c + math.e), 1 + 1e-9)
        return c / max(1, t) * math.log(max(1.0, c / max(1, lc) * max(1, t) / max(1, lt)) + math.e - 1, base)

    def every(node):
        yield node
        for x in node[1]:
            if not isinstance(x, str):
                yield from every(x)

    r = random.Random(6)

    def page(depth):
        out = ""
        for _ in range(r.randint(1, 4)):
            tag = r.choice(["div", "section", "p", "a", "b", "ul", "span"]) if depth else "b"
            inner = page(depth - 1) if depth and tag in ("div", "section") else "text " * r.randint(0, 30)
            out += f"<{tag}>{inner}</{tag}>" + r.choice(["", " ", "<br>"])
        return out

    for _ in range(60):
        html = f"<body>{page(4)}</body>"
        plain = Plain()
        plain.feed(html)
        body = plain.root[1][0]
        nodes = [x for x in htmltext._nodes(htmltext.parse(html)) if x.tag]
        htmltext.measure(nodes)
        want = sorted((n[0], round(density(n, body), 9), round(sum(density(x, body) if not isinstance(x, str) else len(x) if x.strip() else 0 for x in n[1]), 6)) for n in every(body))
        assert sorted((n.tag, round(n.density, 9), round(n.sum, 6)) for n in nodes) == want


# ---- 9 and 10 -------------------------------------------------------------------------------------------------------


def test_quality_statistics(docs, empty):
    labels = docs.sparkSession.createDataFrame([(1, None), (None, 0)], "doc_id bigint, quality int")
    found = rules.fit(docs, labels)
    assert not found.rules
    got = rules.judge(docs.withColumn("kept", F.lit("clash")), found).collect()
    assert len(got) == docs.count()
    for r in got:
        t = r["text"] or ""
        w = WORD.findall(t)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        again = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 10 or 100 * len(again) > 20 * len(w)) and r["kept"] == (not r["base_failed"])
    assert rules.judge(empty, found).count() == 0 and not rules.fit(empty, labels).rules


def labelled(spark, n=600):
    r = random.Random(8)
    rows, gold = [], []
    for i in range(n):
        w = invented(r, r.randint(60, 160)).split()
        kind = r.choice(["good"] * 6 + ["symbols", "caps"])
        w = [f"{x}***" for x in w] if kind == "symbols" else [f"{x.upper()}!!" for x in w] if kind == "caps" else w
        rows.append((i, " ".join(w)))
        gold.append((i, int(kind == "good")))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(gold, "doc_id bigint, quality int"), dict(gold)


def test_decision_list_held_out(spark):
    docs, labels, gold = labelled(spark)
    found = rules.fit(docs, labels.where("doc_id % 2 = 0"))
    assert found.rules and "reject if" in str(found)
    out = {r["doc_id"]: r["kept"] for r in rules.judge(docs, found).where("doc_id % 2 = 1").collect()}
    assert sum(out[i] == bool(gold[i]) for i in out) / len(out) > 0.97
    plan = rules.judge(docs, found)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_weak_labels(spark, docs, empty):
    own, _, gold = labelled(spark)
    out = {r["doc_id"]: r for r in weaklabel.classified(own.withColumn("score", F.lit("clash"))).collect()}
    assert sum(out[i]["kept"] == bool(gold[i]) for i in out) / len(out) > 0.97
    odd = weaklabel.classified(docs).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert weaklabel.classified(empty).count() == 0
    post, table, share = weaklabel.estimate({"----gg-g": 900, "b---gg-b": 60, "--b-gg-b": 40})
    assert post["----gg-g"] < 0.1 < 0.9 < post["b---gg-b"] and 0.05 < share < 0.15


def brute_em(rows, rounds=100):
    """Posteriors of bad, document by document, in plain products."""
    post = [0.9 if "b" in v else 0.01 for v in rows]
    for _ in range(rounds):
        share = min(0.5, max(1e-3, (sum(post) + 1) / (len(rows) + 2)))
        seen = [[{c: 0.1 for c in "bg-"} for _ in (0, 1)] for _ in rows[0]]
        for v, p in zip(rows, post):
            for j, c in enumerate(v):
                seen[j][0][c] += 1 - p
                seen[j][1][c] += p
        post = []
        for v in rows:
            good, bad = 1 - share, share
            for j, c in enumerate(v):
                good *= seen[j][0][c] / sum(seen[j][0].values())
                bad *= seen[j][1][c] / sum(seen[j][1].values())
            post.append(bad / (good + bad))
    return post


def simulated_votes(n=1500, seed=4):
    """Votes of labellers that know one defect each and are independent given the truth, and that truth."""
    r, rows, truth = random.Random(seed), [], []
    for _ in range(n):
        bad = r.random() < 0.2
        rows.append("".join("b" if r.random() < (0.6 if bad else 0.02) else "g" if r.random() < 0.5 else "-" for _ in weaklabel.LABELLERS))
        truth.append(bad)
    return rows, truth


def test_accuracies_against_brute_force():
    """EM over counts of vote patterns is EM over documents, and finds the labellers' accuracies where they are known."""
    rows, truth = simulated_votes()
    post, table, share = weaklabel.estimate(dict(Counter(rows)))
    assert max(abs(post[v] - p) for v, p in zip(rows, brute_em(rows))) < 1e-9
    assert abs(share - sum(truth) / len(truth)) < 0.03
    assert all(abs(table[j, 1, 0] - 0.6) < 0.1 and abs(table[j, 0, 0] - 0.02) < 0.02 for j in range(len(weaklabel.LABELLERS)))
    assert sum((post[v] > 0.5) == t for v, t in zip(rows, truth)) / len(rows) > 0.98


def test_scorer_reaches_the_optimum():
    """Gradient steps end where Newton's method does."""
    r = np.random.default_rng(3)
    x = r.random((200, 6)).astype(np.float32)
    y = 1 / (1 + np.exp(-(x @ np.array([3.0, -2, 1, 0, 0, -1]) - 0.5)))
    w, b = weaklabel.train(x, y, rounds=4000, rate=1.0, decay=0.01)
    one, at = np.hstack([x, np.ones((200, 1))]).astype(float), np.zeros(7)
    weight, decay = y * 0.5 / y.mean() + (1 - y) * 0.5 / (1 - y.mean()), np.diag([0.01] * 6 + [0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-one @ at))
        at -= np.linalg.solve((one * (weight * p * (1 - p) / 200)[:, None]).T @ one + decay, one.T @ ((p - y) * weight / 200) + decay @ at)
    assert np.abs(np.append(w, b) - at).max() < 1e-3


def test_scores_against_brute_force(spark):
    """Votes' posteriors and scores of every document from features counted one by one; the fit takes all documents."""
    own, _, _ = labelled(spark, 150)
    got = {r["doc_id"]: r for r in weaklabel.classified(own).collect()}
    rows = [(r["doc_id"], r["text"], r["h"]) for r in own.select("doc_id", "text", F.xxhash64("doc_id").alias("h")).collect()]
    rows.sort(key=lambda x: x[2])
    post = brute_em([got[d]["votes"] for d, _, _ in rows])
    x = np.zeros((len(rows), weaklabel.SLOTS), np.float32)
    for i, (_, text, _) in enumerate(rows):
        words = text.split()
        for w in words:
            shape = "".join("A" if c.isupper() else "a" if c.islower() else "9" if c.isdigit() else c for c in w)
            shape = re.sub(r"(.)\1+", r"\1", "".join(c for k, c in enumerate(shape) if k == 0 or c not in "Aa9" or shape[k - 1] != c))
            x[i, xxhash.xxh3_64_intdigest(shape) % (weaklabel.SHAPES - 64)] += 1 / len(words)
            x[i, weaklabel.SHAPES + xxhash.xxh3_64_intdigest(w.lower()) % (weaklabel.SLOTS - weaklabel.SHAPES)] += 1 / len(words)
        x[i, weaklabel.SHAPES - 3 - min(20, len(words).bit_length())] = 0.2
        x[i, weaklabel.SHAPES - 2] = 1 - len(set(words)) / len(words)
        x[i, weaklabel.SHAPES - 1] = sum(a == b for a, b in zip(words, words[1:])) / len(words)
    w, b = weaklabel.train(x, np.array(post, np.float32))
    for (d, _, _), p, z in zip(rows, post, x.astype(float) @ w + b):
        assert abs(got[d]["posterior"] - p) < 1e-6 and abs(got[d]["score"] - 1 / (1 + np.exp(z))) < 1e-3
        assert got[d]["kept"] == (got[d]["score"] >= weaklabel.KEEP)


def test_weak_labels_ties_and_repeats(spark):
    """Repeated ids and rows, and a model fitted on less than all rows, give each row of one text one score, whatever the order."""
    own, _, _ = labelled(spark, 120)
    twice = own.unionByName(own).unionByName(own.select(F.lit(5).cast("bigint").alias("doc_id"), "text"))
    one = sorted((r["text"], r["score"]) for r in weaklabel.classified(twice, fit_rows=50).collect())
    two = sorted((r["text"], r["score"]) for r in weaklabel.classified(twice.orderBy(F.xxhash64("text")).repartition(3), fit_rows=50).collect())
    assert one == two and len(set(one)) == len({t for t, _ in one})


# ---- columns, long texts --------------------------------------------------------------------------------------------

CLASH = ("q", "q_score", "kept", "rule", "row", "d_i", "m_id", "p_x", "p_e", "pii", "s_x", "u_x", "w_x", "h", "t", "e", "f", "cid", "no", "copies", "removed", "score", "votes", "host", "a.b", "N_words")


def clashing(df):
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASH])


def own_columns(df, but=()):
    for r in df.select(*[F.col(f"`{c}`") for c in CLASH if c not in but]).collect():
        assert list(r) == [f"own {c}" for c in CLASH if c not in but]


def test_clashing_columns(spark, docs):
    wide = clashing(docs.drop("n_chars"))
    plain = lambda df: Counter(map(repr, df.collect()))
    for f in (lambda d: neardup.deduplicated(d.where("doc_id is null or doc_id != 12")), mixing.mix, pii.redact, lambda d: rules.kept(d, rules.DecisionList())):
        got = f(wide)
        assert got.columns == wide.columns
        own_columns(got)
        assert plain(got.select("doc_id", "text")) == plain(f(docs).select("doc_id", "text"))
    own_columns(pii.find(wide), ("pii",))
    own_columns(linededup.deduplicated(wide), ("removed",))
    own_columns(rules.judge(wide, rules.DecisionList()), ("kept", "rule", "N_words"))
    own_columns(weaklabel.classified(wide), ("kept", "score", "votes"))
    own_columns(htmltext.extracted(wide.withColumn("html", F.col("text"))))
    pages = clashing(spark.createDataFrame([(1, "http://a.org/x"), (None, None)], "page_id bigint, url string"))
    own_columns(urls.judge(pages, spark.createDataFrame([(1, 0)], "page_id bigint, good int")), ("host", "rule"))
    assert neardup.groups(wide).count() == mixing.plan(wide).count() == docs.count()
    assert plain(packing.pack(wide).select("doc_id", "length", "ids_crc32")) == plain(packing.pack(docs).select("doc_id", "length", "ids_crc32"))


def test_redact_hands_no_match_on(spark):
    df = spark.createDataFrame([(1, "write to a.b@c.de now", "old")], "doc_id bigint, text string, pii string")
    assert [tuple(r) for r in pii.redact(df).collect()] == [(1, "write to <EMAIL> now", "old")]


def test_long_texts(spark):
    r = random.Random(11)
    long = invented(r, 60_000)
    df = spark.createDataFrame([(1, long, "en", "s", 0), (2, "short one of two", "en", "s", 0), (3, long, "en", "s", 0)], SCHEMA)
    assert {x["doc_id"]: x["component_id"] for x in neardup.groups(df).collect()} == {1: 1, 2: 2, 3: 1}
    assert {x["doc_id"]: len(x["text"]) for x in linededup.deduplicated(df).collect()}[3] < len(long) / 100
    assert rules.judge(df, rules.DecisionList()).agg(F.max("n_words")).first()[0] == len(WORD.findall(long))
    assert mixing.plan(df).agg(F.max("size")).first()[0] == len(WORD.findall(long))
    assert packing.pack(df).agg(F.sum("length").alias("n")).first()[0] == packing.pack(df).dropDuplicates(["doc_id"]).agg(F.sum("doc_tokens")).first()[0]
    assert weaklabel.classified(df).count() == 3
    url = "http://long.org/" + "a" * 200_000 + "?q"
    page = f"<body><article>{'<p>' + 'word ' * 40 + '</p>'}" + "<p>more words</p>" * 20_000 + "</article></body>"
    assert urls.judge(spark.createDataFrame([(1, url)], "page_id bigint, url string"), spark.createDataFrame([], "page_id bigint, good int")).first()["path"] == url[15:-2]
    assert htmltext.extract(page).count("more words") == 20_000


def test_ties_in_rules_and_urls(spark):
    x = np.zeros((60, len(rules.FEATURES)))
    x[:, 0] = x[:, 1] = np.repeat([0.0, 1.0], 30)  # two features that tell the same
    found = rules.learn(x, np.repeat([True, False], 30))
    assert [c.feature for r in found.rules for c in r] == [rules.FEATURES[0]] and found.covers(x).tolist() == [True] * 30 + [False] * 30
    own = (("allow", "b.org", "/x/"), ("block", "a.org", "/x/"), ("block", "org", "/x/y/"))
    df = spark.createDataFrame([(1, "http://a.org/x/y/"), (2, "http://b.org/x/y/")], "page_id bigint, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(df, spark.createDataFrame([], "page_id bigint, good int"), own).collect()}
    assert got == {1: ("a.org/x/", "block"), 2: ("b.org/x/", "allow")}


def test_stored_asks_for_a_shared_folder(spark):
    from quarry.llm import common

    class Far:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"getCheckpointDir": staticmethod(lambda: None), "master": "spark://far:7077"})

    with pytest.raises(ValueError):
        common.shared_dir(Far)
    out = common.stored_alone(spark, lambda: common.stored(spark.range(5)).where("id > 1"))
    assert out.count() == 3
