"""Segmentation, retrieval, context, answers, evaluation, profile, sources, plans and streaming on small fixtures."""

import json
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import answers, context, evaluate, fuse, lexical, profile, rounds, segment, vector
from quarry.plans import adapters, ask
from quarry.sources import reports, store, tables
from quarry.sources.tables import stored
from quarry.streaming import questions as stream


def fold(spark, build, parts):
    return spark.createDataFrame([(parts,)], "p array<string>").select(build(F.col("p")).alias("x")).first()["x"]


def test_greedy_packing(spark):
    assert fold(spark, lambda p: segment.packed(p, 10), ["aaaa", "bbbb", "cc", "d" * 25, "e"]) == ["aaaa bbbb", "cc", "d" * 10, "d" * 10, "d" * 5, "e"]
    assert fold(spark, lambda p: segment.packed(p, 10), []) == []
    assert fold(spark, lambda p: segment.grown(p, 5), ["ab", "cd", "efgh", "i"]) == ["ab cd", "efgh i"]
    assert fold(spark, lambda p: segment.joined_short(p, 4, 8), ["abcde", "x", "yyy", "zz", " ", "long enough", "q"]) == ["abcde x", "yyy zz", "long enough", "q"]


def test_minimum_merge_may_exceed_the_maximum(spark):
    pieces = fold(spark, lambda p: segment.grown(p, 400), ["a" * 399, "b" * 2200])
    assert [len(x) for x in pieces] == [2600]


PAGES = [
    ("d1", 1, "Front matter with Notice of Disclaimer " + "x " * 80 + "\n4.1 Scope ..... 3"),
    ("d1", 9, "4.1 Scope of work\n" + "This shall hold. " * 20 + "\n4.1 Scope of work\nmore of it here\n4.10 Other things\n" + "Other text goes on. " * 10),
    ("d1", 10, "4.1 Scope of work\nagain\n\n   \n" + "And this closes it; really. " * 8),
]


def test_blocks_and_chunks(spark):
    pages = spark.createDataFrame(PAGES, "doc_id string, page_num int, text string")
    lines = segment.without_toc(segment.lines(pages))
    assert not lines.where("line like '%.....%'").count()
    found = segment.headings(lines)
    assert [(r["number"], r["title"]) for r in found.orderBy("line_no").collect()] == [("4.1", "Scope of work")] * 2 + [("4.10", "Other things"), ("4.1", "Scope of work")]
    blocks = segment.blocks(segment.aligned(lines, found)).orderBy("block_i").collect()
    assert [(b["clause_id"], b["block_i"], b["page_start"], b["page_end"]) for b in blocks] == [("UNKNOWN", 0, 1, 1), ("4.1", 1, 9, 9), ("4.10", 2, 9, 9), ("4.1", 3, 10, 10)]
    rows = segment.corpus(pages).collect()
    assert {r["clause_id"] for r in rows} == {"4.1", "4.10"} and len({r["chunk_id"] for r in rows}) == len(rows)
    assert all(r["is_normative"] == int(" shall " in r["text"].lower()) and r["section_path"].startswith(r["clause_id"] + " ") for r in rows)
    again = segment.corpus(pages.repartition(7)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))


def test_marked_lines_make_the_blocks_of_aligned_ones_without_joining_texts(spark):
    pages = PAGES + [("d2", None, "4.1 Scope of work\n4.1 Scope again"), ("d2", 2, "\u00a04.10 Other things\n4.1 Scope\n4.1234 scope\n12 plain\n4.10.2 deep things\n4.10.21 deep"), ("d3", 1, "1.5 was the value\r\n1.5 was it")]
    lines = segment.lines(spark.createDataFrame(pages, "doc_id string, page_num int, text string"))
    marked = segment.marked(lines)
    assert marked.where("line is not null").count() == lines.count() and "Join" not in marked._jdf.queryExecution().optimizedPlan().toString()
    want = segment.blocks(segment.aligned(lines, segment.headings(lines))).collect()
    assert Counter(map(tuple, want)) == Counter(map(tuple, segment.blocks(marked).collect())) and {r["clause_id"] for r in want} >= {"UNKNOWN", "4.1", "4.10.2", "1.5"}


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "red red fish"), (2, "blue fish"), (3, "green bird bird"), (4, ""), (5, "blue fish")], "doc_id bigint, text string")
    asked = spark.createDataFrame([(1, "red bird bird"), (2, "nothing")], "query_id bigint, text string")
    toks = {r["doc_id"]: r["text"].split() for r in docs.collect()}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df = Counter(t for x in toks.values() for t in set(x))
    idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: v if v >= 0 else 0.25 * mean for t, v in idf.items()}
    score = lambda q, d: round(sum(idf.get(t, 0) * toks[d].count(t) * 2.5 / (toks[d].count(t) + 1.5 * (0.25 + 0.75 * len(toks[d]) / avg)) for t in q.split()), 6)
    got = {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in lexical.search(docs, asked, 4).collect()}
    for q, text in ((1, "red bird bird"), (2, "nothing")):
        want = sorted(((d, score(text, d)) for d in toks), key=lambda x: (-x[1], x[0]))[:4]
        assert [got[q, i][0] for i in range(1, 5)] == [d for d, _ in want]
        assert all(abs(got[q, i][1] - s) < 1e-5 for i, (_, s) in enumerate(want, 1))
    only = lexical.search(docs, asked, 4, F.col("doc_id") > 2).collect()
    assert {r["doc_id"] for r in only} <= {3, 4, 5} and len(only) == 6


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.6, 0.8]), (4, [-1.0, 0.0])], "doc_id bigint, embedding array<float>").repartition(3)
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id bigint, embedding array<float>")
    assert [(r["doc_id"], r["score"]) for r in vector.search(v, q, 3).orderBy("rank").collect()] == [(1, 1.0), (2, 0.6), (3, 0.6)]
    assert spark.range(1).select(vector.unit(F.array(F.lit(3.0), F.lit(4.0))).alias("u"), vector.unit(F.array(F.lit(0.0))).alias("z")).first() == ([0.6, 0.8], [0.0])


def test_fusion_and_gate(spark):
    hits = lambda rows: spark.createDataFrame(rows, "query_id bigint, doc_id bigint, score double, rank int")
    a, b = hits([(1, 10, 9.0, 1), (1, 11, 8.0, 2)]), hits([(1, 11, 1.0, 1), (1, 12, 0.5, 2)])
    got = fuse.rrf({"a": a, "b": b}, weights={"a": 2.0}).orderBy("rank").collect()
    assert [(r["doc_id"], r["score"]) for r in got] == [(11, round(2 / 62 + 1 / 61, 9)), (10, round(2 / 61, 9)), (12, round(1 / 62, 9))]
    assert fuse.rrf({"a": a, "b": b}, caps={"a": 0, "b": 1}).count() == 1
    gates = {r["query_id"]: r["fallback"] for r in fuse.gate(a, spark.range(1, 3).withColumnRenamed("id", "query_id"), 9.5).collect()}
    assert gates == {1: True, 2: True}
    assert fuse.rerank(a, None, None, 1, None).count() == 1


def test_context(spark):
    rows = [(f"c{i}", f"d{i % 2}", "4.1", "4.1 S" if i < 4 else "", "t" * (10 + i)) for i in range(6)]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id string, clause_id string, section_path string, text string")
    seeds = spark.createDataFrame([(1, "c1"), (1, "c5"), (1, "none")], "query_id bigint, chunk_id string")
    assert {r["chunk_id"] for r in context.neighbours(seeds, chunks).collect()} == {"c0", "c1", "c2", "c5", "none"}
    assert {r["chunk_id"] for r in context.neighbours(seeds, chunks, 1, "document").collect()} == {"c1", "c3", "c5", "none"}
    ctx = chunks.withColumn("query_id", F.lit(1))
    assert [r["chunk_id"] for r in context.trimmed(ctx, 25).orderBy("place").collect()] == ["c0", "c2"][:2]
    assert context.trimmed(ctx, 5).count() == 1
    prompt = context.prompts(spark.createDataFrame([(1, "why?"), (2, "no context")], "query_id bigint, question string"), context.trimmed(ctx, 25)).orderBy("query_id").collect()
    assert "why?" in prompt[0]["prompt"] and "[chunk_id=c0]\ntttttttttt" in prompt[0]["prompt"] and "no context" in prompt[1]["prompt"]


RAW = [
    ('{"answer": "2", "citations": [{"chunk_id": "c", "quote": "q"}]}', "2", 1, "clean"),
    ('```json\n{"answer": "3", "citations": []}\n```', "3", 0, "extracted_or_fixed"),
    ('Sure, here: {"answer": "1", "citations": []}', "1", 0, "extracted_or_fixed"),
    ('{"answer": "4", "citations": []} I hope {this} helps', "4", 0, "extracted_or_fixed"),
    ("{answer: '2', citations: [{chunk_id: 'c', quote: 'q'}]}", "2", 1, "extracted_or_fixed"),
    ('{"answer": "2", "citations": [{"chunk_id": "c", "quote": "q",},],}', "2", 1, "extracted_or_fixed"),
    ("Answer: 3", "3", 0, "salvaged"),
    ("I think it is 2 here", "2", 0, "salvaged"),
    ('{"ans": "2"}', "", 0, "clean"),
    ("", "", 0, "salvaged"),
    (None, "", 0, "salvaged"),
    ('{"answer": "a {brace} and \\" quote", "citations": [["c", "q"], ["only"], {"chunk_id": "", "quote": ""}]}', 'a {brace} and " quote', 1, "clean"),
    ('{"answer": 2, "citations": null}', "2", 0, "clean"),
    ('{"answer": "1", "citations": [' + ",".join('{"chunk_id": "c%d", "quote": "q"}' % i for i in range(25)) + "]}", "1", 3, "clean"),
]


def test_parsing(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(RAW)], "id int, raw string")
    for r in answers.parsed(df).collect():
        assert (r["answer"], len(r["citations"]), r["mode"]) == RAW[r["id"]][1:], RAW[r["id"]][0]
    long = spark.createDataFrame([('{"answer": "1", "citations": [{"chunk_id": "c", "quote": "%s"}]}' % ("y" * 261),)], "raw string")
    assert answers.parsed(long).first()["citations"][0]["quote"] == "y" * 260 + "…"
    faults = df.select("id", answers.schema_fault(F.col("raw")).alias("f")).collect()
    assert {r["id"]: r["f"] for r in faults}[0] == "ok" and {r["id"]: r["f"] for r in faults}[8] == "bad_keys=['ans']" and {r["id"]: r["f"] for r in faults}[12] == "answer_not_str" and {r["id"]: r["f"] for r in faults}[9] == "not_dict"


def test_rewrites(spark):
    rows = [("", "empty"), ("Answer: 3", "looks_like_answer"), ("(2)", "looks_like_answer"), ("short", "too_short"), ("Output ONLY this", "prompt_echo"), ("a fine query about things", "")]
    df = spark.createDataFrame(rows, "t string, want string")
    assert all(r[0] == r[1] for r in df.select(answers.rewrite_fault(F.col("t")), "want").collect())
    line = spark.createDataFrame([('\n  Final: "the query"\nmore',)], "t string").select(answers.one_line(F.col("t"))).first()[0]
    assert line == "the query"


def test_evaluation(spark):
    rows = spark.createDataFrame([("E", 0, "1", "1", 2), ("E", 1, "2", "Answer 2", 0), ("M", 2, "3", "x", 1), ("M", 3, "NOT_ENOUGH", "NOT_ENOUGH", 0)], "split string, global_i int, gold string, answer string, n int").withColumn("citations", F.array_repeat(F.lit("c"), F.col("n")))
    scored = evaluate.scored(rows)
    assert {r["split"]: (r["n"], r["acc"], r["avg_citations"]) for r in evaluate.micro(scored).collect()} == {"E": (2, 1.0, 1.0), "M": (2, 0.5, 0.5), "ALL": (4, 0.75, 0.75)}
    parts = evaluate.by_split(scored.withColumn("s", F.col("global_i") % 2), "s")
    assert {r["split"]: r["acc"] for r in evaluate.merged(parts).collect()} == {"E": 1.0, "M": 0.5, "ALL": 0.75}
    assert evaluate.shard(rows, 1, 2).count() == 2
    assert {r["split"]: r["missing_rate"] for r in evaluate.missing_rate(scored).collect()} == {"E": 0.0, "M": 1.0}


@pytest.mark.parametrize("values", [[], [5], list(range(1, 11)), [3, 3, 3, 1], list(range(100)) + [7] * 50])
def test_summary(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    r = profile.summary(df, F.col("v")).first()
    s = sorted(values)
    at = lambda p: s[int(round((len(s) - 1) * p))] if s else 0
    mid = (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2 if s else 0
    assert (r["n"], r["med"], r["p10"], r["p90"], r["minv"], r["maxv"]) == (len(s), mid, at(0.1), at(0.9), at(0), at(1))


def test_profile(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", " a ", "a\n", "b", None, "", "x" * 5000])], "doc_id int, text string")
    assert profile.duplicate_texts(df).first()["n"] == 3 and profile.duplicate_samples(df, "doc_id", k=2).count() == 2
    assert profile.duplicate_ids(df.unionByName(df.limit(1)), "doc_id").first()["extra"] == 1
    b = profile.buckets(df).first()
    assert (b["total"], b["empty"], b["too_short"], b["too_long"]) == (7, 2, 4, 1)
    assert profile.coverage(df.where("doc_id < 3"), df.where("doc_id > 1"), "doc_id").groupBy("side").count().count() == 2
    assert sorted(r["doc_id"] for r in profile.sampled(df, "doc_id", 3).collect()) == sorted(r["doc_id"] for r in profile.sampled(df.repartition(5), "doc_id", 3).collect())


def test_sources(spark, tmp_path):
    lines = ['["Q1?", ["1. a", "2. b"], "2"]', "", '{"question": "Q2?", "choices": ["x"], "label": 1}', '["", ["a"], "1"]', '{"question": "Q3?", "options": "one", "answer": "1"}']
    (tmp_path / "m.jsonl").write_text("\n".join(lines))
    got = tables.read_mcq(spark, str(tmp_path / "m.jsonl")).collect()
    assert [(r["question"], r["options"], r["answer"]) for r in got] == [("Q1?", ["1. a", "2. b"], "2"), ("Q2?", ["x"], "1"), ("Q3?", ["one"], "1")]
    (tmp_path / "one.jsonl").write_text(lines[0])
    assert tables.read_mcq(spark, str(tmp_path / "one.jsonl")).count() == 1
    (tmp_path / "list.json").write_text(json.dumps([json.loads(lines[0]), json.loads(lines[2])]))
    assert tables.read_mcq(spark, str(tmp_path / "list.json")).count() == 2
    rows = ['{"event": "split_started", "split": "E"}', "not json", '{"split": "E", "global_i": 1, "gold": "1", "pred_text": "1", "acc": 1.0, "options": ["a"], "citations": [], "question": "q"}']
    (tmp_path / "s0.jsonl").write_text("\n".join(rows))
    read = tables.read_eval_rows(spark, str(tmp_path / "s*.jsonl"))
    assert read.count() == 1
    tables.write_csv_by_split(read, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 1
    (tmp_path / "c.yaml").write_text("retrieval:\n  rrf_k: 10\n  unknown: 1\n")
    config = tables.load_config(str(tmp_path / "c.yaml"))
    assert config.retrieval.rrf_k == 10 and config.packing.max_context_chars == 25000 and config.gate.min_score == -1.25
    report = tables.markdown_report(spark.createDataFrame([("E", 2, 0.5, 1.0)], "split string, n bigint, acc double, avg_citations double"), config)
    assert "| E | 2 | 0.5000 | 1.00 |" in report
    assert "&lt;b&gt;" in tables.html_report({"t": spark.createDataFrame([("<b>",)], "x string")})
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, o int")
    up = tables.upsert(old.withColumn("o", F.lit(0)), new, "k", F.col("o"))
    assert sorted((r["k"], r["v"]) for r in up.collect()) == [(1, "a"), (2, "d"), (3, "e")]
    assert tables.file_stats(spark, str(tmp_path), "*.jsonl").first()["files"] == 3


def test_ask_end_to_end(spark, tmp_path):
    chunks = segment.corpus(spark.createDataFrame(PAGES, "doc_id string, page_num int, text string"), spark.createDataFrame([("d1", "1.0", "WG1")], "doc_id string, version string, wg string"))
    engine = ask.Engine(chunks)
    questions = spark.createDataFrame([(1, "what is the scope of work"), (2, "other things and text")], "query_id bigint, question string")
    out = {r["query_id"]: r for r in engine.ask(questions).collect()}
    assert set(out) == {1, 2} and all(r["answer"] == "1" and r["mode"] == "clean" for r in out.values())
    ids = {r["chunk_id"] for r in chunks.collect()}
    assert all(c["chunk_id"] in ids for r in out.values() for c in r["citations"])
    found = engine.search(questions, {"wg": "wg1"}, top_k=1).collect()
    assert len(found) == 2 and all(r["rank"] == 1 for r in found) and engine.search(questions, {"wg": "wg9"}).count() == 0
    with pytest.raises(ValueError):
        adapters.adapter("nothing")
    assert adapters.adapter("stub")().generate(["[chunk_id=a]\ntext"])[0].startswith('{"answer"')
    questions.write.json(str(tmp_path / "in"))
    q = stream.answered(spark.readStream.schema(questions.schema).json(str(tmp_path / "in")), lambda b: engine.search(b, top_k=1).select("query_id", "chunk_id"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_lexical_ways_agree(spark, monkeypatch, tmp_path):
    """Blocks of matrices, the join in a shuffle, and a stored index give the same; with and without a filter."""
    rows = [(i, " ".join(f"w{(i * j) % 17}" for j in range(i % 9))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    asked = spark.createDataFrame([(1, "w3 w5 w5"), (2, "none of it"), (3, "w0 w1 w2 w16")], "query_id bigint, text string")
    plain = lambda df: sorted(map(tuple, df.collect()))
    monkeypatch.setattr(lexical, "BLOCK", 7)
    for where in (None, F.col("doc_id") % 3 == 0):
        want = plain(lexical.search(docs, asked, 8, where))
        assert len(want) == 24
        lexical.build(docs).save(str(tmp_path / "index"))
        assert plain(lexical.search(docs, asked, 8, where, lexical.Index.load(spark, str(tmp_path / "index")))) == want
        with monkeypatch.context() as m:
            m.setattr(lexical, "MOST_ASKED", 2)
            assert plain(lexical.search(docs, asked, 8, where)) == want
    empty = lexical.search(docs.limit(0), asked, 3)
    assert empty.count() == 0


def test_shuffled_way_has_no_row_a_pair(spark, monkeypatch):
    """Blocks of documents meet blocks of queries: nothing joins postings and queries by term; many blocks of both give the same."""
    rows = [(i, " ".join(f"w{(i * j) % 17} {'x-y' if i % 5 == 0 else 'é'}" for j in range(i % 9))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    asked = spark.createDataFrame([(f"q{i}", f"w{i} w{i + 1} xy w3 w3 none") for i in range(30)], "query_id string, text string")
    plain = lambda df: sorted(map(tuple, df.collect()))
    want = plain(lexical.search(docs, asked, 8))
    monkeypatch.setattr(lexical, "BLOCK", 7)
    monkeypatch.setattr(lexical, "ASKED", 40)
    monkeypatch.setattr(lexical, "SLICE", 50)
    got = lexical.search(docs, asked, 8, most_asked=0)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Join Inner, (term" not in plan
    assert plain(got) == want == plain(lexical.search(docs, asked, 8)) and len(want) == 240


def test_tokens_are_counted_where_texts_are_read(spark, monkeypatch):
    """Counts and postings of cut slices are those of all tokens, and no plan sorts or explodes tokens in rows."""
    texts = ["Ab-c ab_c", "-a a- a--b", "x.y/z\n0", "é1_2é", "", None, "a", "a-", "-b"] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    tokens = docs.select("doc_id", F.explode(T.domain_tokens(F.col("text"))).alias("term"))
    post = tokens.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    want = sorted(map(tuple, post.groupBy("term").agg(F.count(F.lit(1)), F.sum("tf")).collect()))
    for size in (1, 7, 4_000_000):
        monkeypatch.setattr(lexical, "SLICE", size)
        index = lexical.build(docs)
        assert sorted(map(tuple, index.counts.collect())) == want
        assert sorted(map(tuple, index.postings.select("doc_id", "term", "tf").collect())) == sorted(map(tuple, post.collect()))
    assert "Generate" not in index.counts._jdf.queryExecution().optimizedPlan().toString()


def brute_bm25(rows, asked, k):
    """query_id, doc_id, score, rank by loops: every document has a score, ties go to the smaller id."""
    docs = {i: Counter(t.split()) for i, t in rows}
    n, df = len(docs), Counter(w for c in docs.values() for w in c)
    avgdl = sum(sum(c.values()) for c in docs.values()) / n
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    mean = sum(raw.values()) / len(raw) if raw else 0
    idf = {w: 0.25 * mean if x < 0 else x for w, x in raw.items()}
    out = []
    for q, t in asked:
        scores = {i: round(sum(m * idf[w] * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * sum(c.values()) / avgdl)) for w, m in Counter(t.split()).items() if w in idf and c[w]), 6) for i, c in docs.items()}
        out += [(q, i, x + 0.0, r) for r, (i, x) in enumerate(sorted(scores.items(), key=lambda s: (-s[1], s[0]))[:k], 1)]
    return out


@pytest.mark.parametrize("seed", [0, 2])
def test_lexical_ways_by_loops(spark, monkeypatch, seed):
    """Both ways against loops: terms of no weight (in half of the documents), of negative weight, ties, more asked for than match."""
    r = random.Random(seed)
    words = ["a", "b", "c"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 9)))) for i in range(12)]
    if seed == 0:
        rows = [(1, "x y"), (2, "z"), (3, "x"), (4, "v")]  # x is in half of them, its idf is 0
    asked = [(1, "x"), (2, "a b b"), (3, "c none"), (4, "none"), (5, "x z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    questions = spark.createDataFrame(asked, "query_id bigint, text string")
    monkeypatch.setattr(lexical, "BLOCK", 3)
    for k in (1, 20):
        want = sorted(brute_bm25(rows, asked, k))
        for most in (None, 0):
            assert [(q, i, pytest.approx(x, abs=2e-6), n) for q, i, x, n in want] == sorted((h["query_id"], h["doc_id"], h["score"], h["rank"]) for h in lexical.search(docs, questions, k, most_asked=most).collect()), (seed, k, most)


def test_index_grows(spark, tmp_path):
    """Segments added one by one, one of them twice and with documents that are there already, equal the index of all."""
    r = random.Random(1)
    rows = [(i, " ".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(0, 12)))) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    vectors = docs.select("doc_id", F.array(F.lit(1.0), F.col("doc_id").cast("double")).alias("embedding"))
    path, plain = str(tmp_path / "index"), lambda df: sorted(map(tuple, df.collect()))
    lexical.add(docs.where("doc_id < 30"), path, "0", vectors.where("doc_id < 30"))
    lexical.add(docs.where("doc_id < 60"), path, "1", vectors.where("doc_id < 60"))
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "index").rglob("*.parquet") if "segment=0" in str(f)}
    for _ in range(2):
        lexical.add(docs, path, "late", vectors)
    assert before == {f: f.stat().st_mtime_ns for f in (tmp_path / "index").rglob("*.parquet") if "segment=0" in str(f)}
    grown, whole = lexical.Index.load(spark, path, vectors=True), lexical.build(docs)
    near = lambda df: plain(df.select(*[F.round(c, 9) if t == "double" else c for c, t in df.dtypes]))  # noqa: E731 (sums in another order)
    assert near(grown.terms) == near(whole.terms) and near(grown.sizes) == near(whole.sizes) and plain(grown.ids) == plain(whole.ids)
    assert plain(grown.postings.select("doc_id", "dl", "term", "tf")) == plain(whole.postings) and plain(grown.vectors) == plain(vectors)
    asked = spark.createDataFrame([(1, "a b c"), (2, "p")], "query_id bigint, text string")
    assert plain(lexical.search(docs, asked, 7, index=grown)) == plain(lexical.search(docs, asked, 7))
    lexical.add(docs.limit(0), path, "none", vectors.limit(0))
    assert plain(lexical.Index.load(spark, path).ids) == plain(whole.ids)


def test_rerank_shuffles_no_text(spark):
    """Written hits are broadcast to the texts, whatever the questions' size; texts alone are beyond what is broadcast."""
    bodies = stored(spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("cell "), F.sha2(F.col("id").cast("string"), 512)).alias("body")))
    hits = stored(spark.range(50).select(F.lit(1).alias("query_id"), F.col("id").alias("doc_id")).coalesce(1))
    questions = spark.createDataFrame([(1, "cell of it")], "query_id int, question string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "30k")
    try:
        out = fuse.rerank(hits, questions, bodies, 3)
        assert "BroadcastHashJoin [doc_id" in out._jdf.queryExecution().executedPlan().toString()
        assert sorted((r["doc_id"], r["rank"]) for r in out.collect()) == [(0, 1), (1, 2), (2, 3)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_vectors_of_no_document_are_added_once(spark, tmp_path):
    """A segment has vectors of ids that no document has: a later segment that is given them again passes them over."""
    docs = spark.createDataFrame([(i, f"w{i}") for i in range(4)], "doc_id bigint, text string")
    vectors = spark.range(9).select(F.col("id").alias("doc_id"), F.array(F.lit(1.0)).alias("embedding"))
    path = str(tmp_path / "index")
    lexical.add(docs.where("doc_id % 2 = 0"), path, "a", vectors.where("doc_id % 2 = 0"))
    for _ in range(2):
        lexical.add(docs, path, "b", vectors)
    assert sorted(r["doc_id"] for r in lexical.Index.load(spark, path, vectors=True).vectors.collect()) == list(range(9))


def test_neighbours_over_ranges(spark):
    """A section with nine tenths of the chunks, cut in many ranges, some shorter than the reach; against loops."""
    r = random.Random(6)
    ids = [f"c{i:04d}" for i in range(400)]
    rows = [(i, "hot" if r.random() < 0.9 else r.choice(["one", "two", "", None]), f"d{r.randint(0, 2)}") for i in ids]
    chunks = spark.createDataFrame(rows, "chunk_id string, section_path string, doc_id string").repartition(5)
    seeds = spark.createDataFrame([(q, r.choice(ids)) for q in range(60)] + [(99, "nowhere")], "query_id bigint, chunk_id string")
    for scope in ("section", "document"):
        order = defaultdict(list)
        for i, s, d in rows:
            if s:
                order[(s, d if scope == "document" else None)].append(i)
        at = {i: (x, k) for x in order.values() for k, i in enumerate(x)}
        for reach, ranges in ((1, 7), (4, 150)):
            want = set()
            for q, i in map(tuple, seeds.collect()):
                x, k = at.get(i, ([i], 0))
                want |= {(q, j) for j in x[max(0, k - reach) : k + reach + 1]}
            assert sorted(map(tuple, context.neighbours(seeds, chunks, reach, scope, ranges).collect())) == sorted(want), (scope, reach, ranges)


def test_no_task_has_a_whole_section(spark):
    """Ranges of a table with one section are of like sizes."""
    chunks = spark.range(20_000).select(F.format_string("c%06d", "id").alias("chunk_id"), F.lit("hot").alias("section_path"), F.lit("d").alias("doc_id"))
    sizes = [x["count"] for x in context.ranged(chunks, ["section_path"], 8).groupBy("p").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * sorted(sizes)[4]


def test_ranks_of_doubles(spark):
    """Distinct doubles in several series, ties and nulls, against sorted lists."""
    r = random.Random(2)
    rows = [("a", r.random()) for _ in range(501)] + [("b", float(r.randint(0, 3))) for _ in range(200)] + [("c", 1.5), ("d", None), ("a", None)]
    ranks = {"low": lambda n: F.floor((n - 1) / 2), "p90": lambda n: F.rint((n - 1) * 0.9)}
    got = {x["series"]: x for x in profile.ranked(spark.createDataFrame(rows, "series string, v double").repartition(3), ranks, 9).collect()}
    assert set(got) == {"a", "b", "c"}
    for name in got:
        v = sorted(x for s, x in rows if s == name and x is not None)
        assert (got[name]["n"], got[name]["low"], got[name]["p90"], got[name]["least"], got[name]["most"]) == (len(v), v[(len(v) - 1) // 2], v[round((len(v) - 1) * 0.9)], v[0], v[-1])


def test_hashed_rows_of_one_id(spark):
    """Rows of one document add up, wherever they lie, and tokens aren't rows of a shuffle."""
    docs = spark.createDataFrame([(i % 3, f"word{i} other") for i in range(900)] + [(7, ""), (8, None)], "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: r["embedding"] for r in vector.hashed(docs, 16).collect()}
    joined = spark.createDataFrame([(d, " ".join(f"word{i} other" for i in range(d, 900, 3))) for d in range(3)], "doc_id bigint, text string")
    assert got == {r["doc_id"]: r["embedding"] for r in vector.hashed(joined, 16).collect()} and set(got) == {0, 1, 2}
    assert "Generate" not in vector.hashed(docs, 16)._jdf.queryExecution().optimizedPlan().toString()


def test_postings_count_the_tokens(spark):
    texts = ["A-b a_B ab A", "x/y.z x-x \u212aelvin \u0130s naïve-té", "", None, "--- ... 1.5.", "same same"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = docs.select("doc_id", T.domain_tokens(F.col("text")).alias("t")).collect()
    want = sorted((r["doc_id"], len(r["t"]), term, n) for r in want for term, n in Counter(r["t"]).items())
    assert want == sorted(map(tuple, lexical.postings(docs).collect())) and {w[0] for w in want} == {0, 1, 4, 5}


def test_embeddings(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "two one"), (3, ""), (4, None), (5, "other words")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["embedding"] for r in vector.hashed(docs, 16).collect()}
    assert set(got) == {1, 2, 5} and got[1] == got[2] != got[5] and all(len(v) == 16 and abs(sum(x * x for x in v) - 1) < 1e-9 for v in got.values())

    class Lengths:
        def encode(self, texts):
            return [[float(len(t)), 1.0] for t in texts]

    rows = {r["doc_id"]: r["embedding"] for r in vector.encoded(docs, Lengths).collect()}
    assert rows[3] == [0.0, 1.0] and abs(rows[1][0] - 7 / 50**0.5) < 1e-9
    v = spark.createDataFrame([(i, [float(i % 5), float(i % 3)]) for i in range(50)], "doc_id bigint, embedding array<double>")
    q = v.withColumnRenamed("doc_id", "query_id")
    assert sorted(map(tuple, vector.search(v, q, 4).collect())) == sorted(map(tuple, vector.search(v, q, 4, most_numbers=20).collect()))
    assert vector.search(v, q.limit(0), 4).count() == vector.search(v.limit(0), q, 4, most_numbers=20).count() == 0


def test_pairs_of_blocks_are_of_a_size_of_their_own(spark):
    v = spark.createDataFrame([(i, [float(i * 7 % 11), float(i % 3)]) for i in range(60)], "doc_id bigint, embedding array<double>")
    q = v.withColumnRenamed("doc_id", "query_id")
    want = sorted(map(tuple, vector.search(v, q, 4).collect()))
    assert want == sorted(map(tuple, vector.search(v, q, 4, most_numbers=2).collect())) == sorted(map(tuple, vector.search(v, q, 4, most_numbers=2, block_numbers=14).collect()))
    # what may be broadcast doesn't tell how often rows are repeated: one block of queries, one copy of each row
    assert "[0,1" not in vector.search(v, q, 4, most_numbers=2)._jdf.queryExecution().optimizedPlan().toString()


def test_rewriting(spark):
    df = spark.createDataFrame([("one", 'Final: "a better query"', "q"), ("two", "short", "q"), ("three", "the same question", "the same question"), ("four", None, "q")], "id string, raw string, question string")
    got = {r["id"]: tuple(r["r"]) for r in df.select("id", answers.rewrite_outcome(F.col("raw"), F.col("question")).alias("r")).collect()}
    assert got == {"one": ("a better query", True, "", "a better query"), "two": ("short", False, "too_short", "q"), "three": ("the same question", False, "same_as_original", "the same question"), "four": ("", False, "empty", "q")}
    judge = context.judge_prompts(spark.createDataFrame([(1, "why?")], "query_id bigint, question string"), spark.createDataFrame([(1, 2, "4.2 S", 3, 4, "b"), (1, 1, "4.1 S", 1, 2, "a")], "query_id bigint, place int, section_path string, page_start int, page_end int, text string")).first()["prompt"]
    assert "why?" in judge and judge.index("[1] 4.1 S (p1-p2)\na") < judge.index("[2] 4.2 S (p3-p4)\nb")


def test_evaluation_reports(spark):
    rows = spark.createDataFrame([(i, "E" if i < 6 else "M", float(i % 2), i % 4) for i in range(10)], "global_i int, split string, acc double, citations_count int")
    assert [r["global_i"] for r in evaluate.ranged(rows, 3, 2).orderBy("global_i").collect()] == [3, 4] and [r["global_i"] for r in evaluate.ranged(rows, 99, 0).collect()] == [9] and evaluate.ranged(rows.limit(0), 0, 5).count() == 0
    got = {r["split"]: r.asDict() for r in evaluate.breakdown(rows).collect()}
    assert got["ALL"] == {"split": "ALL", "n": 10, "correct": 5, "failed": 5, "well_cited": 4, "citations": {0: 3, 1: 3, 2: 2, 3: 2}} and got["E"]["n"] == 6
    out = answers.parsed(spark.createDataFrame([(r[0],) for r in RAW], "raw string"))
    report = evaluate.parser_report(out).first().asDict()
    modes = [r[3] for r in RAW]
    assert report["total"] == report["schema_ok"] == len(RAW) and all(report[m] == modes.count(m) for m in set(modes)) and report["empty_raw"] == 2 and report["answer_missing"] == 3
    left, right = (spark.createDataFrame([(i,) for i in x], "k int") for x in ([1, 2, 2, 3], [3, 4]))
    assert tuple(profile.coverage_counts(left, right, "k").first()) == (4, 2, 2, 1)


def test_flags_of_chunks_read_them_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    rows = [("a", "4.1", "x" * 300, 1, 0), ("a", "UNKNOWN", "same", 0, 1), ("b", "unknown", " same ", 0, 0), ("c", "4", "same", 0, 0), ("d", None, None, 0, None)]
    schema = "chunk_id string, clause_id string, text string, is_definition int, is_normative int"
    flags = reports.chunk_flags(spark.createDataFrame(rows, schema).mapInArrow(counted, schema)).first().asDict()
    assert flags == {"chunks": 5, "empty": 1, "too_short": 4, "too_long": 0, "unknown_clause": 2, "definitions": 1, "normative": 1, "duplicate_ids": 1, "repeated_texts": 3}
    assert read.value == 5


def test_store_and_reports(spark, tmp_path):
    chunks = segment.corpus(spark.createDataFrame(PAGES, "doc_id string, page_num int, text string"))
    kept = store.Store(spark, str(tmp_path / "chunks")).create()
    assert kept.read().count() == 0 and kept.create().read().count() == 0
    n = chunks.count()
    assert kept.upsert(chunks).upsert(chunks.limit(1).withColumn("text", F.lit("changed"))).read().count() == n
    assert kept.read().where("text = 'changed'").count() == 1 and kept.ids().count() == n and kept.counts().agg(F.sum("n")).first()[0] == n
    wanted = chunks.select("chunk_id").limit(1).unionByName(spark.createDataFrame([("none",)], "chunk_id string"))
    assert sorted(r["missing"] for r in store.by_id(kept.read(), wanted).collect()) == [False, True]
    assert store.in_sections(kept.read(), chunks.select("section_path").limit(1)).count() >= 1
    page = reports.chunk_report(chunks)
    assert f"<td>chunks</td><td>{n}</td>" in page and reports.chunk_samples(chunks).count() >= 0
    questions = spark.createDataFrame([(1, "what <is> it")], "query_id bigint, question string")
    rows = spark.createDataFrame([(1, "fused", 1, 0.5, 3, "4.1", "a & b", 0.1)], "query_id bigint, list string, rank int, score double, doc_id bigint, clause_id string, snippet string, overlap double")
    html = reports.audit_report(questions, rows, evaluate.audit(rows, questions))
    assert "what &lt;is&gt; it" in html and "a &amp; b" in html and "questions" in html
    log = reports.tee(str(tmp_path / "a.log"))
    log.info("one line")
    reports.joined_logs([str(tmp_path / "a.log")], str(tmp_path / "all.log"))
    assert "one line" in (tmp_path / "all.log").read_text() and fuse.definition_first(None) == {}
    with pytest.raises(FileNotFoundError):
        store.Store(spark, str(tmp_path / "nothing")).read()


def test_configuration_acts(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("ingest:\n  max_chunk_chars: 200\n  min_chunk_chars: 1\n  max_pages: 10\ngate:\n  enabled: true\n  min_score: 2.0\n  max_rounds: 2\nmodel:\n  adapter: stub\npaths:\n  chunks: /x\n")
    config = tables.load_config(str(tmp_path / "c.yaml"))
    assert config.paths == {"chunks": "/x"} and ask.health() == {"ok": True}
    pages = spark.createDataFrame([*PAGES, ("d1", 50, "last page " * 40)], "doc_id string, page_num int, text string")
    small, whole = ask.build_corpus(pages, config=config), ask.build_corpus(pages)
    assert whole.agg(F.max("page_end")).first()[0] == 50 and small.agg(F.max("page_end")).first()[0] == 10
    engine = ask.Engine(whole, config=config)
    engine.index = lexical.build(engine.index_texts())
    questions = spark.createDataFrame([(1, "what is the scope of work")], "query_id bigint, question string")

    class Worded(adapters.Stub):
        def generate(self, prompts, max_new_tokens=256, temperature=0.0, top_p=1.0):
            return ["other words of the text" if "Search line" in p else super(Worded, self).generate([p])[0] for p in prompts]

    engine.model = Worded
    guarded = engine.rewritten(questions).first()
    assert guarded["used"] and guarded["question"] == "other words of the text"
    out = engine.logged(questions.withColumn("asked", F.lit("asked in these words")), max_prompt=60).first()
    assert out["round"] == 2 and out["query"] == "other words of the text" and out["answer"] == "1" and "truncated" in out["prompt"] and out["fused_top"] and out["reranked_top"]
    assert engine.ask(questions).first()["fallback"]
    mini = engine.mini(questions.withColumns({"options": F.array(F.lit("1. a"), F.lit("2. b")), "gold": F.lit("1")}), keep_raw=True).first()
    assert mini["acc"] == 1.0 and mini["pred_num"] == "1" and len(mini["prompt"]) <= 3000 and "2. b" in mini["prompt"]
    scored = fuse.rerank(engine.retrieve(questions), questions, engine.docs.select("doc_id", F.col("text").alias("body")), scorer=fuse.model_scorer(adapters.SharedWords)).collect()
    assert scored and all(0 <= r["score"] <= 1 for r in scored)


def test_rounds_of_the_gate(spark):
    """Questions that pass in the first, second and third round, one that never does, one without any hit, one whose rewriting is
    missing; each round sees the open ones only."""
    passes, seen = {1: 1, 2: 2, 3: 3, 4: 9, 6: 2}, []
    questions = spark.createDataFrame([(i, f"q{i}", i * 10) for i in (1, 2, 3, 4, 5, 6)], "query_id bigint, question string, extra int")

    def retrieve(now):
        rows = now.collect()
        seen.append({r["query_id"]: r["question"] for r in rows})
        assert all(r["extra"] == r["query_id"] * 10 for r in rows)
        hits = [(r["query_id"], d, 1.0 if passes[r["query_id"]] <= len(seen) else 0.1 * len(seen), d) for r in rows if r["query_id"] in passes for d in (1, 2)]
        return spark.createDataFrame(hits, "query_id bigint, doc_id bigint, score double, rank int")

    def rewrite(open_):
        return open_.where("query_id != 6").select("query_id", F.concat("question", F.lit("/"), F.col("round").cast("string")).alias("question"))

    last = rounds.gated(questions, retrieve, lambda now, hits: hits, 0.5, rewrite, 4)
    assert seen == [{i: f"q{i}" for i in range(1, 7)}, {i: "q6" if i == 6 else f"q{i}/2" for i in (2, 3, 4, 5, 6)}, {i: f"q{i}/3" for i in (3, 4, 5)}, {i: f"q{i}/4" for i in (4, 5)}]
    got = {r["query_id"]: (r["round"], r["query"], r["best"], r["fallback"]) for r in last.asked.join(last.gates, "query_id").collect()}
    assert got == {1: (1, "q1", 1.0, False), 2: (2, "q2/2", 1.0, False), 3: (3, "q3/3", 1.0, False), 4: (4, "q4/4", 0.4, True), 5: (4, "q5/4", None, True), 6: (2, "q6", 1.0, False)}
    assert sorted((r["query_id"], r["doc_id"]) for r in last.seeds.collect()) == [(i, d) for i in (1, 2, 3, 4, 6) for d in (1, 2)] == sorted((r["query_id"], r["doc_id"]) for r in last.fused.collect())
    seen.clear()
    once = rounds.gated(questions, retrieve, lambda now, hits: hits, 0.5, None, 4)
    assert len(seen) == 1 and once.gates.where("fallback").count() == 5 and once.asked.count() == 6
    none = rounds.gated(questions.where("false"), retrieve, lambda now, hits: hits, 0.5, rewrite, 4)
    assert none.asked.count() == none.gates.count() == none.seeds.count() == 0
