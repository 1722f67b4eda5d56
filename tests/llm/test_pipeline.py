"""The pipeline's stages, each against a brute-force version on its own input, and the whole run."""

import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import pii, rules
from quarry.llm.queries import ORACLE_SQL, QUERIES

from .test_corpus import SCHEMA, brute_components, clashing, invented, own_columns


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(11)
    path, rows, gold = str(tmp_path_factory.mktemp("sf")), [], []
    for i in range(240):
        t = invented(r, r.randint(40, 160))
        bad = i % 8 == 0
        if bad:
            t = " ".join(f"{w}***" for w in t.split())
        elif i % 8 == 1:
            t += f" write to a{i}@mail.example.com or call +49 30 {1000000 + i}"
        elif i % 8 == 2 and i > 8:
            t = rows[i - 7][1].replace(" ou ", " other ", 1)
        rows.append((i, t, "en", f"s{i % 3}", len(t)))
        gold.append((i, int(not bad), 0))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(gold, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, dict((r[0], r[1]) for r in rows)


def test_stages(spark, folder):
    path, texts = folder
    docs, columns = spark.read.parquet(f"{path}/documents.parquet"), ["doc_id", "text", "lang", "source", "n_chars"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "personal data", "mixing", "packing"]
    inputs = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append(docs)
        out = stage(spark, docs, path)
        if name != "packing":
            assert out.columns == columns
        out.write.parquet(f"{path}/out{i}")
        docs = spark.read.parquet(f"{path}/out{i}")
    kept = {r["doc_id"] for r in inputs[1].collect()}
    assert all(i % 8 for i in kept) and sum(1 for i in range(240) if i % 8) - len(kept) <= 2
    rows = [(r["doc_id"], r["text"]) for r in inputs[1].collect()]
    assert sorted(r["doc_id"] for r in inputs[2].collect()) == sorted(d for d, _, c in brute_components(rows, 5, 80) if d == c)
    for r in inputs[3].collect():
        assert not re.search(r"@|\+49", r["text"]) and ("<EMAIL>" in r["text"]) == ("@" in texts[r["doc_id"]])
    assert {r["doc_id"] for r in inputs[4].collect()} <= {r["doc_id"] for r in inputs[3].collect()}
    copies = Counter(r["doc_id"] for r in inputs[4].collect())
    total = docs.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("d")).collect()
    assert all(r["n"] == copies[r["doc_id"]] * r["d"] for r in total) and len(total) == len(copies)


def test_run(spark, folder):
    path, _ = folder
    assert corpus_pipeline.ORACLE_SQL is None
    out = corpus_pipeline.run(spark, path)
    assert out.count() > 0 and "sequence_id" in out.columns


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows(spark, folder, tmp_path):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "x " * 50, "en", "s", 1), (2, "", "en", None, 0), (3, "one two", "en", "s", 7), (4, "w" * 30_000, "en", "s", 1)] + [(5, "some words that are said once only in this text of mine", "en", "s", 1)] * 3
    docs = spark.createDataFrame(rows, SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder[0]).count() >= 0
    assert corpus_pipeline.near_duplicates(spark, docs, folder[0]).count() == 7
    assert pii.redact(docs).count() == len(rows) and rules.judge(docs, rules.DecisionList()).count() == len(rows)


def test_names():
    assert sorted(n.split("_")[0] for n in QUERIES if n.startswith("op")) == sorted(f"op{i}" for i in range(1, 13)) and set(ORACLE_SQL) <= set(QUERIES)


def test_stages_keep_clashing_columns(spark, folder):
    docs = clashing(spark.read.parquet(f"{folder[0]}/documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder[0])
        if name == "packing":
            assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
        else:
            assert out.columns == docs.columns
            own_columns(out)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_statements(spark, tmp_path, name):
    """Each query with a DuckDB statement against it, on tables with nulls, copies, near copies, personal data and labels."""
    r = random.Random(21)
    rows = [(0, None, "en", None, 0), (1, "", "en", "s1", 0), (2, "one two", "en", "s1", 7), (3, " \t\n", None, "s2", 3)]
    base = [invented(r, n) for n in (12, 40, 90, 200, 400)]
    base += ["mail a.b@c.de or +49 30 123456789, 4111 1111 1111 1111 and 10.0.0.255 or 10.0.0.256", "# a | b\n# a | b\n" * 9, "Some say so. Others don't!  " * 20]
    rows += [(10 + i, t, "en", f"s{i % 4}", 0) for i, t in enumerate(base + base[:6] + [t.replace(" the ", " a ", 1) for t in base] + [f"{base[0]} {base[2]}\n{base[1]}"])]
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    urls = [None, "", "no scheme", *[f"http://h{i % 3}.d{i % 5}.{'com' if i % 2 else 'net'}/{'en' if i % 3 else 'es'}/{i}" for i in range(60)]]
    spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(i, int(r.random() < 0.6)) for i in range(50)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for table in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    got = QUERIES[name](spark, str(tmp_path))
    want = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert Counter(map(tuple, got.select(*names).collect())) == Counter(want.fetchall())
