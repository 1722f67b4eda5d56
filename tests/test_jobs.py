"""The jobs: growing input, repeated and failed runs, odd rows, the command line, and their queries against DuckDB."""

import json
import os
import random
import subprocess
import sys
from collections import Counter

import pytest

from jobs import audit, config, ingest, queries
from quarry.sources.tables import CHUNK_SCHEMA

from .test_catalog import DATA, duck, rows  # noqa: F401 (duck is a fixture)

COLUMNS = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]
SCHEMA = "doc_id bigint, text string, source string, lang string"


def prose(seed, n=60):
    r = random.Random(seed)
    return " ".join(" ".join(r.choice(["cell", "unit", "shall", "be", "set", "to", "power", "node"]) for _ in range(8)).capitalize() + "." for _ in range(n))


def put(spark, folder, name, found, schema=SCHEMA):
    """One more file in a folder of Parquet, by Spark's writer."""
    spark.createDataFrame(found, schema).coalesce(1).write.parquet(f"{folder}/part={name}")


def files(folder):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_statement(spark, duck, name):  # noqa: F811
    df = queries.QUERIES[name](spark, DATA)
    got = duck.execute(queries.ORACLE_SQL[name])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in got.description], got.fetchall())


def expected(spark, latest):
    """The chunk table of documents (doc_id, text, source), all at once."""
    docs = spark.createDataFrame([(str(i), t or "", s or "UNKNOWN") for i, t, s in latest], "doc_id string, text string, wg string")
    return Counter(tuple(r) for r in ingest.chunked(docs, ingest.Settings()).select(*COLUMNS).collect())


def as_it_stands(spark, output):
    return Counter(tuple(r) for r in ingest.current(spark, output).collect())


def test_ingest_growing_input(spark, tmp_path):
    source, output, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    one = [(i, prose(i), f"s{i % 3}", "en") for i in range(12)] + [(20, None, None, None), (21, "", "s1", "en"), (22, "short", "s1", "en")]
    put(spark, source, 1, one)
    first = ingest.run(spark, source, output, checkpoint)
    assert first["rows_read"] == 15 and first["documents"] == 15 and first["chunks"] > 12
    assert as_it_stands(spark, output) == expected(spark, [r[:3] for r in one])
    before = files(output)

    again = ingest.run(spark, source, output, checkpoint)
    assert again == {"batches": 0, "rows_read": 0, "documents": 0, "chunks": 0} and files(output) == before

    # a new document, one with another text, one with another group, one that has no chunk any more, two that come again as they were
    two = [(30, prose(30), "s9", "en"), (3, prose(303), "s0", "en"), (4, prose(4), "s7", "en"), (5, "gone", "s2", "en"), (6, prose(6), "s0", "de"), (7, prose(7), "s1", "en")]
    put(spark, source, 2, two)
    second = ingest.run(spark, source, output, checkpoint)
    assert second["rows_read"] == 6 and second["documents"] == 4
    latest = {r[0]: r[:3] for r in one} | {r[0]: r[:3] for r in two}
    assert as_it_stands(spark, output) == expected(spark, latest.values())
    assert set(before) < set(files(output))  # nothing is rewritten

    # back to an older text
    put(spark, source, 3, [one[3]])
    assert ingest.run(spark, source, output, checkpoint)["documents"] == 1
    assert as_it_stands(spark, output) == expected(spark, (latest | {3: one[3][:3]}).values())


def test_ingest_in_small_batches_and_replayed(spark, tmp_path):
    source, output, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    docs = [(i, prose(i, 30), f"s{i % 2}", "en") for i in range(9)]
    for k in range(3):
        put(spark, source, k, docs[3 * k : 3 * k + 3])
    done = ingest.run(spark, source, output, checkpoint, ingest.Settings(files_per_batch=1))
    assert done["batches"] == 3 and done["rows_read"] == 9
    want = as_it_stands(spark, output)
    assert want == expected(spark, [r[:3] for r in docs])
    for name in ("2", ".2.crc"):  # as if the run had died after its last batch was written
        os.remove(f"{checkpoint}/commits/{name}")
    done = ingest.run(spark, source, output, checkpoint, ingest.Settings(files_per_batch=1))
    assert done["batches"] == 1 and done["rows_read"] == done["documents"] == 3 and as_it_stands(spark, output) == want


def test_ingest_fails_and_goes_on(spark, tmp_path, monkeypatch):
    source, output, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    docs = [(i, prose(i, 30), "s", "en") for i in range(4)]
    put(spark, source, 1, docs[:2])
    ingest.run(spark, source, output, checkpoint)
    put(spark, source, 2, docs[2:])
    whole = ingest._documents

    def broken(df, settings):
        return whole(df, settings).selectExpr("doc_id", "text", "wg", "raise_error('no') as digest")

    monkeypatch.setattr(ingest, "_documents", broken)
    with pytest.raises(Exception, match="no"):
        ingest.run(spark, source, output, checkpoint)
    assert as_it_stands(spark, output) == expected(spark, [r[:3] for r in docs[:2]])  # a half-done batch doesn't count
    monkeypatch.setattr(ingest, "_documents", whole)
    assert ingest.run(spark, source, output, checkpoint)["documents"] == 2
    assert as_it_stands(spark, output) == expected(spark, [r[:3] for r in docs])


def test_ingest_odd_rows(spark, tmp_path):
    source, output, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    a, b = sorted([prose(1), prose(2)])
    odd = [(None, prose(5), "s", "en"), (None, prose(5), "s", "en"), (1, a, "s", "en"), (1, b, "s", "en"), (1, None, "s", "en"), (2, f"{prose(3)}\f{prose(4)}", None, "en")]
    put(spark, source, 1, odd)
    assert ingest.run(spark, source, output, checkpoint) | {"chunks": 0} == {"batches": 1, "rows_read": 6, "documents": 3, "chunks": 0}
    found = ingest.current(spark, output).collect()
    assert {(r["doc_id"], r["wg"]) for r in found if not r["doc_id"].startswith("text-")} == {("1", "s"), ("2", "UNKNOWN")}
    assert b.startswith(next(r["text"] for r in found if r["doc_id"] == "1")) and max(r["page_end"] for r in found) == 2
    assert len({r["doc_id"] for r in found}) == 3


def test_ingest_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/in")
    ingest.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/c")
    assert ingest.current(spark, f"{tmp_path}/out").count() == 0


def audited(spark, tmp_path, name, settings=audit.Settings(), docs=None, asked=None, vectors=None):
    at = f"{tmp_path}/{name}"
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{at}/documents")
    spark.createDataFrame(asked, "item_id bigint, text string").write.parquet(f"{at}/questions")
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").write.parquet(f"{at}/vectors")
    run = lambda: audit.run(spark, f"{at}/documents", f"{at}/questions", f"{at}/vectors", f"{at}/out", settings)
    return f"{at}/out", run


def test_audit(spark, tmp_path):
    r = random.Random(4)
    docs = [(i, prose(i, 3), None if i == 8 else f"s{i % 3}", "en" if i % 2 else "de") for i in range(30)] + [(None, prose(99), "s", "en"), (40, None, "s0", "en")]
    asked = [(i, prose(i, 1)) for i in range(6)] + [(50, "nothing of the kind"), (51, None), (None, "power")]
    vectors = [(i, [r.uniform(-1, 1) for _ in range(4)]) for i in range(30)] + [(3000, None)]
    out, run = audited(spark, tmp_path, "a", audit.Settings(fused_topk=10, rerank_topk=4), docs, asked, vectors)
    done = run()
    hits = audit.read(spark, out).collect()
    assert done["questions"] == 7 and done["documents"] == 31 and done["hits"] == len(hits)
    per = Counter((h["query_id"], h["list"]) for h in hits)
    assert set(per.values()) == {10, 4} and len(per) == 14 and {h["source"] for h in hits} <= {"s0", "s1", "s2", "UNKNOWN"}
    for q in spark.read.parquet(f"{out}/questions").collect():
        best = max(h["score"] for h in hits if h["query_id"] == q["query_id"] and h["list"] == "reranked")
        assert (q["best"], q["fallback"], q["fused"], q["reranked"]) == (best, best < 0.25, 10, 4)
    sources = {s["source"]: (s["documents"], s["hits"], s["found"]) for s in spark.read.parquet(f"{out}/sources").collect()}
    for name in ("s0", "s1", "s2", "UNKNOWN"):
        own = [h["doc_id"] for h in hits if h["source"] == name and h["list"] == "fused"]
        assert sources[name] == (sum((d[2] or "UNKNOWN") == name for d in docs if d[0] is not None), len(own), len(set(own)))
    (summary,) = spark.read.json(f"{out}/summary").collect()
    assert summary["questions"] == 7 and summary["missing"] == 0
    again = run()
    assert again == done and Counter(audit.read(spark, out).collect()) == Counter(hits) and spark.read.json(f"{out}/summary").count() == 1


def test_audit_filter_and_no_vectors(spark, tmp_path):
    docs = [(i, prose(i, 3), f"s{i % 3}", "en" if i % 2 else "de") for i in range(20)]
    out, run = audited(spark, tmp_path, "f", audit.Settings(filters={"lang": "EN"}), docs, [(1, prose(1, 1))], [(i, [1.0, float(i)]) for i in range(20)])
    run()
    assert {h["doc_id"] % 2 for h in audit.read(spark, out).collect()} == {1}
    out, run = audited(spark, tmp_path, "n", audit.Settings(), docs, [(1, prose(1, 1))], [])
    run()
    assert Counter(h["list"] for h in audit.read(spark, out).collect()) == {"fused": 20, "reranked": 12}


def test_audit_knows_how_few_hits_there_are(spark, tmp_path, monkeypatch):
    """Hits are held when the joins with texts are planned, so that the hits are broadcast and not the texts shuffled."""
    sizes = []
    size = lambda df: int(df._jdf.queryExecution().withCachedData().stats().sizeInBytes())
    rerank, rows_of = audit.fuse.rerank, audit.evaluate.audit_rows
    monkeypatch.setattr(audit.fuse, "rerank", lambda hits, *a: sizes.append(size(hits)) or rerank(hits, *a))
    monkeypatch.setattr(audit.evaluate, "audit_rows", lambda f, r, *a: sizes.extend([size(f), size(r)]) or rows_of(f, r, *a))
    docs = [(i, prose(i, 3), f"s{i % 3}", "en") for i in range(20)]
    audited(spark, tmp_path, "k", audit.Settings(), docs, [(1, prose(1, 1))], [(i, [1.0, float(i)]) for i in range(20)])[1]()
    assert len(sizes) == 3 and max(sizes) < 5000


def test_settings(tmp_path):
    path = f"{tmp_path}/c.json"
    with open(path, "w") as f:
        json.dump({"version": "v2", "files_per_batch": 3}, f)
    assert config.read(ingest.Settings, path) == ingest.Settings(version="v2", files_per_batch=3)
    with open(path, "w") as f:
        json.dump({"verison": "v2"}, f)
    with pytest.raises(ValueError, match="verison"):
        config.read(ingest.Settings, path)
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert config.read(ingest.Settings, f"{here}/jobs/ingest.json") == ingest.Settings() and config.read(audit.Settings, f"{here}/jobs/audit.json") == audit.Settings()


def test_command_line(spark, tmp_path):
    """Both jobs as commands, the first one twice."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    put(spark, f"{tmp_path}/documents", 1, [(i, prose(i), "s", "en") for i in range(3)])
    spark.createDataFrame([(1, prose(1, 1))], "item_id bigint, text string").write.parquet(f"{tmp_path}/questions")
    spark.createDataFrame([(1, [1.0, 0.0])], "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/vectors")
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    command = lambda *a: subprocess.run([sys.executable, "-m", *a], cwd=here, env=env, capture_output=True, text=True, timeout=300)
    said = [command("jobs.ingest", f"{tmp_path}/documents", f"{tmp_path}/chunks", f"{tmp_path}/checkpoint", "--config", "jobs/ingest.json") for _ in range(2)]
    assert all(x.returncode == 0 for x in said), said[0].stderr[-2000:]
    assert "1 batches, 3 rows read" in said[0].stderr and "0 batches, 0 rows read" in said[1].stderr
    done = command("jobs.audit", *[f"{tmp_path}/{x}" for x in ("documents", "questions", "vectors", "audit")], "--config", "jobs/audit.json")
    assert done.returncode == 0 and "wrote 6 hits of 1 questions" in done.stderr, done.stderr[-2000:]
