"""Every named query of the engine against its DuckDB statement on the smallest tables."""

import hashlib
import math
import os
import re
from collections import defaultdict

import duckdb
import pytest

from quarry.operators import context
from quarry.plans import catalog

DATA = "/root/testdata/sf0.001"


def rows(columns, found):
    order = sorted(columns)
    at = [columns.index(c) for c in order]

    def plain(v):
        if isinstance(v, bool):
            return int(v)
        if v is None or isinstance(v, str):
            return v
        return None if math.isnan(v) else round(float(v), 6)

    return order, sorted(([plain(r[i]) for i in at] for r in found), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    got = duck.execute(catalog.ORACLE_SQL[name])
    want = rows([c[0] for c in got.description], got.fetchall())
    assert rows(df.columns, df.collect()) == want


def test_plans_prune_and_push(spark):
    plan = catalog.coverage_diff(spark, DATA)._jdf.queryExecution().executedPlan().toString() if os.path.isdir(DATA) else ""
    assert "text" not in plan.split("ReadSchema")[-1]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
def test_sentence_pack(spark):
    """All documents, those with an overlong sentence too, against a fold in Python."""
    want, long = [], set()
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        body = re.sub(r"[ \t]+", " ", r["text"] or "").strip(" \t\n\r")
        pieces, buf = [], ""
        for s in [x for x in re.sub(r"([.?!;:])[ \t\n\r\f\v]+", "\\1\x01", body).split("\x01") if x]:
            if len(s) > 2200:
                long.add(r["doc_id"])
                pieces += [buf] * bool(buf) + [s[i : i + 2200] for i in range(0, len(s), 2200)]
                buf = ""
            elif buf and len(buf) + 1 + len(s) > 2200:
                pieces, buf = [*pieces, buf], s
            else:
                buf = f"{buf} {s}" if buf else s
        want += [(r["doc_id"], i, len(x), hashlib.md5(x.encode()).hexdigest()) for i, x in enumerate([*pieces, *[buf] * bool(buf)])]
    got = [tuple(r) for r in catalog.sentence_pack(spark, DATA).collect()]
    assert long and sorted(got) == sorted(want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
def test_contexts_of_all_items(spark):
    """Seeds of every benchmark item, their neighbours, the budget and the prompts against loops in Python."""
    chunks = {c["chunk_id"]: c for c in catalog.spec_chunks(spark, DATA).collect()}
    sections, by_doc, near = defaultdict(list), defaultdict(list), defaultdict(set)
    for i in sorted(chunks):
        sections[chunks[i]["section_path"]].append(i)
        by_doc[chunks[i]["doc_id"]].append(i)
    place = {i: (x, k) for s, x in sections.items() if s for k, i in enumerate(x)}
    for r in catalog.bm25_topk(spark, DATA).collect():
        for i in by_doc[r["doc_id"]]:
            x, k = place.get(i, ([i], 0))
            near[r["query_id"]].update(x[max(0, k - 1) : k + 2])
    assert {(r["query_id"], r["chunk_id"]) for r in catalog.neighbour_expand(spark, DATA).collect()} == {(q, i) for q, x in near.items() for i in x}
    kept = {}
    for q, x in near.items():
        total, kept[q] = 0, []
        for i in sorted(x, key=lambda i: (str(chunks[i]["doc_id"]), chunks[i]["clause_id"], i)):
            total += len(chunks[i]["text"])
            if chunks[i]["text"] and (total <= 25000 or not kept[q]):
                kept[q].append(i)
    assert sorted(tuple(r) for r in catalog.context_trim(spark, DATA).collect()) == sorted((q, i, k + 1) for q, x in kept.items() for k, i in enumerate(x))
    asked = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    assert all(kept.get(q) for q in asked)
    a, b, c = context.TEMPLATE
    want = {q: hashlib.md5((a + text + b + "\n\n".join(f"[chunk_id={i}]\n{chunks[i]['text']}" for i in kept[q]) + c).encode()).hexdigest() for q, text in asked.items()}
    assert {r["query_id"]: r["hash"] for r in catalog.prompt_assemble(spark, DATA).collect()} == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", ["citation_verify", "store_lookup", "store_sections"])
def test_chunks_are_made_once(spark, name):
    """What reads the chunks several times reads them as written; documents aren't cut anew for each."""
    plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "page_num" not in plan and "spark_partition_id" not in plan


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
def test_audit_searches_once(spark):
    """Both of its lists come from the fused hits as written: no search is left in the plan."""
    plan = catalog.retrieval_audit_rows(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "InArrow" not in plan
