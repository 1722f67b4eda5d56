"""The named queries of the engine over the driver's tables, each with its DuckDB statement.

Documents have no numbered headings, so the clause queries use a derived "spec view" that both engines build by the same
rule: lines get pages of 40, a clause number in every seventh and a modal verb in every fifth.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import answers, context, evaluate, fuse, lexical, profile, segment, vector
from quarry.plans import adapters, ask
from quarry.sources import reports, store, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _texts(spark: SparkSession, sf: str, name: str = "documents") -> DataFrame:
    """A table whose texts are worked on."""
    return tables.spread(_t(spark, sf, name))


# ---- views that several queries share -------------------------------------------------------------------------------


def _spec_line(line: Column, i: Column) -> Column:
    """Line i of a text in the spec view, or null where it is blank."""
    number = F.when(i % 7 == 3, F.concat((F.floor(i / 49) + 1).cast("string"), F.lit("."), (F.floor(i / 14) % 7 + 1).cast("string"), F.lit(" "))).otherwise("")
    modal = F.when(i % 5 == 0, " shall apply.").otherwise("")
    return T.let(F.rtrim(line, F.lit(" \t\n\f\r")), lambda x: F.when(x != "", F.concat(number, x, modal)))


def spec_lines(spark: SparkSession, sf: str) -> DataFrame:
    raw = _texts(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "l"))
    rows = raw.select("doc_id", "i", T.computed(_spec_line(F.col("l"), F.col("i"))).alias("line")).where("line is not null")
    return rows.select("doc_id", (F.floor(F.col("i") / 40) + 1).cast("int").alias("page_num"), F.col("i").alias("line_no"), "line")


def spec_pages(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, page_num, text: the same lines by pages, which are cut inside a document's row."""
    raw = _texts(spark, sf).select("doc_id", T.computed(F.split("text", "\n", -1)).alias("l"))
    pages = F.transform(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / 40).cast("int")), lambda p: F.slice("l", p * 40 + 1, 40))
    cut = raw.select("doc_id", F.posexplode(pages).alias("p", "l"))
    lines = F.array_compact(F.transform("l", lambda x, i: _spec_line(x, F.col("p") * 40 + i)))
    return cut.select("doc_id", (F.col("p") + 1).alias("page_num"), F.array_join(lines, "\n").alias("text"))


_SPEC = r"""raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
spec AS (SELECT doc_id, CAST(i // 40 + 1 AS INTEGER) AS page_num, CAST(i AS INTEGER) AS line_no,
  concat(CASE WHEN i % 7 = 3 THEN concat(i // 49 + 1, '.', (i // 14) % 7 + 1, ' ') ELSE '' END, l2, CASE WHEN i % 5 = 0 THEN ' shall apply.' ELSE '' END) AS line
  FROM (SELECT doc_id, i, regexp_replace(l, '\s+$', '') AS l2 FROM raw) WHERE l2 <> '')"""

_HEADINGS = (
    _SPEC
    + r""", cand AS (SELECT doc_id, page_num, line_no, regexp_extract(line, '^\s*(\d+(?:\.\d+){1,6})\s+(.+?)\s*$', 1) AS number,
  trim(regexp_replace(regexp_extract(line, '^\s*(\d+(?:\.\d+){1,6})\s+(.+?)\s*$', 2), '\.{3,}\s*(?:\.\s*)*\d+\s*$', '')) AS title FROM spec),
heads AS (SELECT doc_id, page_num, line_no, number, title FROM cand WHERE number <> '' AND length(title) >= 2
  AND TRY_CAST(split_part(number, '.', 1) AS INTEGER) <= 2000 AND len(list_filter(string_split(number, '.')[2:], lambda p: length(p) >= 3)) = 0)"""
)

_BLOCKS = (
    _HEADINGS
    + r""", hw AS (SELECT *, list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda w: length(w) >= 3)[1:6] AS words FROM heads),
hit AS (SELECT s.doc_id, s.line_no, h.line_no AS h_no, h.number, h.title FROM spec s JOIN hw h ON s.doc_id = h.doc_id AND s.page_num = h.page_num
  AND starts_with(trim(lower(s.line)), lower(h.number))
  AND (len(h.words) = 0 OR len(list_filter(h.words, lambda w: contains(lower(s.line), w))) >= CASE WHEN len(h.words) <= 2 THEN 1 ELSE 2 END)),
one AS (SELECT doc_id, line_no, arg_min(number, h_no) AS number, arg_min(title, h_no) AS title FROM hit GROUP BY doc_id, line_no),
al AS (SELECT s.*, o.number, o.title FROM spec s LEFT JOIN one o USING (doc_id, line_no)),
filled AS (SELECT doc_id, page_num, line_no, line, coalesce(last_value(number IGNORE NULLS) OVER w, 'UNKNOWN') AS clause_id, last_value(title IGNORE NULLS) OVER w AS title
  FROM al WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
chg AS (SELECT *, CASE WHEN clause_id <> lag(clause_id) OVER (PARTITION BY doc_id ORDER BY line_no) THEN 1 ELSE 0 END AS c FROM filled),
num AS (SELECT *, CAST(sum(c) OVER (PARTITION BY doc_id ORDER BY line_no) AS INTEGER) AS block_i FROM chg),
blocks AS (SELECT doc_id, block_i, clause_id, arg_min(title, line_no) FILTER (WHERE title IS NOT NULL) AS title, min(page_num) AS page_start, max(page_num) AS page_end,
  trim(regexp_replace(string_agg(line, chr(10) ORDER BY line_no), '[ \t]+', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS body FROM num GROUP BY doc_id, block_i, clause_id),
chunks AS (SELECT printf('%s::%s::p%d-%d::b%04d::%04d::%d::%s', CAST(doc_id AS VARCHAR), clause_id, page_start, page_end, block_i, 0, length(body), left(md5(body), 8)) AS chunk_id,
  doc_id, clause_id, CASE WHEN clause_id = 'UNKNOWN' THEN 'UNKNOWN' ELSE trim(clause_id || ' ' || coalesce(title, '')) END AS section_path, body AS text, page_start, page_end FROM blocks WHERE body <> '')"""
)


def spec_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return segment.blocks(segment.marked(spec_lines(spark, sf)))


def spec_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """One chunk a block: chunk_id, doc_id, clause_id, section_path, text, page_start, page_end."""
    b = spec_blocks(spark, sf).where("body != ''")
    number = F.nullif(F.col("clause_id"), F.lit("UNKNOWN"))
    ids = T.chunk_id(F.col("doc_id"), F.col("clause_id"), F.col("page_start"), F.col("page_end"), F.col("block_i"), F.lit(0), F.col("body"))
    return b.select(ids.alias("chunk_id"), "doc_id", "clause_id", T.section_path(number, F.col("title")).alias("section_path"), F.col("body").alias("text"), "page_start", "page_end")


def raw_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Model outputs of six shapes, made from the conversations: conv_id, turn, raw. Quotes hold the turn's letters and digits."""
    k = (F.col("turn") % 4 + 1).cast("string")
    cite = F.concat(F.lit('[{"chunk_id": "c'), F.col("conv_id").cast("string"), F.lit('", "quote": "q'), F.col("turn").cast("string"), F.lit(" "), F.regexp_replace(T.text("text"), "[^A-Za-z0-9]+", " "), F.lit('"}]'))
    clean = F.concat(F.lit('{"answer": "'), k, F.lit('", "citations": '), cite, F.lit("}"))
    shape = F.col("conv_id") % 6
    raw = (
        F.when(shape == 0, clean)
        .when(shape == 1, F.concat(F.lit("```json\n"), clean, F.lit("\n```")))
        .when(shape == 2, F.concat(F.lit("Sure: "), clean, F.lit(" Hope that helps {ok}.")))
        .when(shape == 3, F.concat(F.lit("{answer: '"), k, F.lit("', 'citations': []}")))
        .when(shape == 4, F.concat(F.lit('{"answer": "'), k, F.lit('", "citations": [],}')))
        .otherwise(F.concat(F.lit("Answer: "), k))
    )
    return _t(spark, sf, "conversations").select("conv_id", "turn", raw.alias("raw"))


_RAW = """outs AS (SELECT conv_id, turn, CAST(turn % 4 + 1 AS VARCHAR) AS k, '[{"chunk_id": "c' || conv_id || '", "quote": "q' || turn || ' ' || regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g') || '"}]' AS cite FROM conversations),
raws AS (SELECT conv_id, turn, CASE conv_id % 6 WHEN 0 THEN '{"answer": "' || k || '", "citations": ' || cite || '}'
  WHEN 1 THEN '```json' || chr(10) || '{"answer": "' || k || '", "citations": ' || cite || '}' || chr(10) || '```'
  WHEN 2 THEN 'Sure: {"answer": "' || k || '", "citations": ' || cite || '} Hope that helps {ok}.'
  WHEN 3 THEN '{answer: ''' || k || ''', ''citations'': []}' WHEN 4 THEN '{"answer": "' || k || '", "citations": [],}' ELSE 'Answer: ' || k END AS raw FROM outs)"""


def eval_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = answers.parsed(raw_outputs(spark, sf))
    split = F.element_at(F.array(F.lit("E"), F.lit("M"), F.lit("H")), (F.col("conv_id") % 3 + 1).cast("int"))
    rows = rows.select(split.alias("split"), "conv_id", "turn", (F.col("conv_id") * 100 + F.col("turn")).alias("global_i"), ((F.col("conv_id") + F.col("turn")) % 4 + 1).cast("string").alias("gold"), F.when(F.col("turn") % 9 == 8, "").otherwise(F.col("answer")).alias("answer"), "citations")
    return evaluate.scored(rows)


_EVAL = (
    _RAW
    + """, ev AS (SELECT ['E', 'M', 'H'][conv_id % 3 + 1] AS split, conv_id * 100 + turn AS global_i,
  CASE WHEN turn % 9 = 8 THEN '' ELSE CAST(turn % 4 + 1 AS VARCHAR) END AS pred_num, CAST((conv_id + turn) % 4 + 1 AS VARCHAR) AS gold, CASE WHEN conv_id % 6 <= 2 THEN 1 ELSE 0 END AS citations_count FROM conversations),
scored AS (SELECT *, CASE WHEN pred_num = gold THEN 1.0 ELSE 0.0 END::DOUBLE AS acc FROM ev)"""
)

_TOKENS = r"""flatten(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+(?:[-_/.][A-Za-z0-9]+)*'), lambda t: CASE WHEN regexp_matches(t, '[-_/.]')
  THEN list_concat(list_concat([lower(t)], list_filter(regexp_split_to_array(lower(t), '[-_/.]'), lambda p: p <> '')), [regexp_replace(lower(t), '[-_/.]', '', 'g')]) ELSE [lower(t)] END))"""

_BM25 = f"""dt AS (SELECT doc_id, {_TOKENS} AS toks FROM documents),
dl AS (SELECT doc_id, len(toks) AS dl FROM dt),
sizes AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM dt) GROUP BY ALL),
tdf AS (SELECT term, count(*) AS df FROM post GROUP BY term),
traw AS (SELECT term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS idf FROM tdf, sizes),
tidf AS (SELECT term, df, CASE WHEN idf < 0 THEN 0.25::DOUBLE * (SELECT avg(idf) FROM traw) ELSE idf END AS idf FROM traw)"""

_SCORES = f"""{_BM25},
q AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest({_TOKENS}) AS term FROM asked) GROUP BY ALL),
sc AS (SELECT query_id, doc_id, round(sum(qf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM q JOIN tidf USING (term) JOIN post USING (term) JOIN dl USING (doc_id), sizes GROUP BY query_id, doc_id),
allc AS (SELECT a.query_id, d.doc_id, coalesce(s.score, 0.0::DOUBLE) AS score FROM asked a CROSS JOIN documents d LEFT JOIN sc s ON s.query_id = a.query_id AND s.doc_id = d.doc_id {{where}}),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM allc) WHERE rank <= {{k}})"""


def _bm25(k: int, asked: str = "SELECT item_id AS query_id, text FROM benchmark", where: str = "") -> str:
    return f"asked AS ({asked}), " + _SCORES.replace("{where}", where).replace("{k}", str(k))


def _dense(k: int, where: str = "") -> str:
    return f"""dn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT b.item_id AS query_id, e.vec_id AS doc_id, round(list_inner_product(qe.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score
  FROM benchmark b JOIN embeddings qe ON qe.vec_id = b.item_id CROSS JOIN embeddings e {where})) WHERE rank <= {k})"""


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _lexical(spark: SparkSession, sf: str, k: int, where=None) -> DataFrame:
    return lexical.search(_texts(spark, sf).select("doc_id", "text", "lang", "source"), _asked(spark, sf), k, where)


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    v = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    return v, _asked(spark, sf).join(v.withColumnRenamed("doc_id", "query_id"), "query_id").select("query_id", "embedding")


def _fused(spark: SparkSession, sf: str, **more) -> DataFrame:
    v, q = _vectors(spark, sf)
    return fuse.rrf({"bm25": _lexical(spark, sf, 80), "dense": vector.search(v, q, 80)}, **more)


_FUSED = """fz AS (SELECT query_id, doc_id, round(sum(p), 9) AS score FROM (
  SELECT query_id, doc_id, {wb}::DOUBLE / (60 + rank) AS p FROM bm WHERE rank <= {cb} UNION ALL SELECT query_id, doc_id, {wd}::DOUBLE / (60 + rank) FROM dn WHERE rank <= {cd}) GROUP BY query_id, doc_id),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fz) WHERE rank <= 60)"""


def _fsql(wb: float = 1.0, wd: float = 1.0, cb: int = 80, cd: int = 80) -> str:
    return f"WITH {_bm25(80)}, {_dense(80)}, " + _FUSED.format(wb=wb, wd=wd, cb=cb, cd=cd)


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_KEYS = lambda c: f"list_distinct(list_filter(list_transform(regexp_extract_all({c}, '[A-Za-z0-9][A-Za-z0-9\\-/.]*'), lambda t: lower(t)), lambda t: length(t) >= 3 AND t NOT IN ({_STOP})))"
_RERANKED = (
    f", rr AS (SELECT f.query_id, f.doc_id, round(len(list_intersect({_KEYS('b.text')}, {_KEYS('left(replace(d.text, chr(10), chr(32)), 700)')})) / greatest(1, len({_KEYS('b.text')}))::DOUBLE, 6) AS score"
    " FROM fused f JOIN benchmark b ON b.item_id = f.query_id JOIN documents d USING (doc_id)),"
    " rerank AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM rr) WHERE rank <= 12)"
)


def _reranked(spark: SparkSession, sf: str, fused: DataFrame | None = None) -> DataFrame:
    return fuse.rerank(tables.stored(_fused(spark, sf)) if fused is None else fused, _asked(spark, sf).withColumnRenamed("text", "question"), _t(spark, sf, "documents").select("doc_id", F.col("text").alias("body")))


# ---- retrieval ------------------------------------------------------------------------------------------------------


@query(f"WITH {_bm25(10)} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM bm")
def bm25_topk(spark, sf):
    """The flagship: the ten best documents for every benchmark passage."""
    return _lexical(spark, sf, 10)


@query(f"WITH {_bm25(10, where='WHERE lower(d.lang) = ' + chr(39) + 'en' + chr(39))} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM bm")
def bm25_topk_filtered(spark, sf):
    return _lexical(spark, sf, 10, T.matches({"lang": "EN", "source": ""}, ["doc_id", "text", "lang", "source"]))


@query(f"WITH {_bm25(1)} SELECT term, df, round(idf, 6) AS idf FROM tidf")
def term_stats(spark, sf):
    return lexical.build(_texts(spark, sf)).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_bm25(10)} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM bm")
def bm25_stored_index(spark, sf):
    """bm25_topk over an index that is written and loaded again."""
    path = tables.scratch(spark)
    lexical.build(_texts(spark, sf).select("doc_id", "text")).save(path)
    return lexical.search(_t(spark, sf, "documents"), _asked(spark, sf), 10, index=lexical.Index.load(spark, path))


@query(f"WITH {_bm25(10)} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM bm")
def bm25_shuffled(spark, sf):
    """bm25_topk by the way for more questions than can be broadcast: questions and postings are joined in a shuffle."""
    index = lexical.build(_texts(spark, sf).select("doc_id", "text"))
    return lexical.search(_t(spark, sf, "documents"), _asked(spark, sf), 10, index=index, most_asked=0)


@query(_fsql() + " SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM fused")
def grown_index(spark, sf):
    """rrf_fuse over an index that was made of half the documents and their vectors, to which the others were added; the second
    segment is added twice, with documents of the first among it, which changes nothing."""
    path, docs, v = tables.scratch(spark), _texts(spark, sf).select("doc_id", "text"), _vectors(spark, sf)[0].select("doc_id", "embedding")
    half = F.xxhash64("doc_id") % 2 == 0
    lexical.add(docs.where(half), path, "a", v.where(half))
    for _ in range(2):
        lexical.add(docs, path, "b", v)
    index = lexical.Index.load(spark, path, vectors=True)
    lists = {"bm25": lexical.search(_t(spark, sf, "documents"), _asked(spark, sf), 80, index=index), "dense": vector.search(index.vectors, _vectors(spark, sf)[1], 80)}
    return fuse.rrf(lists)


@query(f"WITH {_dense(10)} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM dn")
def dense_topk(spark, sf):
    v, q = _vectors(spark, sf)
    return vector.search(v, q, 10)


@query(f"WITH {_dense(10, 'WHERE e.label = 3')} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM dn")
def dense_topk_filtered(spark, sf):
    v, q = _vectors(spark, sf)
    return vector.search(v, q, 10, T.matches({"label": "3"}, v.columns))


@query(f"WITH {_dense(10)} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM dn")
def dense_topk_blocked(spark, sf):
    """dense_topk with queries too many to be broadcast, as it were: pairs of blocks."""
    v, q = _vectors(spark, sf)
    return vector.search(v, q, 10, most_numbers=1000)


@query(
    f"""WITH h AS (SELECT doc_id, ('0x' || left(md5(t), 7))::BIGINT AS h FROM (SELECT doc_id, unnest({_TOKENS}) AS t FROM documents)),
  v AS (SELECT doc_id, h % 64 AS slot, sum(1 - 2 * ((h // 1048576) % 2))::DOUBLE AS x FROM h GROUP BY ALL), n AS (SELECT doc_id, sqrt(sum(x * x)) AS n FROM v GROUP BY doc_id)
  SELECT doc_id, CAST(slot AS INTEGER) AS slot, round(CASE WHEN n = 0 THEN x ELSE x / n END, 6) AS value FROM v JOIN n USING (doc_id) WHERE x <> 0"""
)
def embed_hashed(spark, sf):
    """The places that aren't 0 of each document's stand-in embedding."""
    e = vector.hashed(_texts(spark, sf).select("doc_id", "text"))
    return e.select("doc_id", F.posexplode("embedding").alias("slot", "value")).where("value != 0").select("doc_id", "slot", F.round("value", 6).alias("value"))


@query(_fsql() + " SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM fused")
def rrf_fuse(spark, sf):
    return _fused(spark, sf)


@query(_fsql(0.7, 1.3, 20, 10) + " SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM fused")
def rrf_weighted_capped(spark, sf):
    return _fused(spark, sf, weights={"bm25": 0.7, "dense": 1.3}, caps={"bm25": 20, "dense": 10})


@query(_fsql() + _RERANKED + " SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM rerank")
def overlap_rerank(spark, sf):
    return _reranked(spark, sf)


@query(
    _fsql() + """, words AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS q FROM benchmark), sc2 AS (SELECT f.query_id, f.doc_id, round(len(list_intersect(q, list_distinct(regexp_extract_all(lower(d.text), '[a-z0-9]+')))) / greatest(1, len(q))::DOUBLE, 6) AS score FROM fused f JOIN words USING (query_id) JOIN documents d USING (doc_id))
  SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc2) WHERE rank <= 12"""
)
def model_rerank(spark, sf):
    """Reranking through the adapter of pair models, with the stand-in model."""
    bodies = _t(spark, sf, "documents").select("doc_id", F.col("text").alias("body"))
    return fuse.rerank(tables.stored(_fused(spark, sf)), _asked(spark, sf).withColumnRenamed("text", "question"), bodies, scorer=fuse.model_scorer(adapters.SharedWords))


@query(_fsql() + _RERANKED + " SELECT r.query_id, CAST(r.rank AS INTEGER) AS rank, r.doc_id, r.score, d.source, CASE WHEN length(d.text) > 300 THEN left(d.text, 300) || '...' ELSE d.text END AS preview FROM rerank r JOIN documents d USING (doc_id) WHERE rank <= 10")
def hybrid_search(spark, sf):
    hits = _reranked(spark, sf).where("rank <= 10")
    return hits.join(_t(spark, sf, "documents"), "doc_id").select("query_id", "rank", "doc_id", "score", "source", T.preview(F.col("text"), 300).alias("preview"))


@query(_fsql() + _RERANKED + " SELECT b.item_id AS query_id, max(r.score) AS best, coalesce(max(r.score) < 0.25, true) AS fallback FROM benchmark b LEFT JOIN rerank r ON r.query_id = b.item_id GROUP BY b.item_id")
def gate_fallback(spark, sf):
    return fuse.gate(_reranked(spark, sf), _asked(spark, sf), 0.25)


_AUDIT = (
    _fsql() + _RERANKED + f""", cl AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'UNKNOWN' ELSE '4.' || (doc_id % 7) END AS clause_id, trim(left(replace(text, chr(10), chr(32)), 700)) AS snippet FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
  hits AS (SELECT 'fused' AS list, query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM fused UNION ALL SELECT 'reranked', query_id, doc_id, score, CAST(rank AS INTEGER) FROM rerank),
  audited AS (SELECT h.*, c.clause_id, c.snippet, round(len(list_intersect({_KEYS('b.text')}, coalesce({_KEYS('c.snippet')}, []))) / greatest(1, len({_KEYS('b.text')}))::DOUBLE, 6) AS overlap FROM hits h JOIN benchmark b ON b.item_id = h.query_id LEFT JOIN cl c USING (doc_id))"""
)


def _audited(spark: SparkSession, sf: str) -> DataFrame:
    """The hits over all documents, looked up in a chunk table of the labelled ones: what that lacks is told as missing."""
    clause = F.when(F.col("doc_id") % 7 == 0, "UNKNOWN").otherwise(F.concat(F.lit("4."), (F.col("doc_id") % 7).cast("string")))
    chunks = _t(spark, sf, "documents").join(_t(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select("doc_id", clause.alias("clause_id"), "text")
    fused = tables.stored(_fused(spark, sf))  # a few dozen rows a question, for the hits and the reranking
    return evaluate.audit_rows(fused, _reranked(spark, sf, fused), _asked(spark, sf).withColumnRenamed("text", "question"), chunks)


@query(_AUDIT + " SELECT query_id, list, rank, score, doc_id, clause_id, snippet, overlap FROM audited")
def retrieval_audit_rows(spark, sf):
    return _audited(spark, sf)


_HALF = lambda name, own, value: f"round(coalesce(avg({value}) FILTER ({own}), 0), 6) AS {name}_mean, round(coalesce(median({value}) FILTER ({own}), 0), 6) AS {name}_median"


@query(
    _AUDIT + f" SELECT {_HALF('fused', 'list = ' + repr('fused'), 'score')}, {_HALF('fused_overlap', 'list = ' + repr('fused'), 'overlap')}, {_HALF('rerank', 'list <> ' + repr('fused'), 'score')}, {_HALF('rerank_overlap', 'list <> ' + repr('fused'), 'overlap')},"
    " round(avg(CASE WHEN clause_id = 'UNKNOWN' THEN 1 ELSE 0 END) FILTER (list = 'fused'), 6) AS unknown_rate, count(*) FILTER (list = 'fused' AND clause_id IS NULL) AS missing, (SELECT count(*) FROM benchmark) AS questions FROM audited"
)
def retrieval_audit_summary(spark, sf):
    return evaluate.audit(_audited(spark, sf), _asked(spark, sf))


_OWN = "SELECT doc_id AS query_id, concat_ws(chr(10), coalesce(source, ''), coalesce(lang, ''), left(trim(text, ' ' || chr(9) || chr(10) || chr(13)), 400)) AS text FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 100"


@query(f"WITH {_bm25(10, _OWN)}, own AS (SELECT query_id, min(rank) AS rank FROM bm WHERE query_id = doc_id GROUP BY query_id) SELECT count(*) AS queries, round(avg(CASE WHEN rank IS NULL THEN 0 ELSE 1 END), 6) AS hit_rate, round(coalesce(avg(rank), 0), 6) AS mean_rank FROM asked LEFT JOIN own USING (query_id)")
def self_retrieval_bm25(spark, sf):
    """A sample (the feature) of 100 documents, each asked for by its source and language in the place of a title and a clause
    and its own first 400 characters."""
    docs = _texts(spark, sf)
    asked = profile.sampled(docs, "doc_id", 100).select(F.col("doc_id").alias("query_id"), T.self_query(F.col("source"), F.col("lang"), F.col("text")).alias("text"))
    return profile.self_retrieval_with(lambda d, q: lexical.search(d, q, 10), docs, asked)


@query(
    """WITH asked AS (SELECT vec_id AS query_id, embedding FROM embeddings ORDER BY md5('7:' || vec_id), vec_id LIMIT 200),
  s AS (SELECT query_id, vec_id AS doc_id, round(list_inner_product(a.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM asked a CROSS JOIN embeddings e),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s), own AS (SELECT query_id, min(rank) AS rank FROM r WHERE rank <= 10 AND query_id = doc_id GROUP BY query_id)
  SELECT count(*) AS queries, round(avg(CASE WHEN rank IS NULL THEN 0 ELSE 1 END), 6) AS hit_rate, round(coalesce(avg(rank), 0), 6) AS mean_rank FROM asked LEFT JOIN own USING (query_id)"""
)
def self_retrieval_dense(spark, sf):
    v, _ = _vectors(spark, sf)
    asked = profile.sampled(v, "doc_id", 200).select(F.col("doc_id").alias("query_id"), "embedding")
    return profile.self_retrieval_with(lambda d, q: vector.search(d, q, 10), v, asked)


# ---- text -----------------------------------------------------------------------------------------------------------


@query(r"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS line_no, l AS line FROM (SELECT doc_id, i, regexp_replace(l, '\s+$', '') AS l FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)) WHERE l <> ''")
def lines_split(spark, sf):
    pages = _texts(spark, sf).select("doc_id", F.lit(1).alias("page_num"), "text")
    return segment.lines(pages).select("doc_id", "line_no", "line")


@query(r"SELECT doc_id, md5(n) AS hash, length(n) AS n, length(c) AS cleaned FROM (SELECT doc_id, trim(regexp_replace(replace(text, chr(160), ' '), '[ \t]+', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS n, regexp_replace(regexp_replace(replace(text, chr(173), ''), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS c FROM documents)")
def text_normalise(spark, sf):
    n, c = T.normalised(F.col("text")), T.without_artefacts(F.col("text"))
    return _texts(spark, sf).select("doc_id", F.md5(n).alias("hash"), F.length(n).cast("bigint").alias("n"), F.length(c).cast("bigint").alias("cleaned"))


_MARK = " OR ".join(f"contains(low, '{m}')" for m in T.DEFINITION_MARKERS)
_NORM = " OR ".join(f"contains(lower(line), '{m}')" for m in T.NORMATIVE)


@query(
    f"WITH {_SPEC}, x AS (SELECT *, ' ' || lower(trim(line)) || ' ' AS low, trim(line) AS t FROM spec) SELECT doc_id, line_no, CAST(({_NORM}) AS INTEGER) AS is_normative,"
    rf" CAST(({_MARK} OR regexp_matches(left(t, 400), '^[A-Z][A-Za-z0-9/\-\(\)\s]{{1,50}}\s*[:\-–]\s+\S+') OR (regexp_matches(left(t, 400), '^\s*\d+(\.\d+){{0,3}}\s+[A-Z][A-Za-z0-9/\-\(\)\s]{{1,60}}\s*$') AND regexp_matches(low, '\b(is|are|means|refers to|shall mean)\b'))) AS INTEGER) AS is_definition FROM x"
)
def text_flags(spark, sf):
    return spec_lines(spark, sf).select("doc_id", "line_no", T.is_normative(F.col("line")).cast("int").alias("is_normative"), T.is_definition(F.col("line")).cast("int").alias("is_definition"))


_NAME = "'Spec' || CASE page_id % 4 WHEN 0 THEN '.WG' WHEN 1 THEN '-wg ' WHEN 2 THEN '_XWG' ELSE '_' END || (page_id % 13) || CASE page_id % 3 WHEN 0 THEN '_v' WHEN 1 THEN '-V' ELSE '_' END || (page_id % 20) || '.0' || (page_id % 10) || '.pdf'"


@query(
    rf"""WITH n AS (SELECT page_id, {_NAME} AS name FROM pages), x AS (SELECT page_id, name, regexp_extract(name, '(?:^|[^0-9A-Za-z])WG[\s.]*([0-9]{{1,2}})(?:[^0-9A-Za-z]|$)', 1, 'i') AS a, regexp_extract(name, 'WG[\s.]*([0-9]{{1,2}})', 1, 'i') AS b,
  regexp_extract(name, '(?:^|[^0-9A-Za-z])v(\d+\.\d+(?:\.\d+)*)', 1, 'i') AS v, regexp_extract(name, '(?:^|[^0-9A-Za-z])(\d+\.\d+(?:\.\d+)*)', 1) AS p FROM n)
  SELECT page_id, coalesce('WG' || nullif(a, ''), 'WG' || nullif(b, ''), 'UNKNOWN') AS wg, coalesce(nullif(v, ''), nullif(p, ''), 'UNKNOWN') AS version, regexp_replace(name, '\.pdf$', '') AS doc_id FROM x"""
)
def wg_version_from_name(spark, sf):
    i = F.col("page_id")
    s = lambda c: c.cast("string")
    name = F.concat(F.lit("Spec"), F.when(i % 4 == 0, ".WG").when(i % 4 == 1, "-wg ").when(i % 4 == 2, "_XWG").otherwise("_"), s(i % 13), F.when(i % 3 == 0, "_v").when(i % 3 == 1, "-V").otherwise("_"), s(i % 20), F.lit(".0"), s(i % 10), F.lit(".pdf"))
    return _t(spark, sf, "pages").select("page_id", name.alias("name")).select("page_id", T.working_group(F.col("name")).alias("wg"), T.version(F.col("name")).alias("version"), T.document_id(F.col("name")).alias("doc_id"))


@query(f"SELECT doc_id, CAST(len(toks) AS BIGINT) AS n, md5(array_to_string(toks, ' ')) AS hash FROM (SELECT doc_id, {_TOKENS} AS toks FROM documents)")
def domain_tokens(spark, sf):
    return _texts(spark, sf).select("doc_id", T.domain_tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("bigint").alias("n"), F.md5(F.array_join("t", " ")).alias("hash"))


@query(r"SELECT doc_id, CAST(len(t) AS BIGINT) AS n, md5(array_to_string(t, ' ')) AS hash FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9_/\-.]+'), lambda x: lower(x)) AS t FROM documents)")
def simple_tokens(spark, sf):
    return _texts(spark, sf).select("doc_id", T.simple_tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("bigint").alias("n"), F.md5(F.array_join("t", " ")).alias("hash"))


@query(f"SELECT item_id, round(len(list_intersect({_KEYS('b.text')}, {_KEYS('d.text')})) / greatest(1, len({_KEYS('b.text')}))::DOUBLE, 6) AS overlap FROM benchmark b JOIN documents d ON d.doc_id = b.item_id")
def keyword_overlap(spark, sf):
    pairs = _asked(spark, sf).join(_t(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("body")), "query_id")
    return pairs.select(F.col("query_id").alias("item_id"), F.round(T.overlap_ratio(T.keywords(F.col("text")), T.keywords(F.col("body"))), 6).alias("overlap"))


@query(
    """SELECT page_id, md5(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped, length(html) - length(replace(html, chr(10), '')) + 1 AS n_lines,
  CASE WHEN length(html) > 100 THEN left(html, 100) || '...(truncated, len=' || length(html) || ')' ELSE html END AS short, left(replace(html, chr(10), ' '), 700) AS snippet, coalesce(TRY_CAST(regexp_extract(url, '/([0-9]+)', 1) AS INTEGER), -1) AS n FROM pages"""
)
def previews(spark, sf):
    return _t(spark, sf, "pages").select("page_id", F.md5(T.html_escape(F.col("html"))).alias("escaped"), T.line_count(F.col("html")).cast("bigint").alias("n_lines"), T.truncated(F.col("html"), 100).alias("short"), T.snippet(F.col("html")).alias("snippet"), T.safe_int(F.regexp_extract("url", "/([0-9]+)", 1), -1).alias("n"))


# ---- segmentation ---------------------------------------------------------------------------------------------------


@query(rf"WITH {_SPEC}, t AS (SELECT doc_id, page_num, line_no, line || CASE WHEN line_no % 11 = 0 THEN ' ..... ' || (line_no + 1) ELSE '' END AS line FROM spec) SELECT doc_id, line_no, line FROM t WHERE NOT (page_num <= 30 AND regexp_matches(line, '\.{{3,}}\s*(?:\.\s*)*\d+\s*$'))")
def toc_filter(spark, sf):
    dotted = F.when(F.col("line_no") % 11 == 0, F.concat(F.lit(" ..... "), (F.col("line_no") + 1).cast("string"))).otherwise("")
    return segment.without_toc(spec_lines(spark, sf).withColumn("line", F.concat("line", dotted))).select("doc_id", "line_no", "line")


@query(f"WITH {_HEADINGS} SELECT doc_id, page_num, line_no, number, title FROM heads")
def heading_detect(spark, sf):
    return segment.headings(spec_lines(spark, sf))


@query(f"WITH {_BLOCKS} SELECT doc_id, line_no, clause_id, title FROM filled")
def heading_align_ffill(spark, sf):
    filled = segment.filled(segment.marked(spec_lines(spark, sf))).where("line is not null")
    return filled.select("doc_id", "line_no", F.coalesce("h.number", F.lit("UNKNOWN")).alias("clause_id"), F.col("h.title").alias("title"))


@query(f"WITH {_BLOCKS} SELECT doc_id, block_i, clause_id, page_start, page_end, md5(body) AS hash, length(body) AS n FROM blocks")
def clause_blocks(spark, sf):
    return spec_blocks(spark, sf).select("doc_id", "block_i", "clause_id", "page_start", "page_end", F.md5("body").alias("hash"), F.length("body").cast("bigint").alias("n"))


@query(f"WITH {_BLOCKS} SELECT chunk_id, doc_id, section_path FROM chunks")
def chunk_ids(spark, sf):
    return spec_chunks(spark, sf).select("chunk_id", "doc_id", "section_path")


_CUT = r"""flatten(list_transform(list_filter(string_split(regexp_replace(body, '([.?!;:])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> ''), lambda x: CASE WHEN length(x) > 2200
    THEN list_transform(range(0, (length(x) - 1) // 2200 + 1), lambda i: {'out': []::VARCHAR[], 'buf': substr(x, i * 2200 + 1, 2200), 'hard': true}) ELSE [{'out': []::VARCHAR[], 'buf': x, 'hard': false}] END))"""
_FOLD = """list_reduce(parts, lambda a, x: CASE WHEN a.hard OR x.hard OR length(a.buf) + 1 + length(x.buf) > 2200 THEN {'out': list_append(a.out, a.buf), 'buf': x.buf, 'hard': x.hard}
    ELSE {'out': a.out, 'buf': a.buf || ' ' || x.buf, 'hard': false} END)"""


@query(
    rf"""WITH s AS (SELECT doc_id, {_CUT} AS parts FROM (SELECT doc_id, trim(regexp_replace(text, '[ \t]+', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS body FROM documents)),
  f AS (SELECT doc_id, {_FOLD} AS r FROM s WHERE len(parts) > 0), p AS (SELECT doc_id, list_append(r.out, r.buf) AS l FROM f)
  SELECT doc_id, CAST(piece AS INTEGER) AS piece, length(t) AS n, md5(t) AS hash FROM (SELECT doc_id, unnest(l) AS t, unnest(range(len(l))) AS piece FROM p)"""
)
def sentence_pack(spark, sf):
    s = _texts(spark, sf).select("doc_id", segment.packed(segment.sentences(T.normalised(F.col("text")))).alias("p"))
    return s.select("doc_id", F.posexplode("p").alias("piece", "t")).select("doc_id", "piece", F.length("t").cast("bigint").alias("n"), F.md5("t").alias("hash"))


_WHITE = "' ' || chr(9) || chr(10) || chr(13)"
_DEFINES = lambda t: (
    "(" + " OR ".join(f"contains(' ' || lower({t}) || ' ', '{m}')" for m in T.DEFINITION_MARKERS)
    + rf" OR regexp_matches(left({t}, 400), '^[A-Z][A-Za-z0-9/\-\(\)\s]{{1,50}}\s*[:\-–]\s+\S+') OR (regexp_matches(split_part(left({t}, 400), chr(10), 1), '^\s*\d+(\.\d+){{0,3}}\s+[A-Z][A-Za-z0-9/\-\(\)\s]{{1,60}}\s*$') AND regexp_matches(lower({t}), '\b(is|are|means|refers to|shall mean)\b')))"
)
_FRONT = " OR ".join(f"contains(lower(text), '{m}')" for m in T.BOILERPLATE)
_CHUNKS_FULL = (
    _BLOCKS
    + f""", packed AS (SELECT * EXCLUDE (parts), {_FOLD} AS r FROM (SELECT doc_id, block_i, clause_id, title, page_start, page_end, {_CUT} AS parts FROM blocks WHERE body <> '') WHERE len(parts) > 0),
grown AS (SELECT * EXCLUDE (r), list_reduce(list_transform(list_append(r.out, r.buf), lambda x: {{'out': []::VARCHAR[], 'buf': x}}), lambda a, x: CASE WHEN length(a.buf) < 400 THEN {{'out': a.out, 'buf': trim(a.buf || ' ' || x.buf, {_WHITE})}} ELSE {{'out': list_append(a.out, a.buf), 'buf': x.buf}} END) AS r FROM packed),
short AS (SELECT * EXCLUDE (r), list_reduce(list_transform(list_append(r.out, r.buf), lambda x: CASE WHEN trim(x, {_WHITE}) = '' THEN []::VARCHAR[] ELSE [trim(x, {_WHITE})] END), lambda a, x: CASE WHEN len(x) = 0 THEN a
  WHEN len(a) > 0 AND length(x[1]) < 200 AND length(a[-1]) + 1 + length(x[1]) <= 2200 THEN list_append(a[1:len(a) - 1], a[-1] || ' ' || x[1]) ELSE list_concat(a, x) END) AS l FROM grown),
kept AS (SELECT * EXCLUDE (l), list_filter(l, lambda t: length(t) >= 120 OR (length(t) >= 80 AND {_DEFINES('t')})) AS k FROM short),
each AS (SELECT * EXCLUDE (k, piece), trim(regexp_replace(piece, '[ \\t]+', ' ', 'g'), {_WHITE}) AS text FROM (SELECT *, unnest(k) AS piece, unnest(range(len(k))) AS idx FROM kept)),
full_chunks AS (SELECT printf('%s::%s::p%d-%d::b%04d::%04d::%d::%s', CAST(doc_id AS VARCHAR), clause_id, page_start, page_end, block_i, idx, length(text), left(md5(text), 8)) AS chunk_id, CAST(doc_id AS VARCHAR) AS doc_id, 'v1' AS version, 'WG' || (doc_id % 11) AS wg, clause_id,
  CASE WHEN clause_id = 'UNKNOWN' THEN 'UNKNOWN' ELSE trim(clause_id || ' ' || coalesce(title, '')) END AS section_path, coalesce(title, '') AS title, text, page_start, page_end, CAST({_DEFINES('text')} AS INTEGER) AS is_definition,
  CAST(({' OR '.join(f"contains(lower(text), '{m}')" for m in T.NORMATIVE)}) AS INTEGER) AS is_normative FROM each WHERE length(text) >= 80 AND NOT (clause_id = 'UNKNOWN' AND page_end <= 8 AND ({_FRONT} OR (contains(lower(text), 'contents') AND contains(lower(text), 'intellectual property')))))"""
)


@query(f"WITH {_CHUNKS_FULL} SELECT * FROM full_chunks")
def chunks_full(spark, sf):
    """The whole chunk table of the spec view."""
    names = _t(spark, sf, "documents").select("doc_id", F.lit("v1").alias("version"), F.concat(F.lit("WG"), (F.col("doc_id") % 11).cast("string")).alias("wg"))
    return segment.corpus(spec_pages(spark, sf), names)


# ---- context --------------------------------------------------------------------------------------------------------

_NEAR = f"""{_bm25(10)}, seeds AS (SELECT DISTINCT bm.query_id, c.chunk_id FROM bm JOIN chunks c USING (doc_id)),
pos AS (SELECT chunk_id, section_path, row_number() OVER (PARTITION BY section_path ORDER BY chunk_id) AS rn FROM chunks),
near AS (SELECT DISTINCT s.query_id, b.chunk_id FROM seeds s JOIN pos a USING (chunk_id) JOIN pos b ON b.section_path = a.section_path AND b.rn BETWEEN a.rn - 1 AND a.rn + 1)"""


def _near(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The seeds of every benchmark item, all chunks of its ten best documents, with their neighbours. The chunks are written once, as
    seeds, places and texts read them."""
    chunks = tables.stored(spec_chunks(spark, sf))
    seeds = bm25_topk(spark, sf).select("query_id", "doc_id").join(chunks.select("doc_id", "chunk_id"), "doc_id").select("query_id", "chunk_id").distinct()
    return context.neighbours(seeds, chunks), chunks


@query(f"WITH {_BLOCKS}, {_NEAR} SELECT query_id, chunk_id FROM near")
def neighbour_expand(spark, sf):
    return _near(spark, sf)[0]


_TRIM = """trim0 AS (SELECT n.query_id, c.chunk_id, c.text, row_number() OVER w AS place, sum(length(c.text)) OVER (PARTITION BY n.query_id ORDER BY CAST(c.doc_id AS VARCHAR), c.clause_id, c.chunk_id ROWS UNBOUNDED PRECEDING) AS total
  FROM near n JOIN chunks c USING (chunk_id) WINDOW w AS (PARTITION BY n.query_id ORDER BY CAST(c.doc_id AS VARCHAR), c.clause_id, c.chunk_id)), trimmed AS (SELECT query_id, chunk_id, text, place FROM trim0 WHERE total <= 25000 OR place = 1)"""


def _trimmed(spark: SparkSession, sf: str) -> DataFrame:
    near, chunks = _near(spark, sf)
    return context.trimmed(near.join(chunks, "chunk_id").select("query_id", F.col("doc_id").cast("string").alias("doc_id"), "clause_id", "chunk_id", "text"))


@query(f"WITH {_BLOCKS}, {_NEAR}, {_TRIM} SELECT query_id, chunk_id, CAST(place AS INTEGER) AS place FROM trimmed")
def context_trim(spark, sf):
    return _trimmed(spark, sf).select("query_id", "chunk_id", "place")


_HEAD, _MID, _TAIL = (x.replace("'", "''").replace("\n", "' || chr(10) || '") for x in context.TEMPLATE)


@query(f"WITH {_BLOCKS}, {_NEAR}, {_TRIM}, ctx AS (SELECT query_id, string_agg('[chunk_id=' || chunk_id || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY place) AS c FROM trimmed GROUP BY query_id) SELECT item_id AS query_id, md5('{_HEAD}' || b.text || '{_MID}' || coalesce(c, '') || '{_TAIL}') AS hash FROM benchmark b LEFT JOIN ctx ON ctx.query_id = b.item_id")
def prompt_assemble(spark, sf):
    return context.prompts(_asked(spark, sf).withColumnRenamed("text", "question"), _trimmed(spark, sf)).select("query_id", F.md5("prompt").alias("hash"))


# ---- whole plans ----------------------------------------------------------------------------------------------------


ROUNDS, LEAST = 3, 0.2


def _engine(spark: SparkSession, sf: str) -> tuple[ask.Engine, DataFrame]:
    """An engine over whole documents as chunks, sources being sections, with a gate of three rounds; the benchmark's questions."""
    chunks = _texts(spark, sf).select(
        F.col("doc_id").alias("number"), F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("section_path"), F.lit("").alias("clause_id"), F.lit("").alias("title"), "text"
    )
    vectors, _ = _vectors(spark, sf)
    questions = _asked(spark, sf).withColumnRenamed("text", "question").join(vectors.select(F.col("doc_id").alias("query_id"), "embedding"), "query_id", "left")
    config = tables.Config(gate=tables.Gate(min_score=LEAST, max_rounds=ROUNDS))
    return ask.Engine(chunks, vectors.select(F.col("doc_id").cast("string").alias("chunk_id"), "embedding"), config, number="number"), questions


def _longer_words(questions: DataFrame) -> DataFrame:
    """A rewriting that needs no model: the question's words of at least 6 characters, of 8 in the third round."""
    kept = F.filter(F.split("question", " ", -1), lambda w: F.length(w) >= 2 * F.col("round") + 2)
    return questions.select("query_id", F.array_join(kept, " ").alias("question"))


def _rounds_sql(n: int) -> str:
    """All rounds of all questions, as questions of their own (4 * item_id + round), then each question's last one."""
    worded = f"SELECT item_id * 4 + r AS query_id, CASE WHEN r = 1 THEN text ELSE array_to_string(list_filter(string_split(text, ' '), lambda w: length(w) >= 2 * r + 2), ' ') END AS text FROM benchmark, range(1, {n + 1}) t(r)"
    return f"""WITH {_bm25(80, worded)}, dn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT a.query_id, e.vec_id AS doc_id, round(list_inner_product(qe.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score
  FROM asked a JOIN embeddings qe ON qe.vec_id = a.query_id // 4 CROSS JOIN embeddings e WHERE e.vec_id IN (SELECT doc_id FROM documents))) WHERE rank <= 80), {_FUSED.format(wb=1.0, wd=1.0, cb=80, cd=80)},
rr AS (SELECT f.query_id, f.doc_id, round(len(list_intersect({_KEYS('a.text')}, {_KEYS("left(replace(regexp_replace(d.text, '^\\s+|\\s+$', '', 'g'), chr(10), chr(32)), 700)")})) / greatest(1, len({_KEYS('a.text')}))::DOUBLE, 6) AS score
  FROM fused f JOIN asked a USING (query_id) JOIN documents d USING (doc_id)),
rerank AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM rr) WHERE rank <= 12),
gates AS (SELECT a.query_id // 4 AS item, a.query_id % 4 AS r, a.text AS query, max(score) AS best, coalesce(max(score) < {LEAST}, true) AS fallback FROM asked a LEFT JOIN rerank USING (query_id) GROUP BY ALL),
ended AS (SELECT item, coalesce(min(r) FILTER (NOT fallback), {n}) AS r FROM gates GROUP BY item),
outcome AS (SELECT g.* FROM gates g JOIN ended USING (item, r)),
seeds AS (SELECT item, doc_id FROM outcome o JOIN rerank k ON k.query_id = o.item * 4 + o.r WHERE rank <= {{k}}),
tops AS (SELECT o.item, (SELECT string_agg(doc_id, ',' ORDER BY rank) FROM fused f WHERE f.query_id = o.item * 4 + o.r AND rank <= 5) AS fused_top, (SELECT string_agg(doc_id, ',' ORDER BY rank) FROM rerank f WHERE f.query_id = o.item * 4 + o.r AND rank <= 5) AS reranked_top FROM outcome o),
pos AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY CAST(doc_id AS VARCHAR)) AS rn FROM documents WHERE source <> ''),
near AS (SELECT DISTINCT s.item, coalesce(b.doc_id, s.doc_id) AS doc_id FROM seeds s LEFT JOIN pos a USING (doc_id) LEFT JOIN pos b ON b.source = a.source AND b.rn BETWEEN a.rn - 1 AND a.rn + 1),
placed AS (SELECT n.item, d.doc_id, d.text, row_number() OVER w AS place, sum(length(d.text)) OVER w AS total FROM near n JOIN documents d USING (doc_id) WHERE d.text <> ''
  WINDOW w AS (PARTITION BY n.item ORDER BY CAST(d.doc_id AS VARCHAR) ROWS UNBOUNDED PRECEDING)),
kept AS (SELECT * FROM placed WHERE total <= 25000 OR place = 1),
ctx AS (SELECT item, string_agg('[chunk_id=' || doc_id || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY place) AS c FROM kept GROUP BY item),
cited AS (SELECT item, CAST(doc_id AS VARCHAR) AS chunk_id, trim(left(string_split(text, chr(10))[1], 120)) AS quote FROM kept WHERE place = 1)"""


def _tops(c: str):
    return F.array_join(F.transform(c, lambda x: x["chunk_id"]), ",").alias(c)


@query(_rounds_sql(ROUNDS).format(k=5) + " SELECT item AS query_id, CAST(r AS INTEGER) AS round, query, best, fallback FROM outcome")
def gate_rounds(spark, sf):
    """The gate's loop over the hybrid search: one, two or three rounds, questions that pass leave it."""
    engine, questions = _engine(spark, sf)
    last = engine.gated(questions, rewrite=_longer_words)
    return last.gates.join(last.asked, "query_id").select("query_id", "round", "query", "best", "fallback")


@query(_rounds_sql(ROUNDS).format(k=5) + " SELECT o.item AS query_id, '1' AS answer, c.chunk_id, c.quote, 'clean' AS mode, o.fallback FROM outcome o LEFT JOIN cited c USING (item)")
def ask_answers(spark, sf):
    """Answers of the deterministic model after the gate's loop, with the chunk that each cites."""
    engine, questions = _engine(spark, sf)
    one = F.get("citations", F.lit(0))
    return engine.ask(questions, rewrite=_longer_words).select("query_id", "answer", one["chunk_id"].alias("chunk_id"), one["quote"].alias("quote"), "mode", "fallback")


@query(
    _rounds_sql(ROUNDS).format(k=5) + f" SELECT o.item AS query_id, CAST(o.r AS INTEGER) AS round, o.query, t.fused_top, t.reranked_top, '1' AS answer, md5('{_HEAD}' || b.text || '{_MID}' || coalesce(c.c, '') || '{_TAIL}') AS prompt_hash FROM outcome o JOIN tops t USING (item) JOIN benchmark b ON b.item_id = o.item LEFT JOIN ctx c USING (item)"
)
def ask_logged(spark, sf):
    """What happened on the way to each answer: its last round, the first hits before and after reranking, the whole prompt's digest."""
    engine, questions = _engine(spark, sf)
    out = engine.logged(questions, max_prompt=2**31 - 1, rewrite=_longer_words)
    return out.select("query_id", "round", "query", _tops("fused_top"), _tops("reranked_top"), "answer", F.md5("prompt").alias("prompt_hash"))


@query(_rounds_sql(1).format(k=10) + " SELECT o.item AS query_id, '1' AS pred_num, CASE WHEN o.item % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS acc, t.fused_top, t.reranked_top, c.chunk_id FROM outcome o JOIN tops t USING (item) LEFT JOIN cited c USING (item)")
def ask_mini(spark, sf):
    """The benchmark as multiple-choice examples of two options, answered without the gate and scored."""
    engine, questions = _engine(spark, sf)
    examples = questions.withColumns({"options": F.array(F.lit("1. yes"), F.lit("2. no")), "gold": (F.col("query_id") % 2 + 1).cast("string")})
    return engine.mini(examples).select("query_id", "pred_num", "acc", _tops("fused_top"), _tops("reranked_top"), F.get("citations", F.lit(0))["chunk_id"].alias("chunk_id"))


# ---- answers and evaluation -----------------------------------------------------------------------------------------


@query(f"WITH {_RAW} SELECT conv_id, turn, regexp_extract(raw, '(?i)answer[\"'':\\s]+([0-9]+)', 1) AS answer, CASE WHEN contains(raw, '\"chunk_id\"') THEN 1 ELSE 0 END AS n_citations, CASE WHEN length(q) > 260 THEN rtrim(left(q, 260)) || '…' ELSE q END AS quote FROM (SELECT *, trim(regexp_extract(raw, '\"quote\": \"([^\"]*)\"', 1)) AS q FROM raws)")
def parse_answers(spark, sf):
    p = answers.parsed(raw_outputs(spark, sf))
    return p.select("conv_id", "turn", "answer", F.size("citations").alias("n_citations"), F.coalesce(F.get("citations", F.lit(0))["quote"], F.lit("")).alias("quote"))


@query(r"SELECT conv_id, turn, CASE WHEN regexp_matches(t, '^\d+$') THEN t ELSE regexp_extract(t, '\b([1-9][0-9]?)\b', 1) END AS option FROM (SELECT conv_id, turn, trim(text) AS t FROM conversations)")
def parse_option(spark, sf):
    return _t(spark, sf, "conversations").select("conv_id", "turn", answers.option_number(F.col("text")).alias("option"))


@query(f"WITH {_RAW} SELECT CASE WHEN conv_id % 6 = 0 THEN 'clean' WHEN conv_id % 6 = 5 THEN 'salvaged' ELSE 'extracted_or_fixed' END AS mode, count(*) AS n, CAST(0 AS BIGINT) AS empty, CAST(sum(CASE WHEN conv_id % 6 <= 2 THEN 1 ELSE 0 END) AS BIGINT) AS cited FROM raws GROUP BY 1")
def parse_mode_histogram(spark, sf):
    return evaluate.outcomes(answers.parsed(raw_outputs(spark, sf)))


@query(
    r"""WITH r AS (SELECT conv_id, turn, trim(CASE conv_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'Answer: ' || (turn + 1) WHEN 2 THEN 'short' WHEN 3 THEN 'Output ONLY the query ' || turn ELSE replace(coalesce(text, ''), chr(10), ' ') || ' interface' END) AS t FROM conversations)
  SELECT conv_id, turn, CASE WHEN t = '' THEN 'empty' WHEN regexp_matches(t, 'USER QUESTION:|Output ONLY|Rewrite the user''s question', 'i') THEN 'prompt_echo' WHEN regexp_matches(t, '^\(?\s*([1-9]|10)\s*\)?$') OR (regexp_matches(t, '^(answer|final|option)', 'i') AND regexp_matches(t, '[0-9]')) THEN 'looks_like_answer' WHEN length(t) < 12 THEN 'too_short' ELSE '' END AS reason FROM r"""
)
def rewrite_guards(spark, sf):
    k = F.col("conv_id") % 5
    t = F.when(k == 0, "").when(k == 1, F.concat(F.lit("Answer: "), (F.col("turn") + 1).cast("string"))).when(k == 2, "short").when(k == 3, F.concat(F.lit("Output ONLY the query "), F.col("turn").cast("string"))).otherwise(F.concat(F.replace(T.text("text"), F.lit("\n"), F.lit(" ")), F.lit(" interface")))
    return _t(spark, sf, "conversations").select("conv_id", "turn", answers.rewrite_fault(t).alias("reason"))


_REASON = """CASE WHEN t = '' THEN 'empty' WHEN regexp_matches(t, 'USER QUESTION:|Output ONLY|Rewrite the user''s question', 'i') THEN 'prompt_echo' WHEN regexp_matches(t, '^\\(?\\s*([1-9]|10)\\s*\\)?$') OR (regexp_matches(t, '^(answer|final|option)', 'i') AND regexp_matches(t, '[0-9]')) THEN 'looks_like_answer' WHEN length(t) < 12 THEN 'too_short' WHEN t = question THEN 'same_as_original' ELSE '' END"""


@query(
    rf"""WITH r AS (SELECT conv_id, turn, 'what is interface ' || conv_id AS question, CASE conv_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'interface ' || (turn + 1) || ' of the unit' WHEN 2 THEN 'short' WHEN 3 THEN 'Output ONLY the query ' || turn ELSE 'what is interface ' || conv_id END AS t FROM conversations),
  o AS (SELECT *, {_REASON} AS reject_reason FROM r) SELECT conv_id, turn, t AS clean, reject_reason = '' AS used, reject_reason, CASE WHEN reject_reason = '' THEN t ELSE question END AS question FROM o"""
)
def rewrite_record(spark, sf):
    """Rewritings of five shapes, each in quotes on the second line, with what becomes of them."""
    i, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    k = F.col("conv_id") % 5
    question = F.concat(F.lit("what is interface "), i)
    line = F.when(k == 0, "").when(k == 1, F.concat(F.lit("interface "), (F.col("turn") + 1).cast("string"), F.lit(" of the unit"))).when(k == 2, "short").when(k == 3, F.concat(F.lit("Output ONLY the query "), turn)).otherwise(question)
    raw = F.when(line == "", "").otherwise(F.concat(F.lit("\n'"), line, F.lit("'\nmore")))
    return _t(spark, sf, "conversations").select("conv_id", "turn", T.computed(answers.rewrite_outcome(raw, question)).alias("r")).select("conv_id", "turn", "r.clean", "r.used", "r.reject_reason", "r.question")


_SHAPED = """CASE conv_id % 8 WHEN 0 THEN '{"answer": "1", "citations": [{"chunk_id": "c", "quote": "q"}]}' WHEN 1 THEN '{"answer": 1, "citations": []}' WHEN 2 THEN '{"answer": "1", "citations": [{"chunk_id": 1, "quote": "q"}]}' WHEN 3 THEN '{"answer": "1", "citations": [{"id": "c"}]}'
  WHEN 4 THEN '{"citations": [], "ans": "1"}' WHEN 5 THEN '["answer"]' WHEN 6 THEN '{"answer": "1", "citations": ["c", 2]}' ELSE '{"answer": "1", "citations": "none"}' END"""


@query(f"SELECT conv_id, turn, ['ok', 'answer_not_str', 'cite_val_not_str', 'cite_bad_keys', 'bad_keys=[''ans'', ''citations'']', 'not_dict', 'cite_not_dict', 'citations_not_list'][conv_id % 8 + 1] AS fault FROM (SELECT conv_id, turn, {_SHAPED} AS raw FROM conversations)")
def schema_faults(spark, sf):
    """Objects of eight shapes and what is wrong with them."""
    return _t(spark, sf, "conversations").select("conv_id", "turn", answers.schema_fault(F.expr(_SHAPED)).alias("fault"))


@query(
    f"""WITH {_RAW}, m AS (SELECT conv_id, CASE WHEN conv_id % 6 = 0 THEN 'clean' WHEN conv_id % 6 = 5 THEN 'salvaged' ELSE 'extracted_or_fixed' END AS mode FROM raws)
  SELECT count(*) AS total, count(*) AS schema_ok, CAST(0 AS BIGINT) AS schema_fail, count(*) FILTER (mode = 'clean') AS clean, count(*) FILTER (mode = 'extracted_or_fixed') AS extracted_or_fixed, count(*) FILTER (mode = 'salvaged') AS salvaged, CAST(0 AS BIGINT) AS empty_raw, CAST(0 AS BIGINT) AS answer_missing, 1.0::DOUBLE AS schema_ok_rate, 0.0::DOUBLE AS answer_missing_rate FROM m"""
)
def parser_report(spark, sf):
    return evaluate.parser_report(answers.parsed(raw_outputs(spark, sf)))


@query(
    f"""WITH {_BLOCKS}, c AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'none' ELSE chunk_id END AS chunk_id, CASE WHEN doc_id % 2 = 0 THEN left(text, 20) ELSE 'no such quote' END AS quote FROM chunks)
  SELECT c.id, c.chunk_id, c.quote, k.text IS NOT NULL AS known, coalesce(contains(k.text, c.quote) AND c.quote <> '', false) AS supported FROM c LEFT JOIN chunks k USING (chunk_id)"""
)
def citation_verify(spark, sf):
    chunks = tables.stored(spec_chunks(spark, sf))  # cited and looked up
    i = F.col("doc_id")
    cite = F.struct(F.when(i % 3 == 0, "none").otherwise(F.col("chunk_id")).alias("chunk_id"), F.when(i % 2 == 0, F.left("text", F.lit(20))).otherwise("no such quote").alias("quote"))
    return answers.verified(chunks.select(i.alias("id"), F.array(cite).alias("citations")), chunks)


@query(f"WITH {_EVAL} SELECT split, count(*) AS n, round(avg(acc), 6) AS acc, round(avg(citations_count), 6) AS avg_citations FROM scored GROUP BY split")
def eval_accuracy_by_split(spark, sf):
    return evaluate.by_split(eval_rows(spark, sf))


@query(f"WITH {_EVAL} SELECT coalesce(split, 'ALL') AS split, count(*) AS n, round(avg(acc), 6) AS acc, round(avg(citations_count), 6) AS avg_citations FROM scored GROUP BY ROLLUP (split)")
def eval_micro_rollup(spark, sf):
    return evaluate.micro(eval_rows(spark, sf))


@query(
    f"""WITH {_EVAL}, sh AS (SELECT split, global_i % 4 AS shard_id, count(*) AS n, round(avg(acc), 6) AS acc, round(avg(citations_count), 6) AS avg_citations FROM scored GROUP BY 1, 2)
  SELECT coalesce(split, 'ALL') AS split, CAST(sum(n) AS BIGINT) AS n, round(sum(acc * n) / sum(n), 6) AS acc, round(sum(avg_citations * n) / sum(n), 6) AS avg_citations FROM sh GROUP BY ROLLUP (split)"""
)
def eval_shard_merge(spark, sf):
    rows = eval_rows(spark, sf).withColumn("shard_id", F.col("global_i") % 4)
    return evaluate.merged(evaluate.by_split(rows, "shard_id"))


@query(f"WITH {_EVAL} SELECT split, global_i, pred_num, acc FROM scored WHERE global_i % 4 = 1")
def eval_shard(spark, sf):
    """The rows of one of four shards (the feature)."""
    return evaluate.shard(eval_rows(spark, sf), 1, 4).select("split", "global_i", "pred_num", "acc")


@query(f"WITH {_EVAL} SELECT split, global_i, pred_num, acc FROM scored WHERE global_i >= 250 AND global_i < 250 + 400")
def range_slice(spark, sf):
    """The rows numbered 250 to 649 (the feature)."""
    return evaluate.ranged(eval_rows(spark, sf), 250, 400).select("split", "global_i", "pred_num", "acc")


@query(
    f"""WITH {_EVAL}, twice AS (SELECT split, acc, citations_count FROM scored UNION ALL SELECT 'ALL', acc, citations_count FROM scored)
  SELECT split, count(*) AS n, count(*) FILTER (acc = 1) AS correct, count(*) FILTER (acc <> 1) AS failed, count(*) FILTER (citations_count >= 2) AS well_cited, concat_ws(',', '0:' || nullif(count(*) FILTER (citations_count = 0), 0), '1:' || nullif(count(*) FILTER (citations_count = 1), 0)) AS citations FROM twice GROUP BY split"""
)
def eval_breakdown(spark, sf):
    shown = F.array_join(F.transform(F.map_entries("citations"), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))), ",")
    return evaluate.breakdown(eval_rows(spark, sf)).withColumn("citations", shown)


@query(f"WITH {_EVAL} SELECT split, count(*) AS n, round(avg(CASE WHEN pred_num = '' THEN 1 ELSE 0 END), 6) AS missing_rate FROM scored GROUP BY split")
def missing_answer_rate(spark, sf):
    return evaluate.missing_rate(eval_rows(spark, sf))


_MCQ = """mc AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN '["Question ' || item_id || ' ?", [" 1. a ", "2. b"], "' || (item_id % 2 + 1) || '"]' WHEN 1 THEN '{"question": "Question ' || item_id || ' ?", "options": ["1. a", "2. b"], "answer": ' || (item_id % 2 + 1) || '}'
  WHEN 2 THEN '{"question": "Question ' || item_id || ' ?", "choices": "only", "label": "1"}' ELSE '{"question": "", "options": [], "answer": "1"}' END AS line FROM benchmark)"""


@query(f"WITH {_MCQ} SELECT item_id, 'Question ' || item_id || ' ?' AS question, CASE WHEN item_id % 4 = 2 THEN 'only' ELSE '1. a|2. b' END AS options, CASE WHEN item_id % 4 = 2 THEN '1' ELSE CAST(item_id % 2 + 1 AS VARCHAR) END AS answer FROM mc WHERE item_id % 4 <> 3")
def mcq_scan(spark, sf):
    i, s = F.col("item_id"), lambda c: c.cast("string")
    q = F.concat(F.lit("Question "), s(i), F.lit(" ?"))
    line = (
        F.when(i % 4 == 0, F.concat(F.lit('["'), q, F.lit('", [" 1. a ", "2. b"], "'), s(i % 2 + 1), F.lit('"]')))
        .when(i % 4 == 1, F.concat(F.lit('{"question": "'), q, F.lit('", "options": ["1. a", "2. b"], "answer": '), s(i % 2 + 1), F.lit("}")))
        .when(i % 4 == 2, F.concat(F.lit('{"question": "'), q, F.lit('", "choices": "only", "label": "1"}')))
        .otherwise('{"question": "", "options": [], "answer": "1"}')
    )
    return tables.parse_mcq(_t(spark, sf, "benchmark").select("item_id", line.alias("line"))).select("item_id", "question", F.array_join("options", "|").alias("options"), "answer")


# ---- profile and store ----------------------------------------------------------------------------------------------


@query(
    "WITH v AS (SELECT list_sort(list(length(text))) AS l, count(*) AS n, avg(length(text)) AS a, median(length(text)) AS m FROM documents) SELECT n, round(a, 6) AS avg, m AS med,"
    " l[CAST(round_even((n - 1) * 0.1::DOUBLE, 0) AS INTEGER) + 1] AS p10, l[CAST(round_even((n - 1) * 0.9::DOUBLE, 0) AS INTEGER) + 1] AS p90, l[1] AS minv, l[-1] AS maxv FROM v"
)
def length_stats(spark, sf):
    return profile.summary(_t(spark, sf, "documents"), F.length("text").cast("bigint"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 20")
def top_values(spark, sf):
    return profile.top_values(_t(spark, sf, "documents"), "source")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE length(text) = 0) AS empty, count(*) FILTER (WHERE length(text) BETWEEN 1 AND 199) AS too_short, count(*) FILTER (WHERE length(text) > 4000) AS too_long, round(100 * count(*) FILTER (WHERE length(text) BETWEEN 1 AND 199) / greatest(1, count(*))::DOUBLE, 6) AS too_short_pct FROM documents")
def quality_buckets(spark, sf):
    return profile.buckets(_t(spark, sf, "documents"))


@query("SELECT bucket, doc_id, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id) AS place FROM (SELECT doc_id, CASE WHEN length(text) < 200 THEN 'short' WHEN length(text) > 4000 THEN 'long' END AS bucket FROM documents) WHERE bucket IS NOT NULL) WHERE place <= 20")
def bucket_samples(spark, sf):
    n = F.length("text")
    return profile.samples(_t(spark, sf, "documents").select("doc_id", "text"), F.when(n < 200, "short").when(n > 4000, "long"), "doc_id").select("bucket", "doc_id", "place")


@query("SELECT user_id, count(*) AS n, count(*) - 1 AS extra FROM events GROUP BY user_id HAVING count(*) > 1")
def dup_ids(spark, sf):
    return profile.duplicate_ids(_t(spark, sf, "events"), "user_id")


_STRIP = r"trim(text, ' ' || chr(9) || chr(10) || chr(13))"


@query(f"SELECT md5({_STRIP}) AS hash, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) >= 3")
def dup_text_groups(spark, sf):
    return profile.duplicate_texts(_t(spark, sf, "documents"))


@query(f"SELECT hash, doc_id, CAST(place AS INTEGER) AS place FROM (SELECT md5({_STRIP}) AS hash, doc_id, row_number() OVER (PARTITION BY md5({_STRIP}) ORDER BY doc_id) AS place, count(*) OVER (PARTITION BY md5({_STRIP})) AS n FROM documents) WHERE n >= 3 AND place <= 10")
def dup_text_samples(spark, sf):
    return profile.duplicate_samples(_t(spark, sf, "documents"), "doc_id").select("hash", "doc_id", "place")


@query(f"WITH {_BLOCKS} SELECT clause_id, count(*) AS n FROM chunks WHERE clause_id <> 'UNKNOWN' GROUP BY clause_id HAVING count(*) >= 40")
def clause_exploded(spark, sf):
    return profile.exploded_clauses(spec_chunks(spark, sf))


@query("SELECT 'left_only' AS side, doc_id FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'right_only', doc_id FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def coverage_diff(spark, sf):
    return profile.coverage(_t(spark, sf, "documents"), _t(spark, sf, "labels"), "doc_id")


@query("SELECT doc_id, md5(text) AS hash, lang FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, md5(text || ' (new)'), lang FROM documents WHERE doc_id % 3 = 0")
def upsert_chunks(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id", "text", "lang")
    one = docs.where("doc_id % 3 = 0").withColumn("v", F.lit(1)).unionByName(docs.where("doc_id % 3 = 0").withColumns({"text": F.concat("text", F.lit(" (new)")), "v": F.lit(2)}))
    return tables.upsert(docs.withColumn("v", F.lit(0)), one, "doc_id", F.col("v")).select("doc_id", F.md5("text").alias("hash"), "lang")


@query("SELECT (SELECT count(*) FROM documents) AS left_rows, (SELECT count(*) FROM labels) AS right_rows, (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS missing, (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) AS extra")
def coverage_counts(spark, sf):
    return profile.coverage_counts(_t(spark, sf, "documents"), _t(spark, sf, "labels"), "doc_id")


def _stored_chunks(spark: SparkSession, sf: str, chunks: DataFrame | None = None) -> DataFrame:
    """The chunks of the spec view, through a store: created, filled, and upserted with other texts of the even documents. chunks:
    those of the spec view, written, where they are at hand."""
    kept = store.Store(spark, tables.scratch(spark), "chunk_id string, doc_id bigint, clause_id string, section_path string, text string, page_start int, page_end int").create()
    chunks = tables.stored(spec_chunks(spark, sf)) if chunks is None else chunks
    return kept.upsert(chunks).upsert(chunks.where("doc_id % 2 = 0").withColumn("text", F.concat("text", F.lit(" (new)")))).read()


_STORED = f"{_BLOCKS}, stored AS (SELECT chunk_id, doc_id, clause_id, section_path, CASE WHEN doc_id % 2 = 0 THEN text || ' (new)' ELSE text END AS text, page_start, page_end FROM chunks)"


@query(f"WITH {_STORED} SELECT doc_id, count(*) AS n FROM stored GROUP BY doc_id")
def store_counts(spark, sf):
    return store.per_document(_stored_chunks(spark, sf))


@query(f"WITH {_STORED} SELECT w.chunk_id, s.clause_id, md5(s.text) AS hash, s.chunk_id IS NULL AS missing FROM (SELECT CASE WHEN doc_id % 5 = 0 THEN chunk_id || '?' ELSE chunk_id END AS chunk_id FROM chunks) w LEFT JOIN stored s USING (chunk_id)")
def store_lookup(spark, sf):
    """Every chunk by its id, with some ids that there aren't."""
    chunks = tables.stored(spec_chunks(spark, sf))
    wanted = chunks.select(F.when(F.col("doc_id") % 5 == 0, F.concat("chunk_id", F.lit("?"))).otherwise(F.col("chunk_id")).alias("chunk_id"))
    return store.by_id(_stored_chunks(spark, sf, chunks), wanted).select("chunk_id", "clause_id", F.md5("text").alias("hash"), "missing")


@query(f"WITH {_STORED} SELECT section_path, chunk_id, md5(text) AS hash FROM stored WHERE section_path IN (SELECT section_path FROM chunks WHERE doc_id = 3)")
def store_sections(spark, sf):
    """The chunks of all sections that document 3 has."""
    chunks = tables.stored(spec_chunks(spark, sf))
    return store.in_sections(_stored_chunks(spark, sf, chunks), chunks.where("doc_id = 3")).select("section_path", "chunk_id", F.md5("text").alias("hash"))


@query(
    f"""WITH {_CHUNKS_FULL}, t AS (SELECT md5(trim(text, {_WHITE})) AS h, count(*) AS n FROM full_chunks GROUP BY 1 HAVING count(*) >= 3)
  SELECT count(*) AS chunks, CAST(0 AS BIGINT) AS empty, count(*) FILTER (length(text) < 200) AS too_short, count(*) FILTER (length(text) > 4000) AS too_long, count(*) FILTER (clause_id = 'UNKNOWN') AS unknown_clause, coalesce(sum(is_definition), 0)::BIGINT AS definitions, coalesce(sum(is_normative), 0)::BIGINT AS normative,
  count(*) - count(DISTINCT chunk_id) AS duplicate_ids, (SELECT coalesce(sum(least(n, 10)), 0)::BIGINT FROM t) AS repeated_texts FROM full_chunks"""
)
def chunk_report_flags(spark, sf):
    return reports.chunk_flags(chunks_full(spark, sf))
