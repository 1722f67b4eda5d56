"""The registered queries of this subpackage and, where SQL can express them, their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import ann, exactdup, htmltext, infill, linededup, mixing, neardup, packing, pii, rules, urls, weaklabel
from quarry.llm.common import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.plan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", "text", F.size("removed").cast("bigint").alias("n_removed"), spans.alias("removed"))


def op3_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels table's ids are taken as page ids: quality 1 is a good page."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), outcomes).select("page_id", "host", "path", "rule", "verdict")


def op5_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"), k=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *_base_spans(), pii.listed(F.col("pii")).alias("spans"))


def _base_spans() -> list[Column]:
    base = F.filter("pii", lambda s: s["k"] < len(pii.BASE))
    counts = [F.size(F.filter("pii", _of_kind(k))).cast("bigint").alias(f"n_{k}") for k in pii.BASE]
    return [*counts, F.sha2(pii.listed(base).cast("binary"), 256).alias("base_sha256")]


def op7_ivfpq_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = htmltext.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = rules.judge(documents, rules.fit(documents, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weaklabel.classified(table(spark, sf_dir, "documents"), carry=["doc_id"]).select("doc_id", "votes", F.round("posterior", 9).alias("posterior"), F.round("score", 9).alias("score"), "kept")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.marked(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of the outputs and of the texts rebuilt from them."""
    out = infill.transformed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c, 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(infill.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op1_mix_sources aims at: each document's size, its source's size and target."""
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", F.round("target", 3).alias("target"))


def personal_data_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6_personal_data's base spans alone."""
    return pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *_base_spans())


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9_quality_rules's statistics and base rule alone."""
    judged = rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), rules.DecisionList())
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources,
        op2_lexical_packing,
        op3_url_reputation,
        op4_line_dedup,
        op5_minhash_groups,
        op6_personal_data,
        op7_ivfpq_neighbours,
        op8_main_text,
        op9_quality_rules,
        op10_weak_labels,
        op11_exact_dedup,
        op12_fill_in_middle,
        mix_targets,
        personal_data_base,
        quality_base,
    )
}


def _level(level: str, above: str | None) -> str:
    """The statements for one level of the shrinkage: sums, prior strength, posterior."""
    up = "(SELECT m FROM total)" if above is None else "u.up"
    join = "" if above is None else f" JOIN {above}_m u USING ({above})"
    return f"""
{level}_s AS (SELECT {level}{"" if above is None else ", " + above}, sum(n) AS n, sum(g) AS g FROM hd GROUP BY ALL),
{level}_u AS (SELECT s.*, {up} AS up FROM {level}_s s{join}),
{level}_k AS (SELECT 1 / least(0.5::DOUBLE, greatest(0.001::DOUBLE, coalesce(sum(n * pow(g / n - up, 2) - up * (1 - up)) / nullif(sum((n - 1) * up * (1 - up)), 0), 0.001::DOUBLE))) - 1 AS k FROM {level}_u),
{level}_ab AS (SELECT {level} AS name, g + k * up AS a, n - g + k * (1 - up) AS b FROM {level}_u, {level}_k),
{level}_m AS (SELECT name AS {level}, a / (a + b) AS up FROM {level}_ab),
{level}_p AS (SELECT name, a / (a + b) + 2 * sqrt(a * b / (pow(a + b, 2) * (a + b + 1))) AS upper FROM {level}_ab)"""


_RULED = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in sorted(urls.RULES, key=lambda r: -len(r[1] + r[2])))
_SAYS = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for v, h, p in urls.RULES)
ORACLE_SQL: dict[str, str] = {
    "op3_url_reputation": rf"""WITH hp AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
seen AS (SELECT doc_id AS page_id, count(*) AS n, sum(quality)::DOUBLE AS g FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
hosts AS (SELECT host, sum(n)::DOUBLE AS n, sum(g) AS g FROM hp JOIN seen USING (page_id) GROUP BY host),
hd AS (SELECT *, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix FROM hosts),
total AS (SELECT sum(n) AS n, sum(g) AS g, sum(g) / sum(n) AS m FROM hosts),
all_p AS (SELECT m + 2 * sqrt(g * (n - g) / (n * n * (n + 1))) AS upper FROM total),{_level("suffix", None)},{_level("domain", "suffix")},{_level("host", "domain")},
judged AS (SELECT hp.*, CASE {_RULED} END AS rule, coalesce(h.upper, d.upper, s.upper, (SELECT upper FROM all_p)) AS upper FROM hp LEFT JOIN host_p h ON h.name = hp.host
  LEFT JOIN domain_p d ON d.name = array_to_string(string_split(hp.host, '.')[-2:], '.') LEFT JOIN suffix_p s ON s.name = string_split(hp.host, '.')[-1])
SELECT page_id, host, path, rule, CASE rule {_SAYS} ELSE CASE WHEN upper < 0.5 THEN 'block' ELSE 'allow' END END AS verdict FROM judged""",
    "mix_targets": r"""WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
per AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, 3 * source_size::DOUBLE AS cap FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)),
filled AS (SELECT *, row_number() OVER fill AS nth, (sum(source_size) OVER () - coalesce(sum(cap) OVER (fill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(w) OVER () - coalesce(sum(w) OVER (fill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM per WINDOW fill AS (ORDER BY cap / w, source NULLS LAST)),
stop AS (SELECT arg_min(level, nth) AS level FROM filled WHERE cap > level * w)
SELECT doc_id, source, size, source_size, round(least(cap, coalesce(w * stop.level, cap)), 3) AS target FROM sized JOIN (SELECT source AS s, source_size, w, cap FROM filled) ON sized.source IS NOT DISTINCT FROM s, stop""",
    "op4_line_dedup": r"""WITH cut AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS l FROM documents WHERE text IS NOT NULL),
lines AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY l) - length(line) - 1 AS o FROM cut),
pieces AS (SELECT doc_id, l, o, unnest(s) AS piece, generate_subscripts(s, 1) AS p FROM (SELECT doc_id, l, o, string_split(regexp_replace(line, '([.!?…])(\s)', '\1' || chr(1) || '\2', 'g'), chr(1)) AS s FROM lines)),
placed AS (SELECT *, o + sum(length(piece)) OVER (PARTITION BY doc_id, l ORDER BY p) - length(piece) AS a, trim(regexp_replace(lower(piece), '[^\pL\pN]+', ' ', 'g')) AS norm FROM pieces),
units AS (SELECT doc_id, (a + length(piece) - length(ltrim(piece, ' ' || chr(9) || chr(11) || chr(12) || chr(13))))::INT AS a, (a + length(rtrim(piece, chr(0))))::INT AS b, norm, row_number() OVER (PARTITION BY doc_id ORDER BY l, p) AS no FROM placed WHERE norm <> ''),
ranked AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id, no) > 1 AS again FROM units),
runs AS (SELECT doc_id, min(a) AS a, max(b) AS b FROM (SELECT *, no - row_number() OVER (PARTITION BY doc_id ORDER BY no) AS run FROM ranked WHERE again) GROUP BY doc_id, run),
spans AS (SELECT doc_id, string_agg(a || ':' || b, ',' ORDER BY a) AS removed, count(*) AS n FROM runs GROUP BY doc_id),
touched AS (SELECT l.doc_id, l.l, l.line, l.o, greatest(r.a, l.o) AS a, least(r.b, l.o + length(l.line)) AS b FROM lines l JOIN runs r ON r.doc_id = l.doc_id AND r.a < l.o + length(l.line) AND r.b > l.o),
gaps AS (SELECT *, substr(line, (coalesce(lag(b) OVER w, o) - o + 1)::BIGINT, (a - coalesce(lag(b) OVER w, o))::BIGINT) AS gap, row_number() OVER (PARTITION BY doc_id, l ORDER BY a DESC) AS back FROM touched WINDOW w AS (PARTITION BY doc_id, l ORDER BY a)),
left_ AS (SELECT doc_id, l, trim(string_agg(gap, '' ORDER BY a) || max(CASE WHEN back = 1 THEN substr(line, (b - o + 1)::BIGINT) END), ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS rest FROM gaps GROUP BY doc_id, l),
texts AS (SELECT lines.doc_id, coalesce(string_agg(coalesce(rest, line), chr(10) ORDER BY lines.l) FILTER (rest IS NULL OR rest <> ''), '') AS text FROM lines LEFT JOIN left_ ON left_.doc_id = lines.doc_id AND left_.l = lines.l GROUP BY lines.doc_id)
SELECT d.doc_id, texts.text, coalesce(n, 0) AS n_removed, coalesce(removed, '') AS removed FROM documents d LEFT JOIN texts ON texts.doc_id = d.doc_id LEFT JOIN spans ON spans.doc_id = d.doc_id""",
    "op5_minhash_groups": r"""WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))) END AS s FROM worded),
classes AS (SELECT s, min(doc_id) AS id, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
tokens AS (SELECT id, n, unnest(s) AS t FROM classes),
shared AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common FROM tokens a JOIN tokens b ON a.t = b.t AND a.id < b.id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.id, b.id),
links AS (SELECT a, b FROM shared WHERE 100 * common >= 85 * (na + nb - common)),
ways AS (SELECT a AS x, b AS y FROM links UNION ALL SELECT b, a FROM links UNION ALL SELECT id, id FROM classes),
reach(x, y) AS (SELECT x, y FROM ways UNION SELECT reach.x, ways.y FROM reach JOIN ways ON reach.y = ways.x),
least_ AS (SELECT x AS id, min(y) AS component_id FROM reach GROUP BY x)
SELECT sets.doc_id, len(s)::BIGINT AS n_shingles, coalesce(component_id, sets.doc_id) AS component_id, coalesce(component_id, sets.doc_id) = sets.doc_id AS kept FROM sets LEFT JOIN classes USING (s) LEFT JOIN least_ USING (id)""",
    "op11_exact_dedup": """WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256 FROM t WINDOW w AS (PARTITION BY t)""",
    "op12_fill_in_middle": """WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h, length(coalesce(text, '')) AS n FROM documents),
d AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS h1, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS h2, ('0x' || substr(h, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS h4 FROM t),
f AS (SELECT *, least(h1, h2) AS a, greatest(h1, h2) AS b, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
    "personal_data_base": r"""WITH kinds(k, kind, pattern) AS (VALUES (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), (1, 'ip', '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'), (2, 'card', '[0-9](?:[\x20-]?[0-9])+'), (3, 'phone', '\+[0-9][\x20().0-9-]+[0-9]')),
cut AS (SELECT doc_id, k, kind, regexp_extract_all(coalesce(text, ''), pattern) AS m, regexp_split_to_array(coalesce(text, ''), pattern) AS p FROM documents, kinds),
found AS (SELECT doc_id, k, kind, unnest(m) AS m, unnest(p[1:len(m)]) AS p, generate_subscripts(m, 1) AS i FROM cut),
placed AS (SELECT doc_id, k, kind, m, sum(length(p) + length(m)) OVER (PARTITION BY doc_id, k ORDER BY i) AS b, regexp_replace(m, '[^0-9]', '', 'g') AS d FROM found),
fine AS (SELECT * FROM placed WHERE CASE kind WHEN 'email' THEN true WHEN 'ip' THEN list_max(list_transform(string_split(m, '.'), lambda x: x::HUGEINT)) <= 255 WHEN 'phone' THEN length(d) BETWEEN 9 AND 15
  ELSE length(d) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN d[-i]::INT ELSE d[-i]::INT * 2 // 10 + d[-i]::INT * 2 % 10 END)) % 10 = 0 END),
listed AS (SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone, string_agg(kind || ':' || (b - length(m))::BIGINT || ':' || b::BIGINT, ',' ORDER BY b - length(m), k) AS s FROM fine GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(s, '')) AS base_sha256 FROM documents d LEFT JOIN listed USING (doc_id)""",
    "quality_base": r"""WITH worded AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM worded WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
again AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + unnest([0, 1, 2, 3, 4]) AS at FROM twice) GROUP BY doc_id),
counted AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM worded LEFT JOIN again USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted""",
}
