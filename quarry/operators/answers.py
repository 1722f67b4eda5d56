"""Reading model output: extraction and repair of one JSON object, salvage, clamping, scoring helpers, rewrite guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T

_CITATIONS = "array<struct<chunk_id:string,quote:string>>"

# What the behaviour is defined by.
FENCE = r"(?is)```(?:json)?\s*(.*?)\s*```"
TRAILING_COMMA = r",\s*([}\]])"
BARE_KEY = r"([{,]\s*)([A-Za-z_][A-Za-z0-9_]*)\s*:"
LOOSE_ANSWERS = (r'"answer"\s*:\s*"(\d{1,2})"', r'"answer"\s*:\s*(\d{1,2})', r"(?i)\bAnswer\b\s*[:=]\s*(\d{1,2})\b", r"\b([1-9]\d?)\b")
LOOSE_CITATION = r'"chunk_id"\s*:\s*"([^"]*)"\s*,\s*"quote"\s*:\s*"([^"]*)"'
ANSWER_PREFIX = r"(?i)^\s*(final\s*:|answer\s*:|option\s*:)\s*"
PROMPT_ECHO = r"(?i)USER QUESTION:|Output ONLY|Rewrite the user's question"
ONLY_OPTION = r"^\s*\(?\s*([1-9]|10)\s*\)?\s*$"
NAMED_OPTION = r"(?i)^\s*(answer|final|option)\s*[:：]?\s*\(?\s*([1-9]|10)\s*\)?\s*$"


def unfenced(c: Column) -> Column:
    """The inside of the first code fence, if there is one; from the first brace on."""
    t = T.strip(T.text(c))
    inner = F.when(t.rlike(FENCE), T.strip(F.regexp_extract(t, FENCE, 1))).otherwise(t)
    at = F.instr(inner, "{")
    return F.when(at > 0, T.strip(F.substr(inner, at))).otherwise(inner)


def first_object(t: Column) -> Column:
    """The first balanced {...} of t, which starts with a brace; null if it doesn't end. Strings and escapes count."""

    def step(a: Column, c: Column) -> Column:
        text = a["text"]
        quote = (c == '"') & ~a["esc"]
        depth = F.when(text, a["depth"]).when(c == "{", a["depth"] + 1).when(c == "}", a["depth"] - 1).otherwise(a["depth"])
        ended = (a["end"] == 0) & ~text & (c == "}") & (depth == 0)
        return F.struct((a["i"] + 1).alias("i"), depth.alias("depth"), F.when(quote, ~text).otherwise(text).alias("text"), (text & (c == "\\") & ~a["esc"]).alias("esc"), F.when(ended, a["i"] + 1).otherwise(a["end"]).alias("end"))

    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("depth"), F.lit(False).alias("text"), F.lit(False).alias("esc"), F.lit(0).alias("end"))
    end = F.aggregate(F.split(t, ""), start, step, lambda a: a["end"])
    return F.when(t.startswith("{") & (end > 0), F.left(t, end))


def repaired(c: Column) -> Column:
    """Without trailing commas, smart quotes and, where there is no double quote, single ones; bare keys get quotes."""
    t = F.regexp_replace(T.strip(c), TRAILING_COMMA, "$1")
    for a, b in (("“", '"'), ("”", '"'), ("’", "'")):
        t = F.replace(t, F.lit(a), F.lit(b))
    single = ~F.contains(t, F.lit('"')) & (F.length(t) - F.length(F.replace(t, F.lit("'"), F.lit(""))) >= 2)
    t = F.when(single, F.replace(t, F.lit("'"), F.lit('"'))).otherwise(t)
    return F.regexp_replace(t, BARE_KEY, '$1"$2":')


def _object(c: Column) -> Column:
    v = F.try_parse_json(c)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


def _field(v: Column, path: str) -> Column:
    return T.strip(F.coalesce(F.try_variant_get(v, path, "string"), F.lit("")))


def _citations(v: Column) -> Column:
    one = lambda c: F.when(F.schema_of_variant(c).startswith("OBJECT"), F.struct(_field(c, "$.chunk_id").alias("chunk_id"), _field(c, "$.quote").alias("quote"))).when(F.schema_of_variant(c).startswith("ARRAY") & F.try_variant_get(c, "$[1]", "string").isNotNull(), F.struct(_field(c, "$[0]").alias("chunk_id"), _field(c, "$[1]").alias("quote")))
    found = F.transform(F.slice(F.coalesce(F.try_variant_get(v, "$.citations", "array<variant>"), F.array().cast("array<variant>")), 1, 20), one)
    return F.filter(found, lambda c: c.isNotNull() & ((c["chunk_id"] != "") | (c["quote"] != ""))).cast(_CITATIONS)


def _salvaged_answer(t: Column) -> Column:
    """What the first pattern that matches finds; '' if none does."""
    return F.coalesce(*[F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in LOOSE_ANSWERS], F.lit(""))


def _salvaged_citations(t: Column) -> Column:
    ids, quotes = (F.slice(F.regexp_extract_all(t, F.lit(LOOSE_CITATION), F.lit(g)), 1, 3) for g in (1, 2))
    return F.zip_with(ids, quotes, lambda i, q: F.struct(T.strip(i).alias("chunk_id"), T.strip(q).alias("quote"))).cast(_CITATIONS)


def clamped(citations: Column, most: int = 3, chars: int = 260) -> Column:
    """At most `most` citations; a longer quote is cut at `chars` and marked."""
    short = F.transform(citations, lambda c: F.struct(T.strip(T.text(c["chunk_id"])).alias("chunk_id"), T.strip(T.text(c["quote"])).alias("quote")))
    kept = F.slice(F.filter(short, lambda c: (c["chunk_id"] != "") | (c["quote"] != "")), 1, most)
    cut = lambda q: F.when(F.length(q) > chars, F.concat(T.rstrip(F.left(q, F.lit(chars))), F.lit("…"))).otherwise(q)
    return F.transform(kept, lambda c: F.struct(c["chunk_id"].alias("chunk_id"), cut(c["quote"]).alias("quote"))).cast(_CITATIONS)


def parsed(df: DataFrame, raw: str = "raw") -> DataFrame:
    """df with answer, citations (clamped), mode (clean, extracted_or_fixed, salvaged) and how (object, repaired, salvage, empty)."""
    t = T.strip(T.text(raw))
    df = df.withColumn("a_t", t).withColumn("a_u", unfenced(F.col("a_t")))
    df = df.withColumn("a_c", F.coalesce(first_object(F.col("a_u")), F.col("a_u")))
    df = df.withColumn("a_1", _object(F.col("a_c"))).withColumn("a_2", F.when(F.col("a_1").isNull(), _object(repaired(F.col("a_c")))))
    df = df.withColumn("a_v", F.coalesce("a_1", "a_2"))
    salvage = F.col("a_v").isNull()
    answer = F.when(salvage, _salvaged_answer(F.col("a_t"))).otherwise(_field(F.col("a_v"), "$.answer"))
    citations = F.when(salvage, _salvaged_citations(F.col("a_t"))).otherwise(_citations(F.col("a_v")))
    pure = F.col("a_t").startswith("{") & F.col("a_t").endswith("}") & F.try_parse_json("a_t").isNotNull()
    mode = F.when(pure, "clean").when(F.contains("a_t", F.lit("{")) & F.contains("a_t", F.lit("}")), "extracted_or_fixed").otherwise("salvaged")
    how = F.when(F.col("a_t") == "", "empty").when(F.col("a_1").isNotNull(), "object").when(F.col("a_2").isNotNull(), "repaired").otherwise("salvage")
    return df.withColumns({"answer": answer, "citations": clamped(citations), "mode": mode, "how": how}).drop("a_t", "a_u", "a_c", "a_1", "a_2", "a_v")


def schema_fault(c: Column) -> Column:
    """Why a strict JSON object isn't an answer object: ok, not_dict, bad_keys= with its keys in order, answer_not_str,
    citations_not_list, cite_not_dict, cite_bad_keys or cite_val_not_str; of several faults of citations the first citation's."""
    v = F.try_parse_json(c)
    keys = lambda x: F.array_sort(F.coalesce(F.map_keys(F.try_variant_get(x, "$", "map<string,variant>")), F.array().cast("array<string>")))
    kind = lambda x: F.coalesce(F.schema_of_variant(x), F.lit("VOID"))
    cites = F.coalesce(F.try_variant_get(v, "$.citations", "array<variant>"), F.array().cast("array<variant>"))

    def one(x: Column) -> Column:
        values = [kind(F.try_variant_get(x, f"$.{k}", "variant")) != "STRING" for k in ("chunk_id", "quote")]
        return F.when(~kind(x).startswith("OBJECT"), "cite_not_dict").when(keys(x) != F.array(F.lit("chunk_id"), F.lit("quote")), "cite_bad_keys").when(values[0] | values[1], "cite_val_not_str").otherwise("ok")

    return (
        F.when(~F.coalesce(kind(v).startswith("OBJECT"), F.lit(False)), "not_dict")
        .when(keys(v) != F.array(F.lit("answer"), F.lit("citations")), F.concat(F.lit("bad_keys=["), F.array_join(F.transform(keys(v), lambda k: F.concat(F.lit("'"), k, F.lit("'"))), ", "), F.lit("]")))
        .when(kind(F.try_variant_get(v, "$.answer", "variant")) != "STRING", "answer_not_str")
        .when(~kind(F.try_variant_get(v, "$.citations", "variant")).startswith("ARRAY"), "citations_not_list")
        .otherwise(F.coalesce(F.get(F.filter(F.transform(cites, one), lambda x: x != "ok"), F.lit(0)), F.lit("ok")))
    )


def option_number(c: Column) -> Column:
    t = T.strip(T.text(c))
    return F.when(t.rlike(r"^\d+$"), t).otherwise(F.regexp_extract(t, r"\b([1-9][0-9]?)\b", 1))


def exact_match(predicted: Column, gold: Column) -> Column:
    return F.when(T.strip(T.text(predicted)) == T.strip(T.text(gold)), 1.0).otherwise(0.0)


def one_line(c: Column) -> Column:
    """The first line that isn't blank, without an answer prefix and the quotes around it."""
    first = T.strip(F.coalesce(F.get(F.filter(F.split(T.text(c), T.LINE_END), lambda x: ~T.blank(x)), F.lit(0)), F.lit("")))
    bare = T.strip(F.regexp_replace(first, ANSWER_PREFIX, ""))
    return F.when((F.length(bare) >= 2) & (F.left(bare, F.lit(1)) == F.right(bare, F.lit(1))) & F.left(bare, F.lit(1)).isin("'", '"'), T.strip(F.substr(bare, F.lit(2), F.length(bare) - 2))).otherwise(bare)


def rewrite_fault(c: Column, least: int = 12) -> Column:
    """Why a rewritten query is refused: empty, prompt_echo, looks_like_answer, too_short; '' if it is fine."""
    t = T.strip(T.text(c))
    answer = t.rlike(ONLY_OPTION) | t.rlike(NAMED_OPTION) | (t.rlike(r"(?i)^(answer|final|option)") & t.rlike("[0-9]"))
    return F.when(t == "", "empty").when(t.rlike(PROMPT_ECHO), "prompt_echo").when(answer, "looks_like_answer").when(F.length(t) < least, "too_short").otherwise("")


def rewrite_outcome(raw: Column, question: Column) -> Column:
    """What comes of a rewriting: struct of clean (its line), used, reject_reason (why not, or '') and question (the new one if
    it is used, else the old one)."""
    clean = one_line(raw)
    fault = rewrite_fault(clean)
    reason = F.when(fault != "", fault).when(T.strip(clean) == T.strip(T.text(question)), "same_as_original").otherwise("")
    return F.struct(clean.alias("clean"), (reason == "").alias("used"), reason.alias("reject_reason"), F.when(reason == "", clean).otherwise(T.text(question)).alias("question"))


def verified(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """id, chunk_id, quote, known (the chunk exists), supported (it contains the quote) of each citation of answers (id, citations)."""
    one = answers.select("id", F.explode("citations").alias("c")).select("id", F.col("c.chunk_id").alias("chunk_id"), F.col("c.quote").alias("quote"))
    found = one.join(chunks.select("chunk_id", F.col("text").alias("body")), "chunk_id", "left")
    return found.select("id", "chunk_id", "quote", F.col("body").isNotNull().alias("known"), F.coalesce(F.contains("body", F.col("quote")) & (F.col("quote") != ""), F.lit(False)).alias("supported"))
