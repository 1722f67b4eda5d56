"""What goes into a prompt: neighbours of the seeds, a character budget, the rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.sources.tables import stored


def ranged(chunks: DataFrame, section: list[str], ranges: int | None = None) -> DataFrame:
    """section's columns, chunk_id and p, the number of the range of (section, chunk_id) that the row lies in; written, so that
    ranges stay what they are. Ranges are of like sizes, however many chunks one section has."""
    n = ranges or int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(chunks.select(*section, "chunk_id").repartitionByRange(n, *section, "chunk_id").withColumn("p", F.spark_partition_id()))


def neighbours(seeds: DataFrame, chunks: DataFrame, reach: int = 1, scope: str = "section", ranges: int | None = None) -> DataFrame:
    """query_id, chunk_id of the seeds and the chunks within `reach` places of them, once each.

    Places count along a section by chunk_id; scope 'document' keeps to the seed's document as well. Seeds that aren't in
    chunks, or whose section is empty, pass through. Chunks are dealt in ranges, each place looks `reach` rows around itself in its
    range, and the first and last `reach` rows of the ranges are looked at once more in a row: what comes from another range there is
    a neighbour too. A section of any size is no single task, and the join is on the chunk's id.
    """
    section = ["section_path", *(["doc_id"] if scope == "document" else [])]
    rows = ranged(chunks.where(T.text("section_path") != ""), section, ranges)
    own, around = Window.partitionBy("p", *section), lambda w: w.orderBy("chunk_id").rowsBetween(-reach, reach)
    inside = rows.select("chunk_id", F.collect_list("chunk_id").over(around(own)).alias("near"))
    place = lambda order: F.row_number().over(own.orderBy(order))
    border = rows.withColumns({"i": place(F.col("chunk_id")), "j": place(F.desc("chunk_id"))}).where((F.col("i") <= reach) | (F.col("j") <= reach))
    others = F.filter(F.collect_list(F.struct("p", "chunk_id")).over(around(Window.partitionBy(*section))), lambda x: x["p"] != F.col("p"))
    across = border.select("chunk_id", F.transform(others, lambda x: x["chunk_id"]).alias("near")).where(F.size("near") > 0)
    near = inside.unionByName(across)
    found = seeds.select("query_id", "chunk_id").join(near, "chunk_id", "left")
    return found.select("query_id", F.explode(F.coalesce("near", F.array("chunk_id"))).alias("chunk_id")).distinct()


def trimmed(contexts: DataFrame, budget: int = 25000) -> DataFrame:
    """contexts (query_id, doc_id, clause_id, chunk_id, text) in order as far as their lengths fit the budget; the first
    always stays; empty texts don't count. Adds place."""
    order = Window.partitionBy("query_id").orderBy("doc_id", "clause_id", "chunk_id")
    full = contexts.where(T.text("text") != "").withColumns({"place": F.row_number().over(order), "total": F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    return full.where((F.col("total") <= budget) | (F.col("place") == 1)).drop("total")


TEMPLATE = (
    "Answer the question from the context only, as one JSON object with the keys answer (a string) and citations (up to three "
    "objects with chunk_id and quote; each quote is copied from the context).\n\nQuestion:\n",
    "\n\nContext:\n",
    "\n",
)


#: The question stands between the two parts.
REWRITE = (
    "Turn the question below into one line of search words for a collection of technical specifications. Keep abbreviations, "
    "add what they stand for in parentheses where it helps, and write neither an answer nor the number of an option.\n\nQuestion:\n",
    "\n\nSearch line:\n",
)
#: The question stands between the first two parts, the evidence between the last two.
JUDGE = ("Is the evidence enough to answer the question? Reply with one JSON object: sufficient (true or false) and missing (what isn't there).\n\nQuestion:\n", "\n\nEvidence:\n", "\n")


def rewrite_prompts(questions: DataFrame) -> DataFrame:
    """query_id, prompt that asks for a rewriting of each question."""
    return questions.select("query_id", F.concat(F.lit(REWRITE[0]), T.text("question"), F.lit(REWRITE[1])).alias("prompt"))


def judge_prompts(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """query_id, prompt that asks whether the contexts (with section_path, page_start, page_end and place) are enough."""
    one = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), T.text("section_path"), F.lit(" (p"), T.text(F.col("page_start").cast("string")), F.lit("-p"), T.text(F.col("page_end").cast("string")), F.lit(")\n"), T.text("text"))
    parts = contexts.select("query_id", F.struct("place", one.alias("part")).alias("x")).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["part"]), "\n").alias("context"))
    return questions.join(parts, "query_id", "left").select("query_id", F.concat(F.lit(JUDGE[0]), T.text("question"), F.lit(JUDGE[1]), T.text("context"), F.lit(JUDGE[2])).alias("prompt"))


def prompts(questions: DataFrame, contexts: DataFrame, template: tuple[str, str, str] = TEMPLATE) -> DataFrame:
    """query_id, prompt. questions: query_id, question; contexts as from trimmed()."""
    one = F.concat(F.lit("[chunk_id="), F.col("chunk_id"), F.lit("]\n"), F.col("text"))
    parts = contexts.select("query_id", F.struct("place", one.alias("part")).alias("x")).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["part"]), "\n\n").alias("context"))
    return questions.join(parts, "query_id", "left").select("query_id", F.concat(F.lit(template[0]), T.text("question"), F.lit(template[1]), T.text("context"), F.lit(template[2])).alias("prompt"))
