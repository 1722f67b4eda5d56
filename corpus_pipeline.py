"""A corpus pipeline of five stages: quality rules, near-dedup, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written and read again as the next one's docs.

Defined cases, by stage; what isn't said here stands in the operator's module:
quality rules: null and empty texts fail the base rule and go; repeated rows are judged alike and stay or go together.
near duplicates: texts without words are linked with nothing and stay; of rows alike in id and text one stays. Rows with a
null id are told by their sets of shingles: one row of each set stays, none if a row with an id has it; near sets aren't linked.
personal data: a null text stays null; a text without personal data is unchanged; a long text is read whole.
mixing: a document of size 0 counts for its source's documents only; those of a source without words go; repeated rows
are documents of their own.
packing: one piece at least for each row; a null text has the end id only.
An empty table gives an empty one of the same columns at every stage, and no pieces. All stages but the last hand on every
column of documents, extra ones too, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import mixing, neardup, packing, pii, rules
from quarry.llm.common import stored_alone, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the base rule and the decision list learned from the labels keep."""
    return rules.kept(docs, rules.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates: five words, similarity 0.8 or more."""
    return neardup.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind of each span of personal data in its place."""
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's documents as often as its target weight asks."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs)


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("personal data", personal_data), ("mixing", mixture), ("packing", packed)]
#: The decision list, the links and the draw of the mixture can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored_alone(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
