"""Quality rules (9): decision lists learned by sequential covering, emitted as ordered Spark conditionals.

Every statistic is a DataFrame expression over the whole text. A list is fitted on at most `fit_rows` labelled
documents (those with the smallest hash of their id, so any run picks the same ones); the statistics of those few
rows are all that reaches the driver. Applying a list is one `CASE WHEN` per row, without a shuffle.

Defined cases: null or empty text has no words and fails the base rule; a null, conflicting or repeated label counts
once per id, as bad if any says so; without labels of both kinds the list is empty and only the base rule rejects; an empty
table gives no rows; repeated rows each get the same verdict; of thresholds that gain the same the first feature's lowest is
taken, and a row at a threshold counts as above it; a very long text is one row like any other, its windows sorted only where
one occurs twice; input columns that share a name with an output column of judge() give way to it, kept() leaves all as they are.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import SPACE_CHARS, computed, fields, rowed, text_or_empty, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
FIT_ROWS = 8192
OUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "kept")
FEATURES = ("log_words", "word_length", "symbols", "bars", "bangs", "capitals", "digits", "duplicate_lines", "repeated_words", "distinct_words")


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _one(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def with_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """row (df's columns) and a struct `q`: the base statistics and, as `q.f`, the features."""
    df = rowed(df, t=text_or_empty(df[text]))
    df = df.withColumn("w", words(F.col("t")))
    df = df.withColumn("l", F.filter(F.split("t", "\n", -1), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0))
    df = df.withColumn("g", F.transform("w", lambda w: F.xxhash64(w)))
    df = df.withColumn("h", F.when(F.size("g") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("g") - WINDOW), lambda i: F.xxhash64(*[F.get("g", i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>")))
    # Only a text in which some window occurs twice has its windows sorted.
    df = df.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.array_sort(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    twice = F.filter("s", lambda x, i: x["h"].eqNullSafe(F.get("s", i - 1)["h"]) | x["h"].eqNullSafe(F.get("s", i + 1)["h"]))
    df = df.withColumn("p", F.array_sort(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(
        "p",
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("bigint").alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    df = df.select(
        "row", "t", F.size("w").cast("bigint").alias("n"), F.length(F.translate("t", SPACE_CHARS, "")).cast("bigint").alias("c"), _count(F.col("t"), SYMBOLS).cast("bigint").alias("y"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("bigint").alias("d"), F.size("l").alias("k"), covered.alias("r"), F.size(F.array_distinct("g")).alias("u"),
    )
    n, chars = F.greatest(F.lit(1.0), F.col("n")), F.greatest(F.lit(1.0), F.col("c"))
    features = {
        "log_words": F.log(n),
        "word_length": F.col("c") / n,
        "symbols": F.col("y") / chars,
        "bars": _one(F.col("t"), "|") / n,
        "bangs": _one(F.col("t"), "!") / n,
        "capitals": F.length(F.regexp_replace("t", r"[^A-ZÀ-ÖØ-Þ]+", "")) / chars,
        "digits": F.length(F.regexp_replace("t", "[^0-9]+", "")) / chars,
        "duplicate_lines": F.col("d") / F.greatest(F.lit(1.0), F.col("k")),
        "repeated_words": F.col("r") / n,
        "distinct_words": F.col("u") / n,
    }
    return df.select("row", computed(F.struct(F.col("n").alias("n_words"), F.col("c").alias("word_chars"), F.col("y").alias("n_symbols"), F.col("d").alias("n_dup_lines"), F.col("r").alias("n_repeat_words"), F.struct(*[v.cast("double").alias(k) for k, v in features.items()]).alias("f"))).alias("q"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, at: str) -> Column:
        value = F.col(f"{at}.{self.feature}")
        return value >= self.threshold if self.above else value < self.threshold

    def mask(self, x: np.ndarray) -> np.ndarray:
        value = x[:, FEATURES.index(self.feature)]
        return value >= self.threshold if self.above else value < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Ordered conjunctions that reject; a row that none covers is kept."""

    rules: tuple[tuple[Condition, ...], ...] = ()

    def column(self, at: str = "q.f") -> Column:
        """The number, from 1, of the first rule that covers the row; 0 if none does."""
        out = None
        for i, rule in enumerate(self.rules, 1):
            test = reduce(lambda a, b: a & b, [c.column(at) for c in rule])
            out = F.when(test, F.lit(i)) if out is None else out.when(test, F.lit(i))
        return F.lit(0) if out is None else out.otherwise(F.lit(0))

    def covers(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), bool)
        for rule in self.rules:
            out |= np.logical_and.reduce([c.mask(x) for c in rule])
        return out

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(map(str, r)) for r in self.rules) or "keep all"


def learn(x: np.ndarray, bad: np.ndarray, precision: float = 0.97, least: int = 5, max_conditions: int = 4, max_rules: int = 24, cuts: int = 48) -> DecisionList:
    """Sequential covering: grow a conjunction by information gain on two thirds of the rows, prune it on the rest, and take it
    while what it covers there is bad with at least `precision`. Rows are taken in their order; the result is deterministic."""
    rules: list[tuple[Condition, ...]] = []
    left = np.ones(len(x), bool)
    held = np.arange(len(x)) % 3 == 2
    while len(rules) < max_rules:
        grow, prune = left & ~held, left & held
        if bad[grow].sum() < least or not (~bad[grow]).any():
            break
        rule: list[Condition] = []
        gx, gy = x[grow], bad[grow]
        while len(rule) < max_conditions and not gy.all():
            p0, n0 = gy.sum(), (~gy).sum()
            best, gain0 = None, 1e-9
            for j, name in enumerate(FEATURES):
                points = np.unique(np.quantile(gx[:, j], np.linspace(0, 1, cuts)))
                for t in (points[:-1] + points[1:]) / 2:
                    up = gx[:, j] >= t
                    for above, m in ((True, up), (False, ~up)):
                        p, n = gy[m].sum(), (~gy[m]).sum()
                        if p < least:
                            continue
                        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if gain > gain0:
                            best, gain0 = (Condition(name, above, float(t)), m), gain
            if best is None:
                break
            rule.append(best[0])
            gx, gy = gx[best[1]], gy[best[1]]
        if not rule:
            break
        px, py = x[prune], bad[prune]

        def worth(r: list[Condition]) -> float:
            m = np.logical_and.reduce([c.mask(px) for c in r])
            p, n = py[m].sum(), (~py[m]).sum()
            return (p - n) / (p + n) if p + n else -1.0

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        m = np.logical_and.reduce([c.mask(x) for c in rule])
        p, n = bad[left & m].sum(), (~bad[left & m]).sum()
        hp, hn = py[m[prune]].sum(), (~py[m[prune]]).sum()
        if p < least or p < precision * (p + n) or hp + hn == 0 or hp < precision * (hp + hn):
            break
        rules.append(tuple(rule))
        left &= ~m
    return DecisionList(tuple(rules))


def fit(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DecisionList:
    """Learns from at most `fit_rows` labelled documents; quality 0 is bad."""
    one = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    one = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).join(F.broadcast(one), "doc_id")  # at most fit_rows rows of two numbers
    rows = with_stats(texts).groupBy("row.doc_id").agg(F.min(F.struct("q.f", "row.quality")).alias("x")).select("doc_id", "x.f", "x.quality").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    if not rows:
        return DecisionList()
    return learn(np.array([list(r["f"]) for r in rows], float), np.array([r["quality"] == 0 for r in rows]))


def _judged(documents: DataFrame, rules: DecisionList) -> DataFrame:
    """row, q, base (whether the base rule rejects) and rule (the number of the rule that does, or 0)."""
    base = (F.col("q.n_words") < 10) | (F.col("q.n_repeat_words") * 100 > F.col("q.n_words") * 20)
    return with_stats(documents).select("row", "q", base.alias("base"), rules.column().alias("rule"))


def judge(documents: DataFrame, rules: DecisionList) -> DataFrame:
    """documents' columns, and the base statistics, base_failed, rule (the number of the rule that rejects, or 0) and kept."""
    df = _judged(documents, rules)
    return df.select(*fields(df, OUT), *[F.col(f"q.{c}").alias(c) for c in OUT[:5]], F.col("base").alias("base_failed"), "rule", (~F.col("base") & (F.col("rule") == 0)).alias("kept"))


def kept(documents: DataFrame, rules: DecisionList) -> DataFrame:
    """The documents that judge() keeps, with their own columns, whatever those are called."""
    return _judged(documents, rules).where("not base and rule = 0").select("row.*")
