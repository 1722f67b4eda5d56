"""URL filters (3): empirical-Bayes host reputation behind a list of host and path rules.

Labelled page outcomes are summed by host; each host's rate of good pages is shrunk towards its registered domain's,
that towards its suffix's, and that towards the rate of all. The strength of the prior at each level is fitted by the
method of moments from how much the rates of that level differ beyond chance. A page is blocked if the upper posterior
bound of its host's rate is below `floor`: there is good evidence that most of its pages are bad. Hosts without labels
take the bound of the domain, suffix or all.

DataFrame expressions only. What is joined to the pages is one row for each labelled host, domain and suffix; Spark
broadcasts it only while it measures below spark.sql.autoBroadcastJoinThreshold and else splits hot hosts (AQE).

Defined cases: a null url or one without :// has an empty host and path; the empty host is one host of its own; outcomes
with a null id or label don't count, repeated ones all do; without outcomes the method allows; repeated pages each get the
same verdict; of rules of one length that fit, the one first by code point wins; a bound that equals the floor allows; an
empty table gives no rows; a very long url is matched whole, in linear time; input columns that share a name with an output
column give way to it, all others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import ascii_lower, fields, rowed, stored

#: verdict, host, path
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
FLOOR, Z = 0.5, 2.0


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def domain_of(host: Column) -> Column:
    """The last two labels. A list of longer public suffixes isn't at hand; pass another function where one is."""
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path in one string, and its verdict; nulls if none fits. For up to a thousand rules."""
    if len(rules) > 1000:
        raise ValueError("more than 1000 rules")
    name = verdict = None
    for what, at, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        test = ((host == at) | host.endswith(f".{at}")) & path.startswith(start)
        name = F.when(test, at + start) if name is None else name.when(test, at + start)
        verdict = F.when(test, what) if verdict is None else verdict.when(test, what)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if name is None else (name, verdict)


def _strength(rates: DataFrame, n: str, good: str, up: str) -> DataFrame:
    """One row: the prior's weight in pages, from the spread of good/n around up beyond the binomial."""
    v = F.col(up) * (1 - F.col(up))
    spread = F.col(n) * F.pow(F.col(good) / F.col(n) - F.col(up), 2)
    sums = rates.agg(F.sum(spread - v).alias("s"), F.sum((F.col(n) - 1) * v).alias("v"))
    rho = F.least(F.lit(0.5), F.greatest(F.lit(0.001), F.coalesce(F.try_divide("s", "v"), F.lit(0.001))))
    return sums.select((1 / rho - 1).alias("k"))


def reputations(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """level (host, domain, suffix, all), name, mean and upper for all that have outcomes. outcomes: page_id, good (0 or 1)."""
    seen = outcomes.where("page_id is not null and good is not null").groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("good").cast("double")).alias("g"))
    hosts = pages.select("page_id", host_of(F.col("url")).alias("host")).join(seen, "page_id").groupBy("host").agg(F.sum("n").cast("double").alias("n"), F.sum("g").alias("g"))
    hosts = stored(hosts)  # every level is summed from it
    hosts = hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    total = hosts.agg(F.sum("n").alias("n"), F.sum("g").alias("g")).where("n > 0").select("n", "g", (F.col("g") / F.col("n")).alias("m"))
    out, up, levels = [total.select(F.lit("all").alias("level"), F.lit("").alias("name"), F.col("g").alias("a"), (F.col("n") - F.col("g")).alias("b"))], None, (("suffix", None), ("domain", "suffix"), ("host", "domain"))
    for level, above in levels:
        sums = hosts.groupBy(level, *([above] if above else [])).agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
        # one row each for the total and the strength; a level's means are joined by their name
        sums = sums.join(F.broadcast(total.select(F.col("m").alias("up")))) if above is None else sums.join(up, above)
        rates = sums.join(F.broadcast(_strength(sums, "n", "g", "up")))
        rates = rates.withColumns({"a": F.col("g") + F.col("k") * F.col("up"), "b": F.col("n") - F.col("g") + F.col("k") * (1 - F.col("up"))})
        out.append(rates.select(F.lit(level).alias("level"), F.col(level).alias("name"), "a", "b"))
        up = rates.select(F.col(level), (F.col("a") / (F.col("a") + F.col("b"))).alias("up"))
    all_levels = out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])
    mean = F.col("a") / (F.col("a") + F.col("b"))
    deviation = F.sqrt(F.col("a") * F.col("b") / (F.pow(F.col("a") + F.col("b"), 2) * (F.col("a") + F.col("b") + 1)))
    return all_levels.select("level", "name", mean.alias("mean"), (mean + Z * deviation).alias("upper"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, floor: float = FLOOR) -> DataFrame:
    """pages' columns and host, path, rule, verdict, reputation (the posterior mean that decided, or null)."""
    known = stored(reputations(pages.select("page_id", "url"), outcomes))  # four joins read it
    df = rowed(pages, host=host_of(pages["url"]), path=path_of(pages["url"]))
    for level, key in (("host", F.col("host")), ("domain", domain_of(F.col("host"))), ("suffix", suffix_of(F.col("host"))), ("all", F.lit(""))):
        at = known.where(F.col("level") == level).select(F.col("name").alias(f"{level}_n"), F.struct("mean", "upper").alias(f"{level}_v"))
        df = df.join(at, F.col(f"{level}_n") == key, "left")
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    best = F.coalesce("host_v", "domain_v", "suffix_v", "all_v")
    own = F.when(best["upper"] < floor, "block").otherwise("allow")
    return df.select(*fields(df, ("host", "path", "rule", "verdict", "reputation")), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), best["mean"].alias("reputation"))
