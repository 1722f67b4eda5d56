"""PII (6): regular expressions propose spans, validators confirm them, nearby context words adjust a score.

DataFrame expressions only. Positions come from splitting the text by a kind's pattern: the lengths of the pieces and
matches before a match add up to its start, so no text is scanned twice by position. The patterns are possessive forms
that match exactly what the plain forms match, leftmost first, but in linear time and without recursion on long texts.

Defined cases: null text is empty and has no spans; repeated rows each get their own result; spans are in code points,
end exclusive. Base kinds (email, ip, card, phone) stay whatever their score; the added kinds (iban, ssn, local_phone)
need a score of at least `least` and not to lie within a base span; of spans with one start the kind listed first comes
first; an empty table gives no rows; a text of any length is scanned whole. An input column `pii` gives way to find()'s.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import computed, fields, let, rowed, text_or_empty

LOCAL = "A-Za-z0-9._%+-"
#: kind: pattern, a cheap test that any text with a match passes, score once confirmed, context words that raise it.
KINDS: dict[str, tuple[str, str, float, str]] = {
    "email": (rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|contact|write"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.6, r"\bip\b|host|server|address|login"),
    "card": (r"[0-9](?:[\x20-]?[0-9]){11,}+", r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", 0.8, "card|visa|credit|debit|payment"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.6, r"phone|\btel\b|call|mobile|fax"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}", 0.9, "iban|bank|account|konto|compte|cuenta"),
    "ssn": (r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "[0-9]-[0-9]{2}-[0-9]", 0.4, r"\bssn\b|social|security"),
    "local_phone": (r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9-])", r"[0-9]{3}[-.\x20][0-9]{4}", 0.4, r"phone|\btel\b|call|mobile|fax|ring"),
}
BASE = ("email", "ip", "card", "phone")
AGAINST = r"version|invoice|serial|order\x20no|part\x20no"
NEAR = 40


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    total = F.aggregate(
        F.split(F.reverse(digits), ""),
        F.struct(F.lit(0).alias("i"), F.lit(0).alias("n")),
        lambda a, c: let(F.coalesce(c.try_cast("int"), F.lit(0)), lambda d: F.struct((a["i"] + 1).alias("i"), (a["n"] + F.when(a["i"] % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)).alias("n"))),
        lambda a: a["n"],
    )
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without blanks leaves 1 when divided by 97 as the standard says."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.left(iban, F.lit(4)))
    digits = F.array_join(F.transform(F.split(turned, ""), lambda c: F.when(c.rlike("^[A-Z]$"), (F.ascii(c) - 55).cast("string")).otherwise(c)), "")
    return F.aggregate(F.split(digits, ""), F.lit(0), lambda a, c: (a * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97) == 1


def _confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    if kind == "card":
        return let(_digits(m), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        return mod97(F.replace(m, F.lit(" "), F.lit("")))
    return F.lit(True)


def _before(lengths: Column, block: Column, sums: Column, i: Column) -> Column:
    """Sum of the first i lengths, by blocks of about their number's root."""
    whole = F.floor(i / block).cast("int")
    plus = lambda a, x: a + x
    return F.aggregate(F.slice(sums, 1, whole), F.lit(0), plus) + F.aggregate(F.slice(lengths, whole * block + 1, i - whole * block), F.lit(0), plus)


def _found(text: Column, kind: str) -> Column:
    pattern, hint, score, near = KINDS[kind]
    k = list(KINDS).index(kind)

    def spans(pieces: Column, matches: Column) -> Column:
        def at(lengths: Column, block: Column, sums: Column) -> Column:
            def span(m: Column, i: Column) -> Column:
                start = _before(lengths, block, sums, i) + F.length(F.get(pieces, i))
                around = F.lower(F.concat(F.right(F.get(pieces, i), F.lit(NEAR)), F.lit(" "), F.left(F.get(pieces, i + 1), F.lit(NEAR))))
                points = F.lit(score) + F.when(around.rlike(near), 0.3).otherwise(0.0) - F.when(around.rlike(AGAINST), 0.3).otherwise(0.0)
                return F.struct(start.alias("start"), F.lit(k).alias("k"), (start + F.length(m)).alias("end"), F.lit(kind).alias("kind"), m.alias("match"), points.alias("score"))

            return F.filter(F.transform(matches, span), lambda s: _confirmed(kind, s["match"]))

        lengths = F.zip_with(matches, F.slice(pieces, 1, F.size(matches)), lambda m, p: F.length(m) + F.length(p))
        return let(lengths, lambda n: let(F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(n))).cast("int")), lambda b: let(F.transform(F.sequence(F.lit(0), F.floor(F.size(n) / b).cast("int")), lambda j: F.aggregate(F.slice(n, j * b + 1, b), F.lit(0), lambda a, x: a + x)), lambda sums: at(n, b, sums))))

    hinted = F.contains(text, F.lit("@")) if hint == "@" else text.rlike(hint)
    empty = F.array().cast("array<struct<start:int,k:int,end:int,kind:string,match:string,score:double>>")
    return F.when(hinted, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, let(F.split(text, pattern, -1), lambda p: spans(p, m))).otherwise(empty))).otherwise(empty)


def find(df: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """df's columns and pii: an array, by start and kind, of struct(start, k, end, kind, match, score)."""
    df = _spans(df, text, least)
    return df.select(*fields(df, ("pii",)), "pii")


def _spans(df: DataFrame, text: str, least: float) -> DataFrame:
    """row (df's columns), t (the text) and pii."""
    df = rowed(df, t=text_or_empty(df[text]))
    df = df.withColumn("b", F.array_sort(F.flatten(F.array(*[_found(F.col("t"), k) for k in BASE]))))
    more = reduce(F.concat, [_found(F.col("t"), k) for k in KINDS if k not in BASE])
    df = df.withColumn("m", F.filter(more, lambda s: s["score"] >= least))
    clear = F.filter("m", lambda s: ~F.exists("b", lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])))
    return df.select("row", "t", computed(F.when(F.size("m") == 0, F.col("b")).otherwise(F.array_sort(F.concat("b", clear)))).alias("pii"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """df with each span of its text replaced by the kind in angle brackets; overlapping spans are replaced together,
    under the first one's kind. Null text stays null; all other columns stay as they are, whatever their names."""
    df = _spans(df, text, least)
    df = df.withColumn("e", F.transform("pii", lambda s: s["end"]))
    df = df.withColumn("f", F.transform("pii", lambda s, i: F.when(i > 0, F.array_max(F.slice("e", 1, i))).otherwise(F.lit(0))))
    t = F.col("row").getField(text).cast("string")
    parts = F.zip_with("pii", "f", lambda s, f: F.when(s["start"] >= f, F.concat(F.substr(t, f + 1, s["start"] - f), F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(F.lit("")))
    new = F.when(F.size("pii") > 0, F.concat(F.array_join(parts, ""), F.substr(t, F.array_max("e") + 1))).otherwise(t)
    return df.select(*[new.alias(f.name) if f.name.lower() == text.lower() else F.col("row").getField(f.name).alias(f.name) for f in df.schema["row"].dataType])
