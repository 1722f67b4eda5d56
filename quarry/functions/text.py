"""Column builders for text: every one maps Columns to a Column inside whole-stage code, without Python on executors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where a text breaks into lines (Unicode line ends).
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

#: White space of Unicode, what (?U)\s stands for.
WHITE = "\t\n\x0b\x0c\r \x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# What the behaviour is defined by.
STOP_WORDS = "the a an is are was were to of in on for and or with from by between within about as".split()
NORMATIVE = (" shall ", " should ", " must ", " may ")
DEFINITION_MARKERS = (" terms and definitions ", " term and definitions ", " definitions ", " abbreviations ", " acronym ", " acronyms ")
BOILERPLATE = (
    "portal.etsi.org/people/commiteesupport",
    "coordinated vulnerability disclosure",
    "notice of disclaimer",
    "limitation of liability",
    "intellectual property rights",
    "essential patents",
    "publicly available specification",
    "technical specification",
    "ts-family covering the a1 interface",
    "modal verbs terminology",
    "verbal forms for the expression",
    "no guarantee can be given",
    "the present document may be made available in electronic versions",
)
GLOSSARY = r"^[A-Z][A-Za-z0-9/\-\(\)\s]{1,50}\s*[:\-–]\s+\S+"
NUMBERED_TITLE = r"^\s*\d+(\.\d+){0,3}\s+[A-Z][A-Za-z0-9/\-\(\)\s]{1,60}\s*$"
DEFINING_VERB = r"\b(is|are|means|refers to|shall mean)\b"
TOC = r"\.{3,}\s*(?:\.\s*)*\d+\s*$"
HEADING = r"(?i)^\s*(\d+(?:\.\d+){1,6})\s+(.+?)\s*$"
NUMBERED = r"(?U)^\s*[0-9]+\.[0-9]"
TOKEN = r"[A-Za-z0-9]+(?:[-_/.][A-Za-z0-9]+)*"
SIMPLE_TOKEN = r"[A-Za-z0-9_/\-.]+"
KEYWORD = r"[A-Za-z0-9][A-Za-z0-9\-/.]*"


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space (of Unicode) at both ends."""
    return F.btrim(c, F.lit(WHITE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITE))


def lines_of(c: Column) -> Column:
    """The lines of c, cut at LINE_END; what it takes for one end of two characters is made one first, as a class is found faster."""
    return F.split(F.replace(c, F.lit("\r\n"), F.lit("\n")), LINE_END.partition("|")[2], -1)


def blank(c: Column) -> Column:
    return ~c.rlike(r"(?U)\S")


def normalised(c: Column) -> Column:
    """No-break spaces become spaces, runs of blanks and tabs one space; line ends stay. Only texts with runs look for them."""
    runs = lambda t: F.when(F.contains(t, F.lit("  ")) | F.contains(t, F.lit("\t")), F.regexp_replace(t, r"[ \t]+", " ")).otherwise(t)
    return strip(let(F.replace(text(c), F.lit("\u00a0"), F.lit(" ")), runs))


def without_artefacts(c: Column) -> Column:
    """No soft hyphens, single blanks, at most one empty line in a row."""
    return F.regexp_replace(F.regexp_replace(F.replace(text(c), F.lit("\u00ad"), F.lit("")), r"[ \t]+", " "), r"\n{3,}", "\n\n")


def working_group(name: Column) -> Column:
    strict = F.regexp_extract(name, r"(?i)(?:^|[^0-9A-Za-z])WG[\s.]*([0-9]{1,2})(?:[^0-9A-Za-z]|$)", 1)
    loose = F.regexp_extract(name, r"(?i)WG[\s.]*([0-9]{1,2})", 1)
    number = F.coalesce(F.nullif(strict, F.lit("")), F.nullif(loose, F.lit("")))
    return F.coalesce(F.concat(F.lit("WG"), number), F.lit("UNKNOWN"))


def version(name: Column) -> Column:
    marked = F.regexp_extract(name, r"(?i)(?:^|[^0-9A-Za-z])v(\d+\.\d+(?:\.\d+)*)", 1)
    plain = F.regexp_extract(name, r"(?:^|[^0-9A-Za-z])(\d+\.\d+(?:\.\d+)*)", 1)
    return F.coalesce(F.nullif(marked, F.lit("")), F.nullif(plain, F.lit("")), F.lit("UNKNOWN"))


def document_id(path: Column) -> Column:
    """The file's name without its extension."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def section_path(number: Column, title: Column) -> Column:
    return F.when(number.isNull(), F.lit("UNKNOWN")).otherwise(strip(F.concat_ws(" ", number, text(title))))


def chunk_id(doc: Column, clause: Column, first: Column, last: Column, block: Column, index: Column, body: Column) -> Column:
    """doc::clause::p1-2::b0003::0004::length::digest: content-addressed and the same on every run."""
    return F.format_string("%s::%s::p%d-%d::b%04d::%04d::%d::%s", doc.cast("string"), clause, first, last, block, index, F.length(body), F.left(F.md5(body), F.lit(8)))


def search_text(title: Column, clause: Column, body: Column) -> Column:
    return strip(F.concat_ws("\n", text(title), text(clause), text(body)))


def simple_tokens(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(text(c), F.lit(SIMPLE_TOKEN), F.lit(0)), F.lower)


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body).getItem(0)


def computed(value: Column) -> Column:
    """value, behind a generator, so that what reads it several times doesn't compute it several times."""
    return F.explode(F.array(value))


def domain_tokens(c: Column) -> Column:
    """Lower-case tokens; a compound also gives its parts and its collapsed form. Repeats stay.

    Tokens are ASCII without blanks, so all of a text are put in lower case at once; only texts with compounds look at each.
    """

    def forms(t: Column) -> Column:
        parts = F.filter(F.split(t, "[-_/.]"), lambda p: p != "")
        return F.when(t.rlike("[-_/.]"), F.concat(F.array(t), parts, F.array(F.regexp_replace(t, "[-_/.]", "")))).otherwise(F.array(t))

    def tokens(found: Column) -> Column:
        cut = F.split(found, " ")
        return F.when(found == "", F.array().cast("array<string>")).when(found.rlike("[-_/.]"), F.flatten(F.transform(cut, forms))).otherwise(cut)

    return let(F.lower(F.array_join(F.regexp_extract_all(text(c), F.lit(TOKEN), F.lit(0)), " ")), tokens)


def keywords(c: Column) -> Column:
    """The distinct lower-case words of at least three characters that are no stop words."""
    found = F.transform(F.regexp_extract_all(text(c), F.lit(KEYWORD), F.lit(0)), F.lower)
    return F.array_except(F.filter(found, lambda t: F.length(t) >= 3), F.array(*[F.lit(w) for w in STOP_WORDS]))


def overlap_ratio(query: Column, candidate: Column) -> Column:
    """Share of the query's keywords that the candidate has; 0 for an empty query."""
    return F.size(F.array_intersect(query, candidate)) / F.greatest(F.lit(1), F.size(query))


def preview(c: Column, n: int, end: str = "...") -> Column:
    return F.when(F.length(text(c)) > n, F.concat(F.left(text(c), F.lit(n)), F.lit(end))).otherwise(text(c))


def truncated(c: Column, n: int) -> Column:
    """The first n characters with a note of the length; all for n of 0 or less."""
    t = text(c)
    if n <= 0:
        return t
    return F.when(F.length(t) > n, F.concat(F.left(t, F.lit(n)), F.lit("...(truncated, len="), F.length(t).cast("string"), F.lit(")"))).otherwise(t)


def snippet(c: Column, n: int = 700) -> Column:
    return F.left(F.replace(text(c), F.lit("\n"), F.lit(" ")), F.lit(n))


def self_query(title: Column, clause: Column, body: Column, n: int = 400) -> Column:
    return strip(F.concat_ws("\n", text(title), text(clause), F.left(strip(text(body)), F.lit(n))))


def text_hash(c: Column) -> Column:
    return F.md5(text(c))


def line_count(c: Column) -> Column:
    return F.length(text(c)) - F.length(F.replace(text(c), F.lit("\n"), F.lit(""))) + 1


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(text(c), r"(?U)\s+"), lambda w: w != ""))


def html_escape(c: Column) -> Column:
    out = text(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def safe_int(c: Column, default: int = 0) -> Column:
    return F.coalesce(c.try_cast("int"), F.lit(default))


def mcq_prompt(question: Column, options: Column) -> Column:
    ask = "Choose one option of this multiple-choice question. Answer with a JSON object that has the keys answer (the option's number as a string) and citations (up to three objects with chunk_id and quote, from the context).\n\nQuestion: "
    return F.concat(F.lit(ask), text(question), F.lit("\nOptions:\n"), F.array_join(options, "\n"), F.lit("\n"))


def _any_of(c: Column, needles) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(n)) for n in needles])


def is_normative(c: Column) -> Column:
    return _any_of(F.lower(text(c)), NORMATIVE)


def is_definition(c: Column) -> Column:
    t = strip(text(c))
    low = F.concat(F.lit(" "), F.lower(t), F.lit(" "))
    first = F.get(F.split(F.left(t, F.lit(400)), LINE_END), F.lit(0))
    return (t != "") & (_any_of(low, DEFINITION_MARKERS) | F.left(t, F.lit(400)).rlike(GLOSSARY) | (first.rlike(NUMBERED_TITLE) & low.rlike(DEFINING_VERB)))


def is_boilerplate(clause: Column, last_page: Column, body: Column) -> Column:
    low = F.lower(text(body))
    return (clause == "UNKNOWN") & (last_page <= 8) & (_any_of(low, BOILERPLATE) | (F.contains(low, F.lit("contents")) & F.contains(low, F.lit("intellectual property"))))


def is_toc(line: Column) -> Column:
    return F.contains(line, F.lit("...")) & line.rlike(TOC)


def is_numbered(line: Column) -> Column:
    """Whether a line starts with a number of parts, as each heading does; few lines come to the pattern."""
    return F.left(strip(line), F.lit(1)).between("0", "9") & line.rlike(NUMBERED)


def without_toc(title: Column) -> Column:
    return strip(F.regexp_replace(title, TOC, ""))


def plausible_clause(number: Column) -> Column:
    """Not a date, a year above 2000 or a decimal: see the rules of each part."""
    p = F.split(number, r"\.")
    n = lambda i: F.get(p, F.lit(i)).try_cast("int")
    date = (F.size(p) == 3) & n(0).between(1900, 2100) & n(1).between(1, 12) & n(2).between(1, 31)
    digits = F.forall(p, lambda x: x.rlike(r"^\d+$"))
    later = F.exists(F.slice(p, 2, 100), lambda x: F.length(x) >= 3)
    return F.coalesce(digits & ~date & (n(0) <= 2000) & ~later, F.lit(False))


def heading_number(line: Column) -> Column:
    return F.regexp_extract(line, HEADING, 1)


def heading_title(line: Column) -> Column:
    return without_toc(F.regexp_extract(line, HEADING, 2))


def is_heading(line: Column) -> Column:
    return line.rlike(HEADING) & plausible_clause(heading_number(line)) & (F.length(heading_title(line)) >= 2)


def matches(filters: dict[str, str] | None, columns) -> Column:
    """Case-insensitive equality with every filter that has a value; a missing column counts as empty."""
    out = F.lit(True)
    for k, v in (filters or {}).items():
        if v not in (None, ""):
            out = out & (F.lower(text(F.col(k).cast("string")) if k in columns else F.lit("")) == str(v).lower())
    return out
