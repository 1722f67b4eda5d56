"""Column builders against hand-made expectations."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T


def one(spark, build, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(build(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


@pytest.mark.parametrize("name,wg,version", [("X.WG3.Some-Spec.0-v05.00.pdf", "WG3", "05.00"), ("A-WG4-B_v01.02.03.docx", "WG4", "01.02.03"), ("spec wg 7 (1).pdf", "WG7", "UNKNOWN"), ("XWG12y.2.1-v3.0.pdf", "WG12", "3.0"), ("plain 4.5.6.pdf", "UNKNOWN", "4.5.6"), ("nothing", "UNKNOWN", "UNKNOWN"), ("a2.0_V4.10.pdf", "UNKNOWN", "4.10")])
def test_names(spark, name, wg, version):
    assert one(spark, T.working_group, name) == wg and one(spark, T.version, name) == version


def test_strip_and_normalise(spark):
    assert one(spark, T.strip, " \n a \t ") == "a"
    assert one(spark, T.normalised, " a  b\t c\nd ") == "a b c\nd" and one(spark, T.normalised, None) == ""
    assert one(spark, T.without_artefacts, "a­b  c\n\n\n\nd") == "ab c\n\nd"


def test_tokens(spark):
    assert one(spark, T.domain_tokens, "Semi-AB CDE, X-YZ-QW a.b/c_d x") == ["semi-ab", "semi", "ab", "semiab", "cde", "x-yz-qw", "x", "yz", "qw", "xyzqw", "a.b/c_d", "a", "b", "c", "d", "abcd", "x"]
    assert one(spark, T.simple_tokens, "A-b/ c.D,") == ["a-b/", "c.d"]
    assert one(spark, T.keywords, "The the ABC abc of-it 12 345 as") == ["abc", "of-it", "345"]
    assert one(spark, lambda a, b: T.overlap_ratio(T.keywords(a), T.keywords(b)), "alpha beta gamma", "beta delta alpha") == pytest.approx(2 / 3)
    assert one(spark, lambda a, b: T.overlap_ratio(T.keywords(a), T.keywords(b)), "of a", "beta") == 0


@pytest.mark.parametrize("line,toc,heading", [("4.1 Scope ........ 12", True, True), ("4.1 Scope", False, True), ("  4.1.2   Indented title  ", False, True), ("7 Scope", False, False), ("28.552 text here", False, False), ("2022.11.17 text", False, False), ("4.10 X", False, False), ("3001.1 Large", False, False), ("4.1", False, False), ("text 4.1 Scope", False, False)])
def test_headings(spark, line, toc, heading):
    assert one(spark, T.is_toc, line) == toc and one(spark, T.is_heading, line) == heading


def test_heading_title_loses_dots(spark):
    assert one(spark, T.heading_title, "4.1 Scope ........ 12") == "Scope" and one(spark, T.heading_number, "4.1 Scope") == "4.1"


@pytest.mark.parametrize("text,normative,definition", [("It shall be so.", True, False), ("shall", False, False), ("3 Definitions and more", False, True), ("Widget: a thing that turns", False, True), ("3.1 Widget\nThis means a thing", False, True), ("3.1 Widget\nnothing here", False, False), ("", False, False), (None, False, False)])
def test_flags(spark, text, normative, definition):
    assert one(spark, T.is_normative, text) == normative and one(spark, T.is_definition, text) == definition


def test_previews(spark):
    assert one(spark, lambda c: T.preview(c, 3), "abcd") == "abc..." and one(spark, lambda c: T.preview(c, 4), "abcd") == "abcd"
    assert one(spark, lambda c: T.truncated(c, 2), "abcd") == "ab...(truncated, len=4)" and one(spark, lambda c: T.truncated(c, 0), "abcd") == "abcd"
    assert one(spark, T.html_escape, "<a & 'b'>") == "&lt;a &amp; 'b'&gt;" and one(spark, T.line_count, "a\nb\n") == 3 and one(spark, T.word_count, " a b  c ") == 3
    assert one(spark, T.safe_int, "12") == 12 and one(spark, T.safe_int, "x") == 0
    assert one(spark, T.self_query, "t", "4.1", " body ") == "t\n4.1\nbody" and one(spark, T.search_text, None, "4.1", "b") == "4.1\nb"
    assert one(spark, T.document_id, "/a/b.c/Spec v1.0.pdf") == "Spec v1.0"
    assert "Options:\n1. a\n2. b" in one(spark, lambda q: T.mcq_prompt(q, F.array(F.lit("1. a"), F.lit("2. b"))), "Q?")


def test_boilerplate(spark):
    df = spark.createDataFrame([("UNKNOWN", 8, "Notice of Disclaimer"), ("UNKNOWN", 9, "notice of disclaimer"), ("4.1", 2, "notice of disclaimer"), ("UNKNOWN", 1, "Contents ... Intellectual Property"), ("UNKNOWN", 1, "contents")], "c string, p int, t string")
    assert [r[0] for r in df.select(T.is_boilerplate(F.col("c"), F.col("p"), F.col("t"))).collect()] == [True, False, False, True, False]


def test_filters(spark):
    df = spark.createDataFrame([("WG1", "A"), ("wg2", None)], "wg string, doc string")
    assert df.where(T.matches({"wg": "wg1", "doc": ""}, df.columns)).count() == 1
    assert df.where(T.matches({"none": "x"}, df.columns)).count() == 0 and df.where(T.matches(None, df.columns)).count() == 2
