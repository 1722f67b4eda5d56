"""From page lines to chunks: headings, clause blocks, sentence packing, ids and flags.

All of it is DataFrame code keyed by document: windows for what looks back along a document, and folds over a block's
sentences inside one row. Each fold is a column of its own, so that none is evaluated twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T

LEAST, MOST, SHORT = 400, 2200, 200
KEEP, KEEP_DEFINITION = 120, 80


def _cut(pages: DataFrame) -> DataFrame:
    """doc_id, page_num, pos, line: a line's place is that in its page."""
    cut = pages.select("doc_id", "page_num", F.posexplode(T.lines_of(F.replace(T.text("text"), F.lit("\u00a0"), F.lit(" ")))).alias("pos", "raw"))
    return cut.select("doc_id", "page_num", "pos", T.rstrip(F.col("raw")).alias("line")).where("line != ''")


def _placed(pages: DataFrame) -> DataFrame:
    """As lines, but line_no is a line's page and its place there, which orders lines as counting them along the document does,
    without a shuffle. A page without number comes first, as nulls do."""
    place = F.shiftleft(F.coalesce(F.col("page_num").cast("bigint"), F.lit(-(2**31)).cast("bigint")), 32) + F.col("pos")
    return _cut(pages).select("doc_id", "page_num", place.alias("line_no"), "line")


def lines(pages: DataFrame) -> DataFrame:
    """doc_id, page_num, line_no, line of every line that isn't blank; line_no counts along the document's pages."""
    order = Window.partitionBy("doc_id").orderBy("page_num", "pos")
    return _cut(pages).select("doc_id", "page_num", (F.row_number().over(order) - 1).alias("line_no"), "line")


def without_toc(lines: DataFrame, last_page: int = 30) -> DataFrame:
    return lines.where(~((F.col("page_num") <= last_page) & T.is_toc(F.col("line"))))


def _heading(line: Column) -> Column:
    """number and title of a line that is a heading, or null; each is found once."""
    found = F.struct(T.heading_number(line).alias("number"), T.heading_title(line).alias("title"))
    return T.let(found, lambda h: F.when((h["number"] != "") & T.plausible_clause(h["number"]) & (F.length(h["title"]) >= 2), h))


def headings(lines: DataFrame) -> DataFrame:
    own = lines.where(T.is_numbered(F.col("line"))).withColumn("h", T.computed(_heading(F.col("line"))))
    return own.where("h is not null").select("doc_id", "page_num", "line_no", "h.number", "h.title")


def _numbers(low: Column) -> Column:
    """The heading numbers that a line starts with: a first part, and what its next parts, of two digits at most and six of
    them, begin with. 4.10 gives 4.1 and 4.10."""
    first, more = F.regexp_extract(low, r"^(\d+)((?:\.\d{1,2}){1,6})", 1), F.regexp_extract(low, r"^(\d+)((?:\.\d{1,2}){1,6})", 2)
    ends = F.filter(F.sequence(F.lit(2), F.greatest(F.lit(2), F.length(more))), lambda k: (k <= F.length(more)) & (F.substr(more, k, F.lit(1)) != "."))
    return T.let(F.struct(first.alias("a"), more.alias("b")), lambda x: F.transform(ends, lambda k: F.concat(x["a"], F.substr(x["b"], F.lit(1), k))))


def _first(asked: DataFrame) -> DataFrame:
    """doc_id, page_num, line_no, heading: of each line in asked the first heading of its page whose number it starts with and enough
    of whose title words it has; lines without any have no row.

    asked: doc_id, page_num, number, and a line that may start with that number (line_no, low: the line in lower case) or a heading
    with it (h: no, number, title), or both. A page's number is a row, in which its headings stand once.
    """
    words = F.slice(F.filter(F.regexp_extract_all(F.lower("h.title"), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) >= 3), 1, 6)
    one = F.when(F.col("h").isNotNull(), F.struct("h.no", "h.number", "h.title", words.alias("words")))
    row = F.when(F.col("line_no").isNotNull(), F.struct("line_no", "low"))
    by = asked.where("doc_id is not null and page_num is not null").groupBy("doc_id", "page_num", "number").agg(F.array_sort(F.collect_list(one)).alias("heads"), F.collect_list(row).alias("rows"))

    def has(h: Column, low: Column) -> Column:
        return F.size(F.filter(h["words"], lambda w: F.contains(low, w))) >= F.when(F.size(h["words"]) == 0, 0).when(F.size(h["words"]) <= 2, 1).otherwise(2)

    pairs = F.transform("rows", lambda x: F.struct(x["line_no"].alias("line_no"), F.get(F.filter("heads", lambda h: has(h, x["low"])), F.lit(0)).alias("h")))
    found = by.where(F.size("heads") > 0).select("doc_id", "page_num", F.explode(pairs).alias("x")).where("x.h is not null")
    best = found.groupBy("doc_id", "page_num", "x.line_no").agg(F.min(F.struct("x.h.no", "x.h.number", "x.h.title")).alias("x"))
    return best.select("doc_id", "page_num", "line_no", F.struct("x.number", "x.title").alias("heading"))


def _asked(lines: DataFrame) -> DataFrame:
    """The lines that start with a number: doc_id, page_num, line_no, line, low, number (each that the line may start with)."""
    starts = lines.where(T.is_numbered(F.col("line"))).select("doc_id", "page_num", "line_no", "line", F.lower("line").alias("low"))
    return starts.withColumn("number", F.explode(_numbers(F.lower(T.strip(F.col("line"))))))


def aligned(lines: DataFrame, found: DataFrame) -> DataFrame:
    """lines with the heading (number, title) that each one starts, if any: the first of its page whose number it starts
    with and enough of whose title words it has.

    A line that starts with no number has none and isn't compared.
    """
    asked = _asked(lines).select("doc_id", "page_num", "number", "line_no", "low")
    heads = found.select("doc_id", "page_num", "number", F.struct(F.col("line_no").alias("no"), "number", "title").alias("h"))
    first = _first(asked.unionByName(heads, allowMissingColumns=True))
    return lines.select("doc_id", "page_num", "line_no", "line").join(first, ["doc_id", "page_num", "line_no"], "left")


def marked(lines: DataFrame) -> DataFrame:
    """lines with a row more, its line null, for each one that starts a heading of the lines' own (number, title); `blocks` takes
    these as it takes aligned lines. Texts of lines without numbers aren't joined and aren't shuffled here."""
    kind = "struct<number:string,title:string>"
    asked = _asked(lines).withColumn("own", T.computed(_heading(F.col("line"))))  # a heading is among the numbers that its line starts with
    mine = F.when(F.col("own.number") == F.col("number"), F.struct(F.col("line_no").alias("no"), F.col("own.number").alias("number"), F.col("own.title").alias("title")))
    first = _first(asked.select("doc_id", "page_num", "number", "line_no", "low", mine.alias("h")))
    rest = lines.select("doc_id", "page_num", "line_no", "line", F.lit(None).cast(kind).alias("heading"))
    return rest.unionByName(first.select("doc_id", "page_num", "line_no", F.lit(None).cast("string").alias("line"), F.col("heading").cast(kind).alias("heading")))


def filled(lines: DataFrame) -> DataFrame:
    """marked or aligned lines with h, the heading that each one is under, if any."""
    along = Window.partitionBy("doc_id").orderBy("line_no", F.col("line").isNotNull())
    return lines.withColumn("h", F.last("heading", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0)))


def blocks(lines: DataFrame) -> DataFrame:
    """doc_id, block_i, clause_id, title, page_start, page_end, body: runs of lines (marked or aligned) under one clause number."""
    along = Window.partitionBy("doc_id").orderBy("line_no", F.col("line").isNotNull())
    under = filled(lines).withColumn("clause_id", F.coalesce("h.number", F.lit("UNKNOWN")))
    changed = (F.col("clause_id") != F.lag("clause_id").over(along)).cast("int")
    under = under.withColumn("changed", F.coalesce(changed, F.lit(0))).withColumn("block_i", F.sum("changed").over(along))
    runs = under.where("line is not null").groupBy("doc_id", "block_i", "clause_id").agg(
        F.min_by("h.title", "line_no").alias("title"), F.min("page_num").alias("page_start"), F.max("page_num").alias("page_end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("raw"),
    )
    # behind a generator: filters, ids and digests read the body several times
    return runs.select("doc_id", F.col("block_i").cast("int"), "clause_id", "title", "page_start", "page_end", T.computed(T.normalised(F.col("raw"))).alias("body"))


def sentences(body: Column) -> Column:
    return F.filter(F.split(body, r"(?<=[.?!;:])\s+"), lambda s: s != "")


def _pieces(s: Column, most: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / most).cast("int")), lambda i: F.substr(s, i * most + 1, F.lit(most)))


def _state(out: Column, buffer: Column) -> Column:
    return F.struct(out.alias("out"), buffer.alias("buf"))


def _flushed(a: Column) -> Column:
    return F.when(a["buf"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(a["buf"])))


_EMPTY = "array<string>"


def packed(parts: Column, most: int = MOST) -> Column:
    """Sentences joined greedily up to `most` characters; a longer one is cut into windows of its own.

    The fold goes over lengths and keeps where pieces begin; texts are joined once, when all is known.
    """

    def starts(sizes: Column) -> Column:
        def add(a: Column, n: Column) -> Column:
            fits = (a["n"] > 0) & (n <= most) & (a["n"] + 1 + n <= most)
            begun = F.when(fits, a["out"]).otherwise(F.concat(a["out"], F.array(a["i"])))
            return F.struct(begun.alias("out"), (a["i"] + 1).alias("i"), F.when(n > most, 0).when(fits, a["n"] + 1 + n).otherwise(n).alias("n"))

        start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("i"), F.lit(0).alias("n"))
        return F.aggregate(sizes, start, add, lambda a: a["out"])

    def join(s: Column, begin: Column) -> Column:
        def piece(i: Column, j: Column) -> Column:
            whole = F.array_join(F.slice(s, i + 1, F.coalesce(F.get(begin, j + 1), F.size(s)) - i), " ")
            return F.when(F.length(F.get(s, i)) > most, _pieces(F.get(s, i), most)).otherwise(F.array(whole))

        return F.flatten(F.transform(begin, piece))

    return T.let(parts, lambda s: T.let(starts(F.transform(s, F.length)), lambda begin: join(s, begin)))


def _begins(sizes: Column, joins) -> Column:
    """Where the pieces that are joined by a space begin: a part joins the piece before it if joins(length so far, its length)."""

    def add(a: Column, n: Column) -> Column:
        go = (a["i"] > 0) & joins(a["n"], n)
        begun = F.when(go, a["out"]).otherwise(F.concat(a["out"], F.array(a["i"])))
        return F.struct(begun.alias("out"), (a["i"] + 1).alias("i"), F.when(go, a["n"] + 1 + n).otherwise(n).alias("n"))

    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("i"), F.lit(0).alias("n"))
    return F.aggregate(sizes, start, add, lambda a: a["out"])


def _merged(parts: Column, joins, fold) -> Column:
    """Parts without white space at their ends are merged by their lengths alone, and each piece's text is joined once; where a
    part has some, which a merge strips again and again, by a fold over the texts."""

    def by_length(s: Column) -> Column:
        piece = lambda begin: F.transform(begin, lambda i, j: F.array_join(F.slice(s, i + 1, F.coalesce(F.get(begin, j + 1), F.size(s)) - i), " "))
        return T.let(_begins(F.transform(s, F.length), joins), piece)

    return T.let(parts, lambda s: F.when(F.exists(s, lambda x: (x == "") | (x != T.strip(x))), fold(s)).otherwise(by_length(s)))


def grown(parts: Column, least: int = LEAST) -> Column:
    """A piece below `least` takes the next one, whatever the length."""

    def add(a: Column, s: Column) -> Column:
        return F.when(a["buf"] == "", _state(a["out"], s)).when(F.length(a["buf"]) < least, _state(a["out"], T.strip(F.concat(a["buf"], F.lit(" "), s)))).otherwise(_state(F.concat(a["out"], F.array(a["buf"])), s))

    return _merged(parts, lambda n, more: n < least, lambda s: F.aggregate(s, _state(F.array().cast(_EMPTY), F.lit("")), add, _flushed))


def joined_short(parts: Column, short: int = SHORT, most: int = MOST) -> Column:
    """A short piece joins the one before where it fits; then the last one does."""

    def add(out: Column, raw: Column) -> Column:
        s, last = T.strip(raw), F.element_at(out, -1)
        fits = (F.size(out) > 0) & (F.length(s) < short) & (F.length(F.get(out, F.size(out) - 1)) + 1 + F.length(s) <= most)
        return F.when(s == "", out).when(fits, F.concat(F.slice(out, 1, F.size(out) - 1), F.array(T.strip(F.concat(last, F.lit(" "), s))))).otherwise(F.concat(out, F.array(s)))

    return _merged(parts, lambda n, more: (more < short) & (n + 1 + more <= most), lambda s: F.aggregate(s, F.array().cast(_EMPTY), add))


def chunks(blocks: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """doc_id, block_i, clause_id, title, page_start, page_end, idx, text of every chunk kept; idx may have gaps."""
    df = blocks.where(F.col("body") != "")
    df = df.withColumn("c_p", packed(sentences(F.col("body")), most)).withColumn("c_g", grown(F.col("c_p"), least)).withColumn("c_j", T.computed(joined_short(F.col("c_g"), SHORT, most)))
    kept = F.filter(F.transform("c_j", T.strip), lambda t: (F.length(t) >= KEEP) | ((F.length(t) >= KEEP_DEFINITION) & T.is_definition(t)))
    df = df.withColumn("c_k", kept).select("doc_id", "block_i", "clause_id", "title", "page_start", "page_end", F.posexplode("c_k").alias("idx", "piece"))
    return df.withColumn("text", T.computed(T.normalised(F.col("piece")))).where(F.length("text") >= KEEP_DEFINITION).drop("piece")  # the filters below it read it a dozen times


def corpus(pages: DataFrame, names: DataFrame | None = None, boilerplate: bool = True, least: int = LEAST, most: int = MOST, last_toc_page: int = 30) -> DataFrame:
    """The chunk table of pages (doc_id, page_num, text): twelve columns, flags as 0 or 1. names: doc_id, version, wg; the
    sizes and the last page that may hold a table of contents are those of the configuration's ingest section."""
    df = chunks(blocks(marked(without_toc(_placed(pages), last_toc_page))), least, most)
    if boilerplate:
        df = df.where(~T.is_boilerplate(F.col("clause_id"), F.col("page_end"), F.col("text")))
    if names is not None:
        df = df.join(names.select("doc_id", "version", "wg"), "doc_id", "left")
    unknown = lambda c: F.coalesce(c, F.lit("UNKNOWN")) if names is not None else F.lit("UNKNOWN")
    number = F.nullif(F.col("clause_id"), F.lit("UNKNOWN"))
    return df.select(
        T.chunk_id(F.col("doc_id"), F.col("clause_id"), F.col("page_start"), F.col("page_end"), F.col("block_i"), F.col("idx"), F.col("text")).alias("chunk_id"),
        F.col("doc_id").cast("string").alias("doc_id"), unknown(F.col("version")) if names is not None else F.lit("UNKNOWN").alias("version"), unknown(F.col("wg")) if names is not None else F.lit("UNKNOWN").alias("wg"),
        "clause_id", T.section_path(number, F.col("title")).alias("section_path"), T.text("title").alias("title"), "text", "page_start", "page_end",
        T.is_definition(F.col("text")).cast("int").alias("is_definition"), T.is_normative(F.col("text")).cast("int").alias("is_normative"),
    ).toDF("chunk_id", "doc_id", "version", "wg", "clause_id", "section_path", "title", "text", "page_start", "page_end", "is_definition", "is_normative")
