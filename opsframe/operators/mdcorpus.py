"""Structure of a corpus of Markdown documents: blocks, headings, links, tables, inline markup.

A document's lines are read from top to bottom by a fold inside its row, so nothing is shuffled, and documents that share
an id, or have none, stay apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.functions.text import WHITE_SPACE, blank_if_null, col, html_escape, strip

# Line shapes.
FENCE = "```"
RULE = r"^(-{3,}|\*{3,}|_{3,})$"
HEADING = r"^(#{1,6})\s+(.*)$"
BULLET = r"^[-*+]\s+"
NUMBERED = r"^\d+[.)]\s+"
TABLE_RULE = r"^[\s|:-]+$"
QUOTE_MARK = r"^>\s?"
# Inline shapes.
CODE_SPAN = "`([^`]+)`"
IMAGE = r"!\[([^\]]*)\]\(([^)\s]+)\)"
LINK = r"\[([^\]]*)\]\(([^)\s]+)\)"
BOLD = r"\*\*([^*]+)\*\*"
ITALIC = r"(^|[^*])\*([^*\n]+)\*"
STRIKE = "~~([^~]+)~~"


CHUNK = 128  # items folded at a time: appending copies an array, so a long one is folded piece by piece


def running(items: Column, start: Column, kind: str, step: Callable[[Column, Column], Column]) -> Column:
    """States of a fold after each item of an array: ``step(state, item)`` gives the next state, ``kind`` is its type.

    The array is cut into pieces, each folded into an array of its own, so the cost grows with n times the square root of
    n at worst, and no row leaves its place.
    """
    def fold(part: Column, first: Column) -> Column:
        def add(acc: Column, item: Column) -> Column:
            return _named(step(acc["state"], item), lambda s: F.struct(s.alias("state"), F.array_append(acc["out"], s).alias("out")))

        return F.aggregate(part, F.struct(first.alias("state"), F.array().cast(f"array<{kind}>").alias("out")), add)

    def piece(acc: Column, at: Column) -> Column:
        done = fold(F.slice(items, at * CHUNK + 1, F.lit(CHUNK)), acc["state"])
        return _named(done, lambda d: F.struct(d["state"].alias("state"), F.array_append(acc["out"], d["out"]).alias("out")))

    pieces = F.sequence(F.lit(0), F.greatest(F.floor((F.size(items) - 1) / CHUNK).cast("int"), F.lit(0)))
    empty = F.struct(start.cast(kind).alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.flatten(F.aggregate(pieces, empty, piece)["out"])


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


STATE = "struct<fence: boolean, table_at: int, prev: string, kind: string, block_no: bigint, head: boolean, marker: boolean>"


def _states(docs: DataFrame, doc: str, body: str) -> DataFrame:
    """``doc, _raw, _t, _s``: lines, their stripped texts, and the state of a machine that reads them from top to bottom.

    The state of a line tells its kind, its block, whether it begins it, and where its table began.  Everything happens
    inside the document's row.
    """
    text = F.regexp_replace(blank_if_null(body), "\r\n?", "\n")
    lines = docs.select(doc, F.split(text, "\n", -1).alias("_raw"))
    lines = lines.withColumn("_t", F.transform("_raw", lambda r: F.btrim(r, F.lit(WHITE_SPACE))))
    kind = lambda t: (
        F.when(t == "", "blank").when(t.rlike(RULE), "rule").when(t.rlike(HEADING), "heading").when(t.startswith(">"), "quote")
        .when(t.rlike(BULLET), "ul").when(t.rlike(NUMBERED), "ol").otherwise("paragraph"))
    separates = F.transform("_t", lambda t: t.contains("|") & t.contains("-") & t.rlike(TABLE_RULE))
    lines = lines.withColumns({"_base": F.transform("_t", kind), "_sep": separates})
    marks = F.transform("_t", lambda t, i: F.struct(
        i.alias("n"), t.startswith(FENCE).alias("mark"), t.contains("|").alias("pipe"), F.get("_base", i).alias("base"),
        # a table may begin here: the next line separates a header from its rows
        (F.coalesce(F.get("_sep", i + 1), F.lit(False)) & ~F.get("_base", i).isin("heading", "quote")).alias("top")))
    lines = lines.withColumn("_marks", marks)

    def step(s: Column, x: Column) -> Column:
        fenced = s["fence"] | x["mark"]
        in_list = x["base"].isin("ul", "ol") & (s["prev"] == x["base"])
        table_at = F.when(x["pipe"] & ~fenced, F.when(s["table_at"] >= 0, s["table_at"]).when(x["top"] & ~in_list, x["n"]).otherwise(-1)).otherwise(-1)

        def judged(at: Column) -> Column:
            kind = F.when(fenced, "fence").when(at >= 0, "table").otherwise(x["base"])
            head = (kind != "blank") & ((kind != s["kind"]) | kind.isin("rule", "heading") | (x["mark"] & ~s["fence"]))
            return _named(F.struct(kind.alias("kind"), head.alias("head")), lambda k: F.struct(
                (s["fence"] != x["mark"]).alias("fence"), at.alias("table_at"), F.when(fenced, "fence").otherwise(x["base"]).alias("prev"),
                k["kind"].alias("kind"), (s["block_no"] + k["head"].cast("bigint")).alias("block_no"), k["head"].alias("head"), x["mark"].alias("marker")))

        return _named(table_at, judged)

    start = F.struct(F.lit(False), F.lit(-1), F.lit(""), F.lit(""), F.lit(0).cast("bigint"), F.lit(False), F.lit(False))
    return lines.select(doc, "_raw", "_t", running(F.col("_marks"), start, STATE, step).alias("_s"))


def _line(raw: Column, t: Column, s: Column, n: Column) -> Column:
    """What is known of a line: its number, text, kind, block, and its text without block markup (NULL for markup only)."""
    kind, table_line = s["kind"], F.when(s["table_at"] >= 0, n - s["table_at"])
    content = (
        F.when((kind == "fence") & ~s["marker"], raw)
        .when(kind == "heading", F.btrim(F.regexp_extract(t, HEADING, 2), F.lit(WHITE_SPACE)))
        .when(kind == "quote", F.regexp_replace(t, QUOTE_MARK, ""))
        .when(kind == "ul", F.regexp_replace(t, BULLET, ""))
        .when(kind == "ol", F.regexp_replace(t, NUMBERED, ""))
        .when((kind == "paragraph") | ((kind == "table") & (table_line != 1)), t)
    )
    return F.struct(n.alias("n"), raw.alias("raw"), t.alias("t"), kind.alias("kind"), s["block_no"].alias("block_no"), s["head"].alias("head"),
                    table_line.alias("table_line"), content.alias("content"))


def _lines(docs: DataFrame, doc: str, body: str) -> DataFrame:
    """``doc, _lines``: the array of a document's lines that are not blank."""
    found = F.transform("_s", lambda s, i: _line(F.get("_raw", i), F.get("_t", i), s, i))
    return _states(docs, doc, body).select(doc, F.filter(found, lambda x: x["kind"] != "blank").alias("_lines"))


def classify_lines(docs: DataFrame, doc: str, body: str) -> DataFrame:
    """One row per non-blank line: ``doc, n, raw, t, kind, block_no, head, table_line, content`` (``head`` marks a block's first line)."""
    return _lines(docs, doc, body).select(doc, F.inline("_lines"))


def _blocks(docs: DataFrame, doc: str, body: str) -> DataFrame:
    """``doc, kind, block_no, lines``: one row per block with its lines, cut from the document's row."""
    rows = _lines(docs, doc, body)
    places = F.filter(F.transform("_lines", lambda x, i: F.when(x["head"], i)), lambda i: i.isNotNull())
    rows = rows.withColumn("_at", places)
    cut = F.transform("_at", lambda a, k: F.slice("_lines", a + 1, F.coalesce(F.get("_at", k + 1), F.size("_lines")) - a))
    blocks = rows.select(doc, F.explode(cut).alias("lines"))
    return blocks.select(doc, F.col("lines")[0]["kind"].alias("kind"), F.col("lines")[0]["block_no"].alias("block_no"), "lines")


def _joined(lines: Column) -> Column:
    """Contents of lines, one below the other; lines that are markup only do not count."""
    return F.array_join(F.transform(lines, lambda x: x["content"]), "\n")


def md_blocks(docs: DataFrame, doc: str, body: str) -> DataFrame:
    """``doc, block_no, kind, first_line, n_lines, text``."""
    lines = F.col("lines")
    return _blocks(docs, doc, body).select(
        doc, "block_no", "kind", (lines[0]["n"] + 1).alias("first_line"), F.size(lines).cast("bigint").alias("n_lines"), _joined(lines).alias("text"))


# Marks dropped from an anchor, what may stay in it, and the anchor of an empty title.
SLUG_DROPS, SLUG_REST, SLUG_EMPTY = r"[`*_~\[\]()#!]", "[^A-Za-z0-9_一-龥-]", "section"


def slug(c: Column | str) -> Column:
    s = F.regexp_replace(F.lower(col(c)), SLUG_DROPS, "")
    s = F.regexp_replace(F.regexp_replace(s, r"(?U)\s+", "-"), SLUG_REST, "")
    return F.when(s == "", SLUG_EMPTY).otherwise(s)


def md_headings(docs: DataFrame, doc: str, body: str) -> DataFrame:
    """``doc, line_no, level, title, anchor``; repeated anchors get -1, -2, ..."""
    rows = _lines(docs, doc, body).select(doc, F.filter("_lines", lambda x: x["kind"] == "heading").alias("_h"))
    found = F.transform("_h", lambda x: F.struct(slug(x["content"]).alias("slug"), x["n"].alias("n"), x["t"].alias("t"), x["content"].alias("content")))
    rows = rows.select(doc, F.array_sort(found).alias("_h"))  # equal anchors stand together, in the order of their lines
    start = F.struct(F.lit(None), F.lit(-1))
    times = running(F.col("_h"), start, "struct<slug: string, nth: int>", lambda s, x: F.struct(
        x["slug"].alias("slug"), F.when(s["slug"].eqNullSafe(x["slug"]), s["nth"] + 1).otherwise(0).alias("nth")))
    rows = rows.select(doc, F.inline(F.arrays_zip(F.col("_h").alias("h"), times.alias("k"))))
    anchor = F.when(F.col("k.nth") == 0, F.col("h.slug")).otherwise(F.concat("h.slug", F.lit("-"), F.col("k.nth").cast("string")))
    return rows.select(doc, (F.col("h.n") + 1).alias("line_no"), F.length(F.regexp_extract("h.t", HEADING, 1)).alias("level"),
                       F.col("h.content").alias("title"), anchor.alias("anchor"))


def split_cells(t: Column | str) -> Column:
    inner = F.regexp_replace(F.regexp_replace(strip(t), r"^\|", ""), r"\|$", "")
    return F.transform(F.split(inner, r"\|", -1), lambda c: strip(c))


def md_tables(docs: DataFrame, doc: str, body: str) -> DataFrame:
    """``doc, block_no, row_no, col_no, header, value``: body rows padded or cut to the header's width."""
    rows = _blocks(docs, doc, body).filter("kind = 'table'").select(
        doc, "block_no", split_cells(F.col("lines")[0]["t"]).alias("_head"), F.explode(F.filter("lines", lambda x: x["table_line"] != 1)).alias("l"))
    row_no = F.when(F.col("l.table_line") == 0, 0).otherwise(F.col("l.table_line") - 1)
    cells = rows.select(doc, "block_no", row_no.alias("row_no"), split_cells("l.t").alias("_cells"), F.posexplode("_head").alias("_c", "header"))
    return cells.select(doc, "block_no", "row_no", (F.col("_c") + 1).alias("col_no"), "header",
                        F.coalesce(F.get("_cells", F.col("_c")), F.lit("")).alias("value"))


def md_units(docs: DataFrame, doc: str, body: str) -> DataFrame:
    """Stretches of text in which inline markup may occur: ``doc, block_no, unit_no, kind, text``.

    A paragraph or a quote is one unit, a list has one per item, a table one per row (its cells never share markup).
    """
    rows = _blocks(docs, doc, body).filter("kind NOT IN ('fence', 'rule')")
    whole = F.array(F.struct(F.lit(0).alias("unit_no"), _joined(F.col("lines")).alias("text")))
    each = F.transform(F.filter("lines", lambda x: x["content"].isNotNull()), lambda x: F.struct(x["n"].alias("unit_no"), x["content"].alias("text")))
    units = F.when(F.col("kind").isin("paragraph", "quote"), whole).otherwise(each)
    return rows.select(doc, "block_no", F.inline(units), "kind").select(doc, "block_no", "unit_no", "kind", "text")


def links_in(text: Column | str) -> Column:
    """Images first, then links, as ``array<struct<kind,label,url>>``; code spans hold neither."""
    plain = F.regexp_replace(col(text), "`[^`]+`", " ")
    rest = F.regexp_replace(plain, IMAGE, "$1")

    def found(source: Column, pattern: str, kind: str) -> Column:
        labels = F.regexp_extract_all(source, F.lit(pattern), F.lit(1))
        urls = F.regexp_extract_all(source, F.lit(pattern), F.lit(2))
        return F.zip_with(labels, urls, lambda a, b: F.struct(F.lit(kind).alias("kind"), a.alias("label"), b.alias("url")))

    return F.concat(found(plain, IMAGE, "image"), found(rest, LINK, "link"))


def md_links(docs: DataFrame, doc: str, body: str) -> DataFrame:
    units = md_units(docs, doc, body)
    return units.select(doc, "block_no", "unit_no", F.posexplode(links_in("text")).alias("pos", "_l")).select(
        doc, "block_no", "unit_no", "pos", "_l.kind", "_l.label", "_l.url")


def _around_code(text: Column, convert, code) -> Column:
    """Apply ``convert`` with code spans held back, then put the spans back in order."""
    codes = F.regexp_extract_all(text, F.lit(CODE_SPAN), F.lit(1))
    parts = F.split(convert(F.regexp_replace(text, "`[^`]+`", "\u0000")), "\u0000", -1)
    tail = F.array_join(F.transform(codes, lambda c, i: F.concat(code(c), F.get(parts, i + 1))), "")
    return F.concat(F.get(parts, F.lit(0)), tail)


def inline_html(c: Column | str) -> Column:
    """Inline markup as HTML.  The tags are fixed values: the output form of the converter."""
    def convert(s: Column) -> Column:
        s = html_escape(s)
        s = F.regexp_replace(s, IMAGE, '<img src="$2" alt="$1">')
        s = F.regexp_replace(s, LINK, '<a href="$2" target="_blank" rel="noopener">$1</a>')
        s = F.regexp_replace(s, BOLD, "<strong>$1</strong>")
        s = F.regexp_replace(s, ITALIC, "$1<em>$2</em>")
        return F.regexp_replace(s, STRIKE, "<del>$1</del>")

    return _around_code(blank_if_null(c), convert,
                        lambda x: F.concat(F.lit("<code>"), html_escape(x), F.lit("</code>")))


def inline_text(c: Column | str) -> Column:
    """Inline markup removed, words kept."""
    def convert(s: Column) -> Column:
        s = F.regexp_replace(s, IMAGE, "$1")
        s = F.regexp_replace(s, LINK, "$1")
        s = F.regexp_replace(s, BOLD, "$1")
        s = F.regexp_replace(s, ITALIC, "$1$2")
        return F.regexp_replace(s, STRIKE, "$1")

    return _around_code(blank_if_null(c), convert, lambda x: x)


# The kinds of blocks.
KINDS = ["fence", "table", "rule", "heading", "quote", "ul", "ol", "paragraph"]


def md_census(docs: DataFrame, doc: str, body: str) -> DataFrame:
    """Blocks of each kind per document."""
    heads = _states(docs, doc, body).select(doc, F.transform(F.filter("_s", lambda s: s["head"]), lambda s: s["kind"]).alias("_k"))
    def tally(kind: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.size(F.filter("_k", lambda x: x == kind)).cast("bigint").alias("n"))

    counts = F.array(*map(tally, KINDS))
    return heads.select(doc, F.inline(F.filter(counts, lambda c: c["n"] > 0)))


def md_elements(docs: DataFrame, doc: str, body: str) -> DataFrame:
    """Number of block-level elements (headings, paragraphs, list items, table rows, code blocks) per document that is not blank."""
    one = lambda s, i: (s["head"] & s["kind"].isin("heading", "paragraph", "fence")) | s["kind"].isin("ul", "ol") | (
        (s["kind"] == "table") & (i - s["table_at"] != 1))
    counted = F.aggregate(F.transform("_s", lambda s, i: one(s, i).cast("int")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    some = F.exists("_s", lambda s: s["kind"] != "blank")
    # a generator drops the rows: a filter would be pushed below the fold and run it twice
    return _states(docs, doc, body).select(doc, F.explode(F.when(some, F.array(counted))).alias("n_elements"))
