"""Text expressions: whitespace, patterns, lines, templates."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column
from pyspark.sql import functions as F

# Every white-space character, the byte order mark included, for use inside a character class.
SPACES = r"\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"

# The common patterns offered by the pattern library, by scenario.
PATTERN_LIBRARY = {
    "mobile": r"1[3-9]\d{9}",
    "email": r"[\w.+-]+@[\w-]+\.[\w.]+",
    "date": r"\d{4}-\d{2}-\d{2}",
    "id_card": r"\d{17}[\dXx]",
    "amount": r"\d+(\.\d{1,2})?",
    "cjk": r"[一-龥]+",
    # white space spelled out: the JVM's own class is ASCII
    "edge_space": rf"^[{SPACES}]+|[{SPACES}]+$",
    "space_run": rf"[{SPACES}]{{2,}}",
    "brackets": r"\((.+?)\)",
    "url": r"https?://[\w./?=&%-]+",
}

# Text without which a pattern cannot match: a plain search is far cheaper than starting the pattern at every character.
PATTERN_NEEDS = {"email": "@", "date": "-", "brackets": "(", "url": "http"}

# How a price is written on a page (currency prefix, or a yuan suffix).
PRICE_PATTERN = (
    rf"(?:[¥￥$][{SPACES}]?(\p{{Nd}}{{1,3}}(?:,\p{{Nd}}{{3}})*(?:\.\p{{Nd}}{{1,2}})?|\p{{Nd}}+(?:\.\p{{Nd}}{{1,2}})?))"
    rf"|(?:\p{{Nd}}+(?:\.\p{{Nd}}{{1,2}})?[{SPACES}]?元)"
)
PRICE_PATTERN_LONG = PRICE_PATTERN.replace(r"(?:,\p{Nd}{3})*", r"(?:,\p{Nd}{3})+")

# Characters that may not appear in a file name.
UNSAFE_NAME = r'[\\/:*?"<>|]'

# File categories and their extensions.
CATEGORIES = {
    "图片": [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".tiff", ".heic"],
    "文档": [".pdf", ".doc", ".docx", ".txt", ".md", ".ppt", ".pptx"],
    "表格": [".xls", ".xlsx", ".csv"],
    "压缩包": [".zip", ".rar", ".7z", ".tar", ".gz"],
    "视频": [".mp4", ".avi", ".mov", ".mkv", ".wmv"],
    "音频": [".mp3", ".wav", ".m4a", ".flac"],
    "其他": ["*"],
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def named(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def blank_if_null(c: Column | str) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(""))


# Unicode white space, as a set of characters to trim.
WHITE_SPACE = ("\t\n\x0b\x0c\r \x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029"
               "\u202f\u205f\u3000")


def strip(c: Column | str) -> Column:
    """Trim Unicode white space, which plain ``trim`` leaves (full-width space, no-break space, tabs).

    A character-set trim only looks at the two ends; a regular expression would scan every cell.
    """
    return F.btrim(blank_if_null(c), F.lit(WHITE_SPACE))


def squeeze(c: Column | str) -> Column:
    """Collapse every white-space run to one space and trim."""
    return F.trim(F.regexp_replace(blank_if_null(c), r"(?U)\s+", " "))


def is_blank(c: Column | str) -> Column:
    """Nothing but white space.  The search ends at the first other character."""
    return ~blank_if_null(c).rlike(r"(?U)\S")


def or_label(c: Column | str, label: str) -> Column:
    """Stripped text, or ``label`` where nothing is left."""
    s = strip(c)
    return F.when(s == "", F.lit(label)).otherwise(s)


def drop_chars(c: Column, chars: str) -> Column:
    return F.translate(c, chars, "")


# --- patterns ---------------------------------------------------------------------------------------------------

# Word boundary over ASCII letters, digits and underscore; the JVM's own looks at all letters.
ASCII_BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def with_flags(pattern: str, flags: str = "") -> str:
    """The pattern with its flags in front and ASCII word boundaries."""
    keep = "".join(f for f in "ims" if f in flags)
    pattern = re.sub(r"\\\\|\\b", lambda m: ASCII_BOUNDARY if m.group(0) == "\\b" else m.group(0), pattern)
    return f"(?{keep}){pattern}" if keep else pattern


def usable_pattern(pattern: Column) -> Column:
    """The pattern of a cell, NULL where it is malformed, so that one bad cell does not end the job."""
    return F.when(F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern).isNotNull(), pattern)


def is_pattern(pattern: str) -> bool:
    """Whether a pattern given as a parameter is well formed."""
    jvm = SparkContext._active_spark_context._jvm
    try:
        jvm.java.util.regex.Pattern.compile(pattern)
    except (IllegalArgumentException, Py4JJavaError):
        return False
    return True


def matches(c: Column | str, pattern: str | Column, flags: str = "", group: int = 0, first_only: bool = False) -> Column:
    """Array of all matches (or of one capture group) in order of occurrence; a cell's malformed pattern matches nothing."""
    if isinstance(pattern, str):
        found = F.regexp_extract_all(blank_if_null(c), F.lit(with_flags(pattern, flags)), F.lit(group))
    else:
        found = F.coalesce(F.regexp_extract_all(blank_if_null(c), usable_pattern(pattern), F.lit(group)), F.array().cast("array<string>"))
    return F.slice(found, 1, 1) if first_only else found


def match_groups(c: Column | str, pattern: str, n_groups: int, flags: str = "", first_only: bool = False) -> Column:
    """Array of structs ``match, g1..gn``, one per match; a group that took no part is NULL.

    The extract gives empty text for such a group.  A group that did match nothing can be told apart on the match
    itself: a back reference to it succeeds, one to a group that took no part fails.
    """
    arrays = [matches(c, pattern, flags, g, first_only).alias("match" if g == 0 else f"g{g}")
              for g in range(n_groups + 1)]
    whole = with_flags(pattern, flags)

    def took_part(m: Column, g: int) -> Column:
        value = m[f"g{g}"]
        return F.when((value != "") | m["match"].rlike(rf"\A(?:{whole})\z\{g}"), value).alias(f"g{g}")

    return F.transform(F.arrays_zip(*arrays), lambda m: F.struct(
        m["match"].alias("match"), *[took_part(m, g) for g in range(1, n_groups + 1)]))


def replace_pattern(c: Column | str, pattern: str, replacement: str, flags: str = "") -> Column:
    """Global replacement with ``$1`` style group references."""
    return F.regexp_replace(blank_if_null(c), with_flags(pattern, flags), replacement)


def count_matches(c: Column | str, pattern: str, flags: str = "") -> Column:
    return F.regexp_count(blank_if_null(c), F.lit(with_flags(pattern, flags)))


def price_hits(c: Column | str, pattern: str | Column | None = None, group: int = 0,
               long_amounts: bool = False) -> Column:
    """All price texts in a page, inner spaces removed, empty hits dropped."""
    pat = pattern if pattern is not None else (PRICE_PATTERN_LONG if long_amounts else PRICE_PATTERN)
    found = matches(c, pat, group=group)
    return F.filter(F.transform(found, lambda h: F.replace(strip(h), F.lit(" "), F.lit(""))), lambda h: h != "")


def pattern_census(df, key: str, c: str, patterns: dict[str, str] | None = None):
    """Long table ``key, pattern, n`` of match counts; the patterns are counted in one pass over the text."""
    table = PATTERN_LIBRARY if patterns is None else patterns
    needs = PATTERN_NEEDS if patterns is None else {}

    def count(name: str, pattern: str) -> Column:
        n = count_matches(c, pattern).cast("bigint")
        return F.when(col(c).contains(needs[name]), n).otherwise(0) if name in needs else n

    counted = F.array(*[F.struct(F.lit(n).alias("pattern"), count(n, p).alias("n")) for n, p in table.items()])
    return df.select(key, F.inline(counted))


# --- lines ------------------------------------------------------------------------------------------------------

def lines(c: Column | str) -> Column:
    """Lines of a text: CRLF and CR count as line ends, one trailing empty line is dropped, no text has no lines."""
    raw = blank_if_null(c)
    text = F.replace(F.replace(raw, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    body = F.split(F.regexp_replace(text, r"\n\z", ""), "\n", -1)
    return F.when(raw == "", F.array().cast("array<string>")).otherwise(body)


def fold_lines(arr: Column, ignore_case: bool = False, ignore_space: bool = False) -> Column:
    """Comparison form of an array of lines."""
    out = arr
    if ignore_case:
        out = F.transform(out, lambda x: F.lower(x))
    if ignore_space:
        out = F.transform(out, lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    return out


def html_escape(c: Column | str) -> Column:
    s = blank_if_null(c)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        s = F.replace(s, F.lit(raw), F.lit(safe))
    return s


# --- names ------------------------------------------------------------------------------------------------------

def safe_name(c: Column | str) -> Column:
    return F.regexp_replace(col(c), UNSAFE_NAME, "_")


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def extension(path: Column | str) -> Column:
    """Last extension with its dot, as written; names that only start with dots have none."""
    return F.regexp_extract(base_name(path), r"^\.*[^.].*?(\.[^.]*)$", 1)


def stem(path: Column | str) -> Column:
    name = base_name(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(extension(path)))


def category(ext: Column, categories: dict[str, list[str]] | None = None, default: str = "其他") -> Column:
    """Category of an extension; when two categories claim one extension the later one wins.

    The categories are ranked as they are listed, and the highest rank that claims the extension names the row.  Rows
    that nobody claims have rank -1: the default, or the last category where the default is not one of them.
    """
    table = CATEGORIES if categories is None else categories
    names = list(table)
    claims = [F.lower(ext).isin([str(e).strip().lower() for e in exts]) for exts in table.values()]
    rank = F.lit(-1)
    for place, claimed in enumerate(claims):
        rank = F.when(claimed, place).otherwise(rank)
    unclaimed = default if default in names or not names else names[-1]
    return F.element_at(F.array(*[F.lit(n) for n in [unclaimed, *names]]), rank + 2)


def flatten_path(path: Column | str) -> Column:
    return F.replace(col(path), F.lit("/"), F.lit("__"))


TEMPLATE_TOKEN = re.compile(r"\{(\w+)(?::0?(\d+)d)?\}")  # fixed value: {name} and {name:03d}


def render(template: str, values: dict[str, Column]) -> Column:
    """Fill ``{name}`` / ``{name:03d}`` tokens from columns; unknown tokens stay as written."""
    pieces: list[Column] = []
    at = 0
    for token in TEMPLATE_TOKEN.finditer(template):
        pieces.append(F.lit(template[at:token.start()]))
        at = token.end()
        name, width = token.group(1), token.group(2)
        if name not in values:
            pieces.append(F.lit(token.group(0)))
            continue
        text = values[name].cast("string")
        if width:
            # pad, never cut: lpad alone would shorten a value wider than the token
            text = F.when(F.length(text) >= int(width), text).otherwise(F.lpad(text, int(width), "0"))
        pieces.append(text)
    pieces.append(F.lit(template[at:]))
    return F.concat(*pieces)
