"""URL expressions with the strictness of a browser's component codec."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opsframe.functions.text import blank_if_null, is_blank

# Where form encoding and component encoding differ, and the characters a whole address keeps.
FORM_TO_COMPONENT = {"+": "%20", "%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~"}
STRUCTURE = {"%2F": "/", "%3A": ":", "%3F": "?", "%26": "&", "%3D": "=", "%23": "#"}


def _swap(c: Column, table: dict[str, str]) -> Column:
    for old, new in table.items():
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def encode_component(c: Column | str, keep_structure: bool = False, plus: bool = False) -> Column:
    out = _swap(F.url_encode(blank_if_null(c)), FORM_TO_COMPONENT)
    if keep_structure:
        out = _swap(out, STRUCTURE)
    return F.replace(out, F.lit("%20"), F.lit("+")) if plus else out


def decode(c: Column | str, plus: bool = False) -> Column:
    """Decoded text, NULL for broken escapes and for bytes that are not UTF-8."""
    s = blank_if_null(c)
    s = F.replace(s, F.lit("+"), F.lit(" ")) if plus else s
    out = F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B")))
    bad_escape = s.rlike("%(?![0-9A-Fa-f]{2})")
    # the JVM decoder writes U+FFFD for bad bytes; accept only those that the input spelled out itself
    spelled = F.regexp_count(s, F.lit("(?i)�|%EF%BF%BD"))
    made = F.regexp_count(out, F.lit("�"))
    return F.when(~bad_escape & (made == spelled), out)


def _decode_or_raw(c: Column) -> Column:
    return F.coalesce(decode(c), c)


def query_params(c: Column | str) -> Column:
    """Ordered ``array<struct<k,v>>``; repeated keys are kept, undecodable parts stay raw."""
    s = F.substring_index(blank_if_null(c), "#", 1)
    has_query = s.contains("?")
    bare = s.contains("=") & ~s.contains("/") & ~s.contains(":")
    query = F.when(has_query, F.substring(s, F.locate("?", s) + 1, F.length(s))).when(bare, s).otherwise("")
    parts = F.filter(F.split(query, "&", -1), lambda p: p != "")

    def pair(p: Column) -> Column:
        at = F.locate("=", p)
        key = F.when(at > 0, F.substring(p, F.lit(1), at - 1)).otherwise(p)
        val = F.when(at > 0, F.substring(p, at + 1, F.length(p))).otherwise("")
        return F.struct(_decode_or_raw(key).alias("k"), _decode_or_raw(val).alias("v"))

    return F.transform(parts, pair)


def base_of(c: Column | str) -> Column:
    """Everything before the query; the fragment is cut first so that re-joining cannot repeat it."""
    return F.substring_index(F.substring_index(blank_if_null(c), "#", 1), "?", 1)


def hash_of(c: Column | str) -> Column:
    s = blank_if_null(c)
    at = F.locate("#", s)
    return F.when(at > 0, F.substring(s, at, F.length(s))).otherwise("")


def build_query(pairs: Column, plus: bool = False) -> Column:
    enc = lambda x: encode_component(x, plus=plus)
    return F.array_join(F.transform(pairs, lambda p: F.concat(enc(p["k"]), F.lit("="), enc(p["v"]))), "&")


def pairs_to_text(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "\n")


def text_to_pairs(c: Column | str) -> Column:
    rows = F.filter(F.split(blank_if_null(c), "\r?\n", -1), lambda x: ~is_blank(x))

    def pair(x: Column) -> Column:
        at = F.locate("=", x)
        return F.struct(
            F.when(at > 0, F.substring(x, F.lit(1), at - 1)).otherwise(x).alias("k"),
            F.when(at > 0, F.substring(x, at + 1, F.length(x))).otherwise("").alias("v"),
        )

    return F.transform(rows, pair)


def batch_convert(c: Column | str, encode: bool = True, keep_structure: bool = False, plus: bool = False) -> Column:
    """Struct ``out, bad``: blank cells stay empty and are not counted, undecodable cells are flagged."""
    done = encode_component(c, keep_structure, plus) if encode else decode(c, plus)
    blank = is_blank(c)
    failed = ~blank & done.isNull()
    out = F.when(blank, "").when(failed, F.concat(F.lit("（解不开："), blank_if_null(c), F.lit("）"))).otherwise(done)
    return F.struct(out.alias("out"), failed.alias("bad"), (~blank).alias("counted"))
