"""JSON text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.functions.text import blank_if_null


# Control characters whose escape has a letter digit and no short form.
LETTER_CODES = ["0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F"]


def is_valid(c: Column | str) -> Column:
    """Strict check.  The parser alone accepts trailing text, so the value must also fit inside ``[ ]`` and ``{ }``."""
    s = blank_if_null(c)
    as_item = F.try_parse_json(F.concat(F.lit("["), s, F.lit("]")))
    member = F.concat(F.lit('{"x":'), s, F.lit("}"))
    alone = (
        F.try_variant_get(as_item, "$[0]", "variant").isNotNull()
        & F.try_variant_get(as_item, "$[1]", "variant").isNull()
    )
    one_key = F.try_parse_json(member).isNotNull() & (F.size(F.json_object_keys(member)) == 1)
    return F.coalesce(alone & one_key, F.lit(False))


def kind(c: Column | str) -> Column:
    """Top-level kind with the labels of the validity report; NULL when invalid."""
    shape = F.schema_of_variant(F.try_parse_json(blank_if_null(c)))
    return F.when(
        is_valid(c),
        F.when(shape.startswith("ARRAY"), "数组").when(shape.startswith("OBJECT"), "对象")
        .when(shape == "STRING", "string").when(shape == "BOOLEAN", "boolean").when(shape == "VOID", "object")
        .otherwise("number"),
    )


def key_count(c: Column | str) -> Column:
    s = blank_if_null(c)
    n = F.coalesce(F.size(F.json_object_keys(s)), F.json_array_length(s), F.lit(0))
    return F.when(is_valid(c), F.when(n < 0, 0).otherwise(n))


def validate(c: Column | str) -> Column:
    """Struct ``valid, kind, n_keys, n_chars``."""
    return F.struct(is_valid(c).alias("valid"), kind(c).alias("kind"), key_count(c).alias("n_keys"),
                    F.length(blank_if_null(c)).alias("n_chars"))


def canonical(c: Column | str) -> Column:
    """Compact text with the keys sorted at every level; NULL when invalid."""
    return F.when(is_valid(c), F.to_json(F.try_parse_json(blank_if_null(c))))


# A string literal, or white space outside of one.  Possessive, so that long strings need no backtracking stack.
STRING_OR_SPACE = r'("(?:[^"\\]++|\\.)*+")|[ \t\r\n]+'


def minify(c: Column | str) -> Column:
    """The same text without white space between tokens, members in their order; NULL when invalid."""
    return F.when(is_valid(c), F.regexp_replace(blank_if_null(c), STRING_OR_SPACE, "$1"))


def escape(c: Column | str) -> Column:
    """Body of a JSON string literal, control characters with lower-case hex digits."""
    quoted = F.to_json(F.array(blank_if_null(c)))
    body = F.substring(quoted, F.lit(3), F.length(quoted) - 4)
    lowered = body
    for code in LETTER_CODES:
        # an even number of backslashes before the escape belongs to the text itself
        lowered = F.regexp_replace(lowered, r"(?<!\\)((?:\\\\)*)\\u00" + code, "$1" + r"\\u00" + code.lower())
    return F.when(F.col(c).rlike(r"[\x0B\x0E\x0F\x1A-\x1F]") if isinstance(c, str) else c.rlike(
        r"[\x0B\x0E\x0F\x1A-\x1F]"), lowered).otherwise(body)


def unescape(c: Column | str) -> Column:
    """Text of a JSON string body; NULL when the body is not one."""
    wrapped = F.concat(F.lit('["'), F.trim(blank_if_null(c)), F.lit('"]'))
    items = F.from_json(wrapped, "array<string>")
    return F.when(is_valid(wrapped) & (F.size(items) == 1), F.element_at(items, 1))


def rows_to_json(df: DataFrame, columns: list[str], header: bool = True, out: str = "json") -> DataFrame:
    """One JSON text per row: an object with missing cells as empty text, or an array when there is no header."""
    cells = [blank_if_null(c).alias(c) for c in columns]
    value = F.to_json(F.struct(*cells)) if header else F.to_json(F.array(*cells))
    return df.withColumn(out, value)


def _members(df: DataFrame, c: str, keep: list[str]) -> DataFrame:
    """One row per array member; a single value counts as an array of one."""
    s = blank_if_null(c)
    listed = F.when(F.ltrim(s).startswith("["), s).otherwise(F.concat(F.lit("["), s, F.lit("]")))
    usable = F.when(is_valid(c), listed)
    return df.select(*keep, F.posexplode(F.from_json(usable, "array<variant>")).alias("pos", "member"))


def object_keys(df: DataFrame, c: str, order_by: str) -> DataFrame:
    """Distinct member keys in first-seen order: ``key, first_at``."""
    members = _members(df, c, [order_by])
    keys = members.select(order_by, "pos", F.posexplode(F.json_object_keys(F.to_json("member"))).alias("kpos", "key"))
    return keys.groupBy("key").agg(F.min(F.struct(order_by, "pos", "kpos")).alias("first_at"))


def json_members(df: DataFrame, c: str, order_by: str) -> DataFrame:
    """Every member of the objects as one row: ``order_by, pos, key, value`` (members as text, null as empty text)."""
    value = F.coalesce(F.try_variant_get("_v", "$", "string"), F.lit(""))
    each = _members(df, c, [order_by]).select(order_by, "pos", F.explode(
        F.from_json(F.to_json("member"), "map<string,variant>")).alias("key", "_v"))
    return each.select(order_by, "pos", "key", value.alias("value"))


def json_to_table(df: DataFrame, c: str, order_by: str, keys: list[str]) -> DataFrame:
    """Columns for the named keys of the objects; absent and null members are empty text, other members become text.

    The keys are the schema of the result, so they are given; :func:`object_keys` lists what there is, and
    :func:`json_members` gives all members whatever their number.
    """
    def member(key: str) -> Column:
        quote = "'" if "'" not in key else '"'
        if quote in key or "\\" in key:  # no path can write such a key
            return F.try_variant_get(F.from_json(F.to_json("member"), "map<string,variant>")[key], "$", "string")
        return F.try_variant_get("member", f"$[{quote}{key}{quote}]", "string")

    cells = [F.coalesce(member(k), F.lit("")).alias(k) for k in keys]
    return _members(df, c, [order_by]).select(order_by, "pos", *cells)
