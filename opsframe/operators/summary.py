"""Group summaries, sorting and bounded reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.functions.normalize import guarded_number, plain_number
from opsframe.functions.text import blank_if_null, is_blank, or_label, safe_name, strip
from opsframe.operators.order import dense_number

BLANK_GROUP = "(空)"       # fixed values: labels of the blank group
BLANK_GROUP_WEB = "（空）"


def _whole_or_cents(total: Column) -> Column:
    return F.round(total, 2).cast("double")


def group_summary(df: DataFrame, by: str, order_by: str, sums: Sequence[str] = (),
                  counts: Sequence[str] = ()) -> DataFrame:
    """Rows, lenient sums and non-blank counts per group, with the group's first position as ``first_at``."""
    number = lambda c: guarded_number(F.translate(blank_if_null(c), ",¥$", ""))
    aggs = [F.count("*").alias("行数")]
    aggs += [_whole_or_cents(F.sum(F.coalesce(number(s), F.lit(0)))).alias(f"{s}_合计") for s in sums]
    aggs += [F.count_if(~is_blank(c)).alias(f"{c}_非空数") for c in counts]
    return df.groupBy(or_label(by, BLANK_GROUP).alias(by)).agg(*aggs, F.min(order_by).alias("first_at"))


def group_single_sum(df: DataFrame, by: str, order_by: str, total: str | None = None) -> DataFrame:
    """The web variant: a count and at most one sum, only commas are forgiven."""
    aggs = [F.count("*").alias("条数")]
    if total:
        aggs.append(_whole_or_cents(F.sum(F.coalesce(plain_number(total), F.lit(0)))).alias(f"{total}_合计"))
    return df.groupBy(or_label(by, BLANK_GROUP_WEB).alias(by)).agg(*aggs, F.min(order_by).alias("first_at"))


def with_sort_keys(df: DataFrame, by: str, locale: str | None = None) -> DataFrame:
    """Add ``_is_text, _number, _text``: computed before the sort, which would else redo them per comparison."""
    number = plain_number(by)
    keyed = df.withColumns({"_number": number, "_shown": strip(by)})
    text = F.when(F.col("_number").isNull(), F.col("_shown"))
    keyed = keyed.withColumns({"_is_text": F.col("_number").isNull(), "_text": F.collate(text, locale) if locale else text})
    return keyed.drop("_shown")


SORT_KEYS = ["_is_text", "_number", "_text"]


def sort_order(descending: bool = False) -> list[Column]:
    """Numbers before text ascending; the whole order is reversed descending."""
    return [F.col(k).desc() if descending else F.col(k).asc() for k in SORT_KEYS]


def sort_mixed(df: DataFrame, by: str, order_by: str, descending: bool = False, locale: str | None = None) -> DataFrame:
    """Stable sort of a column holding numbers and text."""
    keyed = with_sort_keys(df, by, locale)
    return keyed.orderBy(*sort_order(descending), F.col(order_by).asc()).drop(*SORT_KEYS)


def number_mixed(df: DataFrame, by: str, order_by: str, out: str, descending: bool = False,
                 locale: str | None = None) -> DataFrame:
    """Position of every row in the order of :func:`sort_mixed`."""
    keyed = with_sort_keys(df, by, locale)
    return dense_number(keyed, [*[(k, descending) for k in SORT_KEYS], order_by], out).drop(*SORT_KEYS)


def bounded_sample(df: DataFrame, order_by: str, n: int) -> tuple[DataFrame, DataFrame]:
    """First ``n`` rows, and one row telling how many there are beyond them."""
    first = df.orderBy(order_by).limit(n)
    rest = df.agg(F.greatest(F.count("*") - n, F.lit(0)).alias("n_rest"))
    return first, rest


def split_manifest(df: DataFrame, by: str, blank: str = BLANK_GROUP) -> DataFrame:
    """File name and row count of each part of a split; keys that share a safe name share the part."""
    part = safe_name(or_label(by, blank))
    return df.groupBy(part.alias("part")).agg(F.count("*").alias("n_rows"))


def archive_manifest(df: DataFrame, day: Column | str, category: str) -> DataFrame:
    d = F.col(day) if isinstance(day, str) else day
    return df.groupBy(d.alias("process_date"), safe_name(F.col(category)).alias("part")).agg(
        F.count("*").alias("n_rows"))
