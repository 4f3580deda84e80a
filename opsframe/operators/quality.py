"""Cleaning whole tables, required cells, rejects and quality counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.functions import normalize
from opsframe.functions.text import blank_if_null, is_blank, named, strip

REASON_PREFIX = "缺少必填："  # fixed values: reject reasons
MISSING_KEY = "缺主键「%s」"


def column_kinds(columns: Sequence[str], profile: str = "table", kinds: Mapping[str, str] | None = None) -> dict:
    """Kind per column, guessed from its name unless given."""
    given = dict(kinds or {})
    return {c: given.get(c) or normalize.guess_kind(c, profile) for c in columns}


def clean(df: DataFrame, columns: Sequence[str] | None = None, profile: str = "table",
          kinds: Mapping[str, str] | None = None, flags: bool = False) -> DataFrame:
    """Normalise the named columns (default all) in one projection; ``flags`` adds ``ok_<column>`` validity."""
    targets = list(columns) if columns else df.columns
    by_name = column_kinds(targets, profile, kinds)
    out, marks = [], []
    for c in df.columns:
        if c not in by_name:
            out.append(named(c))
            continue
        done = normalize.clean_cell(named(c), by_name[c], profile)
        out.append(done.value.alias(c))
        marks.append(done.ok.alias(f"ok_{c}"))
    return df.select(*out, *(marks if flags else []))


def clean_report(df: DataFrame, columns: Sequence[str], profile: str = "table",
                 kinds: Mapping[str, str] | None = None) -> DataFrame:
    """Invalid and changed cells per column: ``column, kind, n_invalid, n_changed``, from one aggregate."""
    by_name = column_kinds(columns, profile, kinds)
    parts = []
    for c, kind in by_name.items():
        done = normalize.clean_cell(named(c), kind, profile)
        parts.append(F.struct(F.lit(c).alias("column"), F.lit(kind).alias("kind"),
                              (~done.ok).cast("bigint").alias("invalid"),
                              (~blank_if_null(named(c)).eqNullSafe(done.value)).cast("bigint").alias("changed")))
    aggs = []
    for i, c in enumerate(by_name):
        aggs += [F.sum(F.col("_p")[i]["invalid"]).alias(f"i{i}"), F.sum(F.col("_p")[i]["changed"]).alias(f"c{i}")]
    totals = df.select(F.array(*parts).alias("_p")).agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind"), F.coalesce(f"i{i}", F.lit(0)).alias("n_invalid"),
                     F.coalesce(f"c{i}", F.lit(0)).alias("n_changed"))
            for i, (c, k) in enumerate(by_name.items())]
    return totals.select(F.inline(F.array(*rows)))


def trim_cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: strip(c) for c in columns})


def changed_cells(df: DataFrame, after: Mapping[str, Column]) -> DataFrame:
    """Number of cells a rewrite alters, as one row ``n_changed``."""
    n = sum((F.sum((~blank_if_null(c).eqNullSafe(v)).cast("bigint")) for c, v in after.items()), F.lit(0))
    return df.agg(n.cast("bigint").alias("n_changed"))


def missing_reason(columns: Sequence[str]) -> Column:
    """Reject reason listing the blank columns in order; empty text when none is missing."""
    names = F.concat_ws("、", *[F.when(is_blank(c), F.lit(c)) for c in columns])
    return F.when(names == "", "").otherwise(F.concat(F.lit(REASON_PREFIX), names))


def tag_required(df: DataFrame, columns: Sequence[str], out: str = "reason") -> DataFrame:
    return df.withColumn(out, missing_reason(columns))


def require(df: DataFrame, columns: Sequence[str], out: str = "reason") -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejected rows with their reason.

    The split tests the cells themselves; only rejected rows pay for building a reason.
    """
    missing = reduce(or_, [is_blank(c) for c in columns], F.lit(False))
    return df.filter(~missing), tag_required(df.filter(missing), columns, out)


def split_missing_key(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    blank = is_blank(key)
    return df.filter(~blank), df.filter(blank).withColumn("reason", F.lit(MISSING_KEY % key))


def usable_amount(df: DataFrame, amount: str, out: str = "amount_value") -> DataFrame:
    return df.withColumn(out, normalize.kpi_number(amount)).filter(F.col(out).isNotNull())


def drop_blank_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows in which at least one cell holds something."""
    return df.filter(~reduce(and_, [is_blank(named(c)) for c in (columns or df.columns)]))


def size_flag(size: Column | str, tiny_below: int = 1024) -> Column:
    s = F.col(size) if isinstance(size, str) else size
    return F.when(s == 0, "empty").when(F.lit(bool(tiny_below)) & (s < tiny_below), "tiny").otherwise("ok")


def quality_report(df: DataFrame, table: str, columns: Sequence[str], key: str, order_by: str,
                   profile: str = "table") -> DataFrame:
    """``table_name, check_name, column_name, n``: invalid cells per column, rows without key, repeated keys."""
    from opsframe.operators.dedupe import duplicate_keys

    shape = lambda d, check, column, n: d.select(
        F.lit(table).alias("table_name"), F.lit(check).alias("check_name"), column.alias("column_name"),
        n.cast("bigint").alias("n"))
    invalid = shape(clean_report(df, columns, profile), "invalid", F.col("column"), F.col("n_invalid"))
    blank = df.agg(F.count_if(is_blank(key)).alias("n"))
    dup = duplicate_keys(df, key, order_by).agg(F.coalesce(F.sum("n_extra"), F.lit(0)).alias("n"))
    return invalid.unionByName(shape(blank, "missing_key", F.lit(key), F.col("n"))).unionByName(
        shape(dup, "duplicate", F.lit(key), F.col("n")))
