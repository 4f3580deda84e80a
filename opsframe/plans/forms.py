"""The form job: clean, check required cells, drop duplicates, number, route."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.functions import normalize
from opsframe.operators import dedupe, order, quality, rules


def number_rows(df: DataFrame, position: str, prefix: str, day: str, by_id: bool = True) -> DataFrame:
    """``PREFIX-YYYYMMDD-0001`` ids over the surviving rows in order; wider numbers keep all their digits."""
    numbered = order.dense_number_by_id(df, position, "_no") if by_id else order.dense_number(df, [position], "_no")
    stamp = day.replace("-", "")
    return numbered.withColumn("order_id", F.concat(F.lit(f"{prefix}-{stamp}-"), F.format_string("%04d", "_no"))).drop(
        "_no")


def route_forms(df: DataFrame, required: Sequence[str], keys: Sequence[str], routing: Sequence[Mapping], order_by: str,
                day: str, columns: Sequence[str] | None = None, keep: str = "last", prefix: str = "ORD",
                by_id: bool = True) -> tuple[DataFrame, DataFrame]:
    """Routed rows with their order id, and the rejected rows with their reason.

    Missing cells are told from the raw cells, so rejected rows are dropped before the costly cleaning; a test on the
    cleaned cells would be pushed below the cleaning and compute it twice.
    """
    targets = [c for c in (columns or df.columns) if c not in (order_by, "__source__", "__row__")]
    missing = F.lit(False)
    for c in required:
        missing = missing | normalize.blank_after_clean(c, normalize.guess_kind(c, "form"))
    valid = quality.clean(df.filter(~missing), targets, "form")
    rejected = quality.tag_required(quality.clean(df.filter(missing), targets, "form"), required)
    unique = dedupe.dedupe_composite(valid, keys, order_by, keep) if keys else valid.withColumn(
        "position", F.col(order_by))
    numbered = number_rows(unique, "position", prefix, day, by_id).withColumn("process_date", F.lit(day))
    return rules.route(numbered, routing), rejected
