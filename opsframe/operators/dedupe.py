"""Duplicate removal with well-defined first/last rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsframe.functions.text import strip


def dedupe(df: DataFrame, key: str, order_by: str, keep: str = "first") -> DataFrame:
    """One row per stripped key; rows without a key all stay.

    ``row_number() <= 1`` lets Spark cut each map partition to one row per key before the shuffle.  A blank key is
    paired with the row's own ordinal, so blank rows neither meet in one partition nor lose a row.
    """
    ord_ = F.col(order_by)
    w = Window.partitionBy("_key", "_alone").orderBy(ord_.desc() if keep == "last" else ord_.asc())
    keyed = df.withColumn("_key", strip(key)).withColumn("_alone", F.when(F.col("_key") == "", ord_))
    return keyed.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_key", "_alone", "_rn")


def dedupe_composite(df: DataFrame, keys: Sequence[str], order_by: str, keep: str = "last",
                     position: str = "position") -> DataFrame:
    """One row per key combination, blanks included; the survivor takes the place of the first row.

    One aggregation over the rows: it combines on the map side, so a key with very many copies sends one row per task
    and never gathers in one place.
    """
    ids = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*[strip(k).alias(i) for i, k in zip(ids, keys)], F.col(order_by).alias("_o"),
                     F.struct(*df.columns).alias("_row"))
    pick = F.max_by if keep == "last" else F.min_by
    kept = rows.groupBy(*ids).agg(pick("_row", "_o").alias("_row"), F.min("_o").alias(position))
    return kept.select("_row.*", position)


def duplicate_keys(df: DataFrame, key: str, order_by: str) -> DataFrame:
    """Keys that occur more than once: ``key, n_rows, n_extra, first_at``."""
    return (
        df.select(strip(key).alias("key"), order_by).filter("key <> ''")
        .groupBy("key").agg(F.count("*").alias("n_rows"), F.min(order_by).alias("first_at"))
        .filter("n_rows > 1").withColumn("n_extra", F.col("n_rows") - 1)
    )


def duplicate_rows(df: DataFrame, key: str, order_by: str) -> DataFrame:
    """The rows a ``keep='first'`` dedupe would remove, found by their ordinal (no key skew)."""
    firsts = (
        df.select(strip(key).alias("_key"), F.col(order_by)).filter("_key <> ''")
        .groupBy("_key").agg(F.min(order_by).alias(order_by)).select(order_by)
    )
    return df.filter(strip(key) != "").join(firsts, order_by, "left_anti")
