"""Daily figures: totals, comparison with an earlier day, breakdowns, alerts, history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsframe.functions.text import or_label

BLANK_VALUE = "(未填)"  # fixed value


def daily_kpis(df: DataFrame, date: str, amount: str) -> DataFrame:
    """``day, total, n_orders, avg_amount`` for every observed day, in one pass."""
    daily = df.filter(F.col(date).isNotNull()).groupBy(F.col(date).cast("date").alias("day")).agg(
        F.sum(amount).alias("total"), F.count("*").alias("n_orders"))
    return daily.withColumn("total", F.col("total").cast("double")).withColumn(
        "avg_amount", F.col("total") / F.col("n_orders"))


def pct_change(cur: Column, prev: Column) -> Column:
    return F.when(prev != 0, (cur - prev) / F.abs(prev) * 100)


def fill_calendar(daily: DataFrame) -> DataFrame:
    """Add the days without rows between the first and last day, with zero figures."""
    span = daily.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("day"))
    return days.join(daily, "day", "left").select(
        "day", F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("n_orders", F.lit(0)).alias("n_orders"),
        F.coalesce("avg_amount", F.lit(0.0)).alias("avg_amount"))


def compare(daily: DataFrame, mode: str = "previous_day") -> DataFrame:
    """Put the comparison day beside each day.

    ``daily`` has one row per calendar day, so the unpartitioned window below works on a few thousand rows.
    """
    observed = F.when(F.col("n_orders") > 0, F.struct("day", "total", "n_orders", "avg_amount"))
    if mode == "same_day_last_week":
        earlier = daily.filter("n_orders > 0").select(
            F.date_add("day", 7).alias("day"), F.struct("day", "total", "n_orders", "avg_amount").alias("_p"))
        joined = daily.join(earlier, "day", "left")
    else:
        past = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
        joined = daily.withColumn("_p", F.last(observed, ignorenulls=True).over(past))
    p = F.col("_p")
    return joined.select(
        "day", "total", "n_orders", "avg_amount", p["day"].alias("prev_day"), p["total"].alias("prev_total"),
        p["n_orders"].alias("prev_orders"), pct_change(F.col("total"), p["total"]).alias("total_pct"),
        (F.col("n_orders") - p["n_orders"]).alias("orders_delta"),
        pct_change(F.col("avg_amount"), p["avg_amount"]).alias("avg_pct"),
    )


def kpi_alerts(compared: DataFrame, drop_pct: float | None = 20, rise_pct: float | None = 50, min_amount: float = 0,
               min_orders: int = 0) -> DataFrame:
    """Threshold breaches as rows: ``day, alert, observed, threshold``.  ``None`` switches a percentage alert off."""
    def breach(name: str, hit: Column, observed: Column, threshold: float) -> Column:
        return F.when(hit, F.struct(F.lit(name).alias("alert"), observed.cast("double").alias("observed"),
                                    F.lit(float(threshold)).alias("threshold")))

    pct, total, n = F.col("total_pct"), F.col("total"), F.col("n_orders")
    checks = [breach("no_data", n == 0, n, 0)]
    if drop_pct is not None:
        checks.append(breach("drop", pct <= -abs(drop_pct), pct, -abs(drop_pct)))
    if rise_pct is not None:
        checks.append(breach("rise", pct >= abs(rise_pct), pct, abs(rise_pct)))
    if min_amount > 0:
        checks.append(breach("min_amount", total < min_amount, total, min_amount))
    if min_orders > 0:
        checks.append(breach("min_orders", n < min_orders, n, min_orders))
    hits = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return compared.select("day", F.inline(hits))


def breakdown(df: DataFrame, date: str, amount: str, fields: Sequence[str]) -> DataFrame:
    """Amount per day, field and value with its share of the day and its bar relative to the largest value.

    Totals come from the already grouped rows (every row counts once per field) and are joined back; with few
    (day, field) pairs Spark turns that join into a broadcast from the measured size.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), or_label(f, BLANK_VALUE).alias("value"))
                                for f in fields]))
    groups = (
        df.select(F.col(date).cast("date").alias("day"), F.col(amount).alias("_a"), pairs.alias("_p"))
        .groupBy("day", F.col("_p.field").alias("field"), F.col("_p.value").alias("value"))
        .agg(F.sum("_a").alias("_sum"))
    )
    whole = groups.groupBy("day", "field").agg(F.max("_sum").alias("_max"), F.sum("_sum").alias("_all"))
    joined = groups.join(whole, ["day", "field"])
    total, day_total = F.col("_sum").cast("double"), F.col("_all").cast("double")
    return joined.select(
        "day", "field", "value", total.alias("total"),
        F.when(day_total != 0, total / day_total * 100).otherwise(0.0).alias("share_pct"),
        bar_length(total, F.col("_max").cast("double"), 20).alias("bar"),
    )


def bar_length(value: Column, largest: Column, width: int) -> Column:
    n = F.bround(value / largest * width, 0).cast("bigint")
    return F.when((largest == 0) | (value <= 0), F.lit(0)).otherwise(F.greatest(n, F.lit(1))).cast("bigint")


def top_rows(df: DataFrame, date: str, amount: str, label: str, order_by: str, n: int = 5) -> DataFrame:
    """The ``n`` largest rows of each day; the rank filter is applied before the shuffle."""
    w = Window.partitionBy("day").orderBy(F.col("_a").desc(), F.col(order_by).asc())
    return (
        df.select(F.col(date).cast("date").alias("day"), or_label(label, BLANK_VALUE).alias("label"),
                  F.col(amount).alias("_a"), order_by)
        .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
        .select("day", "rank", "label", F.col("_a").cast("double").alias("amount"))
    )


def trend(history: DataFrame, days: int = 7, width: int = 18) -> DataFrame:
    """The report's recent days with bars scaled to the largest day of all history (one row per day)."""
    scaled = history.withColumn("_largest", F.max("total").over(Window.partitionBy()))
    return scaled.orderBy(F.col("day").desc()).limit(days).select(
        "day", "total", "n_orders", bar_length(F.col("total"), F.col("_largest"), width).alias("bar"))


def upsert_history(history: DataFrame, new: DataFrame, key: str = "day") -> DataFrame:
    """New rows replace history rows of the same key, all others stay."""
    columns = [c for c in history.columns if c != key]
    old = history.select(key, F.struct(*columns).alias("_old"))
    fresh = new.select(key, F.struct(*columns).alias("_new"))
    chosen = F.coalesce("_new", "_old")
    return old.join(fresh, key, "full").select(key, *[chosen[c].alias(c) for c in columns])
