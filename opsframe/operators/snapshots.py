"""Price pages and snapshot logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.functions.text import blank_if_null, price_hits
from opsframe.operators.order import with_previous


def main_price(df: DataFrame, doc: str, html: str, pattern: str | Column | None = None, group: int = 0,
               long_amounts: bool = False) -> DataFrame:
    """The price a page shows most often (first seen wins ties) and its first ten samples.

    Pages without a price keep a row with a NULL price.  The hits of a page are counted inside its row: sorted, equal
    ones stand together, and a fold keeps the longest run, so nothing is shuffled.
    """
    hits = df.select(doc, price_hits(html, pattern, group, long_amounts).alias("_hits"))
    ordered = F.array_sort(F.transform("_hits", lambda h, i: F.struct(h.alias("hit"), i.alias("at"))))
    none = F.struct(F.lit(None).cast("string").alias("hit"), F.lit(0).alias("n"), F.lit(0).alias("at"))

    def step(state: Column, h: Column) -> Column:
        same = h["hit"].eqNullSafe(state["run"]["hit"])
        run = F.struct(h["hit"].alias("hit"), F.when(same, state["run"]["n"] + 1).otherwise(1).alias("n"),
                       F.when(same, state["run"]["at"]).otherwise(h["at"]).alias("at"))
        best = state["best"]
        better = (run["n"] > best["n"]) | ((run["n"] == best["n"]) & (run["at"] < best["at"]))
        return F.struct(run.alias("run"), F.when(better, run).otherwise(best).alias("best"))

    best = F.aggregate(ordered, F.struct(none.alias("run"), none.alias("best")), step, lambda s: s["best"]["hit"])
    return hits.select(doc, best.alias("price"), F.size("_hits").cast("bigint").alias("n_hits"))


def price_samples(html: Column | str, n: int = 10) -> Column:
    return F.slice(price_hits(html), 1, n)


def last_snapshot(log: DataFrame, name: str, order_by: list[str], columns: list[str]) -> DataFrame:
    """Latest log row per name, by a map-side combined aggregate."""
    last = F.max_by(F.struct(*columns), F.struct(*order_by))
    return log.filter(blank_if_null(name) != "").groupBy(name).agg(last.alias("_last")).select(
        name, *[F.col("_last")[c].alias(f"last_{c}") for c in columns])


def status_of(price: Column, seen: Column, last_price: Column, blocked: Column | None = None,
              failed: Column | None = None, separate_no_price: bool = False) -> Column:
    """Change status against the previous record: blocked, error, no_price, first, changed or unchanged."""
    now, before = blank_if_null(price), blank_if_null(last_price)
    out = F.when(F.coalesce(blocked, F.lit(False)), "blocked") if blocked is not None else F.when(F.lit(False), "")
    if failed is not None:
        out = out.when(F.coalesce(failed, F.lit(False)), "error")
    if separate_no_price:
        out = out.when(now == "", "no_price")
    known = F.coalesce(seen, F.lit(False))
    return out.when(~known & (now == ""), "error").when(~known, "first").when(now != before, "changed").otherwise(
        "unchanged")


def compare_snapshot(current: DataFrame, log: DataFrame, name: str, price: str, order_by: list[str]) -> DataFrame:
    """Status of the current run's rows against the latest row of the log."""
    last = last_snapshot(log, name, order_by, [price]).withColumn("_seen", F.lit(True))
    joined = current.join(last, name, "left")
    return joined.withColumn("status", status_of(F.col(price), F.col("_seen"), F.col(f"last_{price}"))).withColumn(
        "prev_price", blank_if_null(f"last_{price}")).drop("_seen", f"last_{price}")


def price_changes(log: DataFrame, name: str, price: str, order_by: list[str], chunk: Column,
                  ignore_failed: bool = False, blocked: str | None = None, failed: str | None = None,
                  separate_no_price: bool = False) -> DataFrame:
    """Status of every row of a log against the row before it.

    ``blocked`` and ``failed`` name columns that mark refused pages and fetch errors.  ``ignore_failed`` leaves out rows
    without a price before comparing, ``separate_no_price`` tells pages without a price from errors.
    """
    rows = log.filter(blank_if_null(price) != "") if ignore_failed else log
    seen = with_previous(rows, name, order_by, [price], chunk)
    return seen.withColumn("status", status_of(
        F.col(price), F.col("prev_exists"), F.col(f"prev_{price}"), F.col(blocked) if blocked else None,
        F.col(failed) if failed else None, separate_no_price)).drop("prev_exists")


def status_counts(df: DataFrame, status: str = "status") -> DataFrame:
    """Report sections: failures and blocked pages count as one."""
    section = F.when(F.col(status).isin("error", "blocked"), "failed").otherwise(F.col(status))
    return df.groupBy(section.alias("section")).agg(F.count("*").alias("n"))
