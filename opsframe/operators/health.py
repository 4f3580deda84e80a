"""Endpoint checks: failure streaks, outages, recoveries and the state per target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsframe.operators.order import join_same


def streaks(checks: DataFrame, target: str, ok: str, ts: str, order_by: Sequence[str], chunk: Column,
            carry: Sequence[str] = (), before: DataFrame | None = None) -> DataFrame:
    """Every check with its failure streak, the streak before it and the first failure ever seen.

    Work is cut into (target, time slice) windows; a slice hands three numbers to the next one (rows so far, place of
    the last success, first failure), so one target owning a third of all checks is spread over its slices.  ``before``
    may give, one row per target, the ``streak`` and ``first_fail_at`` its earlier checks have left.
    """
    rows = checks.select(target, *order_by, *[c for c in dict.fromkeys([ok, ts, *carry]) if c not in order_by],
                         chunk.alias("_chunk"))
    w = Window.partitionBy(target, "_chunk").orderBy(*order_by)
    upto, past = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_rn", F.row_number().over(w))
    ok_at = F.when(F.col(ok), F.col("_rn"))
    local = local.withColumns({
        "_ok_before": F.max(ok_at).over(past),
        "_fail_first": F.min(F.when(~F.col(ok), F.col(ts))).over(upto),
    })
    tails = local.groupBy(target, "_chunk").agg(
        F.max("_rn").alias("_n"), F.max(ok_at).alias("_ok"), F.min("_fail_first").alias("_fail"))
    slices = Window.partitionBy(target).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    tails = tails.withColumn("_base", F.coalesce(F.sum("_n").over(slices), F.lit(0)))
    tails = tails.select(
        target, "_chunk", "_base", F.max(F.col("_base") + F.col("_ok")).over(slices).alias("_ok_carry"),
        F.min("_fail").over(slices).alias("_fail_carry"))
    if before is not None:
        held = before.select(F.col(target).alias("_held"), (-F.col("streak")).alias("_ok_held"), F.col("first_fail_at").alias("_fail_held"))
        tails = tails.join(held, F.col(target).eqNullSafe(F.col("_held")), "left").select(
            target, "_chunk", "_base", F.coalesce("_ok_carry", "_ok_held").alias("_ok_carry"),
            F.least("_fail_carry", "_fail_held").alias("_fail_carry"))
    joined = join_same(local, tails, [target, "_chunk"])
    place = F.col("_base") + F.col("_rn")
    last_ok = F.coalesce(F.col("_base") + F.col("_ok_before"), F.col("_ok_carry"), F.lit(0))
    failed = (place - 1 - last_ok).cast("bigint")
    return (
        joined.withColumn("streak_before", failed)
        .withColumn("streak", F.when(F.col(ok), F.lit(0)).otherwise(failed + 1).cast("bigint"))
        .withColumn("first_fail_at", F.least("_fail_first", "_fail_carry"))
        .drop("_chunk", "_rn", "_ok_before", "_fail_first", "_base", "_ok_carry", "_fail_carry")
    )


def with_state(df: DataFrame, ok: str, threshold: int = 2) -> DataFrame:
    """Add ``down``, ``was_down`` and the state label of every check."""
    down, was_down = F.col("streak") >= threshold, F.col("streak_before") >= threshold
    state = (
        F.when(F.col(ok) & was_down, "recovered").when(F.col(ok), "ok")
        .when(down & ~was_down, "outage").when(down, "still_down").otherwise("below_threshold")
    )
    return df.withColumns({"down": down, "was_down": was_down, "state": state})


def outage_edges(df: DataFrame, ok: str, threshold: int = 2) -> DataFrame:
    """Only the checks at which an outage starts or ends."""
    return with_state(df, ok, threshold).filter(F.col("state").isin("outage", "recovered"))


def target_state(df: DataFrame, target: str, ok: str, ts: str, order_by: Sequence[str], status: str, ms: str,
                 threshold: int = 2) -> DataFrame:
    """State record per target after its last check, from one map-side combined aggregate over the streaks."""
    last = F.max_by(F.struct("streak", F.col(status).alias("_status"), F.col(ms).alias("_ms")), F.struct(*order_by))
    out = df.groupBy(target).agg(
        last.alias("_last"), F.min("first_fail_at").alias("first_fail_at"),
        F.max(F.when(F.col(ok), F.col(ts))).alias("last_ok_at"))
    return out.select(
        target, (F.col("_last.streak") >= threshold).alias("down"), F.col("_last.streak").alias("consecutive_fail"),
        "first_fail_at", "last_ok_at", F.col("_last._status").alias("last_status"), F.col("_last._ms").alias("last_ms"))


def round_summary(checks: DataFrame, round_by: Column, ok: str, ms: str, slow_ms: int = 3000) -> DataFrame:
    """Total, ok, bad and slow checks per round."""
    return checks.groupBy(round_by.alias("round")).agg(
        F.count("*").alias("total"), F.count_if(F.col(ok)).alias("n_ok"), F.count_if(~F.col(ok)).alias("n_bad"),
        F.count_if(F.col(ok) & (F.col(ms) > slow_ms)).alias("n_slow"))


def combine_attempts(attempts: DataFrame, target: str, check: str, attempt: str, ok: str,
                     columns: Sequence[str]) -> DataFrame:
    """Retries of one check become one result: the first success, else the last attempt."""
    rank = F.struct(F.when(F.col(ok), 0).otherwise(1), F.when(F.col(ok), F.col(attempt)).otherwise(-F.col(attempt)))
    out = attempts.groupBy(target, check).agg(F.min_by(F.struct(ok, attempt, *columns), rank).alias("_r"))
    return out.select(target, check, F.col("_r")[ok].alias(ok), F.col("_r")[attempt].alias("attempts"),
                      *[F.col("_r")[c].alias(c) for c in columns])
