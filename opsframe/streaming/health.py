"""Outage and recovery events, and the state record per target, from a stream of checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.functions.text import blank_if_null
from opsframe.operators import health
from opsframe.operators.order import after_last, expired, time_chunk
from opsframe.streaming.store import KeyStore

#: One row per target: what the next check is judged by, and what a report shows.
RECORD = ("target string, down boolean, consecutive_fail bigint, first_fail_at timestamp, last_ok_at timestamp, "
          "last_status string, last_ms double, last_at timestamp, last_us bigint, last_id bigint")


def records(spark: SparkSession, folder: str, buckets: int = 64) -> DataFrame:
    """State record of every target after the batches so far."""
    return KeyStore(spark, folder, ["target"], RECORD, buckets).latest().drop("last_us")


def health_writer(sink: str, folder: str, threshold: int = 2, slice_seconds: int = 3600, forget_days: int | None = None,
                  buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function over checks ``target, event_id, at timestamp, ok, status, ms, error`` that writes the
    outages and recoveries of every batch, with their cause, and keeps the state records in ``folder``.

    A batch's checks are reduced in (target, time slice) windows, so a target that owns a third of them is spread over its
    slices; only one summary per slice meets the record of its target.  A check at or before the last one counted came too
    late and is left out, which is decided before the slices are summed; one without a time comes before all others.
    A record whose last check lies ``forget_days`` before the newest check of the batch is forgotten: the target starts
    anew.  ``first_fail_at`` is never reset by a recovery.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        store = KeyStore(batch.sparkSession, folder, ["target"], RECORD, buckets)
        rows = batch.select(
            "target", "event_id", "at", F.coalesce("ok", F.lit(False)).alias("ok"), F.col("status").cast("string").alias("status"),
            F.col("ms").cast("double").alias("ms"), F.when(blank_if_null("error") != "", F.col("error")).otherwise(F.col("status").cast("string")).alias("cause"))
        touched = store.touched(rows)
        known = store.read(batch_id, touched)
        if forget_days is not None:
            newest = rows.agg(F.max("at")).first()[0]
            known = known.filter(~expired("last_at", newest, forget_days))
        rows = after_last(rows, known, "target", "at", "event_id", time_chunk("at", slice_seconds))
        before = known.select("target", F.col("consecutive_fail").alias("streak"), "first_fail_at")
        seen = health.streaks(rows, "target", "ok", "at", ["us", "event_id"], F.col("slice"), ["status", "ms", "cause"], before)
        seen = seen.persist()
        try:
            edges = health.outage_edges(seen, "ok", threshold)
            edges.select("target", "event_id", "at", "state", "streak", "streak_before", "cause", "first_fail_at").write.mode(
                "overwrite").parquet(f"{sink}/batch={batch_id}")
            last = seen.groupBy("target").agg(F.max_by(F.struct("at", "us", "event_id"), F.struct("us", "event_id")).alias("_at"))
            now = health.target_state(seen, "target", "ok", "at", ["us", "event_id"], "status", "ms", threshold)
            now = now.join(last.withColumnRenamed("target", "_t"), F.col("target").eqNullSafe(F.col("_t"))).select(
                *now.columns, F.col("_at.at").alias("last_at"), F.col("_at.us").alias("last_us"), F.col("_at.event_id").alias("last_id"))
            old = known.select(F.col("target").alias("_t"), F.col("last_ok_at").alias("_ok"))
            now = now.join(old, F.col("target").eqNullSafe(F.col("_t")), "left").withColumn("last_ok_at", F.coalesce("last_ok_at", "_ok"))
            kept = known.join(now.select(F.col("target").alias("_t")), F.col("target").eqNullSafe(F.col("_t")), "left_anti")
            store.write(kept.unionByName(now.select(*known.columns)), batch_id)
        finally:
            seen.unpersist()

    return write
