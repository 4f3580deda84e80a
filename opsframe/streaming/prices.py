"""Price changes from a stream of page snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.functions.text import blank_if_null
from opsframe.operators import snapshots
from opsframe.operators.order import after_last, expired, time_chunk, with_previous
from opsframe.streaming.store import KeyStore

#: The last snapshot of every name.
LAST = "name string, price string, last_at timestamp, last_us bigint, last_id bigint"


def price_writer(sink: str, folder: str, only_changes: bool = True, ignore_failed: bool = False, separate_no_price: bool = False,
                 slice_seconds: int = 3600, forget_days: int | None = None, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function over snapshots ``name, event_id, at timestamp, price`` and, where given, the booleans
    ``blocked`` and ``failed``, that writes the status of each against the one before it, and keeps the last of each name.

    Inside a batch a row's predecessor comes from its (name, time slice) window or from the last row of the slice before;
    the first row of a name looks into the table in ``folder``, of which only the buckets of the batch's names are read.  So
    a name with a third of all rows is spread over its slices.  A snapshot at or before the last one of its name came too
    late and is left out; one without a time comes before all others.  Names not seen for ``forget_days`` start anew.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        store = KeyStore(batch.sparkSession, folder, ["name"], LAST, buckets)
        flags = [c for c in ("blocked", "failed") if c in batch.columns]
        rows = batch.select("name", "event_id", "at", blank_if_null("price").alias("price"), *flags)
        if ignore_failed:
            rows = rows.filter("price <> ''")
        known = store.read(batch_id, store.touched(rows))
        if forget_days is not None:
            newest = rows.agg(F.max("at")).first()[0]
            known = known.filter(~expired("last_at", newest, forget_days))
        rows = after_last(rows, known, "name", "at", "event_id", time_chunk("at", slice_seconds)).persist()
        try:
            seen = with_previous(rows, "name", ["us", "event_id"], ["price"], F.col("slice"), before=known.select("name", "price"))
            status = snapshots.status_of(F.col("price"), F.col("prev_exists"), F.col("prev_price"), *[
                F.col(c) if c in flags else None for c in ("blocked", "failed")], separate_no_price)
            out = seen.select("name", "event_id", "at", "price", blank_if_null("prev_price").alias("prev_price"), status.alias("status"))
            out = out.filter("status <> 'unchanged'") if only_changes else out
            out.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
            last = rows.groupBy("name").agg(F.max_by(F.struct("price", "at", "us", "event_id"), F.struct("us", "event_id")).alias("_l"))
            now = last.select("name", "_l.price", F.col("_l.at").alias("last_at"), F.col("_l.us").alias("last_us"), F.col("_l.event_id").alias("last_id"))
            kept = known.join(now.select(F.col("name").alias("_t")), F.col("name").eqNullSafe(F.col("_t")), "left_anti")
            store.write(kept.unionByName(now), batch_id)
        finally:
            rows.unpersist()

    return write
