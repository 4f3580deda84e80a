"""Form rows from arriving files: clean, check, drop repeats, route."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opsframe.functions.text import base_name, named, strip
from opsframe.operators import quality, rules
from opsframe.operators.order import expired
from opsframe.streaming.store import KeyStore


def inbox(spark: SparkSession, folder: str, schema: str, pattern: str = "*.csv",
          max_files: int | None = None) -> DataFrame:
    """Stream of delimited files with a declared schema and ``__source__``."""
    reader = spark.readStream.schema(schema).option("header", "true").option("escape", '"').option(
        "multiLine", "true").option("pathGlobFilter", pattern)
    reader = reader.option("maxFilesPerTrigger", max_files) if max_files else reader
    return reader.csv(folder).withColumn("__source__", F.url_decode(base_name(F.col("_metadata.file_path"))))


def ingest_stream(rows: DataFrame, columns: Sequence[str], required: Sequence[str], routing: Sequence[Mapping]) -> DataFrame:
    """Cleaned and routed rows with ``reason`` (empty for valid rows)."""
    cleaned = quality.clean(rows, columns, "form")
    return rules.route(quality.tag_required(cleaned, required), routing)


def once_writer(sink: str, keys: Sequence[str], order_by: Sequence[str], at: str | None = None, late_days: int = 30,
                folder: str | None = None, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that writes valid rows once per key, and all rejected rows, as one part per batch.

    Of a batch's repeats the first in ``order_by`` stays.  Keys that earlier batches wrote are kept in ``folder`` (beside
    the sink), in buckets by their hash: a batch reads and writes the buckets of its own keys, not the parts written so
    far.  With ``at`` only keys of the last ``late_days`` before the batch are remembered, and older ones leave their
    buckets, so what a batch reads does not grow with the stream's age.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    schema = ", ".join(f"{n} string" for n in names) + ", seen_at timestamp"

    def write(batch: DataFrame, batch_id: int) -> None:
        store = KeyStore(batch.sparkSession, folder or f"{sink.rstrip('/')}-keys", names, schema, buckets)
        stripped = {n: strip(k) for n, k in zip(names, keys)}
        place = F.row_number().over(Window.partitionBy(*names).orderBy(*order_by))
        valid = batch.filter("reason = ''").withColumns(stripped).withColumn("_place", place).filter("_place = 1")
        seen = store.read(batch_id, store.touched(valid, names))
        if at:
            oldest = batch.agg(F.min(F.col(at).cast("timestamp"))).first()[0]
            seen = seen.filter(~expired("seen_at", oldest, late_days))
        fresh = valid.join(seen.select(*names), names, "left_anti").persist()
        try:
            out = fresh.select(*[named(c) for c in batch.columns]).unionByName(batch.filter("reason <> ''"))
            out.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
            when = F.col(at).cast("timestamp") if at else F.lit(None).cast("timestamp")
            store.write(seen.unionByName(fresh.select(*names, when.alias("seen_at"))), batch_id)
        finally:
            fresh.unpersist()

    return write
