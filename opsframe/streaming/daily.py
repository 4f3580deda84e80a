"""Running day totals, their history, and alerts on days that are over, from a stream of facts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.operators import kpi

HISTORY = "day date, total double, n_orders bigint"
#: Running sums are exact decimals, so the order in which facts arrive leaves no trace.
SUMS = "day date, total decimal(38,8), n_orders bigint"


def daily_kpi_stream(facts: DataFrame, at: str, amount: str, late: str = "2 days") -> DataFrame:
    """Day totals of an event-time stream; days older than the watermark leave the state.

    In append mode a day comes out once, when the watermark has closed it.
    """
    return (
        facts.withWatermark(at, late)
        .groupBy(F.window(at, "1 day").alias("_w"))
        .agg(F.sum(amount).cast("double").alias("total"), F.count("*").alias("n_orders"))
        .select(F.col("_w.start").cast("date").alias("day"), "total", "n_orders")
    )


def _version(spark: SparkSession, folder: str, batch_id: int, schema: str = HISTORY) -> DataFrame:
    """The history as the batch before left it; empty before the first."""
    if batch_id == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/v={batch_id - 1}")


def _keep(history: DataFrame, folder: str, batch_id: int) -> None:
    """Write a version and remove the one before the last: a repeated batch still finds what it started from."""
    history.write.mode("overwrite").parquet(f"{folder}/v={batch_id}")
    spark = history.sparkSession
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/v={batch_id - 2}")
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def history_adder(folder: str, at: str, amount: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function over raw facts that adds each batch's day sums to a history in numbered versions.

    There is no watermark, so a fact that is years late still counts for its day.  A batch is one small row per day, and
    a batch that is repeated after a failure starts from the version before it and gives the same result.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        sums = batch.groupBy(F.col(at).cast("date").alias("day")).agg(
            F.sum(F.col(amount).cast("decimal(28,8)")).alias("total"), F.count("*").alias("n_orders")).filter("day IS NOT NULL")
        both = _version(batch.sparkSession, folder, batch_id, SUMS).unionByName(sums)
        _keep(both.groupBy("day").agg(F.sum("total").cast("decimal(38,8)").alias("total"), F.sum("n_orders").alias("n_orders")), folder, batch_id)

    return write


def latest_history(spark: SparkSession, folder: str) -> DataFrame:
    """The newest version of a history kept in ``folder``."""
    versions = spark.read.option("basePath", folder).parquet(folder)
    newest = versions.agg(F.max("v").alias("v"))
    return versions.join(newest, "v", "left_semi").drop("v").withColumn("total", F.col("total").cast("double"))


def alert_writer(sink: str, history: str, drop_pct: float | None = 20, rise_pct: float | None = 50, min_amount: float = 0,
                 min_orders: int = 0) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function over closed days (:func:`daily_kpi_stream` in append mode) that writes their alerts.

    A day is judged once, when it is over, beside the last observed day before it; the closed days are kept as a history
    of their own.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        known = _version(batch.sparkSession, history, batch_id)
        days = known.unionByName(batch).withColumn("avg_amount", F.col("total") / F.col("n_orders"))
        judged = kpi.compare(days).join(batch.select("day"), "day", "left_semi")
        alerts = kpi.kpi_alerts(judged, drop_pct, rise_pct, min_amount, min_orders)
        alerts.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        _keep(known.unionByName(batch), history, batch_id)

    return write
