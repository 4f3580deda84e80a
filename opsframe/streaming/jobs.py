"""Running a stream over what has arrived so far."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def run_available(stream: DataFrame, checkpoint: str, sink: str | None = None, mode: str = "append",
                  each_batch: Callable[[DataFrame, int], None] | None = None) -> None:
    """Process everything available and stop; the checkpoint folder carries state to the next run."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if each_batch is not None:
        query = writer.foreachBatch(each_batch).start()
    else:
        query = writer.format("parquet").option("path", sink).start()
    query.awaitTermination()
