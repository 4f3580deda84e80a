"""Files of a folder tree, listed level by level in tasks and opened by byte range."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.session import ensure_checkpoints

LISTED = "path string, rel_path string, size bigint, mtime timestamp"
ENTRIES = pa.schema([("folder", pa.bool_()), ("path", pa.string()), ("rel_path", pa.string()), ("size", pa.int64()),
                     ("mtime", pa.timestamp("us", "UTC"))])
ROWS = 10_000  # fixed value: entries per Arrow batch


def filesystem(root: str) -> tuple[fs.FileSystem, str]:
    """File system of a path or address, and the path within it."""
    return fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")


def list_files(spark: SparkSession, root: str, recursive: bool = True, enter: Callable[[str], bool] = lambda name: True,
               take: Callable[[str], bool] = lambda name: True) -> DataFrame:
    """``path, rel_path, size, mtime`` of the files below a folder, whatever their names begin with.

    The tree is walked breadth first: the folders of one level are dealt over all tasks, each listing one folder at a
    time, and what they find is checkpointed as the next level's input.  So a deep or lopsided tree is spread by its
    folders, and the driver counts folders only.  ``enter`` and ``take`` choose folders and files by name.
    """
    ensure_checkpoints(spark)
    _, top = filesystem(root)
    top = top.rstrip("/")

    def list_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = filesystem(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = [e for e in system.get_file_info(fs.FileSelector(folder))
                         if (e.type == fs.FileType.File and take(e.base_name)) or (e.type == fs.FileType.Directory and recursive and enter(e.base_name))]
                for k in range(0, len(found), ROWS):
                    part = found[k:k + ROWS]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([e.type == fs.FileType.Directory for e in part]), pa.array([e.path for e in part], pa.string()),
                         pa.array([e.path[len(top) + 1:] for e in part], pa.string()), pa.array([e.size for e in part], pa.int64()),
                         pa.array([e.mtime for e in part], pa.timestamp("us", "UTC"))], schema=ENTRIES)

    files, level, n = None, spark.createDataFrame([(top,)], "path string"), 1
    while n:
        tasks = min(n, spark.sparkContext.defaultParallelism * 4)
        entries = level.repartition(tasks).mapInArrow(list_level, f"folder boolean, {LISTED}").checkpoint()
        own = entries.where("NOT folder").drop("folder")
        files = own if files is None else files.unionByName(own)
        level = entries.where("folder").select("path")
        n = level.count()
    return files


def file_splits(files: DataFrame, size: int) -> DataFrame:
    """``path, size, start, stop``: byte ranges of at most ``size`` bytes; an empty file has one empty range."""
    start = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(size).cast("bigint")))
    return files.select("path", "size", start.alias("start")).withColumn("stop", F.least(F.col("start") + size, F.col("size")))
