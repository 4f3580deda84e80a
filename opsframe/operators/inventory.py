"""File inventories: categories, sizes and identical contents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.functions.text import category, extension
from opsframe.operators.order import attach_by_key
from opsframe.operators.quality import size_flag
from opsframe.sources.files import LISTED, filesystem, list_files

# Names never scanned, and labels.
EXCLUDED = [".git", "node_modules", "__pycache__", ".DS_Store", "Thumbs.db"]
NO_EXTENSION = "(无扩展名)"


CHUNK = 1 << 20  # fixed value: bytes hashed at a time


def file_inventory(spark: SparkSession, root: str, recursive: bool = True, exclude: Sequence[str] | None = None,
                   with_hash: bool = True) -> DataFrame:
    """``path, rel_path, size, mtime[, fingerprint]`` of the files below a folder, hidden ones included.

    Folders are listed level by level in tasks, and tasks hash the files piece by piece, so neither the number of files
    nor the size of one is held anywhere.  Names in ``exclude`` are left out at any depth.
    """
    excluded = set(EXCLUDED if exclude is None else exclude)
    listed = list_files(spark, root, recursive, lambda n: n not in excluded, lambda n: n not in excluded)
    if not with_hash:
        return listed

    def hash_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = filesystem(root)
        for batch in batches:
            prints = []
            for path in batch.column(0).to_pylist():
                digest = hashlib.sha256()
                with system.open_input_stream(path) as stream:
                    while piece := stream.read(CHUNK):
                        digest.update(piece)
                prints.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints, pa.string())], names=[*batch.schema.names, "fingerprint"])

    spread = listed.repartition(spark.sparkContext.defaultParallelism * 4, "path")
    return spread.mapInArrow(hash_files, LISTED + ", fingerprint string")


def classify(df: DataFrame, path: str, size: Column | str, tiny_below: int = 1024) -> DataFrame:
    ext = F.lower(extension(path))
    return df.withColumns({"ext": ext, "category": category(ext), "size_flag": size_flag(size, tiny_below)})


def extension_tally(df: DataFrame, path: str) -> DataFrame:
    ext = F.lower(extension(path))
    return df.groupBy(F.when(ext == "", NO_EXTENSION).otherwise(ext).alias("ext")).agg(F.count("*").alias("n"))


def mark_duplicates(df: DataFrame, path: str, fingerprint: str, hot_rows: int = 5_000_000) -> DataFrame:
    """Add ``original`` (first path with the same fingerprint) and ``is_duplicate``.

    The first path per fingerprint comes from a map-side combined minimum; attaching it salts fingerprints with very
    many copies (all empty files share one).
    """
    firsts = df.groupBy(fingerprint).agg(F.min(path).alias("original"), F.count("*").alias("n_copies"))
    out = attach_by_key(df, firsts, fingerprint, "n_copies", F.col(path), hot_rows)
    return out.withColumn("is_duplicate", F.col(path) != F.col("original"))


def category_tally(marked: DataFrame, duplicates: str = "_重复文件") -> DataFrame:
    """Archived files per category; duplicates form their own line."""
    label = F.when(F.col("is_duplicate"), duplicates).otherwise(F.col("category"))
    return marked.groupBy(label.alias("category")).agg(F.count("*").alias("n"))
