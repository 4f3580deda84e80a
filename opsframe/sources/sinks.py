"""Writing tables, parts, archives and logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.functions.text import or_label, safe_name
from opsframe.operators import kpi
from opsframe.operators.summary import BLANK_GROUP, archive_manifest, split_manifest


# Cells keep their outer spaces, and quotes are doubled.
CSV_OPTIONS = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _options(writer, fmt: str, **extra: str):
    return writer.options(**CSV_OPTIONS, **extra) if fmt == "csv" else writer


def save_table(df: DataFrame, path: str, columns: Sequence[str] | None = None, fmt: str = "parquet",
               mode: str = "overwrite", **options: str) -> None:
    """Write the declared columns in their order; other columns are dropped.  ``options`` go to a CSV writer."""
    out = df.select(*columns) if columns else df
    _options(out.write.mode(mode).format(fmt), fmt, **options).save(path)


def _write_parts(df: DataFrame, path: str, part_columns: Sequence[str], fmt: str, max_records: int) -> None:
    writer = df.write.mode("overwrite").format(fmt).option("maxRecordsPerFile", max_records).partitionBy(*part_columns)
    _options(writer, fmt).save(path)


def split_by(df: DataFrame, by: str, path: str, fmt: str = "csv", blank: str = BLANK_GROUP,
             max_records: int = 5_000_000) -> DataFrame:
    """One folder per distinct key and a manifest of row counts.

    Rows are not shuffled by key: every task writes its share of each part, so a part holding most rows is written by
    all tasks.
    """
    _write_parts(df.withColumn("part", safe_name(or_label(by, blank))), path, ["part"], fmt, max_records)
    return split_manifest(df, by, blank)


def archive_by_category(df: DataFrame, path: str, day: str, category: str, fmt: str = "csv",
                        max_records: int = 5_000_000) -> DataFrame:
    tagged = df.withColumns({"process_date": F.col(day).cast("string"), "part": safe_name(category)})
    _write_parts(tagged, path, ["process_date", "part"], fmt, max_records)
    return archive_manifest(tagged, "process_date", category)


def reject_table(rejected: DataFrame, path: str, columns: Sequence[str], reason: str = "reason",
                 source: str = "__source__", fmt: str = "csv") -> None:
    """Rejected rows in their own column order: data, then reason and provenance."""
    data = [c for c in columns if c not in (reason, source)]
    save_table(rejected, path, [*data, *[c for c in (reason, source) if c in rejected.columns]], fmt)


def append_snapshot(df: DataFrame, path: str, columns: Sequence[str] | None = None, fmt: str = "parquet") -> None:
    save_table(df, path, columns, fmt, mode="append")


def upsert_history(history: DataFrame, new: DataFrame, path: str, key: str = "day") -> DataFrame:
    """Merge and write to a fresh path (a table must not be overwritten while it is read)."""
    merged = kpi.upsert_history(history, new, key)
    save_table(merged, path)
    return merged.sparkSession.read.parquet(path)
