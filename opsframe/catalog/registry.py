"""Registered queries: a Spark function and, beside it, the SQL it must agree with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsframe.session import configure

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
INPUTS: dict[str, str] = {}


def given(name: str, sql: str) -> None:
    """Name an input derived from the tables.  The text is plain enough to mean the same in Spark and in DuckDB."""
    INPUTS[name] = sql


def _used(sql: str) -> list[str]:
    words = set(re.findall(r"\b[a-z_0-9]+\b", sql))
    return [n for n in INPUTS if n in words]


def _with_inputs(sql: str) -> str:
    """Put the derived inputs a query names in front of it, dependencies first."""
    order: list[str] = []

    def add(name: str) -> None:
        for dep in _used(INPUTS[name]):
            if dep != name and dep not in order:
                add(dep)
        if name not in order:
            order.append(name)

    for name in _used(sql):
        add(name)
    if not order:
        return sql
    parts = ", ".join(f"{n} AS ({INPUTS[n]})" for n in order)
    for start in ("WITH RECURSIVE ", "WITH "):
        if sql.strip().upper().startswith(start):
            return f"{start}{parts}, {sql.strip()[len(start):]}"
    return f"WITH {parts} {sql.strip()}"




# Tables and derived inputs whose rows get costly cell work.
ROW_WORK = {"documents", "pages", "dirty_amounts", "dirty_dates", "form_rows", "mixed_cells", "moments", "json_cells",
            "sale_lines"}
_SCHEMAS: dict[str, T.StructType] = {}


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for a scan with fewer splits than cores (a file of one row group cannot be split).

    Real tables have far more splits than cores and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


class Tables:
    """The given tables and derived inputs of one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder

    def table(self, name: str, costly: bool = False) -> DataFrame:
        path = f"{self.folder}/{name}.parquet"
        if path not in _SCHEMAS:  # one footer look per table, not one per query
            _SCHEMAS[path] = self.spark.read.parquet(path).schema
        df = self.spark.read.schema(_SCHEMAS[path]).parquet(path)
        return spread(df) if costly or name in ROW_WORK else df

    def input(self, name: str) -> DataFrame:
        sql = INPUTS[name]
        frames = {n: self.table(n, name in ROW_WORK) for n in TABLES if re.search(rf"\b(FROM|JOIN) {n}\b", sql)}
        frames |= {n: self.input(n) for n in _used(sql) if n != name}
        sql = sql.replace("{", "{{").replace("}", "}}")
        for n in frames:
            sql = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", sql)
        return self.spark.sql(sql, **frames)

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        if name in INPUTS:
            return self.input(name)
        raise AttributeError(name)


def plain(df: DataFrame) -> DataFrame:
    """Result types both engines write alike: days as text, exact decimals as doubles, whole numbers as bigint."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: plain(fn(Tables(spark, folder)))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def oracles() -> dict[str, str]:
    """The SQL twins with the derived inputs they name; put together once every input is known."""
    return {name: _with_inputs(sql) for name, sql in ORACLES.items()}
