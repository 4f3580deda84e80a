"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.session import shared_dir

#: A word: a run of anything but these six ASCII blanks, in every operator whose definition counts words.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"

_SCRATCH: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``; removed when the driver's Python ends."""
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        _SCRATCH[app] = f"{shared_dir(spark).rstrip('/')}/opsframe-llm-{app}"
        atexit.register(_remove, spark, _SCRATCH[app])
    return _SCRATCH[app]


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may be gone; the folder is then the cluster's to clean
        pass


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back: lineage is cut, lost executors cost nothing."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of at most a few dozen bytes that may be broadcast; beyond it the join shuffles.  Only the plan differs.
BROADCAST_ROWS = 1_000_000


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a narrow side whose counted rows are within ``BROADCAST_ROWS``."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def own_names(docs: DataFrame, known: Iterable[str]) -> DataFrame:
    """The same columns in the same order, those not among ``known`` under names of their place: they clash with nothing.

    ``toDF(*docs.columns)`` gives the names back.
    """
    known = set(known)
    first = {c: i for i, c in reversed(list(enumerate(docs.columns)))}
    return docs.toDF(*[c if c in known and first[c] == i else f"other column {i}" for i, c in enumerate(docs.columns)])


def bucket(id_col: str, buckets: int) -> Column:
    """crc32 of an id written as text, modulo ``buckets``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % buckets


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def whole_keys(batches: Iterator[pa.RecordBatch], key: Callable[[pa.Table], np.ndarray], rows: int) -> Iterator[pa.Table]:
    """Join Arrow batches of a partition sorted by key into tables of about ``rows`` rows that end between two keys."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held)
        keys = key(table)
        last = int(np.searchsorted(keys != keys[-1], True, side="left")) if keys[0] == keys[-1] else (
            len(keys) - int(np.argmax(keys[::-1] != keys[-1])))
        if last and last < len(keys) or keys[0] != keys[-1]:
            yield table.slice(0, last)
            rest = table.slice(last)
            held, count = rest.to_batches(), rest.num_rows
    if held:
        yield pa.Table.from_batches(held)


def local_components(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Smallest position reachable from each of n positions over the links a-b; ``labels`` continues an earlier result."""
    labels = np.arange(n) if labels is None else labels
    while len(a):
        la, lb = labels[a], labels[b]
        differ = la != lb
        if not differ.any():
            break
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels = up
    return labels


def components(edges: DataFrame, name: str = "links") -> DataFrame:
    """Connected components of links (a, b): one row (node, component), the component being its smallest node.

    Each round every node moves to the neighbour (or itself) of least hash, and the links are redrawn between where
    their ends moved; the hash order makes a constant share of the nodes vanish per round whatever the ids look like.
    The moves are composed backwards at the end.  Minima are combined before shuffling, so hubs are no burden.
    """
    def order(c: str) -> Column:
        return F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))

    links = keep(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    moves = []
    while not moves or links.count():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        move = both.groupBy("a").agg(F.min(order("b")).alias("m")).select(
            F.col("a").alias("node"), F.least(F.col("m"), order("a"))["n"].alias("to"))
        moves.append(keep(move, f"{name}-moves"))
        left = moves[-1].select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = moves[-1].select(F.col("node").alias("b"), F.col("to").alias("y"))
        links = keep(links.join(left, "a").join(right, "b").where("x <> y").select(
            F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), name)
    root = moves.pop()
    while moves:
        last = root.select(F.col("node").alias("to"), F.col("to").alias("root"))
        root = moves.pop().join(last, "to", "left").select("node", F.coalesce("root", "to").alias("to"))
    root = keep(root, f"{name}-roots")
    least = root.groupBy("to").agg(F.min("node").alias("low"))
    return root.join(least, "to").select("node", F.least("low", "to").alias("component"))
