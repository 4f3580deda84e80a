"""Near duplicates by SimHash: pivot distance tables thin the pairs inside equi-joined buckets, survivors are verified.

Two fingerprints within ``most`` bits leave at least two of ``most + 2`` bit blocks untouched (pigeonhole), so every link
meets in a bucket keyed by two blocks.  In a bucket each fingerprint has its Hamming distances to a set of reference
fingerprints; by the triangle inequality two that differ by more than ``most`` in any of these coordinates are no link.
The rows are sorted by the first coordinate, so only neighbours inside that range are looked at at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.llm.common import components, keep, local_components, whole_keys

WORDS = 4
MOST = 4
#: A larger bucket is dealt out as pairs of slices of this many fingerprints.
BUCKET = 4096
PIVOTS = np.random.default_rng(64).integers(0, 1 << 64, 12, dtype=np.uint64)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64-bit SimHash of the shingles of a text: a bit is set if it is in over half of their XXH64 (seed 42)."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and blanks alone
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(1, len(parts) - words + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[:last].tolist(), ends[min(words, len(parts)) - 1:].tolist())],
                      dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, last, 1 << 16):
        block = hashes[at:at + (1 << 16)]
        ones += np.unpackbits(block.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > last).view(">u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, fp: the fingerprint of each whole text as a signed long."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made)], names=["doc_id", "fp"])

    ident = F.col(id_col).cast("long").alias("doc_id")
    return docs.select(ident, F.col(text_col).alias("text")).mapInArrow(work, "doc_id long, fp long")


def _blocks(most: int) -> list[int]:
    """Bit masks whose blocks, two by two, are the keys of the buckets."""
    count = most + 2
    edges = [64 * i // count for i in range(count + 1)]
    single = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [x | y for x, y in combinations(single, 2)]


def linked_in_buckets(bucket: np.ndarray, prints: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join up every pair within ``most`` bits inside each bucket: (node, smallest member it is joined with)."""
    table = np.bitwise_count(prints[:, None] ^ PIVOTS).astype(np.int16)
    order = np.lexsort((prints, table[:, 0], bucket))
    bucket, prints, table = bucket[order], prints[order], table[order]
    n = len(prints)
    labels = np.arange(n)
    alive = np.arange(n - 1)
    step = 1
    while len(alive):
        other = alive + step
        near = (bucket[other] == bucket[alive]) & (table[other, 0] - table[alive, 0] <= most)
        alive, other = alive[near], other[near]
        fresh = labels[alive] != labels[other]  # those already joined need no further look
        a, b = alive[fresh], other[fresh]
        for k in range(1, len(PIVOTS)):
            close = np.abs(table[a, k] - table[b, k]) <= most
            a, b = a[close], b[close]
        true = np.bitwise_count(prints[a] ^ prints[b]) <= most
        labels = local_components(n, a[true], b[true], labels)
        step += 1
        alive = alive[alive + step < n]
    moved = labels != np.arange(n)
    return prints[moved], prints[labels[moved]]


def fingerprint_links(prints: DataFrame, most: int = MOST, bucket_size: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that join up all that lie within ``most`` bits.

    A bucket above ``bucket_size`` is cut into slices; every two slices meet in a task of their own, so no bucket is
    too large for one and no link is lost.
    """
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("bits"))
                               for i, m in enumerate(_blocks(most))])).alias("key")
    rows = prints.select("fp", keys).select("fp", "key.mask", "key.bits")
    large = rows.groupBy("mask", "bits").agg(F.count("*").alias("size")).where(F.col("size") > bucket_size)
    large = keep(large.withColumn("slices", F.ceil(F.col("size") / bucket_size).cast("int")), "large-buckets")
    cut = rows.join(large.drop("size"), ["mask", "bits"], "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int")
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("slices") - 1),
                                  lambda j: F.struct(F.least(own, j).alias("x"), F.greatest(own, j).alias("y"))))
    met = cut.withColumn("tile", pairs).select("fp", F.xxhash64("mask", "bits", "tile.x", "tile.y").alias("bucket"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_keys(batches, lambda t: t.column("bucket").to_numpy(), 200_000):
            a, b = linked_in_buckets(table.column("bucket").to_numpy(), table.column("fp").to_numpy().view(np.uint64), most)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return met.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(work, "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, most: int = MOST,
                   bucket_size: int = BUCKET) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links).

    Texts are lower-cased in A-Z.  Shorter texts are one shingle; a null, empty or blank text has fingerprint zero and
    is linked like any other.  Documents of one fingerprint are one node, so copies make no pairs.  A null id stays in
    the result and is never a component_id unless the whole component has null ids; repeated rows stay; an empty table
    gives no rows; other columns are ignored.
    """
    made = keep(fingerprints(docs, id_col, text_col, words), "fingerprints")
    nodes = keep(made.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    joined = components(fingerprint_links(nodes.select("fp"), most, bucket_size), "simhash").withColumnRenamed("node", "fp")
    named = nodes.join(joined, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = named.select("fp", "component").join(lows, "component").select("fp", "component_id")
    return made.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
