"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Within a source the documents stand in one order, and each has an expected number of copies.  The running sum of these,
plus one random offset, crosses whole numbers; a document is emitted once for each number it crosses.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opsframe.llm.common import WORD, keep, own_names, small_side
from opsframe.operators.order import dense_number

#: Weights in turn of the sources by code point, and the mix's size as a share of all sizes.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
SEED = 20


def words(text: Column) -> Column:
    """Number of words; none in a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Targets of sources (source, source_size): shares of ``share`` times all sizes by weight, at most ``cap`` times a
    source's size, the excess shared again by weight until no source is above.

    The sources in order of cap by weight fill one after the other; a source is capped when the level all uncapped
    sources would get is above its own cap.  One narrow row per source takes part.
    """
    by_name = W.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(by_name) - 1) % len(weights) + 1
    named = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int")))
    named = named.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    level = W.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    before = level.rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    filled = named.select(
        "*", F.coalesce(F.sum("most").over(before), F.lit(0.0)).alias("capped"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("gone"), F.sum("weight").over(everything).alias("all_weight"),
        (F.sum("source_size").over(everything) * F.lit(float(share))).alias("total"))
    given = (F.col("total") - F.col("capped")) / (F.col("all_weight") - F.col("gone"))
    filled = filled.select("source", "source_size", "weight", "most", given.alias("given"))
    full = filled.withColumn("is_full", F.col("most") <= F.col("given") * F.col("weight"))
    open_level = F.min(F.when(~F.col("is_full"), F.struct(F.col("most") / F.col("weight"), "given"))).over(everything)["given"]
    return full.select("source", "source_size",
                       F.when(F.col("is_full"), F.col("most")).otherwise(open_level * F.col("weight")).alias("target"))


def systematic_copies(rows: DataFrame, group: str, expected: str, order: list[str], slice_by: list[Column],
                      seed: int = SEED) -> DataFrame:
    """Adds ``copies``: how many whole numbers the running sum of ``expected`` crosses at each row of its group.

    A group is cut into slices (``slice_by``, which lead the order) summed apart; one row per slice carries the sums on,
    so that a group with a third of all rows is no single task's.  The sums are exact decimals: a slice begins where
    the one before it ended.  The offset is a random number from the seed, the same in every rerun.
    """
    names = [f"_slice{i}" for i in range(len(slice_by))]
    cut = rows.select("*", *[c.alias(n) for c, n in zip(slice_by, names)],
                      F.col(expected).cast("decimal(28,15)").alias("_e"))
    cut = cut.withColumn("_group", F.struct(F.col(group).isNull(), F.coalesce(group, F.lit(""))))
    keys = ["_group", *names]
    sums = cut.groupBy(*keys).agg(F.sum("_e").alias("_sum"))
    earlier = W.partitionBy("_group").orderBy(*names).rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("decimal(38,15)")
    sums = sums.select(*keys, F.coalesce(F.sum("_sum").over(earlier), zero).alias("_before"))
    inside = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    offset = F.lit(f"{random.Random(seed).random():.15f}").cast("decimal(28,15)")
    run = cut.withColumn("_run", F.sum("_e").over(inside)).join(sums, keys)
    end = F.col("_before") + F.col("_run") + offset
    crossed = F.floor(end) - F.floor(end - F.col("_e"))
    return run.select(*rows.columns, crossed.cast("long").alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", salts: int = 64,
        weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """How often each document goes into the mix: doc_id, source, size, source_size, target, copies, taken.

    Every document of a source has the same expected copies, its source's target by its size.  Documents are ordered by
    size class, then by a salt from their id, so that neighbours have near sizes and the words taken come near the
    target.  A null text has no words; null sources form one source of their own, the last; a source without words has
    target 0; a null id is an id like any other; repeated rows are rows of their own; an empty table gives no rows.
    """
    ident, source = F.col(id_col).cast("long"), F.col(source_col).cast("string")
    rows = keep(docs.select(ident.alias("doc_id"), source.alias("source"), words(F.col(text_col)).alias("size")), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = keep(source_targets(sizes, weights, share, cap), "targets").select(
        F.col("source").alias("_source"), "source_size", "target")
    known = rows.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn(
        "expected", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    salt = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(salts))
    size_class = F.floor(F.sqrt("size"))
    out = systematic_copies(known, "source", "expected", ["size", "doc_id"], [size_class, salt], seed)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The mix itself: each document as often as it is taken, all columns as they were, whatever their names.

    Rows that share an id (or have none) are taken as often as all of them together are, evenly, the first by hash once
    more where that does not come out even; they are numbered in ranges, so any number of them may share an id.  Null
    and empty texts, null sources and empty tables are as :func:`mix` has them.
    """
    named = {k: parameters.get(k, k.removesuffix("_col")) for k in ("text_col", "source_col")}
    ident = parameters.get("id_col", "doc_id")
    rows = own_names(docs, [ident, *named.values()])
    copies = keep(mix(rows, **parameters).groupBy("doc_id").agg(F.sum("copies").alias("_all"), F.count("*").alias("_rows")), "copies")
    same = F.col(ident).cast("long").eqNullSafe(F.col("_id"))
    taken = copies.where("_all > 0").withColumnRenamed("doc_id", "_id")
    columns = [F.col(f"`{c}`") for c in rows.columns]
    times = F.floor(F.col("_all") / F.col("_rows")).cast("int")
    out = rows.join(small_side(taken, copies.count()), same).where(times > 0).withColumn(
        "_turn", F.explode(F.sequence(F.lit(1), times))).select(*columns)
    uneven = taken.where("_all % _rows > 0")
    count = uneven.count()
    if count:
        left = rows.join(small_side(uneven, count), same).withColumn("_hash", F.xxhash64(*columns))
        rest = dense_number(keep(left, "uneven"), ["_hash"], "_place", ["_id"]).where("_place <= _all % _rows")
        out = out.unionByName(rest.select(*columns))
    return out.toDF(*docs.columns)
