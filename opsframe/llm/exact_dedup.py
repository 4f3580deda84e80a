"""Exact deduplication: binary-fuse filters of immutable snapshots screen incoming digests before any text moves.

A snapshot is written once: its distinct 64-bit text keys and, per shard of keys, a three-way binary-fuse filter
(Graf and Lemire 2022, about 9 bits a key, one false positive in 256).  An incoming batch is first grouped by itself,
so a text with a million copies reaches the filters as one key.  Keys that a filter passes are looked up in the
snapshot's exact buckets (an equi-join on the key).  Only documents whose key occurs more than once bring their text,
and these are grouped by the bytes of the text, so two texts with one key stay apart.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.llm.common import BLANKS, keep, small_side

#: Keys a filter shard holds at most on average; a shard is built and asked in one task.
SHARD_KEYS = 200_000
FILTER_FIELDS = "shard long, seed long, segment long, segments long, cells binary"


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + np.uint64(seed)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def _places(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Three cells of each key, in neighbouring segments, and its 8-bit fingerprint."""
    h = _mix(keys, seed)
    first = ((h >> np.uint64(32)) * np.uint64(segments * segment)) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * segment)) ^ (h & mask)
    return np.stack([first, second, third]).astype(np.int64), (h ^ (h >> np.uint64(32))).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, np.ndarray]:
    """Seed, segment length, segment count and cells of the filter of distinct unsigned keys.

    Keys are peeled in rounds: whoever is alone in a cell takes it.  Filled in reverse, each key's three cells xor to
    its fingerprint.  A failed peeling is tried again with the next seed.
    """
    n = len(keys)
    segment = 1 << max(2, min(18, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    load = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    segments = max(1, -(-int(n * load) // segment) - 2)
    size = (segments + 2) * segment
    for seed in range(1, 1000):
        places, prints = _places(keys, seed, segment, segments)
        count = np.bincount(places.ravel(), minlength=size)
        held = np.zeros(size, np.int64)  # xor of the numbers of the keys in a cell
        for row in places:
            np.bitwise_xor.at(held, row, np.arange(n))
        rounds, left = [], n
        cells = np.flatnonzero(count == 1)
        while len(cells):
            owner, at = np.unique(held[cells], return_index=True)
            own = cells[at]
            rounds.append((owner, own))
            left -= len(owner)
            touched = places[:, owner]
            for row in touched:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(held, row, owner)
            near = np.unique(touched)
            cells = near[count[near] == 1]
        if left == 0:
            table = np.zeros(size, np.uint8)
            for owner, own in reversed(rounds):
                three = places[:, owner]
                table[own] = 0
                table[own] = prints[owner] ^ table[three[0]] ^ table[three[1]] ^ table[three[2]]
            return seed, segment, segments, table
    raise ValueError("keys are not distinct")


def ask_filter(keys: np.ndarray, seed: int, segment: int, segments: int, table: np.ndarray) -> np.ndarray:
    places, prints = _places(keys, seed, segment, segments)
    return (table[places[0]] ^ table[places[1]] ^ table[places[2]]) == prints


def bare(text: Column) -> Column:
    """Text without ASCII blanks; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("shard"), "key"), F.lit(shards))


def make_filters(keys: DataFrame, shards: int) -> DataFrame:
    """Filters of a snapshot's distinct keys, one row per shard."""
    def build(shard: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        seed, segment, segments, table = build_filter(rows["key"].to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame({"shard": [shard[0]], "seed": [seed], "segment": [segment], "segments": [segments],
                             "cells": [table.tobytes()]})

    return keys.select(_shard(shards).alias("shard"), "key").groupBy("shard").applyInPandas(build, FILTER_FIELDS)


def screen(keys: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The incoming distinct keys that a snapshot's filters pass: all that it holds, and one in 256 of the others."""
    def ask(rows: pd.DataFrame, made: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or made.empty:
            return rows[["key"]].head(0)
        f = made.iloc[0]
        passed = ask_filter(rows["key"].to_numpy(np.int64).view(np.uint64), int(f.seed), int(f.segment), int(f.segments),
                            np.frombuffer(f.cells, np.uint8))
        return rows.loc[passed, ["key"]]

    asked = keys.select(_shard(shards).alias("shard"), "key")
    return asked.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(ask, "key long")


def repeated_keys(keys: DataFrame, batches: int = 3, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """Keys that more than one row has, found as a corpus grows batch by batch.

    ``keys``: batch, key.  Each batch is grouped alone, then its keys are screened against the snapshot of every
    earlier batch; what passes is looked up in the snapshot's exact bucket.
    """
    found, snapshots = [], []
    for number in range(batches):
        groups = keep(keys.where(F.col("batch") == number).groupBy("key").agg(F.count("*").alias("n")), "batch")
        found.append(groups.where("n > 1").select("key"))
        fresh = groups.select("key")
        for held, filters, shards in snapshots:
            found.append(screen(fresh, filters, shards).join(held, "key", "left_semi"))
        if number + 1 < batches:
            shards = max(1, -(-fresh.count() // shard_keys))
            snapshots.append((fresh, keep(make_filters(fresh, shards), "filters"), shards))
    return reduce(DataFrame.unionByName, found).distinct()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 3,
                 key_bits: int = 64, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """One row per document with the document that stays of those with equal text.

    Texts are equal when equal without ASCII blanks.  The longest original text stays, then the smallest id.

    Returns doc_id, keep_id, group_size, kept, text_sha256.  A null text counts as empty, so all null and blank texts
    form one group; rows with a null id come after the others, and a group of such rows alone keeps a null id (its rows
    then all count as kept); repeated rows with one id are all kept or dropped together; an empty table gives no rows;
    other columns are ignored.  ``key_bits`` shortens the key, for tests of the byte check.
    """
    text, ident = F.col(text_col), F.col(id_col).cast("long")
    key = F.shiftright(F.xxhash64("bare"), 64 - key_bits)
    read = docs.select(ident.alias("doc_id"), F.length(F.coalesce(text, F.lit(""))).alias("points"), bare(text).alias("bare"))
    rows = keep(read.select("doc_id", "points", key.alias("key"), F.unhex(F.sha2("bare", 256)).alias("sha"),
                            F.pmod(F.xxhash64(F.lit("batch"), "doc_id"), F.lit(batches)).alias("batch")), "digests")
    again = keep(repeated_keys(rows.select("batch", "key"), batches, shard_keys), "repeated")

    # Byte check: the texts of repeated keys alone are brought and grouped by what they are.  The order (longest, then
    # smallest id, null last) is one exact number, so that the groups are hashed and combined before the shuffle.
    def number(value: int) -> Column:
        return F.lit(str(value)).cast("decimal(20,0)")

    rank = (F.col("points").cast("decimal(10,0)") * number(1 << 65)
            + F.coalesce(number(1 << 63) - F.col("doc_id").cast("decimal(20,0)"), number(0)))
    texts = read.withColumn("key", key).join(small_side(again, again.count()), "key", "left_semi")
    same = texts.groupBy("key", "bare").agg(F.count("*").alias("n"), F.max(rank).alias("best"))
    term = F.pmod(F.col("best"), number(1 << 65))
    groups = same.select("key", F.unhex(F.sha2("bare", 256)).alias("sha"), "n",
                         F.when(term > 0, (number(1 << 63) - term).cast("long")).alias("best_id"))
    groups = keep(groups, "groups")
    out = rows.join(groups, ["key", "sha"], "left").select(
        "doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.lower(F.hex("sha")).alias("text_sha256"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
