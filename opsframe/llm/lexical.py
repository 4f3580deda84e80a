"""Ranked lexical search: an index of posting blocks by shard, searched by Block-Max MaxScore.

Index: every task cuts the documents it scans into shards of bounded text and writes one row per shard: its sorted terms, and
for each term its postings in compressed blocks, with the highest impact of each block beside them.

Search: for each item and shard the lists are taken by falling global bound (weight times the term's highest impact anywhere).
While documents in none of the lists taken so far could still reach the item's threshold, the next list is essential and is
read whole; the rest are non-essential: they only add to candidates, and a candidate whose score so far, block maximum and
remaining bounds stay below the threshold is rejected before its block is decompressed.  The thresholds and best documents
are carried from shard to shard of a task; the tasks' heaps are merged by a window.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from opsframe.llm.common import keep

#: Bytes of text per shard, postings per block, documents returned per item, bytes of items searched at once.
SHARD, BLOCK, TOP, ITEMS = 16_000_000, 128, 20, 4_000_000
INDEX = ("shard long, doc_ids array<long>, lengths binary, terms binary, df binary, base binary, block_max binary, widths binary, "
         "payload binary")

# Terms are runs of ASCII letters and digits and of anything beyond ASCII; in UTF-8 that is a property of single bytes.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def norms(lengths: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    """m of each document; whole numbers of any size where 64 bits would not hold the product."""
    longest = int(lengths.max()) if len(lengths) else 0
    if 25 * longest * n_docs < 2**63:
        return 75 + (25 * n_docs * lengths) // max(1, all_terms)
    return np.array([75 + 25 * n_docs * int(n) // all_terms for n in lengths], dtype=np.int64)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Shard:
    """Postings of documents being gathered."""

    def __init__(self):
        self.vocabulary: dict[bytes, int] = {}
        self.term, self.doc, self.tf, self.lengths = array("i"), array("i"), array("q"), array("q")
        self.doc_ids: list[int | None] = []
        self.size = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        self.size += len(text)
        found = terms_of(text)
        if not found:
            return
        counts, v = Counter(found), self.vocabulary
        self.term.extend([v.setdefault(t, len(v)) for t in counts])
        self.tf.extend(counts.values())
        self.doc.extend([len(self.doc_ids)] * len(counts))
        self.doc_ids.append(doc_id)
        self.lengths.append(len(found))

    def row(self, n_docs: int, all_terms: int) -> dict:
        """The shard's index row: lists by term, cut into blocks, each block packed with as few bytes as it needs."""
        names = sorted(self.vocabulary)
        rank = np.empty(len(names), np.int32)
        rank[[self.vocabulary[t] for t in names]] = np.arange(len(names), dtype=np.int32)
        term = rank[np.frombuffer(self.term, np.int32)]
        order = np.argsort(term, kind="stable")
        term, doc, tf = term[order], np.frombuffer(self.doc, np.int32)[order], np.frombuffer(self.tf, np.int64)[order]
        df = np.bincount(term, minlength=len(names))
        place = np.arange(len(term)) - (np.cumsum(df) - df)[term]
        start = np.flatnonzero(place % BLOCK == 0)
        count = np.diff(start, append=len(term))
        block = np.repeat(np.arange(len(start)), count)
        lengths = np.frombuffer(self.lengths, np.int64)
        block_max = np.maximum.reduceat(impact(tf, norms(lengths, n_docs, all_terms)[doc]), start)
        base = doc[start]
        offset = doc - base[block]
        w_doc, w_tf = (_bytes_needed(np.maximum.reduceat(x, start)) for x in (offset, tf))
        at = np.cumsum(count * (w_doc + w_tf)) - count * (w_doc + w_tf)
        payload = np.zeros(int((count * (w_doc + w_tf)).sum()), np.uint8)
        step = np.arange(len(term)) - start[block]
        for values, width, first in ((offset, w_doc, at), (tf, w_tf, at + count * w_doc)):
            to = first[block] + step * width[block]
            for k in range(int(width.max())):
                has = width[block] > k
                payload[to[has] + k] = (values[has] >> (8 * k)) & 255
        return {"doc_ids": self.doc_ids, "lengths": lengths.astype(np.uint32).tobytes(), "terms": b" ".join(names),
                "df": df.astype(np.int32).tobytes(), "base": base.astype(np.int32).tobytes(),
                "block_max": block_max.astype(np.int32).tobytes(), "widths": (w_doc * 16 + w_tf).astype(np.uint8).tobytes(),
                "payload": payload.tobytes()}


def _bytes_needed(most: np.ndarray) -> np.ndarray:
    return np.where(most < 256, 1, np.where(most < 65536, 2, 4))


def statistics(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """N and L: documents with a term, and all their terms."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(terms_of(t)) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([sum(s > 0 for s in sizes)], pa.int64()), pa.array([sum(sizes)], pa.int64())],
                                             names=["n", "l"])

    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n, total = texts.mapInArrow(count, "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    return n or 0, total or 0


def build_index(docs: DataFrame, n_docs: int, all_terms: int, id_col: str = "doc_id", text_col: str = "text",
                shard: int = SHARD) -> DataFrame:
    """One row per shard, not yet written.  A shard ends at the first document that takes its text to ``shard`` bytes."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, part = 0, TaskContext.get().partitionId()
        schema = pa.schema([("shard", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *[(c, pa.binary()) for c in (
            "lengths", "terms", "df", "base", "block_max", "widths", "payload")]])
        open_shard = Shard()

        def closed() -> Iterator[pa.RecordBatch]:
            if open_shard.doc_ids:
                yield pa.RecordBatch.from_pylist([{"shard": (part << 32) + made, **open_shard.row(n_docs, all_terms)}], schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                open_shard.add(doc_id, text.as_py())
                if open_shard.size >= shard:
                    yield from closed()
                    open_shard, made = Shard(), made + 1
        yield from closed()

    return rows.mapInArrow(work, INDEX)


class Lists:
    """A shard's index row opened for reading."""

    def __init__(self, row: dict):
        self.names = row["terms"].split(b" ")
        self.df = np.frombuffer(row["df"], np.int32)
        blocks = -(-self.df // BLOCK)
        self.first = np.concatenate([[0], np.cumsum(blocks)])
        self.block_max = np.frombuffer(row["block_max"], np.int32)

    def find(self, wanted: list[bytes]) -> list[int]:
        """Place of each wanted term, -1 where the shard has none."""
        out = []
        for t in wanted:
            i = bisect_left(self.names, t)
            out.append(i if i < len(self.names) and self.names[i] == t else -1)
        return out

    def open(self, row: dict, n_docs: int, all_terms: int) -> None:
        self.lengths = np.frombuffer(row["lengths"], np.uint32).astype(np.int64)
        self.m = norms(self.lengths, n_docs, all_terms)
        self.base = np.frombuffer(row["base"], np.int32)
        widths = np.frombuffer(row["widths"], np.uint8)
        self.w_doc, self.w_tf = widths >> 4, widths & 15
        last = self.first[1:] - 1
        self.count = np.full(len(widths), BLOCK, np.int64)
        self.count[last] = self.df - (np.diff(self.first) - 1) * BLOCK
        size = self.count * (self.w_doc + self.w_tf)
        self.at = np.cumsum(size) - size
        self.payload = row["payload"]
        self.ids = row["doc_ids"]
        self.decoded = 0

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and occurrences of one block, decompressed."""
        self.decoded += 1
        n, at, w, v = int(self.count[b]), int(self.at[b]), int(self.w_doc[b]), int(self.w_tf[b])
        return (np.frombuffer(self.payload, f"<u{w}", n, at).astype(np.int64) + self.base[b],
                np.frombuffer(self.payload, f"<u{v}", n, at + n * w).astype(np.int64))

    def blocks(self, which: list[int]) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.block(b) for b in which]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


class Best:
    """The best documents of an item so far: score, whether the id is null, id."""

    def __init__(self, top: int):
        self.top = top
        self.score, self.odd, self.ids = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def threshold(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, ids: list[int | None]) -> None:
        odd = np.array([i is None for i in ids], bool)
        ids = np.array([0 if i is None else i for i in ids], np.int64)
        score, odd, ids = (np.concatenate(p) for p in ((self.score, score), (self.odd, odd), (self.ids, ids)))
        order = np.lexsort((ids, odd, -score))[:self.top]
        self.score, self.odd, self.ids = score[order], odd[order], ids[order]


def search_shard(lists: Lists, query: list[tuple[int, int, int]], best: Best) -> None:
    """One item in one shard.  ``query``: (place of the term, weight with repeats, global bound), by falling bound."""
    query = [q for q in query if q[0] >= 0]
    rest = [0]
    for _, _, bound in reversed(query):
        rest.append(rest[-1] + bound)
    rest.reverse()
    scores = np.zeros(len(lists.m), np.int64)
    threshold, i = best.threshold(), 0
    while i < len(query) and rest[i] >= threshold:  # essential: a document in these lists alone may still get in
        place, w, _ = query[i]
        docs, tf = lists.blocks(range(int(lists.first[place]), int(lists.first[place + 1])))
        scores[docs] += w * impact(tf, lists.m[docs])
        i += 1
        if len(scores) >= best.top:
            threshold = max(threshold, int(np.partition(scores, -best.top)[-best.top]))
    found = np.flatnonzero((scores > 0) & (scores + rest[i] >= threshold))
    for j in range(i, len(query)):
        if not len(found):
            return
        place, w, _ = query[j]
        first, end = int(lists.first[place]), int(lists.first[place + 1])
        block = first - 1 + np.searchsorted(lists.base[first:end], found, side="right")
        most = np.where(block >= first, lists.block_max[np.maximum(block, first)], 0).astype(np.int64)
        stays = scores[found] + w * most + rest[j + 1] >= threshold
        found, block = found[stays], block[stays]
        needed = np.unique(block[block >= first])
        if len(needed):
            docs, tf = lists.blocks(needed.tolist())
            at = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
            hit = docs[at] == found
            scores[found[hit]] += w * impact(tf[at[hit]], lists.m[found[hit]])
    found = found[scores[found] >= threshold]
    if len(found):
        best.add(scores[found], [lists.ids[d] for d in found.tolist()])


def search(index: DataFrame, items: list[tuple[int, str]], n_docs: int, all_terms: int, top: int = TOP) -> DataFrame:
    """item (its number), rank, doc_id, score of one block of items over the whole written index."""
    spark = index.sparkSession
    asked = [(number, Counter(terms_of((text or "").encode()))) for number, text in items]
    wanted = sorted(set().union(*[c for _, c in asked]))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, most = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                lists = Lists(row)
                list_max = np.maximum.reduceat(lists.block_max, lists.first[:-1])
                place = np.array(lists.find(wanted))
                has = place >= 0
                df[has] += lists.df[place[has]]
                most[has] = np.maximum(most[has], list_max[place[has]])
        has = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(df[has]), pa.array(most[has])], names=["term", "df", "most"])

    # as many rows as the block of items has terms
    known = {r.term: (weight(n_docs, r.df), r.most) for r in index.select("terms", "df", "block_max").mapInArrow(
        frequencies, "term long, df long, most long").groupBy("term").agg(F.sum("df").alias("df"), F.max("most").alias("most")).collect()}
    number_of = {t: i for i, t in enumerate(wanted)}
    queries = []
    for number, counts in asked:
        own = [(number_of[t], n * known[number_of[t]][0], n * known[number_of[t]][0] * known[number_of[t]][1])
               for t, n in counts.items() if number_of[t] in known and known[number_of[t]][0] > 0]
        queries.append((number, sorted(own, key=lambda q: (-q[2], q[0]))))
    shared = spark.sparkContext.broadcast((wanted, queries))  # bounded by the block of items

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, queries = shared.value
        best = [Best(top) for _ in queries]
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                lists = Lists(row)
                place = lists.find(wanted)
                lists.open(row, n_docs, all_terms)
                for (_, query), own in zip(queries, best):
                    search_shard(lists, [(place[t], w, bound) for t, w, bound in query], own)
        for (number, _), own in zip(queries, best):
            if len(own.score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(own.score), pa.int64()), pa.array(own.ids, mask=own.odd), pa.array(own.score)],
                    names=["item", "doc_id", "score"])

    heaps = index.mapInArrow(work, "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def ranked(docs: DataFrame, items: DataFrame, item_col: str = "item_id", item_text: str = "text", id_col: str = "doc_id",
           text_col: str = "text", top: int = TOP, shard: int = SHARD, block_bytes: int = ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` best documents of every item, equal scores by ascending id, null ids last.

    A null or empty item, and one none of whose terms is found, gives no rows; items that share an id are ranked each, and
    so are documents that do; null and empty documents are never found; an empty table gives no rows; other columns are
    ignored.  A long document is one posting per term.  Items are searched in blocks of bounded text, each block against
    the whole written index; a block's texts and terms are what the driver holds and broadcasts.
    """
    n_docs, all_terms = statistics(docs, text_col)
    index = keep(build_index(docs, n_docs, all_terms, id_col, text_col, shard), "lexical-index")
    asked = items.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    size = asked.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    kind = asked.schema["item_id"].dataType
    out = docs.sparkSession.createDataFrame([], T.StructType([
        T.StructField("item_id", kind), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())]))
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        if not rows:
            continue
        found = search(index, [(k, r.text) for k, r in enumerate(rows)], n_docs, all_terms, top)
        named = docs.sparkSession.createDataFrame([(k, r.item_id) for k, r in enumerate(rows)],
                                                  T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", kind)]))
        out = out.unionByName(found.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score"))
    return out
