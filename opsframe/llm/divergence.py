"""Audit of how the sources of a language differ in their words, recounted through minimal perfect hashes.

First pass: in how many documents of its language each term stands, counted exactly; the frequent ones are kept.  They are
dealt into shards, and every shard gets a minimal perfect hash (levels of bit arrays; a key sits at the first level where it
stands alone, its slot is the rank of its bit) with its keys stored in slot order.  Second pass: the shards are broadcast, as
many at once as a byte bound allows, the documents are read again, each term is looked up and compared with the key stored in
its slot, and the slots of its group's dense array are incremented.  What is left are small tables by group and slot.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opsframe.llm.common import keep

#: Documents of its language a term must stand in; terms reported per group.
LEAST, TOP = 10, 10
#: Keys of a shard, bytes of shards broadcast at once, terms a task counts before it passes them on, dense cells a task holds.
SHARD_KEYS, ROUND, HELD, CELLS = 100_000, 48_000_000, 300_000, 6_000_000
#: Slots of a block compared at once, and cells (sources times slots) of a comparison.
BLOCK, MATRIX = 4096, 500_000
SEED = 42

# Terms are runs of ASCII letters and of anything beyond ASCII; in UTF-8 that is a property of single bytes.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


def hashes(terms: list[bytes]) -> np.ndarray:
    """XXH64 with seed 42, as Spark's ``xxhash64`` of the string."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(t, SEED) for t in terms), np.uint64, len(terms))


def _place(h: np.ndarray, level: int, size: int) -> np.ndarray:
    x = h + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


def build_hash(terms: list[bytes], h: np.ndarray) -> tuple[list[tuple[int, bytes]], list[bytes]]:
    """Levels (size, packed bits) and the terms in slot order; terms whose 64-bit hash another one has stand at the end."""
    _, first = np.unique(h, return_index=True)
    left = np.sort(first)
    levels, slots = [], []
    while len(left):
        size = max(64, 2 * len(left))
        place = _place(h[left], len(levels), size)
        alone = np.bincount(place, minlength=size)[place] == 1
        bits = np.zeros(size, np.uint8)
        bits[place[alone]] = 1
        levels.append((size, np.packbits(bits).tobytes()))
        mine = left[alone]
        slots.append(mine[np.argsort(place[alone])])
        left = left[~alone]
    order = np.concatenate([*slots, np.setdiff1d(np.arange(len(terms)), first)]).astype(np.int64) if len(terms) else []
    return levels, [terms[i] for i in order]


class PerfectHash:
    """Slots of terms, -1 for any that is not stored."""

    def __init__(self, levels: list[tuple[int, bytes]], keys: list[bytes]):
        self.keys, self.levels, first = keys, [], 0
        for size, packed in levels:
            bits = np.unpackbits(np.frombuffer(packed, np.uint8), count=size).astype(bool)
            ranks = (np.cumsum(bits, dtype=np.int32) - 1 + first).astype(np.int32)
            self.levels.append((size, bits, ranks))
            first += int(bits.sum())
        self.odd = {k: first + i for i, k in enumerate(keys[first:])}  # keys that share another key's 64-bit hash

    def slots(self, terms: list[bytes], h: np.ndarray) -> np.ndarray:
        out = np.full(len(terms), -1, np.int64)
        left = np.arange(len(terms))
        for level, (size, bits, ranks) in enumerate(self.levels):
            place = _place(h[left], level, size)
            here = bits[place]
            out[left[here]] = ranks[place[here]]
            left = left[~here]
            if not len(left):
                break
        keys = self.keys
        same = np.fromiter((s >= 0 and keys[s] == t for s, t in zip(out.tolist(), terms)), bool, len(terms))
        out[~same] = -1
        if self.odd:
            for i in np.flatnonzero(~same).tolist():
                out[i] = self.odd.get(terms[i], -1)
        return out


def group_rows(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n)
                         for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])


def frequent_terms(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, term, df of the terms that stand in at least ``least`` documents of their language."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def passed() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.binary()).cast(pa.string()),
                                                  pa.array(list(counts.values()), pa.int64())], names=["lang", "term", "df"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                held[lang].update(set(terms_of(text.as_py())))
                if sum(map(len, held.values())) > HELD:
                    yield from passed()
        yield from passed()

    partial = rows.select("lang", "text").mapInArrow(work, "lang string, term string, df long")
    return partial.groupBy("lang", "term").agg(F.sum("df").alias("df")).where(F.col("df") >= least)


def perfect_hashes(kept: DataFrame, shards: int) -> DataFrame:
    """lang, shard, levels, keys (in slot order) of the kept terms."""
    def work(table: pa.Table) -> pa.Table:
        terms = table.column("term").cast(pa.binary()).to_pylist()
        levels, keys = build_hash(terms, hashes(terms))
        one = {"lang": table.column("lang")[0].as_py(), "shard": table.column("shard")[0].as_py(),
               "levels": [{"size": s, "bits": b} for s, b in levels], "keys": [k.decode() for k in keys]}
        return pa.Table.from_pylist([one], schema)

    schema = pa.schema([("lang", pa.string()), ("shard", pa.int64()), ("levels", pa.list_(pa.struct([("size", pa.int64()), ("bits", pa.binary())]))),
                        ("keys", pa.list_(pa.string()))])
    dealt = kept.select("lang", F.pmod(F.xxhash64("term"), F.lit(shards)).alias("shard"), "term")
    return dealt.groupBy("lang", "shard").applyInArrow(work, "lang string, shard long, levels array<struct<size: long, bits: binary>>, keys array<string>")


def recount(rows: DataFrame, hashed: list, shards: int) -> DataFrame:
    """lang, source, shard, slot, n: occurrences of the terms of the given shards, by group.  Every row of the result is one
    task's sum; slots without occurrences are left out."""
    shared = rows.sparkSession.sparkContext.broadcast(
        {(r.lang, r.shard): ([(x.size, bytes(x.bits)) for x in r["levels"]], [k.encode() for k in r["keys"]]) for r in hashed})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[tuple[str, int], PerfectHash] = {}
        for k, (levels, keys) in shared.value.items():
            tables[k] = PerfectHash(levels, keys)
        dense: dict[tuple[str, str, int], np.ndarray] = {}

        def passed() -> Iterator[pa.RecordBatch]:
            for (lang, source, shard), cells in dense.items():
                slot = np.flatnonzero(cells)
                if len(slot):
                    yield pa.RecordBatch.from_arrays([
                        pa.array([lang] * len(slot), pa.string()), pa.array([source] * len(slot), pa.string()),
                        pa.array(np.full(len(slot), shard)), pa.array(slot), pa.array(cells[slot])], names=["lang", "source", "shard", "slot", "n"])
            dense.clear()

        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            groups: dict[tuple[str, str], list[bytes]] = defaultdict(list)
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
                groups[lang, source].append(text)
            for (lang, source), own in groups.items():
                met = Counter(terms_of(b" ".join(own)))
                terms = list(met)
                h, n = hashes(terms), np.fromiter(met.values(), np.int64, len(met))
                shard_of = np.mod(h.view(np.int64), shards)
                for shard in np.unique(shard_of).tolist():
                    table = tables.get((lang, shard))
                    if table is None:
                        continue
                    here = np.flatnonzero(shard_of == shard) if shards > 1 else np.arange(len(terms))
                    slots = table.slots([terms[i] for i in here.tolist()] if shards > 1 else terms, h[here])
                    found = slots >= 0
                    cells = dense.get((lang, source, shard))
                    if cells is None:
                        cells = dense[lang, source, shard] = np.zeros(len(table.keys), np.int64)
                    cells[slots[found]] += n[here[found]]  # each term once, so each slot once
                if sum(map(len, dense.values())) > CELLS:
                    yield from passed()
        yield from passed()

    return rows.mapInArrow(work, "lang string, source string, shard long, slot long, n long")


def share(count: Column, all_terms: Column, kinds: Column) -> Column:
    """1 + floor(1e9 (count + 2) / (N + 2 V)), exact."""
    wide = (count + 2).cast("decimal(28,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    return F.lit(1) + F.call_function("div", wide, (all_terms + 2 * kinds).cast("decimal(28,0)"))


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The same by long division in steps of a thousand, so that 64 bits hold every step; total: N + 2 V of each row."""
    q, r = np.divmod(counts + 2, total[:, None])
    for _ in range(3):
        d, r = np.divmod(r * 1000, total[:, None])
        q = q * 1000 + d
    return q + 1


def differences(p: np.ndarray) -> np.ndarray:
    """Sum over the columns of floor((p-q)^2 / (p+q)) for every two rows."""
    out = np.zeros((len(p), len(p)), np.int64)
    for i in range(len(p) - 1):
        for j in range(i + 1, len(p), step := max(1, MATRIX // max(1, p.shape[1]))):
            others = p[j:j + step]
            d = others - p[i]
            out[i, j:j + step] = (d * d // (others + p[i])).sum(axis=1)
    return out + out.T


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST,
          top: int = TOP, shard_keys: int = SHARD_KEYS, round_bytes: int = ROUND) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from the others, and its ``top`` terms.

    Null text, lang or source count as empty.  A language without kept terms gives its pairs with value 0 and no terms; an
    empty table gives no rows; ties are ranked by the item's UTF-8; other columns are ignored; repeated rows count each.
    Shards hold about ``shard_keys`` terms of a language, as many of them as ``round_bytes`` allows are collected and
    broadcast at once; a larger vocabulary takes more rounds over the documents.  A group's counts are summed by slot, so
    a language or source with a third of all rows is spread like the others.
    """
    rows = group_rows(docs, text_col, lang_col, source_col)
    kept = keep(frequent_terms(rows, least), "kept-terms")
    n_kept, n_bytes = kept.agg(F.count("*"), F.sum(F.octet_length("term") + 40)).first()
    shards = max(1, -(-n_kept // shard_keys))
    hashed = keep(perfect_hashes(kept, shards), "perfect-hashes")
    at_once = max(1, round_bytes * shards // max(1, n_bytes or 0))  # shards are dealt by hash, so they hold like many bytes
    sums = None
    for low in range(0, shards, at_once):
        part = recount(rows, hashed.where(F.col("shard").between(low, low + at_once - 1)).collect(), shards)
        part = keep(part.groupBy("lang", "shard", "slot", "source").agg(F.sum("n").alias("n")), "slot-counts")
        sums = part if sums is None else sums.unionByName(part)

    kinds = kept.groupBy("lang").agg(F.count("*").alias("kinds"))
    groups = rows.select("lang", "source").distinct()
    totals = sums.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = keep(groups.join(totals, ["lang", "source"], "left").join(kinds, "lang", "left").select(
        "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kinds", F.lit(0)).alias("kinds")), "groups")

    cut = F.floor(F.col("slot") / BLOCK)
    last = F.greatest(F.floor((F.size("keys") - 1) / BLOCK), F.lit(0))
    blocks = hashed.select("lang", "shard", F.size("keys").alias("slots"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    sides = groups.join(blocks, "lang", "left").select(
        "lang", F.coalesce("shard", F.lit(0)).alias("shard"), F.coalesce("block", F.lit(0)).alias("block"), "source", "total", "kinds",
        F.coalesce(F.least(F.col("slots") - F.col("block") * BLOCK, F.lit(BLOCK)), F.lit(0)).alias("slots"))

    def compare(key: tuple, found: pa.Table, side: pa.Table) -> pa.Table:
        lang, names = key[0].as_py(), side.column("source").to_pylist()
        row = {s: i for i, s in enumerate(names)}
        counts = np.zeros((len(names), side.column("slots")[0].as_py()), np.int64)
        at = np.fromiter((row[s] for s in found.column("source").to_pylist()), np.int64, found.num_rows)
        counts[at, found.column("slot").to_numpy() % BLOCK] = found.column("n").to_numpy()
        total = side.column("total").to_numpy() + 2 * side.column("kinds").to_numpy()
        values = differences(shares(counts, total)) if counts.size else np.zeros((len(names),) * 2, np.int64)
        a, b = np.nonzero(~np.eye(len(names), dtype=bool))
        named = pa.array(names, pa.string())
        return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "source": named.take(pa.array(a)), "item": named.take(pa.array(b)),
                         "value": pa.array(values[a, b])})

    pairs = sums.withColumn("block", cut).groupBy("lang", "shard", "block").cogroup(sides.groupBy("lang", "shard", "block")).applyInArrow(
        compare, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    of_lang = sums.groupBy("lang", "shard", "slot").agg(F.sum("n").alias("lang_n"))
    lang_total = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    terms = hashed.select("lang", "shard", F.posexplode("keys").alias("slot", "item")).withColumn("slot", F.col("slot").cast("long"))
    p, q = share(F.col("n"), F.col("total"), F.col("kinds")), share(F.col("lang_n"), F.col("lang_total"), F.col("kinds"))
    above = sums.join(of_lang.join(terms, ["lang", "shard", "slot"]), ["lang", "shard", "slot"]).join(
        groups.join(lang_total, "lang"), ["lang", "source"]).select("lang", "source", "item", p.alias("p"), q.alias("q")).where("p > q")
    own = above.select("lang", "source", "item", F.expr("(p - q) * (p - q) div (p + q)").alias("value"))

    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = [part.select("lang", "source", F.lit(name).alias("part"), "item", "value", F.row_number().over(by).alias("rank"))
           for name, part in (("pair", pairs), ("term", own))]
    return out[0].unionByName(out[1].where(F.col("rank") <= top))
