"""Language-model scoring by online logistic context mixing, beside an add-one unigram base.

A token (a word closed by a blank, or the end mark) is a string of bytes, and every byte a walk of binary decisions down
the Huffman tree of the byte before it.  Four predictors count the outcomes of decisions in hashed contexts over the
whole training text: the last byte, the last two, the last three, and the whole word so far.  Their log odds are
combined by weights that a gate picks (depth of the decision, and how often the longest context was seen), fitted by
Newton steps whose sums go over the whole training text.  The contexts of bytes are those of the running text: they reach
over the blank into the token before.  What they see of it changes only the first three bytes of a token, so a token is
walked in two entries: its head (three bytes of running text, then its first three) and its rest, each once per distinct
entry of the corpus, not once per occurrence.  Along each text the result is refined adaptively: two sharpenings of the
mixed odds, the token's own frequency, its recency in the text, and what followed the same token before in the text share
each token's probability, and the shares follow how well each has done so far.  All of these are probabilities over byte
strings, so the score is one too: total bits, hence bits per byte.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.llm.common import bucket, keep

#: Slots of each hashed predictor; the first has one for every tree node.
SIZES = (1 << 16, 1 << 18, 1 << 20, 1 << 21)
STARTS = np.concatenate([[0], np.cumsum(SIZES)])
DEEPEST = 24
GATE_DEPTH, GATE_SEEN = 6, (2, 8, 40, 400)
SHARPEN = (0.85, 1.1)
#: Starting shares of the sharpenings, the frequency and the recency; tokens per adaptive step; how fast shares move.
SHARES, STEP, MOVE = (0.1, 0.1, 0.75, 0.05), 32, 0.15
#: The same with a share for what followed the token before.
FOLLOWED = (0.1, 0.1, 0.7, 0.05, 0.05)
#: Passes over the training tokens that fit the weights, at most, and the share of the loss that is too little for another one.
ROUNDS, ENOUGH = 8, 1e-4
#: Text bytes per group of documents scored together.
CHUNK = 32_000_000
#: Bytes worked on at once, and text bytes cut into tokens at once.
PIECE, CUT = 1 << 20, 1 << 20
END = b"\n"
#: Bytes of an entry that are only the context of its others, and what stands there before a text's first token.
LEAD = 3
START = b" " * LEAD


def tokens(text: str | None) -> list[bytes]:
    """Words in lower case (A-Z); blanks are ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def running(texts: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Tokens of texts and their ends, in columns: the distinct ones, the numbers of the running ones, how many each text has."""
    found, counts = [], []
    for chunk in texts.chunks:
        sizes = np.cumsum(pc.binary_length(chunk).to_numpy(zero_copy_only=False), dtype=np.int64)
        low = 0
        while low < len(chunk):
            high = min(int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + CUT)) + 1, len(chunk))
            shown = pc.binary_join_element_wise(pc.ascii_lower(chunk.slice(low, high - low).cast(pa.string())), END.decode(), "")
            ends = np.frombuffer(shown.buffers()[1], np.int32)[:len(shown) + 1]
            data = np.frombuffer(shown.buffers()[2], np.uint8)[:ends[-1]]
            blank = (data == 32) | (data - np.uint8(9) < 5)
            begins = ~blank
            begins[1:] &= blank[:-1]
            begins[ends[1:] - 1] = True
            kept = ~blank
            kept[ends[1:] - 1] = True
            starts = np.flatnonzero(begins)
            places = np.append(np.cumsum(kept, dtype=np.int32)[starts] - np.int32(1), np.int32(np.count_nonzero(kept)))
            words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(data[kept])])
            found.append(words.dictionary_encode())
            counts.append(np.diff(np.searchsorted(starts, ends)))
            low = high
    parts = pa.chunked_array(found).unify_dictionaries().chunks
    pa.default_memory_pool().release_unused()  # the pieces' memory, so that it does not stay beside what follows
    return parts[0].dictionary, np.concatenate([x.indices.to_numpy() for x in parts]), np.concatenate(counts)


@dataclass
class Codes:
    """The walk of each (byte before, byte): its length, and at each depth the tree node and the outcome."""

    length: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray


def _huffman(counts: np.ndarray) -> list[tuple[list[int], list[int]]]:
    """Node numbers and outcomes on the way to each of 256 bytes."""
    heap = [(float(c), b, b) for b, c in enumerate(counts)]
    heapq.heapify(heap)
    above: dict[int, tuple[int, int]] = {}
    number = 256
    while len(heap) > 1:
        x, y = heapq.heappop(heap), heapq.heappop(heap)
        above[x[2]], above[y[2]] = (number, 0), (number, 1)
        heapq.heappush(heap, (x[0] + y[0], number, number))
        number += 1
    walks = []
    for b in range(256):
        nodes, bits, at = [], [], b
        while at in above:
            at, bit = above[at]
            nodes.append(at - 256)
            bits.append(bit)
        walks.append((nodes[::-1], bits[::-1]))
    return walks


def make_codes(pairs: np.ndarray) -> Codes:
    """Trees from the counts of byte pairs; rare bytes share what all trees have, and no walk is deeper than DEEPEST."""
    overall = pairs.sum(axis=0) + 1.0
    overall /= overall.sum()
    length = np.zeros(65536, np.uint8)
    nodes, bits = np.zeros((DEEPEST, 65536), np.uint8), np.zeros((DEEPEST, 65536), np.uint8)
    for before in range(256):
        own = pairs[before].astype(float)
        share = (own + 8 * overall) / (own.sum() + 8)
        floor = 1e-6
        while True:
            walks = _huffman(np.maximum(share, floor))
            if max(len(w[0]) for w in walks) <= DEEPEST:
                break
            floor *= 4
        for b, (path, outcome) in enumerate(walks):
            at = before * 256 + b
            length[at] = len(path)
            nodes[:len(path), at] = path
            bits[:len(path), at] = outcome
    return Codes(length, nodes, bits)


def closed(word: bytes) -> bytes:
    """A token as it is written: a word ends in a blank."""
    return word if word == END else word + b" "


def edges(words: list[bytes] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each token, as halves of a head's key: what the next token sees of it, and its own first bytes."""
    words = pa.array(words, pa.binary())
    data = np.frombuffer(pc.binary_join_element_wise(b"  ", words, b"  ", b"").buffers()[2], np.uint8)
    sizes = pc.binary_length(words).to_numpy().astype(np.int64) + 4
    ends = np.cumsum(sizes)
    begins = ends - sizes
    at = lambda places: data[places].astype(np.int64)
    after = (at(ends - 4) << 16 | at(ends - 3) << 8 | 32) << (8 * LEAD)
    first = at(begins + 2) << 16 | at(begins + 3) << 8 | at(begins + 4)
    return after, first


def head_keys(ids: np.ndarray, begins: np.ndarray, after: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Keys of the heads of running tokens (places in ``after`` and ``first``); texts begin at ``begins``."""
    out = np.empty(len(ids), np.int64)
    for low in range(0, len(ids), PIECE):  # a piece at a time, so that the texts' tokens stand in memory once
        high = min(low + PIECE, len(ids))
        out[max(low, 1):high] = after[ids[max(low - 1, 0):high - 1]] | first[ids[max(low, 1):high]]
    out[begins] = int.from_bytes(START, "big") << (8 * LEAD) | first[ids[begins]]
    return out


def head_entry(key: int) -> bytes:
    """Bytes of a head: its context, then the token's first bytes, no further than the token's end."""
    data = key.to_bytes(2 * LEAD, "big")
    if data[LEAD:LEAD + 1] == END:
        return data[:LEAD + 1]
    blank = data.find(b" ", LEAD)
    return data if blank < 0 else data[:blank + 1]


def head_key(entry: bytes) -> int:
    return int.from_bytes(entry.ljust(2 * LEAD), "big")


def lay_out(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of entries, each behind a zero; the places to predict, all but an entry's first three; the entry of each place."""
    data = np.frombuffer(b"".join([b"\x00" + e for e in entries]), np.uint8)
    sizes = np.fromiter(map(len, entries), np.int64, len(entries)) + 1
    owner = np.repeat(np.arange(len(entries), dtype=np.int32), sizes)
    begins = np.cumsum(sizes) - sizes
    places = np.flatnonzero(np.arange(len(data)) - begins[owner] > LEAD)
    return data, places, owner[places]


def decisions(data: np.ndarray, places: np.ndarray, codes: Codes) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray], int]]:
    """For each depth: the places (as numbers into ``places``) that decide there, the outcomes, the predictors' slots.

    A word begins behind a blank, or behind the zero before an entry; a zero inside a word only shortens its context.
    """
    wide = data.astype(np.uint32)
    one, two, three = wide[places - 1], wide[places - 2], wide[places - 3]
    pair = (one << np.uint32(8) | wide[places]).astype(np.int32)
    power = np.cumprod(np.full(len(data), 0x01000193, np.uint32), dtype=np.uint32)
    inverse = np.cumprod(np.full(len(data), pow(0x01000193, -1, 1 << 32), np.uint32), dtype=np.uint32)
    total = np.cumsum((wide + np.uint32(1)) * power, dtype=np.uint32)
    start = np.maximum.accumulate(np.where((data == 0) | (data == 32), np.arange(len(data)), 0))[places - 1]
    word = (total[places - 1] - total[start]) * inverse[start]
    h2 = one * np.uint32(0x9E3779B1) + two * np.uint32(0x85EBCA77)
    h3 = h2 + three * np.uint32(0xC2B2AE3D)
    hashes = [h2 ^ (h2 >> np.uint32(15)), h3 ^ (h3 >> np.uint32(15)), word ^ (word >> np.uint32(15))]
    alive = np.arange(len(places), dtype=np.int32)
    for depth in range(DEEPEST):
        own = pair[alive]
        going = codes.length[own] > depth
        if not going.all():
            alive, own = alive[going], own[going]
        if not len(alive):
            return
        node = (own & np.int32(0xFF00)) | codes.nodes[depth][own]
        spread = node.astype(np.uint32) * np.uint32(0x27D4EB2F)
        slots = [node]
        for k, h in enumerate(hashes):
            mixed = h[alive] + spread
            slots.append(((mixed ^ (mixed >> np.uint32(14))) & np.uint32(SIZES[k + 1] - 1)).astype(np.int32) + np.int32(STARTS[k + 1]))
        yield alive, codes.bits[depth][own], slots, depth


def pieces(words: list[bytes]) -> Iterator[slice]:
    start = size = 0
    for i, word in enumerate(words):
        size += len(word) + 4
        if size >= PIECE:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(words):
        yield slice(start, len(words))


@dataclass
class Model:
    codes: Codes
    odds: np.ndarray
    seen: np.ndarray
    weights: np.ndarray

    def costs(self, words: list[bytes]) -> np.ndarray:
        """Natural-log cost of each token (row), as a text's first, under each sharpening."""
        return self.entry_costs([START + closed(w) for w in words])

    def entry_costs(self, entries: list[bytes]) -> np.ndarray:
        """Natural-log cost of the bytes of each entry (row) behind its context, under each sharpening."""
        out = np.zeros((len(entries), len(SHARPEN)))
        for part in pieces(entries):
            data, places, owner = lay_out(entries[part])
            for alive, bits, slots, depth in decisions(data, places, self.codes):
                weights = self.weights[min(depth, GATE_DEPTH - 1)][self.seen[slots[-1]]]
                z = weights[:, 4].copy()
                for k, slot in enumerate(slots):
                    z += weights[:, k] * self.odds[slot]
                z *= np.float32(1) - np.float32(2) * bits  # now the odds against what happened
                at = owner[alive]
                for s, sharp in enumerate(SHARPEN):
                    wrong = np.log(np.float32(1) + np.exp(np.minimum(z * np.float32(sharp), np.float32(60))))
                    out[part, s] += np.bincount(at, weights=wrong, minlength=part.stop - part.start)
        return out


def earlier(keys: np.ndarray) -> np.ndarray:
    """How often each key came before in the array."""
    n = len(keys)
    bits = n.bit_length()
    if bits + int(keys.max(initial=0)).bit_length() > 63:
        keys = pd.factorize(keys)[0]
    packed = np.sort(keys << bits | np.arange(n))
    ranked, order = packed >> bits, packed & (1 << bits) - 1
    firsts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    out = np.empty(n, np.int64)
    out[order] = np.arange(n) - np.repeat(firsts, np.diff([*firsts, n]))
    return out


def recall(ids: np.ndarray, sizes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares of each token among the tokens before it in its text, and among those that followed the same token there."""
    begins = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(ids)) - begins[text]
    before = np.empty(len(ids), np.int64)
    before[1:] = ids[:-1]
    before[begins] = words
    seen = earlier(text * (words + 1) + ids)
    led = np.zeros(len(ids), np.int64)  # the token before came so often before, and each time something followed it
    led[1:] = seen[:-1]
    led[begins] = 0
    return seen / np.maximum(place, 1), earlier((text * (words + 1) + before) * (words + 1) + ids) / np.maximum(led, 1)


def adapt(costs: np.ndarray, sizes: np.ndarray, shares: tuple[float, ...] = SHARES) -> np.ndarray:
    """Natural-log cost of texts of the given numbers of tokens.  costs: of each token (row) under each expert.

    Within a step of tokens the experts' shares are fixed; then they move toward what each expert has explained.
    """
    offset = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    share = np.tile(np.array(shares), (len(sizes), 1))
    total = np.zeros(len(sizes))
    chance = np.exp(-costs)
    longest = int(sizes.max(initial=0))
    for begin in range(0, longest, STEP):
        own = order[:np.searchsorted(-sizes[order], -begin, side="left")]
        length = np.minimum(sizes[own] - begin, STEP)
        rows = np.repeat(offset[own] + begin, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        text = np.repeat(np.arange(len(own)), length)
        part = chance[rows] * share[own][text]
        mass = np.maximum(part.sum(axis=1), 1e-300)
        starts = np.cumsum(length) - length
        total[own] -= np.add.reduceat(np.log(mass), starts)
        explained = np.add.reduceat(part / mass[:, None], starts, axis=0) / length[:, None]
        moved = (1 - MOVE) * share[own] + MOVE * (explained + 0.01) / (1 + 0.01 * len(shares))
        share[own] = moved
    return total


def _seen(n: np.ndarray) -> np.ndarray:
    return np.digitize(n, GATE_SEEN).astype(np.uint8)


def fit_sums(codes: Codes, zeros: np.ndarray, ones: np.ndarray, weights: np.ndarray, entries: list[bytes], counts: np.ndarray) -> np.ndarray:
    """Per gate (depth, seen): the loss of the entries' decisions under the weights, its falling gradient (5) and its curvature (25).

    Every decision weighs as often as its entry occurs, and has its own outcome taken out of the counts.
    """
    out = np.zeros((*weights.shape[:2], 31))
    for part in pieces(entries):
        data, places, owner = lay_out(entries[part])
        often = counts[part].astype(np.float32)
        for alive, bits, slots, depth in decisions(data, places, codes):
            d, c = min(depth, GATE_DEPTH - 1), often[owner[alive]]
            own1 = bits.astype(np.float32)
            own0 = np.float32(1) - own1
            x = np.ones((5, len(bits)), np.float32)
            for k, slot in enumerate(slots):
                n1, n0 = np.maximum(ones[slot] - own1, 0), np.maximum(zeros[slot] - own0, 0)
                x[k] = np.log((n1 + np.float32(0.4)) / (n0 + np.float32(0.4)))
            gate = _seen(n0 + n1)
            order = np.argsort(gate, kind="stable")
            edges = np.searchsorted(gate[order], np.arange(len(GATE_SEEN) + 2))
            for g, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                if a == b:
                    continue
                at = order[a:b]
                xs, cs = x[:, at], c[at]
                z = np.clip(weights[d, g].astype(np.float32) @ xs, -30, 30)
                chance = np.float32(1) / (np.float32(1) + np.exp(-z))
                out[d, g, 0] += np.dot(np.log1p(np.exp(np.where(own1[at] > 0, -z, z))), cs)
                out[d, g, 1:6] += xs @ ((own1[at] - chance) * cs)
                out[d, g, 6:] += ((xs * (chance * (np.float32(1) - chance) * cs)) @ xs.T).ravel()
    return out


def fit(sums: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Mixing weights of least loss: Newton steps of all gates at once, halved where a gate's loss has risen.

    sums: from weights to ``fit_sums`` over the whole training corpus.  One unit of ridge holds gates without decisions at the start.
    """
    begin = np.full((GATE_DEPTH, len(GATE_SEEN) + 1, 5), 0.3)
    begin[:, :, 4] = 0
    best, least, step = begin, np.full(begin.shape[:2], np.inf), np.zeros_like(begin)
    tried = begin
    for _ in range(ROUNDS):
        found = sums(tried)
        away = tried - begin
        loss = found[:, :, 0] + (away * away).sum(axis=2) / 2
        slope = found[:, :, 1:6] - away
        newton = np.linalg.solve(found[:, :, 6:].reshape(*loss.shape, 5, 5) + np.eye(5), slope[..., None])[..., 0]
        better = (loss <= least)[..., None]
        best, least, step = np.where(better, tried, best), np.minimum(loss, least), np.where(better, newton, step / 2)
        gain = np.where(better[..., 0], (slope * newton).sum(axis=2) / 2, 0)
        if better.all() and gain.sum() <= ENOUGH * max(least.sum(), 1e-9):
            break
        tried = best + step
    return np.round(best, 5).astype(np.float32)  # the order of a distributed sum does not show


def make_model(codes: Codes, zeros: np.ndarray, ones: np.ndarray, words: list[bytes],
               sums: Callable[[np.ndarray], np.ndarray] | None = None) -> Model:
    """Log odds of all slots, and the weights fitted on the given tokens, or by ``sums`` where they are not at hand."""
    odds = np.log((ones + np.float32(0.4)) / (zeros + np.float32(0.4)))
    entries, once = [START + closed(w) for w in words], np.ones(len(words))
    weights = fit(sums or (lambda w: fit_sums(codes, zeros, ones, w, entries, once)))
    return Model(codes, odds, _seen(zeros + ones), weights)


def train(totals: DataFrame) -> Model:
    """Counts and weights over all training text as entries (entry, c: how often).  The tables are of fixed size."""
    used = totals.where("c > 0").select("entry", "c")

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(65536)
        for batch in batches:
            data, places, owner = lay_out(batch.column(0).to_pylist())
            held += np.bincount(data[places - 1].astype(np.int32) << 8 | data[places], minlength=65536,
                                weights=batch.column(1).to_numpy()[owner])
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at].astype(np.int64))], names=["pair", "n"])

    pairs = np.zeros(65536)
    rows = used.mapInArrow(count_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    pairs[rows["pair"].to_numpy(int)] = rows["n"].to_numpy(float)
    codes = make_codes(pairs.reshape(256, 256))

    def count_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(2 * STARTS[-1])
        words, counts, size = [], [], 0

        def flush() -> None:
            weight = np.concatenate(counts)
            data, places, owner = lay_out(words)
            own: list[list[np.ndarray]] = [[] for _ in SIZES]
            occurs = []
            for alive, bits, slots, _ in decisions(data, places, codes):
                occurs.append(weight[owner[alive]])
                for k, slot in enumerate(slots):
                    own[k].append((slot - np.int32(STARTS[k])) * 2 + bits)
            if not occurs:
                return
            occurs = np.concatenate(occurs)
            for k, parts in enumerate(own):
                held[2 * STARTS[k]:2 * STARTS[k + 1]] += np.bincount(np.concatenate(parts), weights=occurs, minlength=2 * SIZES[k])

        for batch in batches:
            words += batch.column(0).to_pylist()
            counts.append(batch.column(1).to_numpy().astype(float))
            size += batch.column(0).nbytes
            if size >= PIECE:
                flush()
                words, counts, size = [], [], 0
        if words:
            flush()
        two = held.reshape(-1, 2)
        at = np.flatnonzero(two.any(axis=1))
        for i in range(0, len(at), 50_000):
            part = at[i:i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *(pa.array(two[part, j].astype(np.int64)) for j in (0, 1))],
                                             names=["slot", "zeros", "ones"])

    made = used.mapInArrow(count_slots, "slot int, zeros long, ones long")
    rows = made.groupBy("slot").agg(F.sum("zeros").cast("float").alias("zeros"), F.sum("ones").cast("float").alias("ones"))
    zeros, ones = np.zeros(STARTS[-1], np.float32), np.zeros(STARTS[-1], np.float32)
    for batch in rows.toArrow().to_batches():
        at = batch.column(0).to_numpy()
        zeros[at], ones[at] = batch.column(1).to_numpy(), batch.column(2).to_numpy()
    tables = totals.sparkSession.sparkContext.broadcast((codes, zeros, ones))

    def sums(weights: np.ndarray) -> np.ndarray:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros((*weights.shape[:2], 31))
            for batch in batches:
                held += fit_sums(*tables.value, weights, batch.column(0).to_pylist(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(held.size)), pa.array(held.ravel())], names=["place", "v"])

        added = used.mapInArrow(add, "place long, v double").groupBy("place").agg(F.sum("v").alias("v")).toPandas()
        out = np.zeros((*weights.shape[:2], 31))
        out.ravel()[added["place"].to_numpy(int)] = added["v"].to_numpy(float)
        return out

    model = make_model(codes, zeros, ones, [], sums)
    tables.unpersist()
    return model


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2,
          chunk: int = CHUNK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every text.

    Counts come from the documents outside one fold.  The words of a group of documents, and the heads its tokens have
    there, are listed once with their training counts, summed over all groups and sent back to the groups that have them;
    the texts meet these lists.
    A null text is empty: one token, the end.  Null ids count as empty text for the fold; repeated rows are learned and
    scored each; without training texts every count is zero; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumn("held_out", bucket("doc_id", folds) == held_fold)
    groups = max(1, -(-(rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0) // chunk))
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int"))

    def list_words(table: pa.Table) -> pa.Table:
        own, ids, sizes = running(table.column("text"))
        learned = np.repeat(~table.column("held_out").to_numpy(), sizes)
        which, keys = pd.factorize(head_keys(ids, np.cumsum(sizes) - sizes, *edges(own)))
        n = np.concatenate([np.bincount(at[learned], minlength=size) for at, size in ((ids, len(own)), (which, len(keys)))])
        words = pc.if_else(pc.equal(own, END), own, pc.binary_join_element_wise(own, b" ", b""))
        entries = pa.chunked_array([words, pa.array([head_entry(k) for k in keys.tolist()], pa.binary())])
        return pa.table({"chunk": pa.array(np.full(len(n), table.column("chunk")[0].as_py(), np.int32)), "entry": entries,
                         "head": pa.array(np.arange(len(n)) >= len(own)), "n": pa.array(n.astype(np.int64))})

    words = keep(dealt.groupBy("chunk").applyInArrow(list_words, "chunk int, entry binary, head boolean, n long"), "chunk-words")
    totals = keep(words.groupBy("entry", "head").agg(F.sum("n").alias("c")), "words")
    known = totals.where("NOT head").agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v")).first()
    n_train = known["n"] or 0
    base = float(np.log10(n_train + (known["v"] or 0) + 1))
    model = train(totals)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs = model.entry_costs(batch.column(0).to_pylist()).astype(np.float32)
            offsets = np.arange(0, costs.size + 1, len(SHARPEN), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, costs.ravel())],
                                             names=["entry", "head", "c", "costs"])

    costed = totals.mapInArrow(walk, "entry binary, head boolean, c long, costs array<float>")
    back = words.select("chunk", "entry", "head").join(costed, ["entry", "head"]).select("chunk", "entry", "head", "c", "costs")

    def score_chunk(key: tuple, texts: pa.Table, lists: pa.Table) -> pa.Table:
        if texts.num_rows == 0:
            return empty.slice(0, 0)
        is_head = lists.column("head").to_numpy()
        cost_of = np.concatenate([x.flatten().to_numpy() for x in lists.column("costs").chunks]).reshape(-1, len(SHARPEN)).astype(float)
        keys = pd.Index([head_key(e) for e in lists.column("entry").filter(lists.column("head")).to_pylist()], dtype=np.int64)
        head_cost = cost_of[is_head]
        own = lists.column("entry").filter(pa.array(~is_head)).combine_chunks()
        own = pc.if_else(pc.equal(own, END), own, pc.binary_slice(own, 0, -1))
        after, first = edges(own)
        length_of = pc.binary_length(own).to_numpy().astype(np.int64)
        distinct, all_ids, all_lengths = running(texts.column("text"))
        all_ids = pc.index_in(distinct, value_set=own).to_numpy()[all_ids]
        all_ends = np.cumsum(all_lengths)
        c_of, cost_of = lists.column("c").to_numpy()[~is_head].astype(float), cost_of[~is_head]
        logs_of = np.log10(c_of + 1)
        frequency = np.where(c_of > 0, -np.log(np.maximum(c_of, 1) / max(n_train, 1)), 700.0)
        n_tokens, n_known, logs, costs, sizes = [], [], [], [], []
        for at in range(0, texts.num_rows, 128):
            lengths, ends = all_lengths[at:at + 128], all_ends[at:at + 128]
            begins = np.cumsum(lengths) - lengths
            ids = all_ids[ends[0] - lengths[0]:ends[-1]]
            heads = keys.get_indexer(head_keys(ids, begins, after, first))
            with np.errstate(divide="ignore"):
                recent, followed = (np.minimum(-np.log(x), 700.0) for x in recall(ids, lengths, len(own)))
            experts = np.column_stack([cost_of[ids] + head_cost[heads], frequency[ids], recent, followed])
            costs.append(adapt(experts, lengths, FOLLOWED))
            n_tokens.append(lengths)
            n_known.append(np.add.reduceat((c_of[ids] > 0).astype(np.int64), begins))
            logs.append(np.add.reduceat(logs_of[ids], begins) - lengths * base)
            sizes.append(np.add.reduceat(length_of[ids], begins) + lengths - 1)
        n_tokens, n_known, logs, cost, sizes = (np.concatenate(x) for x in (n_tokens, n_known, logs, costs, sizes))
        return pa.table({"doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"), "n_tokens": pa.array(n_tokens, pa.int64()),
                         "n_known": pa.array(n_known, pa.int64()), "base_score": pa.array(logs, pa.float64()),
                         "score": pa.array(-cost / np.log(10)), "bits_per_byte": pa.array(cost / np.log(2) / sizes)})

    fields = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
              ("base_score", pa.float64()), ("score", pa.float64()), ("bits_per_byte", pa.float64())]
    empty = pa.table({n: pa.array([], t) for n, t in fields})
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, bits_per_byte double"
    out = dealt.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(score_chunk, schema)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score",
                      "score", "bits_per_byte")
