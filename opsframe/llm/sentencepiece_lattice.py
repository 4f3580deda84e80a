"""SentencePiece encoding as a relational lattice, and decoding.

Words (a run of blanks with what follows it, which no piece crosses, cut again where two letters stand side by side in
no piece) are listed once for a block of documents, and once for the corpus.  Every distinct word is exploded into its substrings of bounded length, these are equi-joined to the
piece table, the matches are grouped by word, and a higher-order aggregate folds them from left to right like Viterbi:
for each prefix it keeps the one piece that ends its best segmentation.

The public model at hand is a byte-pair model, whose encoding is no sum of scores: the path is right where no merge of
better rank would have crossed the border of two neighbouring pieces.  So the fold's test for "this piece may follow
that one" is whether a crossing piece of the lattice would have been merged before either side was complete, which the
merge trees of both sides tell (their outer spines come with the piece table).  The ids are exactly the library's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Text bytes per block of documents whose words are listed together.
CHUNK = 24_000_000
#: Text bytes cut into words at once.
CUT = 4_000_000
#: Words put together at once.
SLICE = 500_000
#: Text bytes per task that folds distinct words, so that a task groups its lattice in memory; and tasks at most.
TASK, MOST_TASKS = 2_500_000, 20_000
#: Edges or letters of a word folded before what was found is put aside.
PIECE = 512
NEVER = 1 << 30


@dataclass
class Pieces:
    """The piece table: rows (piece, len, id, rank, heads, tails), ids of single bytes, what each id decodes to, and the
    pairs of neighbouring letters inside pieces.

    heads and tails: the left and right spine of a piece's merge tree (see ``_tree``), empty for one that merging never
    builds.
    """

    rows: list[tuple]
    byte_ids: list[int]
    decoded: list[bytes]
    longest: int
    split_lines: bool
    pairs: frozenset[str]


def _tree(piece: str, rank: dict[str, int]) -> tuple[list[int], list[int]] | None:
    """Outer spines of the merge tree of a piece, or None if merging its letters does not give it.

    A spine is an array by length: the rank at which the piece of that length at the edge is merged on, -1 where the
    tree has none.
    """
    parts = [(c, {1: NEVER}, {1: NEVER}) for c in piece]
    while len(parts) > 1:
        r, i = min((rank.get(a[0] + b[0], NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if r == NEVER:
            return None
        (left, heads, _), (right, _, tails) = parts[i:i + 2]
        whole = {len(left) + len(right): NEVER}
        parts[i:i + 2] = [(left + right, {**heads, len(left): r, **whole}, {**tails, len(right): r, **whole})]
    return tuple([spine.get(n, -1) for n in range(1, len(piece) + 1)] for spine in parts[0][1:])


def load_pieces(model: str = MODEL) -> Pieces:
    """Read a byte-pair model with byte fallback.  The table is as large as the model's vocabulary."""
    p = sentencepiece.SentencePieceProcessor(model_file=model)
    size = p.get_piece_size()
    normal = [i for i in range(size) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
    scores = sorted({p.get_score(i) for i in normal}, reverse=True)
    place = {s: n for n, s in enumerate(scores)}
    rank = {p.id_to_piece(i): place[p.get_score(i)] for i in normal}
    rows = []
    for i in normal:
        piece = p.id_to_piece(i)
        spines = _tree(piece, rank)
        rows.append((piece, len(piece), i, rank[piece], *(spines or ([], []))))
    byte_ids = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    decoded = [b""] * size
    for i in normal:
        decoded[i] = p.id_to_piece(i).replace(BLANK, " ").encode()
    for b, i in enumerate(byte_ids):
        decoded[i] = bytes([b])
    return Pieces(rows, byte_ids, decoded, max(len(r[0]) for r in rows), not any("\n" in r[0] for r in rows),
                  frozenset(r[0][k:k + 2] for r in rows for k in range(len(r[0]) - 1)))


def lattice(words: DataFrame, pieces: Pieces) -> DataFrame:
    """word, edges of each distinct word, by end and start.  A letter that is no piece is an edge without id."""
    spark = words.sparkSession
    table = spark.createDataFrame(pieces.rows, "piece string, len int, id int, rank int, heads array<int>, tails array<int>")
    length = F.char_length("word")
    spans = words.select("word", F.explode(F.sequence(F.lit(1), length)).alias("at")).select(
        "*", F.explode(F.sequence(F.lit(1), F.least(F.lit(pieces.longest), F.char_length("word") - F.col("at") + 1))).alias("size"))
    spans = spans.withColumn("piece", F.substring("word", F.col("at"), F.col("size")))
    table = F.broadcast(table.drop("len"))  # bounded by the vocabulary
    one = F.array(F.lit(NEVER))
    found = spans.join(table, "piece", "left").where("id IS NOT NULL OR size = 1").select(
        "word", F.struct((F.col("at") + F.col("size") - 1).alias("end"), (F.col("at") - 1).alias("start"), "id", F.coalesce("rank", F.lit(NEVER)).alias("rank"), F.coalesce("heads", one).alias("heads"),
                                 F.coalesce("tails", one).alias("tails")).alias("edge"))
    return found.groupBy("word").agg(F.sort_array(F.collect_list("edge")).alias("edges"))


def _named(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def best_edges(edges: Column, longest: int) -> Column:
    """The fold: for each prefix of a word the number of the edge that ends its segmentation.

    Edges come by their ends, so those that may cross the border before an edge stand between the edge chosen for that
    border and the edge itself.  The state holds the choices of the piece at hand, behind those of the last prefixes before
    it; all choices are gathered piece by piece, so a long word is not copied at every step.
    """
    def step(acc: Column, e: Column) -> Column:
        place, j, out = acc["place"], e["start"], acc["out"]
        at = F.element_at(out, F.greatest(j - acc["done"] + F.size(out), F.lit(1)))

        def crossed(chosen: Column) -> Column:
            before = chosen["edge"]
            between = F.slice(edges, chosen["at"] + 1, F.greatest(place - chosen["at"] - 1, F.lit(0)))
            return F.exists(between, lambda x: (x["start"] < j) & (x["end"] > j) & (x["start"] >= before["start"])
                            & (x["rank"] < F.element_at(before["tails"], j - x["start"]))
                            & (x["rank"] <= F.element_at(e["heads"], x["end"] - j)))

        free = (j == 0) | ~_named(F.struct(at.alias("at"), F.element_at(edges, at).alias("edge")), crossed)
        follows = (acc["done"] < e["end"]) & (F.size(e["heads"]) > 0) & free
        return F.when(follows, F.struct((place + 1).alias("place"), (acc["done"] + 1).alias("done"), F.array_append(out, place).alias("out"))).otherwise(
            F.struct((place + 1).alias("place"), acc["done"].alias("done"), out.alias("out")))

    def piece(acc: Column, k: Column) -> Column:
        start = F.struct(acc["place"].alias("place"), acc["done"].alias("done"), acc["recent"].alias("out"))
        done = F.aggregate(F.slice(edges, k * PIECE + 1, F.lit(PIECE)), start, step)

        def kept(d: Column) -> Column:
            n, recent = F.size(d["out"]), F.size(acc["recent"])
            return F.struct(d["place"].alias("place"), d["done"].alias("done"),
                            F.slice(d["out"], F.greatest(n - longest + 1, F.lit(1)), F.lit(longest)).alias("recent"),
                            F.array_append(acc["out"], F.slice(d["out"], recent + 1, n - recent)).alias("out"))

        return _named(done, kept)

    none = F.array().cast("array<int>")
    start = F.struct(F.lit(1).alias("place"), F.lit(0).alias("done"), none.alias("recent"), F.array().cast("array<array<int>>").alias("out"))
    pieces = F.sequence(F.lit(0), F.floor((F.size(edges) - 1) / PIECE).cast("int"))
    return F.flatten(F.aggregate(pieces, start, piece, lambda s: s["out"]))


def chosen_ids(edges: Column, last: Column, word: Column, byte_ids: list[int]) -> Column:
    """Walk back from the word's end, piece by piece; a letter without a piece becomes its bytes."""
    kind = "array<struct<start: int, id: int>>"

    def step(acc: Column, _: Column) -> Column:
        def back(e: Column) -> Column:
            return F.struct(e["start"].alias("at"), F.array_append(acc["out"], F.struct(e["start"].alias("start"), e["id"].alias("id"))).alias("out"))

        return F.when(acc["at"] > 0, _named(F.element_at(edges, F.element_at(last, acc["at"])), back)).otherwise(acc)

    def piece(acc: Column, _: Column) -> Column:
        steps = F.sequence(F.lit(1), F.least(acc["at"], F.lit(PIECE)))
        done = F.aggregate(steps, F.struct(acc["at"].alias("at"), F.array().cast(kind).alias("out")), step)
        more = _named(done, lambda d: F.struct(d["at"].alias("at"), F.array_append(acc["out"], d["out"]).alias("out")))
        return F.when(acc["at"] > 0, more).otherwise(acc)

    start = F.struct(F.size(last).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
    pieces = F.sequence(F.lit(0), F.floor((F.size(last) - 1) / PIECE).cast("int"))
    path = F.reverse(F.flatten(F.aggregate(pieces, start, piece, lambda s: s["out"])))
    table = F.array(*map(F.lit, byte_ids))

    def ids(e: Column) -> Column:
        digits = F.hex(F.encode(F.substring(word, e["start"] + 1, F.lit(1)), "UTF-8"))
        fallback = F.transform(F.sequence(F.lit(1), F.length(digits), F.lit(2)),
                               lambda k: F.element_at(table, F.conv(F.substring(digits, k, F.lit(2)), 16, 10).cast("int") + 1))
        return F.when(e["id"].isNull(), fallback).otherwise(F.array(e["id"]))

    return F.flatten(F.transform(path, ids))


def encode_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """word, ids of a table of distinct words."""
    made = lattice(words, pieces)
    made = made.withColumn("last", best_edges(F.col("edges"), pieces.longest))
    ids = chosen_ids(F.col("edges"), F.col("last"), F.col("word"), pieces.byte_ids).cast("array<int>")
    return made.select("word", ids.alias("ids"))


def decode_ids(ids: list[int], pieces: Pieces) -> str:
    """Text of piece ids, without the blank that encoding puts in front."""
    out = b"".join([pieces.decoded[i] for i in ids])
    return (out[1:] if out[:1] == b" " else out).decode("utf-8", "replace")


def decode(encoded: DataFrame, pieces: Pieces) -> DataFrame:
    """Replaces the column ``ids`` (array of int) by ``text``; null ids give a null text, no ids an empty one."""
    kept = [f for f in encoded.schema.fields if f.name not in ("ids", "text")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if i is None else decode_ids(i, pieces) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(texts, pa.string())],
                                             names=[f.name for f in kept] + ["text"])

    return encoded.mapInArrow(work, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", text string")


def gathered(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Stretches of a flat array one after the other."""
    first = np.cumsum(length) - length
    return flat[np.repeat(start - first, length) + np.arange(int(length.sum()))]


def _press(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue())


def _unpress(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all()


def _press_numbers(values: np.ndarray) -> bytes:
    """Whole numbers with their bytes of like weight side by side, which leaves little of the upper ones."""
    return zstandard.ZstdCompressor(level=3).compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpress_numbers(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


BLOCK_ROW = "block bigint, texts binary, sequence binary, cuts binary, n_cuts binary, parts binary"


def _letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Buffer]:
    """Ends of texts (with a zero in front) and their bytes, as an array and as a buffer."""
    offsets, data = (x or pa.py_buffer(b"") for x in texts.buffers()[1:])
    ends = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    return ends, np.frombuffer(data, np.uint8)[:ends[-1]], data


def _stretches(starts: np.ndarray, data: np.ndarray, buffer: pa.Buffer) -> pa.DictionaryArray:
    """The stretches of text from each start to the next."""
    offsets = np.append(starts, len(data)).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), buffer).dictionary_encode()


class Words:
    """Words of many texts at a time, and the parts they are cut into: wherever two letters stand side by side in no piece,
    which no merge ever crosses."""

    def __init__(self, pieces: Pieces):
        self.lines = pieces.split_lines
        letters = sorted({ord(c) for pair in pieces.pairs for c in pair})
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[letters] = np.arange(1, len(letters) + 1)
        first, second = (np.array([ord(pair[k]) for pair in sorted(pieces.pairs)], np.int64) for k in (0, 1))
        self.pairs = self._pair(self.letter[first], self.letter[second])

    def _pair(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return first * np.int64(self.letter.max(initial=0) + 1) + second

    def listed(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """Words of all texts, and how many each has: a run of blanks (one more stands in front of a text) with what follows
        it, and a line feed with what follows it where no piece holds one."""
        shown = pc.replace_substring(texts, BLANK, " ")
        shown = pc.binary_join_element_wise(pc.if_else(pc.equal(shown, ""), "", " "), shown, "")
        ends, data, buffer = _letters(shown)
        begins = data == 32
        begins[1:] &= data[:-1] != 32
        if self.lines:
            begins |= data == 10
        begins[ends[:-1][ends[:-1] < ends[1:]]] = True
        starts = np.flatnonzero(begins)
        return _stretches(starts, data, buffer), np.diff(np.searchsorted(starts, ends))

    def parts(self, words: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """Parts of all words, and how many each has."""
        ends, data, buffer = _letters(pc.replace_substring(words, " ", BLANK))
        places = np.flatnonzero((data & 0xC0) != 0x80)
        letters = self.letter[np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)]
        cut = np.ones(len(places), bool)
        cut[1:] = ~np.isin(self._pair(letters[:-1], letters[1:]), self.pairs)
        cut[np.searchsorted(places, ends[:-1])] = True
        starts = places[cut]
        return _stretches(starts, data, buffer), np.diff(np.searchsorted(starts, ends))


def blocks_of_words(rows: DataFrame, pieces: Pieces, size: int) -> DataFrame:
    """Texts as numbers of words, block by block: one row for about ``size`` bytes of a task's texts, with the block's
    distinct parts of words, the parts of each word, and the numbers of each text's words.  The texts are not moved."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held = TaskContext.get().partitionId(), 0, 0
        words = Words(pieces)
        doc_ids, odd, listed, counts = [], [], [], []

        def closed() -> pa.RecordBatch:
            found = pa.chunked_array(listed).unify_dictionaries().chunks
            keys, used = found[0].dictionary, np.concatenate([x.indices.to_numpy() for x in found])
            # the commonest words get the smallest numbers, parts stand in order: both leave less to move
            order = np.argsort(-np.bincount(used, minlength=len(keys)), kind="stable")
            rank = np.empty(len(keys), np.int32)
            rank[order] = np.arange(len(keys), dtype=np.int32)
            cuts, n_cuts = words.parts(keys.take(pa.array(order)))
            by_name = pc.sort_indices(cuts.dictionary)
            place = np.empty(len(by_name), np.int32)
            place[by_name.to_numpy()] = np.arange(len(by_name), dtype=np.int32)
            texts = pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "odd": np.concatenate(odd), "n": np.concatenate(counts)})
            blobs = [_press(texts), _press_numbers(rank[used]), _press_numbers(place[cuts.indices.to_numpy()]), _press_numbers(n_cuts),
                     _press(pa.table({"part": cuts.dictionary.take(by_name)}))]
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + made]), *(pa.array([b], pa.binary()) for b in blobs)],
                                              names=["block", "texts", "sequence", "cuts", "n_cuts", "parts"])

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.string())
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
            low = 0
            while low < len(texts):  # up to the text that fills the block
                before = int(ends[low - 1]) if low else 0
                high = min(int(np.searchsorted(ends, before + min(size - held, CUT))) + 1, len(texts))
                own = texts.slice(low, high - low)
                found, n = words.listed(own)
                listed.append(found)
                counts.append(n)
                doc_ids.extend(ids.slice(low, high - low).to_pylist())
                odd.append(pc.match_substring(own, BLANK).to_numpy(zero_copy_only=False))
                held += int(ends[high - 1]) - before
                low = high
                if held >= size:
                    yield closed()
                    made, held = made + 1, 0
                    doc_ids, odd, listed, counts = [], [], [], []
        if doc_ids:
            yield closed()

    return rows.mapInArrow(work, BLOCK_ROW)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """doc_id, ids (array of int), n_pieces, round_trip of every whole text.

    ``round_trip`` says whether decoding gives the text back; it does unless the text holds the visible blank itself.
    A null or empty text has no ids (and round-trips to the empty text); null ids keep their rows; repeated rows are
    encoded each; an empty table gives no rows; other columns are ignored.  A text above ``chunk`` bytes is a block of its
    own; an unbroken word of any length is folded in time that grows with its length times the root of it.  The table
    must give its rows in the same order when a task is run again, as files do; write any other first.
    """
    pieces = load_pieces(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = blocks_of_words(rows, pieces, chunk)

    def list_parts(table: pa.Table) -> pa.Table:
        parts = _unpress(table.column("parts")[0].as_py()).column(0)
        block = np.full(len(parts), table.column("block")[0].as_py())
        return pa.table({"block": pa.array(block), "k": pa.array(np.arange(len(parts), dtype=np.int32)), "word": parts})

    words = blocks.groupBy("block").applyInArrow(list_parts, "block long, k int, word string")
    tasks = min(MOST_TASKS, max(1, -(-size // TASK)))
    words = words.repartition(tasks, "word")  # read for both sides of the join, neither is shuffled again
    # asks for all columns, so that both sides of the join share one shuffle
    distinct = words.groupBy("word").agg(F.min("block").alias("low"), F.min("k").alias("k")).where("low + k IS NOT NULL").select("word")
    coded = encode_words(distinct, pieces)
    back = _packed_codes(words.join(coded, "word").select("block", "k", "ids"))

    def assemble(key: tuple, texts: pa.Table, codes: pa.Table) -> pa.Table:
        parts = _unpress(texts.column("parts")[0].as_py()).column(0).combine_chunks()
        flat, length = _codes_in_order([b.as_py() for b in codes.column("blob")], len(parts))
        good = _decoded_equal(parts, flat, length, pieces)
        del parts
        # ids of every word, from those of its parts
        of_word = _unpress_numbers(texts.column("cuts")[0].as_py())
        n_parts = _unpress_numbers(texts.column("n_cuts")[0].as_py()).astype(np.int64)
        start = np.cumsum(length) - length
        flat = gathered(flat, start[of_word], length[of_word])
        good = _sums((~good[of_word]).astype(np.int64), n_parts) == 0
        length = _sums(length[of_word], n_parts)
        start = np.cumsum(length) - length
        own = _unpress(texts.column("texts")[0].as_py())
        odd = own.column("odd").to_numpy(zero_copy_only=False).astype(bool)
        sequence = _unpress_numbers(texts.column("sequence")[0].as_py())
        ends = np.concatenate([[0], np.cumsum(own.column("n").to_numpy())])
        out, low = [], 0
        while low < len(odd):  # some texts at a time
            high = max(low + 1, int(np.searchsorted(ends, ends[low] + SLICE, side="right")) - 1)
            words, counts = sequence[ends[low]:ends[high]], np.diff(ends[low:high + 1]).astype(np.int64)
            n_pieces = _sums(length[words], counts)
            bad = _sums((~good[words]).astype(np.int64), counts) > 0
            offsets = pa.array(np.concatenate([[0], np.cumsum(n_pieces)]).astype(np.int32))
            ids = pa.array(gathered(flat, start[words], length[words]))
            out.append(pa.table({"doc_id": own.column("doc_id").slice(low, high - low), "ids": pa.ListArray.from_arrays(offsets, ids),
                                 "n_pieces": pa.array(n_pieces), "round_trip": pa.array(~bad & ~odd[low:high])}))
            low = high
        return pa.concat_tables(out)

    return blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(
        assemble, "doc_id long, ids array<int>, n_pieces long, round_trip boolean")


def _codes_in_order(blobs: list[bytes], n_parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all parts of a block in the order of their numbers, and how many each has."""
    k, n, ids = [], [], []
    for blob in blobs:
        table = _unpress(blob)
        k.append(table.column("k").to_numpy())
        n.append(table.column("n").to_numpy().astype(np.int64))
        ids.append(np.frombuffer(table.column("ids")[0].as_py(), np.int32))
    k, n, flat = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (k, n, ids))
    if len(k) != n_parts:
        raise RuntimeError("the table gave its rows in another order when it was read again; write it first")
    order = np.argsort(k)
    n = n.astype(np.int64)
    return gathered(flat, (np.cumsum(n) - n)[order], n[order]), n[order]


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches, empty ones included."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def _decoded_equal(parts: pa.Array, ids: np.ndarray, length: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Whether the ids of each part decode to its bytes."""
    if not len(parts):
        return np.zeros(0, bool)
    size = np.fromiter(map(len, pieces.decoded), np.int64, len(pieces.decoded))
    table = np.frombuffer(b"".join(pieces.decoded), np.uint8)
    wanted = pc.replace_substring(parts, BLANK, " ").cast(pa.binary())
    n_wanted = pc.binary_length(wanted).to_numpy().astype(np.int64)
    found = gathered(table, (np.cumsum(size) - size)[ids], size[ids])
    n_found = _sums(size[ids], length)
    if np.array_equal(n_found, n_wanted):
        bytes_ = np.frombuffer(b"".join(wanted.to_pylist()), np.uint8)
        return _sums((found != bytes_).astype(np.int64), n_wanted) == 0
    ends = np.cumsum(n_found).tolist()
    return np.array([found[e - n:e].tobytes() == w for e, n, w in zip(ends, n_found.tolist(), wanted.to_pylist())], bool)


def _packed_codes(rows: DataFrame) -> DataFrame:
    """block, blob: the codes of each block's parts (k, ids), packed many to a blob, so that few bytes move."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, k = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            lists = batch.column(2)
            flat, ends = lists.values.to_numpy().astype(np.int32), lists.offsets.to_numpy().astype(np.int64)
            start, n = ends[:-1], np.diff(ends)
            order = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[order])) + 1
            for own in np.split(order, cuts):
                if not len(own):
                    continue
                ids = gathered(flat, start[own], n[own])
                table = pa.table({"k": pa.array(k[own]), "n": pa.array(n[own].astype(np.int32))})
                table = table.append_column("ids", pa.array([ids.tobytes()] + [b""] * (len(own) - 1), pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array(block[own[:1]]), pa.array([_press(table)], pa.binary())], names=["block", "blob"])

    return rows.mapInArrow(pack, "block long, blob binary")
