"""Line diff between two versions of the documents of a corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsframe.functions.text import fold_lines, lines

OPS = T.ArrayType(T.StructType([
    T.StructField("op", T.StringType()), T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())]))


#: Steps as numbers.
DEL, ADD, EQ = 1, 2, 3
#: Texts of at most so many lines are compared side by side, their rows being machine words; texts compared at once.
SHORT, SIDE_BY_SIDE = 62, 4096
#: Bytes of lines compared at once; a text above it is compared by itself.
AT_ONCE = 2_000_000

#: Lines that stand this often in a text have their places kept as one number; fewer places are put together when needed.
OFTEN = 32


def _rows(a: list[int], places: dict[int, list[int]], above: int, mask: int, masks: dict[int, int]) -> Iterator[int]:
    """One whole number for each line of ``a`` from the last to the first: bit p is 0 where the longest common part of the
    lines from here on with the last p + 1 lines of ``b`` is longer than with the last p.  A machine word does 64 lines."""
    for line in reversed(a):
        own = places.get(line)
        if own:
            bits = masks.get(line)
            if bits is None:
                bits = sum([1 << p for p in own])
                if len(own) >= OFTEN:
                    masks[line] = bits
            met = above & bits
            above = ((above + met) | (above - met)) & mask
        yield above


def _middle(a: list[int], b: list[int], at: int) -> list[tuple[str, int | None, int | None]]:
    """Steps of the differing middle; of equal scores the deletion comes first.

    Only the row of every k-th line of ``a`` is held (k the square root of their number); the rows between are computed
    again where the walk needs them, so texts of any size take a narrow strip of memory.
    """
    n, m = len(a), len(b)
    common = set(a) & set(b)
    places: dict[int, list[int]] = {}
    for j, line in enumerate(b):
        if line in common:
            places.setdefault(line, []).append(m - 1 - j)
    mask, masks = (1 << m) - 1, {}
    stride = max(1, int(n ** 0.5))
    held = {n: mask}
    for i, row in zip(range(n - 1, -1, -1), _rows(a, places, mask, mask, masks)):
        if i % stride == 0:
            held[i] = row

    def longest(row: int, j: int) -> int:
        """Common lines from a row's line on with the lines from j on."""
        return m - j - (row & ((1 << (m - j)) - 1)).bit_count()

    out, j = [], 0
    left = longest(held[0], 0)  # common lines still to come
    for start in range(0, n, stride):
        stop = min(start + stride, n)
        rows = [held[stop], *_rows(a[start:stop], places, held[stop], mask, masks)][::-1]
        for i in range(start, stop):
            below = rows[i - start + 1]
            without = longest(below, j)
            while j < m and a[i] != b[j] and without < left:  # dropping line i would lose a common line
                without -= not below >> (m - 1 - j) & 1
                out.append(("add", None, at + j))
                j += 1
            if j < m and a[i] == b[j]:
                out.append(("eq", at + i, at + j))
                j, left = j + 1, left - 1
            else:
                out.append(("del", at + i, None))
    return out + [("add", None, at + k) for k in range(j, m)]


def _script(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Steps between two texts of any length, as numbers."""
    short = min(len(a), len(b))
    differs = np.flatnonzero(a[:short] != b[:short])
    head = int(differs[0]) if len(differs) else short
    room = short - head
    back = np.flatnonzero(a[len(a) - room:][::-1] != b[len(b) - room:][::-1])
    tail = int(back[0]) if len(back) else room
    codes = {"del": DEL, "add": ADD, "eq": EQ}
    middle = [codes[op] for op, _, _ in _middle(a[head:len(a) - tail].tolist(), b[head:len(b) - tail].tolist(), head)]
    return np.concatenate([np.full(head, EQ, np.int8), np.array(middle, np.int8), np.full(tail, EQ, np.int8)])


def _leading(met: np.ndarray) -> np.ndarray:
    """How many of a row's first cells hold."""
    return np.argmin(np.hstack([met, np.zeros((len(met), 1), bool)]), axis=1)


def _short_scripts(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Steps of many short texts, one text a row, 0 where there is none.  ``a`` and ``b``: lines as numbers, n and m of them
    in each row, then fillers that are equal to nothing.  The same steps as ``_script``, all texts going forward together."""
    texts, width = np.arange(len(a)), a.shape[1]
    across = np.arange(width)
    head = _leading(a == b)
    room = np.minimum(n, m) - head
    from_end = lambda x, size: np.take_along_axis(x, np.maximum(size[:, None] - 1 - across, 0), axis=1)
    tail = _leading((from_end(a, n) == from_end(b, m)) & (across < room[:, None]))
    n, m = n - head - tail, m - head - tail
    inner = lambda x, size, filler: np.where(across < size[:, None], np.take_along_axis(x, np.minimum(head[:, None] + across, width - 1), axis=1), filler)
    a, b = inner(a, n, -1), inner(b, m, -2)
    high, wide = int(n.max(initial=0)), int(m.max(initial=0))
    one = np.uint64(1)
    mask = (one << m.astype(np.uint64)) - one
    place = np.where(across < m[:, None], one << np.maximum(m[:, None] - 1 - across, 0).astype(np.uint64), np.uint64(0))[:, :wide]
    rows = np.empty((high + 1, len(a)), np.uint64)
    rows[high] = mask
    for i in range(high - 1, -1, -1):
        met = rows[i + 1] & np.where(a[:, i:i + 1] == b[:, :wide], place, np.uint64(0)).sum(axis=1, dtype=np.uint64)
        rows[i] = ((rows[i + 1] + met) | (rows[i + 1] - met)) & mask

    def longest(row: np.ndarray, j: np.ndarray) -> np.ndarray:
        still = m - j
        return still - np.bitwise_count(row & ((one << still.astype(np.uint64)) - one)).astype(np.int64)

    i, j = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    left = longest(rows[0], j)
    steps = np.zeros((int((n + m).max(initial=0)), len(a)), np.int8)
    for k in range(len(steps)):
        more_a, more_b = i < n, j < m
        same = more_a & more_b & (a[texts, np.minimum(i, width - 1)] == b[texts, np.minimum(j, width - 1)])
        add = more_b & ~same & (~more_a | (longest(rows[np.minimum(i + 1, high), texts], j) < left))
        drop = more_a & ~same & ~add
        steps[k] = EQ * same + ADD * add + DEL * drop
        i += same | drop
        j += same | add
        left -= same
    same = lambda size: (across < size[:, None]).astype(np.int8) * np.int8(EQ)
    return np.hstack([same(head), steps.T, same(tail)])


def scripts(old: pa.ListArray, new: pa.ListArray) -> pa.ListArray:
    """Edit scripts of texts as lists of lines."""
    n, m = (x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in (old, new))
    lines_of = pa.concat_arrays([old.flatten(), new.flatten()]).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
    a, b = lines_of[:n.sum()], lines_of[n.sum():]
    first_a, first_b = np.cumsum(n) - n, np.cumsum(m) - m
    longer = np.maximum(n, m)
    found, which, lengths = [], [], []
    for low, high in ((-1, 8), (8, 16), (16, 32), (32, SHORT)):
        group = np.flatnonzero((longer > low) & (longer <= high))
        for at in range(0, len(group), SIDE_BY_SIDE):
            own = group[at:at + SIDE_BY_SIDE]
            across = np.arange(high)
            sides = [np.where(across < size[own, None], lines[np.minimum(first[own, None] + across, len(lines) - 1)] if len(lines) else -3, filler)
                     for lines, first, size, filler in ((a, first_a, n, -1), (b, first_b, m, -2))]
            steps = _short_scripts(*sides, n[own], m[own])
            found.append(steps[steps > 0])
            which.append(own)
            lengths.append((steps > 0).sum(axis=1))
    for t in np.flatnonzero(longer > SHORT):
        found.append(_script(a[first_a[t]:first_a[t] + n[t]], b[first_b[t]:first_b[t] + m[t]]))
        which.append([t])
        lengths.append([len(found[-1])])
    size = np.zeros(len(n), np.int64)
    if which:
        which, lengths, found = np.concatenate(which), np.concatenate(lengths), np.concatenate(found)
        size[which] = lengths
        begins = np.cumsum(size) - size
        steps = np.empty(len(found), np.int8)
        steps[np.repeat(begins[which] - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(found))] = found
    else:
        steps = np.empty(0, np.int8)
    own = np.repeat(np.arange(len(n)), size)
    sides = []
    for other, first in ((ADD, first_a), (DEL, first_b)):
        has = steps != other
        sides.append(pa.array((np.cumsum(has) - 1 - first[own]).astype(np.int32), mask=~has))
    names = pa.array([None, "del", "add", "eq"]).take(pa.array(steps))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)),
                                    pa.StructArray.from_arrays([names, *sides], names=["op", "a", "b"]))


def portions(old: pa.ListArray, new: pa.ListArray, size: int = AT_ONCE) -> Iterator[tuple[pa.ListArray, pa.ListArray]]:
    """The same texts, some at a time: up to the one that brings their lines to ``size`` bytes."""
    def ends(texts: pa.ListArray) -> np.ndarray:
        lengths = pc.binary_length(texts.flatten()).to_numpy(zero_copy_only=False)
        so_far = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        return so_far[np.cumsum(texts.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)]

    total, low = ends(old) + ends(new), 0
    while low < len(old):
        high = min(int(np.searchsorted(total, (total[low - 1] if low else 0) + size)) + 1, len(old))
        yield old.slice(low, high - low), new.slice(low, high - low)
        low = high


@F.arrow_udf(OPS)
def edit_script(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Edit script of two arrays of (already folded) lines; indices are 0-based."""
    for old, new in batches:
        for sides in portions(old, new):
            yield scripts(*sides)
        pa.default_memory_pool().release_unused()


def diff_versions(old: DataFrame, new: DataFrame, doc: str, body: str, ignore_case: bool = False,
                  ignore_space: bool = False) -> DataFrame:
    """One row per edit step: ``doc, op_no, op, a_line, b_line, line`` (1-based line numbers).

    A document that only one version has is compared with no lines: all of it is added or removed.
    """
    none = F.array().cast("array<string>")
    left, right = old.select(doc, lines(body).alias("_a")), new.select(F.col(doc).alias("_doc"), lines(body).alias("_b"))
    sides = left.join(right, F.col(doc).eqNullSafe(F.col("_doc")), "full").select(
        F.coalesce(doc, "_doc").alias(doc), F.coalesce("_a", none).alias("_a"), F.coalesce("_b", none).alias("_b"))
    fold = lambda c: fold_lines(F.col(c), ignore_case, ignore_space)
    folded = sides.withColumns({"_fa": fold("_a"), "_fb": fold("_b")}).withColumn("_same", F.col("_fa") == F.col("_fb"))
    # texts that are equal, or have no lines on one side, send nothing to Python: their script is the same step for each line
    plain = F.col("_same") | (F.size("_a") == 0) | (F.size("_b") == 0)
    sent = lambda c: F.when(plain, none).otherwise(F.col(c))
    nowhere = F.lit(None).cast("int")
    each = lambda c, op, a, b: F.transform(c, lambda x, i: F.struct(
        F.lit(op).alias("op"), (i if a else nowhere).alias("a"), (i if b else nowhere).alias("b")))
    scripted = folded.select(doc, "_a", "_b", "_same", edit_script(sent("_fa"), sent("_fb")).alias("_script"))
    ops = F.when(F.col("_same"), each("_a", "eq", True, True)).when(F.size("_b") == 0, each("_a", "del", True, False)).when(
        F.size("_a") == 0, each("_b", "add", False, True)).otherwise(F.col("_script"))
    both = scripted.select(doc, "_a", "_b", F.posexplode(ops).alias("op_no", "_op"))
    a, b = F.col("_op.a"), F.col("_op.b")
    return both.select(
        doc, (F.col("op_no") + 1).alias("op_no"), F.col("_op.op").alias("op"), (a + 1).alias("a_line"),
        (b + 1).alias("b_line"),
        F.when(a.isNotNull(), F.get("_a", a)).otherwise(F.get("_b", b)).alias("line"))


def diff_counts(ops: DataFrame, doc: str) -> DataFrame:
    op = F.col("op")
    return ops.groupBy(doc).agg(F.count_if(op == "add").alias("added"), F.count_if(op == "del").alias("removed"),
                                F.count_if(op == "eq").alias("unchanged"))


def unified_lines(ops: DataFrame) -> DataFrame:
    """Lines with the unified prefix: two spaces, ``- `` or ``+ ``."""
    mark = F.when(F.col("op") == "eq", "  ").when(F.col("op") == "del", "- ").otherwise("+ ")
    return ops.withColumn("unified", F.concat(mark, "line"))


def unified_text(ops: DataFrame, doc: str) -> DataFrame:
    """Unified text per document (bounded by the document's own size)."""
    rows = F.array_sort(F.collect_list(F.struct("op_no", "unified")))
    return unified_lines(ops).groupBy(doc).agg(F.array_join(rows["unified"], "\n").alias("unified"))
