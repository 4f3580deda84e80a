"""Language identification: script ranges narrow the candidates, Viterbi over per-word scores labels the spans of a text.

A word's score for a language is the log probability of its letter trigrams (hashed, counted over all training texts).
Changing language between two words costs a fixed penalty; the best path through a text's words gives its spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.llm.common import bucket

SLOTS = 1 << 15
PENALTY = 12.0
#: A script is a language's own if this share of its training letters are in it.
SCRIPT_SHARE = 0.005
#: Largest amount a single trigram may count for one language against the average of all.
MOST = 4.0
#: Letters worked on at once inside a task.
BLOCK = 2_000_000
UNKNOWN = "und"

# First code points of script ranges, and the script that begins there (0: any other).
SCRIPT_STARTS = [0x0, 0x41, 0x250, 0x370, 0x400, 0x530, 0x590, 0x600, 0x900, 0xE00, 0xE80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00,
                 0x2000, 0x3040, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0x20000, 0x30000]
SCRIPT_NAMES = [0, 1, 0, 2, 3, 0, 4, 5, 6, 7, 0, 8, 9, 0, 1, 2, 0, 10, 0, 11, 0, 9, 0, 11, 0, 11, 0]
SCRIPTS = 12


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point: whether it is a letter, and its script."""
    letter = np.frombuffer(bytes(chr(i).isalpha() for i in range(0x110000)), np.uint8)
    script = np.repeat(SCRIPT_NAMES, np.diff([*SCRIPT_STARTS, 0x110000])).astype(np.uint8)
    return letter, script


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigram slots of all letters, where words begin among them, the words' scripts, and the words' texts."""
    letter, script = _tables()
    joined = " " + " ".join(texts) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts])
    is_letter = letter[points] == 1
    points = np.where(is_letter, points, np.uint32(32))
    at = np.flatnonzero(is_letter)
    mixed = points[at - 1] * np.uint32(0x9E3779B1) + points[at] * np.uint32(0x85EBCA77) + points[at + 1] * np.uint32(0xC2B2AE3D)
    slots = (mixed ^ (mixed >> np.uint32(13))) & np.uint32(SLOTS - 1)
    begins = np.flatnonzero(~is_letter[at - 1])
    return slots, begins, script[points[at[begins]]], np.searchsorted(ends, at[begins] - 1, side="right")


def _blocks(texts: list[str]) -> Iterator[slice]:
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= BLOCK:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


@dataclass
class Model:
    """Languages by code point, trigram scores (slot, language), and which scripts each language writes."""

    names: list[str]
    scores: np.ndarray
    scripts: np.ndarray
    prior: int


def learn(docs: DataFrame) -> Model:
    """Counts over every given text with its language.  docs: text, lang.  The counts are SLOTS per language at most."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_lang.setdefault(lang, []).append((text or "").lower())
            for lang, texts in by_lang.items():
                counts = held.setdefault(lang, np.zeros(SLOTS + SCRIPTS + 1, np.int64))
                counts[-1] += len(texts)
                for part in _blocks(texts):
                    slots, _, scripts, _ = _letters(texts[part])
                    counts[:SLOTS] += np.bincount(slots, minlength=SLOTS)
                    counts[SLOTS:-1] += np.bincount(scripts, minlength=SCRIPTS)
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(counts[at])],
                                             names=["lang", "slot", "n"])

    made = docs.where("lang IS NOT NULL").select("text", "lang").mapInArrow(work, "lang string, slot long, n long")
    rows = made.groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(rows["lang"].unique().tolist())
    counts = np.zeros((SLOTS + SCRIPTS + 1, len(names)))
    counts[rows["slot"].to_numpy(int), [names.index(x) for x in rows["lang"]]] = rows["n"].to_numpy(float)
    grams, scripts = counts[:SLOTS] + 0.5, counts[SLOTS:-1]
    logs = np.log(grams / grams.sum(axis=0, keepdims=True)) if names else grams
    middle = logs.mean(axis=1, keepdims=True) if names else 0
    logs = np.clip(logs - middle, -MOST, MOST).astype(np.float32)
    writes = scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(axis=0, keepdims=True))
    return Model(names, logs, writes & (scripts > 0), int(np.argmax(counts[-1])) if names else -1)


def word_scores(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Scores (word, language) of all words in order, and the text each is in."""
    slots, begins, scripts, owner = _letters([t.lower() for t in texts])
    if not len(begins):
        return np.zeros((0, len(model.names)), np.float32), owner
    scores = np.add.reduceat(model.scores[slots], begins, axis=0)
    may = model.scripts[scripts]
    known = may.any(axis=1)
    scores[~known] = 0
    return np.where(may | ~known[:, None], scores, np.float32(-1000)), owner


def best_path(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The languages of a text's words that score most, less a penalty for each change (ties: stay, then the first)."""
    m, k = scores.shape
    came = np.empty((m, k), np.int16)
    value = scores[0].astype(float)
    stay = np.arange(k)
    for i in range(1, m):
        top = int(value.argmax())
        change = value[top] - penalty > value
        came[i] = np.where(change, top, stay)
        value = np.where(change, value[top] - penalty, value) + scores[i]
    path = np.empty(m, np.int16)
    path[-1] = value.argmax()
    for i in range(m - 1, 0, -1):
        path[i - 1] = came[i, path[i]]
    return path


def best_paths(scores: np.ndarray, starts: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """``best_path`` of many texts, whose words are rows from ``starts`` on: the n-th words of all texts are taken together.

    The paths stand one after the other.
    """
    order = np.argsort(-sizes, kind="stable")
    begins = (np.cumsum(sizes) - sizes)[order]
    starts, sizes = starts[order], sizes[order]
    k, stay = scores.shape[1], np.arange(scores.shape[1])
    alive = np.searchsorted(-sizes, -np.arange(1, int(sizes.max(initial=0)) + 1), side="right")  # texts with so many words
    value = scores[starts].astype(float)
    came = []
    for i in range(1, len(alive)):
        n = alive[i]
        own = value[:n]
        top = own.argmax(axis=1)
        switched = own[np.arange(n), top][:, None] - penalty
        change = switched > own
        came.append(np.where(change, top[:, None], stay).astype(np.int16))
        value[:n] = np.where(change, switched, own) + scores[starts[:n] + i]
    path = np.empty(int(sizes.sum()), np.int16)
    at = value.argmax(axis=1)
    path[begins + sizes - 1] = at
    for i in range(len(alive) - 1, 0, -1):
        n = alive[i]
        at[:n] = came[i - 1][np.arange(n), at[:n]]
        path[begins[:n] + i - 1] = at[:n]
    return path


def label_words(scores: np.ndarray, owner: np.ndarray, texts: int, penalty: float) -> np.ndarray:
    """Best path of every text.  Where no stretch of words gains more than half a penalty over the text's best language,
    that language throughout is the best path, which needs no word-by-word walk: a path with k changes has k + 1
    stretches, which gain (k + 1) / 2 penalties together at most, and pays k."""
    first = np.searchsorted(owner, np.arange(texts))
    some = np.flatnonzero(np.diff([*first, len(owner)]))
    starts = first[some]
    best = np.zeros(texts, np.int16)
    best[some] = np.add.reduceat(scores.astype(np.float64), starts, axis=0).argmax(axis=1)
    path = best[owner]
    gain = np.cumsum(scores - scores[np.arange(len(owner)), path][:, None], axis=0, dtype=np.float64)
    lowest = np.vstack([np.zeros((1, gain.shape[1])), gain[:-1]])
    place = np.repeat(np.arange(len(some)), np.diff([*starts, len(owner)]))
    walls = place[:, None] * -1e9  # later texts lie far lower, so a running minimum never reaches back
    stretch = gain - (np.minimum.accumulate(lowest + walls, axis=0) - walls)
    mixed = np.maximum.reduceat(stretch.max(axis=1), starts) > penalty / 2 - 0.01  # rounding of long sums
    walked = np.flatnonzero(mixed)
    if len(walked):
        sizes = np.diff([*starts, len(owner)])[walked]
        rows = np.repeat(starts[walked] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        path[rows] = best_paths(scores, starts[walked], sizes, penalty)
    return path


def identify(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """doc_id, held_out, lang_pred, score and spans (first word, last word, language) of each text.  docs: doc_id, text, held_out."""
    names = model.names
    span = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            made = []
            for part in _blocks(texts):
                block = texts[part]
                scores, owner = word_scores(block, model)
                path = label_words(scores, owner, len(block), penalty) if len(owner) and names else np.zeros(len(owner), np.int16)
                cuts = np.searchsorted(owner, np.arange(len(block) + 1))
                for a, b in zip(cuts[:-1], cuts[1:]):
                    if a == b or not names:
                        made.append((UNKNOWN, 0.0, []))
                        continue
                    own = path[a:b]
                    count = np.bincount(own, minlength=len(names))
                    top = int(count.argmax()) if scores[a:b].any() else model.prior
                    edge = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), b - a]
                    made.append((names[top], float(max(count[top], 1) / (b - a)),
                                 [{"first": x, "last": y - 1, "lang": names[own[x]]} for x, y in zip(edge, edge[1:])]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([m[0] for m in made], pa.string()),
                 pa.array([m[1] for m in made], pa.float64()), pa.array([m[2] for m in made], pa.list_(span))],
                names=["doc_id", "held_out", "lang_pred", "score", "spans"])

    return docs.select("doc_id", "text", "held_out").mapInArrow(
        work, "doc_id long, held_out boolean, lang_pred string, score double, "
              "spans array<struct<first: int, last: int, lang: string>>")


def languages(docs: DataFrame, folds: int = 5, held_fold: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred, score, spans of each document; documents of one fold are never learned from.

    The language with most words is predicted, its share of the words is the score.  A text that is null or has no
    letter is ``und`` with score 0; one whose letters no language writes gets the most frequent language.  A null
    language is not learned from; null ids count as empty text for the fold; repeated rows are labelled each; without
    any training text all is ``und``; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang"))
    rows = rows.withColumn("held_out", bucket("doc_id", folds) == held_fold)
    return identify(rows, learn(rows.where(~F.col("held_out"))))
