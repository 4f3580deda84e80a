"""Toxicity by a weighted lexicon: folded text, Aho-Corasick matching, exception phrases, a score normalised by length.

The lexicon is learned from labelled documents: words and word beginnings that toxic documents have far more often than
clean ones, weighted by the log of that ratio.  Matching runs once over the folded text for all terms and phrases.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.llm.common import bucket, keep

#: Labelled documents that learning reads at most: those with the least hash of their id.
FIT_ROWS = 12_000
#: A term is in this share of the toxic documents at least (and in this many), and this many times as often as in clean ones.
LEAST_SHARE, LEAST_DOCS, LEAST_RATIO = 0.01, 6, 20.0
#: Terms and phrases that a lexicon holds at most, those of most weight times coverage first.
TERMS = 5_000
PREFIXES = range(3, 9)

# Letters that look like a Latin letter, and what digits and signs stand for inside words.
HOMOGLYPHS = str.maketrans("аеорсухіјѕһԁԛԝвкмнтгіӏαοενικρτυχ", "aeopcyxijshdqwbkmhtrilaoevikptux")
DIGITS = str.maketrans("0134578", "oieastb")
SIGNS = str.maketrans("@$!€", "asie")
_ODD = re.compile("[0-9@$!€Ͱ-ϿЀ-ӿԀ-ԯ！-～​-‍­]")
_HIDDEN = re.compile("[​-‍­]")
_DIGIT_RUN = re.compile(r"(?<=[^\W\d_])[013457]+|[013457]+(?=[^\W\d_])")
_SIGN = re.compile(r"(?<=[^\W\d_])[@$!€](?=[^\W\d_])")
_WIDE = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}
_GAP = re.compile(r"[\W_]+")


def fold(text: str | None) -> str:
    """Lower-case words between single blanks, look-alike letters and digits inside words replaced by what they mimic."""
    text = (text or "").lower()
    if _ODD.search(text):
        text = _HIDDEN.sub("", text).translate(_WIDE).translate(HOMOGLYPHS)
        text = _SIGN.sub(lambda m: m[0].translate(SIGNS), text)
        text = _DIGIT_RUN.sub(lambda m: m[0].translate(DIGITS), text)
    return f" {_GAP.sub(' ', text).strip()} "


@dataclass
class Lexicon:
    """Terms with weights (" word " is whole, " beg" a beginning), exception phrases, and the logistic scale."""

    terms: dict[str, float]
    phrases: list[str]
    scale: tuple[float, float, float] = (-3.0, 1.0, 0.5)

    def automaton(self) -> ahocorasick.Automaton:
        made = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            made.add_word(term, (term, weight))
        for phrase in self.phrases:
            made.add_word(phrase, (phrase, None))
        if len(made):
            made.make_automaton()
        return made


def hits(text: str, automaton: ahocorasick.Automaton) -> dict[int, tuple[str, float]]:
    """The strongest term of each matched word, by the word's place, without words that lie in an exception phrase."""
    found: dict[int, tuple[str, float]] = {}
    spans = []
    for end, (term, weight) in automaton.iter(text) if len(automaton) else ():
        start = end - len(term) + 1
        if weight is None:
            spans.append((start, end))
        elif start not in found or weight > found[start][1]:
            found[start] = (term, weight)
    return {at: hit for at, hit in found.items() if not any(a <= at < b for a, b in spans)} if spans else found


def evidence(text: str | None, automaton: ahocorasick.Automaton) -> tuple[int, float, float]:
    """Number of matches, their weight, and their weight per hundred words, the last two damped."""
    folded = fold(text)
    found = hits(folded, automaton)
    weight = sum(w for _, w in found.values())
    return len(found), float(np.log1p(weight)), float(np.log1p(100 * weight / max(1, folded.count(" ") - 1)))


def _scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Adds hits, weight, density of each whole text."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = lexicon.automaton()
        for rows in batches:
            made = [evidence(t, automaton) for t in rows.pop("text")]
            yield rows.assign(hits=[m[0] for m in made], weight=[m[1] for m in made], density=[m[2] for m in made])

    kept = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return docs.mapInPandas(work, f"{schema}, hits long, weight double, density double")


def _tally(sample: DataFrame, terms: Callable[[str], set[str]]) -> DataFrame:
    """term, toxic, clean: in how many documents of each kind a term is.  sample: toxic, text."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = list(terms(text))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([toxic] * len(found), pa.int64())],
                                                 names=["term", "toxic"])

    made = sample.select("toxic", "text").mapInArrow(work, "term string, toxic long")
    return made.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))


def _candidates(sample: DataFrame) -> DataFrame:
    """The tally of words and word beginnings."""
    def terms(text: str) -> set[str]:
        whole = set(fold(text).split())
        return {f" {w} " for w in whole} | {f" {w[:k]}" for w in whole for k in PREFIXES if len(w) > k}

    return _tally(sample, terms)


def _prune(terms: pd.DataFrame) -> dict[str, float]:
    """One term for each family of beginnings: the longest that loses nearly none of the shorter one's documents."""
    weight, docs = dict(zip(terms.term, terms.weight)), dict(zip(terms.term, terms.toxic))
    best_child: dict[str, float] = {}
    for term, n in docs.items():
        for k in range(3, len(term)):
            best_child[term[:k]] = max(best_child.get(term[:k], 0), n)
    kept: dict[str, float] = {}
    for term in sorted(docs, key=len):
        if best_child.get(term, 0) >= 0.95 * docs[term]:
            continue
        if any(term[:k] in kept and weight[term] <= kept[term[:k]] + 0.7 for k in range(3, len(term))):
            continue
        kept[term] = weight[term]
    return kept


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Newton steps of a ridge logistic regression with an intercept."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Lexicon:
    """Lexicon from labelled documents.  docs: doc_id, text; labels: doc_id, toxic (0 or 1).

    Terms come from one half of the documents, the scale from the other half.  Without labels of both kinds the lexicon
    is empty and the score is the share of toxic labels.
    """
    one = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    sample = keep(docs.join(F.broadcast(chosen), "doc_id").dropDuplicates(["text"]).select(
        "toxic", "text", (F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)) == 0).alias("first")), "toxic-sample")
    totals = {bool(r["toxic"]): r["n"] for r in sample.where("first").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    t, c = totals.get(True, 0), totals.get(False, 0)
    weight = F.log((F.col("toxic") + 0.5) / (t + 1.0)) - F.log((F.col("clean") + 0.5) / (c + 1.0))
    strong = _candidates(sample.where("first").select("toxic", "text")).withColumn("weight", weight).where(
        (F.col("toxic") >= max(LEAST_DOCS, LEAST_SHARE * t)) & (F.col("weight") >= float(np.log(LEAST_RATIO))))
    lexicon = Lexicon(_prune(strong.orderBy(F.desc(F.col("weight") * F.col("toxic")), "term").limit(TERMS).toPandas()), [])
    lexicon.phrases = _exceptions(sample.where("first"), lexicon)
    rest = _scored(sample.where("NOT first").select("toxic", "text"), lexicon).toPandas()
    if rest["toxic"].nunique() == 2:
        lexicon.scale = tuple(_logistic(rest[["weight", "density"]].to_numpy(), rest["toxic"].to_numpy(float)))
    else:
        lexicon.scale = (float(np.log((t + 0.5) / (c + 0.5))), 1.0, 0.5)
    return lexicon


def _exceptions(sample: DataFrame, lexicon: Lexicon) -> list[str]:
    """Pairs of a matched word and a neighbour that are in clean documents rather than toxic ones."""
    automaton: list[ahocorasick.Automaton] = []

    def pairs(text: str) -> set[str]:
        if not automaton:
            automaton.append(lexicon.automaton())
        folded, found = fold(text), set()
        for at in hits(folded, automaton[0]):
            stop = folded.index(" ", at + 1)
            before, after = folded.rfind(" ", 0, at), folded.find(" ", stop + 1)
            found |= {folded[before:stop + 1]} if before >= 0 else set()
            found |= {folded[at:after + 1]} if after >= 0 else set()
        return found

    counts = _tally(sample, pairs)
    clean = counts.where("clean >= 3 AND clean > 4 * toxic").orderBy(F.desc("clean"), "term").limit(TERMS)
    return [r["term"] for r in clean.collect()]


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """Adds hits, score (0 to 1) and predicted to doc_id, text and further columns of ``docs``; the text is dropped."""
    bias, by_weight, by_density = map(float, lexicon.scale)
    z = F.lit(bias) + F.lit(by_weight) * F.col("weight") + F.lit(by_density) * F.col("density")
    out = _scored(docs, lexicon).withColumn("score", 1 / (1 + F.exp(-z)))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int")).drop("weight", "density")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held_fold: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted, hits of each document; documents of one fold are never learned from.

    Null and empty texts score like a text without matches; null ids are scored and not learned from; of contradicting
    labels toxic holds; repeated rows are scored each; an empty table gives no rows; other columns are ignored.
    """
    held = bucket("doc_id", folds) == held_fold
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(~held)
    lexicon = learn(rows, given)
    return score(rows.withColumn("held_out", held), lexicon).select("doc_id", "held_out", "score", "predicted", "hits")
