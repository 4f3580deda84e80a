"""Quality by hierarchical empirical Bayes: a document's own evidence, shrunk site and path posteriors, global prior.

A document's evidence is the sum of log likelihood ratios of its binned features, counted from labelled documents.  The
expected number of good documents of a site is shrunk toward the global prior, that of a path toward its site's
posterior; how strongly follows from how much sites (paths) differ from each other beyond chance.  Everything is grouped
aggregation, combined before shuffling, so a site with a third of all documents is one small row per task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.functions.text import named
from opsframe.llm.common import BLANKS, bucket, keep, own_names, small_side

#: Upper limits of the bins of each feature (the last bin is open).
BINS = {
    "length": (0, 5, 20, 60, 200, 1000, 5000),
    "signs": (0.0, 0.01, 0.02, 0.04, 0.08, 0.15, 0.3),
    "capitals": (0.02, 0.05, 0.1, 0.2, 0.4, 0.7),
    "digits": (0.0, 0.01, 0.03, 0.08, 0.2, 0.5),
    "distinct": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8),
    "repeats": (0.0, 0.01, 0.03, 0.1, 0.3, 0.6),
    "word_length": (2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 9.0, 12.0),
    "lone_signs": (0.0, 0.01, 0.03, 0.1, 0.2),
}
#: Most that a single feature, and all together, may weigh in log odds.
FEATURE_MOST, EVIDENCE_MOST = 4.0, 12.0
#: Documents whose posterior is at least this are kept.
THRESHOLD = 0.4


def measures(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds ``_m``, the measures of a whole text (null counts as empty), in the order of BINS."""
    text, words = F.col("_text"), F.col("_words")
    count, chars = F.greatest(F.size(words), F.lit(1)), F.greatest(F.length(text), F.lit(1))

    def share(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)) / chars

    followed = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: a == b)
    made = [F.size(words), share(r"[^\p{L}\p{M}\p{N}\s.,;:'’\-()?\"]"), share(r"\p{Lu}"), share(r"\p{Nd}"),
            F.size(F.array_distinct(words)) / count, F.size(F.filter(followed, lambda same: same)) / count, chars / count,
            F.size(F.filter(words, lambda w: w.isin("|", "-", "*", "#", "=", "~", "_"))) / count]
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn("_text", text).withColumn("_words", F.filter(F.split("_text", BLANKS), lambda w: w != "")).withColumn(
        "_m", F.array(*[m.cast("double") for m in made])).drop("_text", "_words")


def binned(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``bins``: for every feature the number of the bin its measure falls in."""
    bins = []
    for i, limits in enumerate(BINS.values()):
        bins.append(sum((F.col("_m")[i] > x).cast("int") for x in limits))
    return measures(docs, text_col).withColumn("bins", F.array(*bins)).drop("_m")


def likelihoods(rows: DataFrame, smooth: float = 2.0) -> list[list[float]]:
    """Log likelihood ratio of every bin of every feature.  rows: bins, good (0 or 1).  A table of fixed size."""
    each = rows.select("good", F.posexplode("bins").alias("feature", "bin"))
    counts = {(r["feature"], r["bin"], r["good"]): r["n"] for r in
              each.groupBy("feature", "bin", F.col("good").cast("int").alias("good")).agg(F.count("*").alias("n")).collect()}
    totals = [sum(n for (f, _, g), n in counts.items() if f == 0 and g == kind) for kind in (0, 1)]
    out = []
    for f, limits in enumerate(BINS.values()):
        share = sum(totals) + 2.0
        line = []
        for b in range(len(limits) + 1):
            bad, good = (counts.get((f, b, kind), 0) + smooth * (totals[kind] + 1.0) / share for kind in (0, 1))
            ratio = math.log(good / (totals[1] + 1.0)) - math.log(bad / (totals[0] + 1.0))
            line.append(max(-FEATURE_MOST, min(FEATURE_MOST, ratio)))
        out.append(line)
    return out


def evidence(bins: Column, ratios: list[list[float]]) -> Column:
    """Sum of the ratios of a document's bins, within EVIDENCE_MOST."""
    total = F.lit(0.0)
    for f, line in enumerate(ratios):
        total = total + F.element_at(F.array(*map(F.lit, line)), F.element_at(bins, f + 1) + 1)
    return F.greatest(F.least(total, F.lit(EVIDENCE_MOST)), F.lit(-EVIDENCE_MOST))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _logit(p: Column) -> Column:
    return F.log(p) - F.log1p(-p)


def _strength(groups: DataFrame, mean: str) -> float:
    """Pseudo-count of a prior by moments: how much group means differ from ``mean`` beyond what their size explains."""
    spread = F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.col(mean), 2))
    chance = F.sum(F.col(mean) * (1 - F.col(mean)))
    r = groups.where("n > 0").select(spread.alias("spread"), chance.alias("chance"), F.sum("n").alias("n"), F.count("*").alias("k"),
                                     F.sum(F.col("n") * F.col("n")).alias("nn"),
                                     F.avg(F.col(mean) * (1 - F.col(mean))).alias("unit")).first()
    if not r["k"] or r["k"] < 2 or not r["unit"]:
        return 100.0
    between = max(0.0, r["spread"] - r["chance"]) / r["n"]
    return max(2.0, min(10_000.0, r["unit"] / between - 1 if between > 0 else 10_000.0))


def site_posteriors(rows: DataFrame) -> tuple[DataFrame, float]:
    """host, path, host_posterior, path_posterior, and the global prior.  rows: host, path, p (a document's probability)."""
    paths = keep(rows.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum("p").alias("good")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    overall = hosts.select(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    prior = (overall["good"] + 1.0) / (overall["n"] + 2.0) if overall["n"] else 0.5
    hosts = hosts.withColumn("prior", F.lit(prior))
    by_host = _strength(hosts, "prior")
    hosts = hosts.withColumn("host_posterior", (F.col("good") + by_host * F.col("prior")) / (F.col("n") + by_host))
    held = hosts.select(F.col("host").alias("_host"), "host_posterior")
    joined = paths.join(held, F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    by_path = _strength(joined, "host_posterior")
    post = (F.col("good") + by_path * F.col("host_posterior")) / (F.col("n") + by_path)
    return joined.select("host", "path", "host_posterior", post.alias("path_posterior")), prior


def quality(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, folds: int = 5,
            held_fold: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` with host_posterior, path_posterior, evidence, quality (0 to 1), kept and held_out.

    ``host`` is the site (the source if not given), ``path`` a part of it (the language).  Documents of one fold are
    never learned from.  A null or empty text is one with no words; null hosts and paths are a site and a path of their
    own; null ids are scored and not learned from; contradicting labels count as bad; without labels of both kinds the
    evidence is nothing and only priors speak; repeated rows are scored each; an empty table gives no rows.
    Existing columns of the names above are replaced; all others stay as they are, whatever their names.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    sited = docs.select("*", host.cast("string").alias("host of it"), path.cast("string").alias("path of it"))
    plain = own_names(sited, ["doc_id", "text"])
    plain = plain.toDF(*plain.columns[:-2], "host", "path")
    given = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("good"))
    names = ["host", "path", "host_posterior", "path_posterior", "evidence", "quality", "kept", "held_out"]
    scored = binned(plain.withColumn("held_out", bucket("doc_id", folds) == held_fold))
    narrow = keep(scored.select("doc_id", "host", "path", "held_out", "bins"), "bins")
    train = narrow.where(~F.col("held_out")).join(given, F.col("doc_id") == F.col("_id")).select("bins", "good")
    ratios = likelihoods(train)
    rate = train.agg(F.avg("good").alias("p"), F.count("*").alias("n")).first()
    start = min(0.99, max(0.01, ((rate["p"] or 0.0) * rate["n"] + 1.0) / (rate["n"] + 2.0)))
    said = evidence(F.col("bins"), ratios)
    sites, prior = site_posteriors(narrow.select("host", "path", _sigmoid(said + _logit(F.lit(start))).alias("p")))
    sites = keep(sites, "sites")
    known = small_side(sites.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "host_posterior", "path_posterior"), sites.count())
    out = scored.withColumn("evidence", said).join(
        known, F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p")), "left")
    score = _sigmoid(F.col("evidence") + _logit(F.col("path_posterior")))
    out = out.withColumn("quality", score).withColumn("kept", F.col("quality") >= threshold)
    kept = [named(c).alias(given) for c, given in zip(plain.columns, docs.columns) if given not in names]
    return out.select(*kept, *names)
