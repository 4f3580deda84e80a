"""A corpus made ready for training: classified, deduplicated exactly and nearly, mixed to weights, and encoded.

Every stage takes the documents its predecessor kept and returns documents (the last: piece ids).  Decisions travel as
narrow tables of ids; texts are not shuffled for them while these tables are within the counted broadcast bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.functions.text import named
from opsframe.llm import exact_dedup, mixing, quality, sentencepiece_lattice, simhash
from opsframe.llm.common import keep, own_names, small_side

#: SQL cannot say the classifier, the fingerprints or the piece lattice; the tests check stages against brute force.
ORACLE_SQL = None


def _stage(work):
    """A stage over columns whose names clash with nothing inside it; the names are given back at its end."""
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return work(spark, own_names(docs, ["doc_id", "text", "lang", "source"]), sf_dir).toDF(*docs.columns)

    stage.__name__, stage.__doc__ = work.__name__, work.__doc__
    return stage


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Documents whose id is not among ``dropped`` (a written table); rows without an id stay."""
    ids = dropped.select("doc_id").distinct()
    return docs.join(small_side(ids, dropped.count()), "doc_id", "left_anti").select(*docs.columns)


@_stage
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose posterior quality is below the classifier's threshold.

    A null or empty text is one without words; null sources and languages are a site and a path of their own; repeated rows
    are judged each; an empty table stays empty; columns keep their names, whatever they are; texts of any length are
    measured whole.
    """
    scored = quality.quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("kept").select(*[named(c) for c in docs.columns])


@_stage
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays.  Rows that share an id, or have none, are told apart by text.

    Null counts as empty, so one empty document stays; an empty table stays empty; columns keep their names; the longest
    text stays, then the smallest id, and of rows that are equal in both any one.
    """
    groups = keep(exact_dedup.exact_groups(docs), "exact-groups")
    out = _without(docs, keep(groups.where("NOT kept").select("doc_id"), "exact-dropped"))
    odd = keep(groups.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").select("doc_id"), "odd-ids")
    count = odd.count()
    if not count:
        return out
    columns = [named(c) for c in docs.columns]
    side = small_side(odd.withColumnRenamed("doc_id", "_id"), count)
    odd_row = F.col("doc_id").eqNullSafe(F.col("_id"))
    marked = out.join(side, odd_row, "left_semi").withColumn("_sha", F.sha2(exact_dedup.bare(F.col("text")), 256))
    kept = groups.where("kept").select(F.col("text_sha256").alias("_sha"), F.col("doc_id").alias("_id")).distinct()
    one = marked.join(kept, ["_sha"]).where(odd_row).dropDuplicates(["_sha"])
    return out.join(side, odd_row, "left_anti").select(*columns).unionByName(one.select(*columns))


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of linked fingerprints stays; rows without an id stay.

    Null and empty texts share the fingerprint zero; an empty table stays empty; columns keep their names; long texts are
    fingerprinted whole.
    """
    groups = simhash.simhash_groups(docs)
    return _without(docs, keep(groups.where("doc_id <> component_id").select("doc_id"), "near-dropped"))


@_stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A text without words counts nothing and may come any number of times; null sources are one source; rows that share an
    id, or have none, are taken evenly; an empty table stays empty; columns keep their names.
    """
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, null and empty texts without any, repeated rows each, texts of any length whole."""
    return sentencepiece_lattice.encode(docs)


STAGES = [("quality", good_quality), ("exact_dedup", exact_copies), ("simhash", near_copies), ("mixing", mixed),
          ("sentencepiece", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
