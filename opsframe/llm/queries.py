"""The operators as queries over the given tables, with SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.llm import (divergence, exact_dedup, language, lexical, licenses, mixing, mixing_lm, neighbours, quality,
                          sentencepiece_lattice, simhash, token_counts, toxicity)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op1_exact_dedup", r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS bare FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(bare) AS text_sha256
FROM t WINDOW w AS (PARTITION BY bare ORDER BY points DESC, doc_id)""")
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


@query("op2_mixing", r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight,
             source_size * 2.0::DOUBLE AS most FROM s),
f AS (SELECT *, coalesce(sum(most) OVER b, 0) AS capped, coalesce(sum(weight) OVER b, 0) AS gone,
             sum(weight) OVER () AS all_weight, sum(source_size) OVER () * 1.5::DOUBLE AS total
      FROM w WINDOW b AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, (total - capped) / (all_weight - gone) AS given FROM f),
h AS (SELECT *, most <= given * weight AS is_full FROM g),
t AS (SELECT source, source_size, CASE WHEN is_full THEN most ELSE weight *
             (SELECT given FROM h WHERE NOT is_full ORDER BY most / weight LIMIT 1) END AS target FROM h),
k AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
             floor(sqrt(size)) AS class, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % 64 AS salt
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, salt, size, doc_id) AS place FROM k)
SELECT doc_id, source, size, source_size, target,
       (floor(place * rate + 0.905639676174521) - floor((place - 1) * rate + 0.905639676174521))::BIGINT AS copies,
       ((floor(place * rate + 0.905639676174521) - floor((place - 1) * rate + 0.905639676174521)) * size)::BIGINT AS taken
FROM n""")
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


@query("op3_simhash")
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(documents(spark, sf_dir))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


@query("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.quality(documents(spark, sf_dir), labels(spark, sf_dir))
    return scored.select("doc_id", "held_out", "host", "path", "evidence", "host_posterior", "path_posterior", "quality", "kept")


@query("op6_language")
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.languages(documents(spark, sf_dir))
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


@query("op7_licenses", licenses.twin_sql())
def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(documents(spark, sf_dir))
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), F.array_join("sentence_ids", ",").alias("sentence_ids"))


@query("op9_vectors")
def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op10_context_mixing")
def op10_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_lm.score(documents(spark, sf_dir))


@query("op8_sentencepiece")
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_lattice.encode(documents(spark, sf_dir))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op11_block_max_search", rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT doc_id, terms, len(terms) AS n FROM d WHERE len(terms) > 0),
g AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS all_terms FROM t),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM t) GROUP BY doc_id, n, term),
f AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY term, n_docs),
q AS (SELECT item_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // all_terms))))::BIGINT AS score
      FROM q JOIN f USING (term) JOIN p USING (term), g GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 20""")
def op11_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op12_token_counts")
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir))


@query("op13_source_divergence", rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM d) GROUP BY lang, term HAVING count(*) >= 10),
v AS (SELECT lang, count(*) AS kinds FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM d) JOIN kept USING (lang, term)
      GROUP BY lang, source, term),
g AS (SELECT lang, source, coalesce(sum(n), 0)::BIGINT AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source)
      GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (total + 2 * kinds) AS p
      FROM g JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
l AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 2)) // (any_value(all_n) + 2 * any_value(kinds)) AS q
      FROM c JOIN v USING (lang) JOIN (SELECT lang, sum(total) AS all_n FROM g GROUP BY lang) USING (lang) GROUP BY lang, term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
own AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value
        FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
      FROM (SELECT * FROM pair UNION ALL SELECT * FROM own))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10""")
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))
