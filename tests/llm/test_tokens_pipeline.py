"""SentencePiece ids against the library, and the pipeline's stages."""

import random
import re

import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from opsframe.llm import queries, sentencepiece_lattice as lattice

TEXTS = ["hello world", " a  b", "", None, "\n", "a\tb ", "日本🙂x", "  ", "ﬁ Ⅷ", "x" * 700, "ab" * 400, "def f(x):\n    return x**2\n\n\n",
         "a\r\n();\r\n", "    " * 9 + "z", "word " * 3000, "internationalization antidisestablishmentarianism"]


def test_ids_equal_the_library(spark, docs):
    rng = random.Random(7)
    texts = TEXTS + ["".join(rng.choice("etaoinshrdlu  ,.ENé\n") for _ in range(80)) for _ in range(300)]
    texts += [r.text for r in queries.documents(spark, "/root/testdata/sf0.001").orderBy("doc_id").limit(40).collect()]
    library = sentencepiece.SentencePieceProcessor(model_file=lattice.MODEL)
    rows = list(enumerate(texts)) + [(None, "no id"), (5, "same id"), (5, "same id")]
    got = lattice.encode(docs(rows), chunk=20_000).collect()
    want = sorted((str(i), library.encode(t or "")) for i, t in rows)
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == want
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in got)


def test_words_of_any_length(docs):
    rng = random.Random(3)
    library = sentencepiece.SentencePieceProcessor(model_file=lattice.MODEL)
    texts = ["".join(rng.choice("etaoinshrdlucmfw") for _ in range(n)) for n in (511, 513, 3000, 100_000)] + ["a" * 20_000, "=" * 5000 + "ab" * 9000]
    got = {r.doc_id: r for r in lattice.encode(docs(list(enumerate(texts)))).collect()}
    assert all(list(got[i].ids) == library.encode(t) and got[i].round_trip for i, t in enumerate(texts))


def test_words_of_many_texts_are_those_of_each():
    pieces, rng = lattice.load_pieces(), random.Random(1)
    words, blank = lattice.Words(pieces), lattice.BLANK
    texts = ["", "\n\n", "a \nb", "a▁b", "日本🙂x", " a ", *("".join(rng.choice("etao  ,.▁E日🙂\n") for _ in range(rng.randrange(40))) for _ in range(500))]
    for column in (pa.array(texts), pa.array(["before", *texts]).slice(1), pa.array(["", ""]), pa.array([], pa.string())):
        found, n = words.listed(column)
        want = [re.findall(f"\n[^{blank}\n]*|{blank}+[^{blank}\n]*", blank + t.replace(" ", blank) if t else "") for t in column.to_pylist()]
        assert n.tolist() == [len(w) for w in want]
        assert [w.replace(" ", blank) for w in found.to_pylist()] == [w for own in want for w in own]
        parts, n = words.parts(found.dictionary)
        cuts = []
        for w in found.dictionary.to_pylist():
            w = w.replace(" ", blank)
            cuts.append("".join(c if i == 0 or w[i - 1:i + 1] in pieces.pairs else "\0" + c for i, c in enumerate(w)).split("\0"))
        assert n.tolist() == [len(c) for c in cuts] and parts.to_pylist() == [p for c in cuts for p in c]


def test_decode(spark):
    pieces = lattice.load_pieces()
    library = sentencepiece.SentencePieceProcessor(model_file=lattice.MODEL)
    texts = [t for t in TEXTS if t is not None]
    df = spark.createDataFrame([(i, library.encode(t), "x") for i, t in enumerate(texts)] + [(99, None, "x")], "i long, ids array<int>, text string")
    got = {r.i: r.text for r in lattice.decode(df, pieces).collect()}
    assert [got[i] for i in range(len(texts))] == texts and got[99] is None


def test_empty_table(spark):
    assert lattice.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_unknown_blank_does_not_round_trip(docs):
    assert not lattice.encode(docs([(1, "a▁b")])).first().round_trip


@pytest.fixture(scope="module")
def sf():
    return "/root/testdata/sf0.001"


def test_stages_keep_columns_and_decide(spark, sf):
    docs = queries.documents(spark, sf)
    extra = docs.limit(0)
    for i, (text, n) in enumerate([("a copied text of some words", 3), ("another one here " * 3, 2)]):
        for k in range(n):
            extra = extra.union(spark.range(1).select((F.lit(10_000 + 10 * i + k)).alias("doc_id"), F.lit(text + " " * k).alias("text"),
                                                      F.lit("en").alias("lang"), F.lit("src1").alias("source"), F.lit(1).cast("long").alias("n_chars")))
    odd = spark.createDataFrame([(None, "no id at all", "en", "s", 1), (None, "no id at all", "en", "s", 1), (5, None, None, None, None),
                                 (5, None, None, None, None)], docs.schema)
    exact = corpus_pipeline.exact_copies(spark, docs.union(extra).union(odd), sf)
    assert exact.columns == docs.columns
    rows = exact.collect()
    bare = ["".join((r.text or "").split()) for r in rows]
    assert len(set(bare)) == len(bare)
    assert set(bare) == {"".join((r.text or "").split()) for r in docs.union(extra).union(odd).collect()}
    assert {r.doc_id for r in rows if r.doc_id and r.doc_id >= 10_000} == {10_002, 10_011}  # the longest original stays
    near = corpus_pipeline.near_copies(spark, exact, sf)
    assert near.columns == docs.columns and near.count() <= len(rows)
    good = corpus_pipeline.good_quality(spark, docs, sf)
    assert good.columns == docs.columns and 0 < good.count() < docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "simhash", "mixing", "sentencepiece"]


def test_stages_keep_columns_of_any_name(spark, sf):
    """Names the operators use themselves, dots, and no ids at all."""
    docs = queries.documents(spark, sf)
    names = ["_id", "_rows", "_all", "_h", "_p", "host", "path", "bins", "a.b", "kept", "quality", "_text", "_sha", "_turn", "copies", "held_out", "size"]
    odd = spark.createDataFrame([(None, "no id at all", "en", "s", 1)] * 3 + [(5, None, None, None, None)] * 2, docs.schema)
    wide = docs.union(odd).select("*", *[F.lit(f"own {n}").alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, wide, sf)
        assert got.columns == wide.columns, name
        first = got.first()
        assert [first[n] for n in names] == [f"own {n}" for n in names] and got.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, wide, sf).count() == wide.count()


def test_stages_take_empty_tables(spark, sf):
    docs = queries.documents(spark, sf).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_run(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "ids", "n_pieces", "round_trip"] and got.where("NOT round_trip").count() == 0
    assert got.count() > 0
