"""Scorers and scans: held-out accuracy on the given tables, brute force and edge cases on small ones."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from opsframe.llm import language, licenses, mixing, mixing_lm, quality, queries, toxicity

SF = "/root/testdata/sf0.01"
ODD = [(1, None, None, None), (2, "", "en", "a"), (3, " \n", "en", None), (None, "word " * 5, "de", "a"), (4, "x" * 100_000, "en", "b"),
       (5, "1234 ... 99", "en", "b"), (5, "1234 ... 99", "en", "b"), (6, "Привет мир", "en", "c")]


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_fold_undoes_disguises():
    assert toxicity.fold("You 1D10T, scυm!  st​upid$$$ lоsеr 2001") == " you idiot scum stupid loser 2001 "
    assert toxicity.fold(None) == "  "


def test_matches_and_exceptions():
    lexicon = toxicity.Lexicon({" clown ": 4.0, " vequ": 3.0}, [" clown fish "])
    automaton = lexicon.automaton()
    found = toxicity.hits(toxicity.fold("A clown fish and a cl0wn, vequette; unvequ clowns"), automaton)
    assert sorted(found.values()) == [(" clown ", 4.0), (" vequ", 3.0)]
    assert toxicity.hits(toxicity.fold("calm"), toxicity.Lexicon({}, []).automaton()) == {}


def test_toxicity_held_out(spark):
    got = {r.doc_id: r for r in queries.op4_toxicity(spark, "/root/testdata/sf0.1").collect()}
    given = {r.doc_id: r.toxic for r in queries.labels(spark, "/root/testdata/sf0.1").collect()}
    held = [(r, given[i]) for i, r in got.items() if r.held_out and i in given]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    hit = sum(r.predicted for r, y in held if y)
    assert hit >= 0.8 * sum(y for _, y in held) and hit >= 0.9 * sum(r.predicted for r, _ in held)


def test_scorers_take_odd_rows(spark, docs):
    table = docs(ODD)
    some = labels(spark, [(1, 0, 1), (1, 1, 0), (4, None, None), (None, 1, 1), (77, 1, 1)])
    none = labels(spark, [])
    for given in (some, none):
        assert len(toxicity.toxicity(table, given).collect()) == len(ODD)
        scored = quality.quality(table, given).collect()
        assert len(scored) == len(ODD) and all(0 < r.quality < 1 and r.key == 7 for r in scored)
    empty = table.limit(0)
    assert toxicity.toxicity(empty, some).count() == quality.quality(empty, some).count() == language.languages(empty).count() == 0
    assert mixing_lm.score(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_quality_held_out(spark):
    got = {r.doc_id: r for r in queries.op5_quality(spark, "/root/testdata/sf0.1").collect()}
    given = {r.doc_id: r.quality for r in queries.labels(spark, "/root/testdata/sf0.1").collect()}
    held = [(r.kept, given[i]) for i, r in got.items() if r.held_out and i in given]
    assert sum(k == bool(y) for k, y in held) >= 0.97 * len(held)
    assert sum(k for k, y in held if y) >= 0.98 * sum(y for _, y in held)


def test_sites_shrink_toward_priors(spark):
    rows = [("big", "p", 0.9)] * 400 + [("bad", "p", 0.1)] * 400 + [("bad", "q", 0.9)] + [("new", "p", 0.1)]
    sites, prior = quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double"))
    got = {(r.host, r.path): r for r in sites.collect()}
    assert got["big", "p"].host_posterior > 0.85 and got["bad", "p"].host_posterior < 0.15
    assert got["new", "p"].host_posterior > 0.2  # one document says little
    assert got["bad", "q"].path_posterior < 0.6  # and a path starts from its site
    assert 0.4 < prior < 0.6


def test_language_held_out(spark):
    got = queries.op6_language(spark, SF).collect()
    given = {r.doc_id: r.lang for r in queries.documents(spark, SF).select("doc_id", "lang").collect()}
    held = [(r.lang_pred, given[r.doc_id]) for r in got if r.held_out and given[r.doc_id]]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)


def test_language_edge_cases(docs):
    rows = {(r.doc_id, r.lang_pred, r.score) for r in language.languages(docs(ODD + [(i, "the cat sat on the mat", "en", "a") for i in range(20, 60)])).collect()}
    assert {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0), (5, "und", 0.0)} <= rows
    assert all(r.lang_pred == "und" for r in language.languages(docs([(3, "abc")])).collect())


def test_spans_match_the_full_walk():
    rng = np.random.default_rng(2)
    for _ in range(40):
        sizes = rng.integers(1, 30, 6)
        scores = rng.normal(size=(sizes.sum(), 3)).astype(np.float32) * 4
        owner = np.repeat(np.arange(6), sizes)
        got = language.label_words(scores, owner, 6, 5.0)
        for j in range(6):
            own = scores[owner == j].astype(float)
            value = lambda path: own[np.arange(len(own)), path].sum() - 5.0 * (np.diff(path) != 0).sum()
            assert value(got[owner == j]) == pytest.approx(value(language.best_path(own, 5.0)), abs=1e-3)


def test_two_stretches_share_one_penalty():
    """Neither stretch gains a penalty over the best language throughout (the third), but both together do."""
    scores = np.array([[5, -6, 0]] * 2 + [[-6, 5, 0]] * 2, np.float32)
    assert language.label_words(scores, np.zeros(4, int), 1, 12.0).tolist() == language.best_path(scores, 12.0).tolist() == [0, 0, 1, 1]


def test_mixed_text_has_two_spans(spark, docs):
    en, de = "the house and the garden with that thing ", "der hund und die katze mit einem ding "
    train = [(i, en * 5, "en", "a") for i in range(10, 40)] + [(i, de * 5, "de", "a") for i in range(40, 70)]
    got = [r for r in language.languages(docs(train + [(999, en * 4 + de * 3, None, "a")])).collect() if r.doc_id == 999][0]
    assert [s.lang for s in got.spans] == ["en", "de"] and got.lang_pred == "en" and got.spans[0].last == 31


def test_licenses(docs):
    s = licenses.SENTENCES
    rows = [(1, "Intro. Released under the MIT License."), (2, s["bsd_grant"] + ":\n" + s["bsd_source"] + ".\n" + s["bsd_binary"] + ".\n" + s["bsd_names"] + "."),
            (3, s["bsd_grant"] + ".\nforeign one.\n" + s["bsd_source"] + ". x. y. z! " + s["bsd_binary"] + "."), (4, None), (5, ""), (6, "unlicensed"),
            (7, s["gpl_free"] + ": " + s["gpl3_terms"] + "."), (8, s["gpl3_terms"] + ". " + s["gpl_free"] + "."), (8, "all RIGHTS  reserved"),
            (9, s["bsd_grant"] + ".\nforeign.\n" + s["bsd_source"] + ". x. " + s["bsd_binary"] + "."), (10, "word " * 100_000 + ". Licensed under the Apache License, Version 2.0.")]
    got = sorted((r.doc_id, list(r.licenses), r.key) for r in licenses.scan(docs(rows)).collect())
    assert got == [(1, ["MIT"], 7), (2, ["BSD-3-Clause"], 7), (3, [], 7), (4, [], 7), (5, [], 7), (6, [], 7), (7, ["GPL-3.0"], 7), (8, [], 7),
                   (8, ["all-rights-reserved"], 7), (9, ["BSD-2-Clause"], 7), (10, ["Apache-2.0"], 7)]


def targets_by_hand(sizes):
    weights = dict(zip(sorted(sizes, key=lambda s: (s is None, s)), [5, 2, 1] * len(sizes)))
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        open_ = [s for s in sizes if s not in capped]
        level = (total - sum(2 * sizes[s] for s in capped)) / max(sum(weights[s] for s in open_), 1e-9)
        over = {s for s in open_ if level * weights[s] > 2 * sizes[s]}
        if not over:
            return {s: 2 * sizes[s] if s in capped else level * weights[s] for s in sizes}
        capped |= over


def test_mix(docs):
    rng = np.random.default_rng(4)
    rows = [(i, "w " * int(rng.integers(0, 60)), None, [None, "a", "b", "c", "d", "e"][min(5, int(rng.integers(0, 12)))]) for i in range(2000)]
    rows += [(None, "w w", None, "a"), (7, None, None, "zz"), (7, None, None, "zz"), (8, "a b c", None, "d")]
    got = mixing.mix(docs(rows)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs(rows)).collect()), key=str)
    sizes, taken = {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.taken == r.copies * r.size <= 2 * r.size
    want = targets_by_hand(sizes)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
    assert len(got) == len(rows)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(70, 0.02 * want[s])
    full = mixing.mixed_documents(docs(rows))
    assert full.columns == docs(rows).columns and full.count() == sum(r.copies for r in got)


def test_copies_are_proportional_to_expectation(spark):
    """Each row is emitted floor or ceil of its expectation, and any run of rows as often as expected, within one."""
    rng = np.random.default_rng(6)
    e = np.round(rng.random(3000) * 2.5, 6)
    df = spark.createDataFrame([(i, "g", float(x)) for i, x in enumerate(e)], "i long, g string, e double").repartition(4)
    from pyspark.sql import functions as F
    got = {r.i: r.copies for r in mixing.systematic_copies(df, "g", "e", ["i"], [F.floor(F.col("i") / 100)]).collect()}
    copies = np.array([got[i] for i in range(3000)])
    assert ((copies == np.floor(e)) | (copies == np.ceil(e))).all()
    assert np.abs(np.cumsum(copies) - np.cumsum(e)).max() <= 1.0 + 1e-6


def test_language_model(spark, docs):
    words = ["alpha", "beta", "gamma", "delta", "Épsilon", "zeta,"]
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(words, 40))) for i in range(300)] + [(1000, None), (1001, ""), (1002, "the the the the " * 500),
                                                                    (None, "alpha ALPHA"), (1003, "new \x00 words"), (1003, "new \x00 words")]
    got = mixing_lm.score(docs(rows), chunk=4000).collect()
    assert len(got) == len(rows)
    toks = lambda t: (t or "").encode().lower().split()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts, ends = {}, 0
    for i, t in rows:
        if not held(i):
            ends += 1
            for w in toks(t):
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    by_id = dict(rows)
    for r in got:
        c = [counts.get(w, 0) for w in toks(by_id[r.doc_id])] + [ends]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(c), sum(x > 0 for x in c), n, held(r.doc_id))
        assert r.base_score == pytest.approx(sum(math.log10((x + 1) / (n + v + 1)) for x in c))
        assert r.score < 0 and r.bits_per_byte > 0
    repeated = [r for r in got if r.doc_id == 1002][0]
    assert repeated.score > 0.5 * repeated.base_score  # recency takes over


def test_model_is_a_probability():
    """The costs of all bytes after a prefix sum to one, in each sharpening, for the binary walks of one tree."""
    rng = np.random.default_rng(0)
    codes = mixing_lm.make_codes(rng.integers(0, 50, (256, 256)) * (rng.random((256, 256)) < 0.1))
    kraft = np.exp2(-codes.length.reshape(256, 256).astype(float)).sum(axis=1)
    assert np.allclose(kraft, 1) and codes.length.max() <= mixing_lm.DEEPEST
    zeros, ones = rng.integers(0, 9, (2, int(mixing_lm.STARTS[-1]))).astype(np.float32)
    model = mixing_lm.make_model(codes, zeros, ones, [b"ab", b"abc"] * 50)
    first = np.exp(-model.costs([bytes([b]) for b in range(1, 256) if b != 10]))
    assert (first[:, 1] > 0).all() and first[:, 1].sum() < 1


def test_recency_counts_only_the_past():
    assert mixing_lm.adapt(np.array([[700.0, 700.0, 0.0, 700.0]]), np.array([1]))[0] == pytest.approx(-math.log(0.75))


def test_mixing_weights_learn_from_all_texts(spark, docs, monkeypatch):
    """Texts of more than 20,000 letters set the weights too."""
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(words, 4000))) for i in range(40)]
    made, train = [], mixing_lm.train
    monkeypatch.setattr(mixing_lm, "train", lambda *given: made.append(train(*given)) or made[-1])
    mixing_lm.score(docs(rows))
    begin = np.full(made[0].weights.shape, 0.3)
    begin[:, :, 4] = 0
    assert (np.abs(made[0].weights - begin).max(axis=2) > 0.01).sum() >= 5


def test_mixing_weights_are_of_least_loss():
    """Occurrences weigh as repeated tokens do, and no move of one weight lowers the loss."""
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcd"), 4)).encode() for _ in range(60)]
    counts = rng.integers(1, 9, len(words))
    codes = mixing_lm.make_codes(rng.integers(0, 50, (256, 256)))
    zeros, ones = rng.integers(0, 9, (2, int(mixing_lm.STARTS[-1]))).astype(np.float32)
    sums = lambda w: mixing_lm.fit_sums(codes, zeros, ones, w, words, counts)
    weights = mixing_lm.fit(sums)
    every = mixing_lm.fit_sums(codes, zeros, ones, weights, [w for w, n in zip(words, counts) for _ in range(n)], np.ones(counts.sum()))
    assert np.allclose(every, sums(weights), rtol=1e-3, atol=1e-2)
    begin = np.full(weights.shape, 0.3)
    begin[:, :, 4] = 0
    loss = lambda w: (sums(w)[:, :, 0] + ((w - begin) ** 2).sum(axis=2) / 2).sum()
    least = loss(weights)
    for k in range(5):
        for move in (-0.05, 0.05):
            moved = weights.copy()
            moved[:, :, k] += move
            assert loss(moved) > least


def test_contexts_reach_into_the_token_before():
    """Heads and rests of tokens cost what a walk over the running text costs."""
    rng = np.random.default_rng(4)
    codes = mixing_lm.make_codes(rng.integers(0, 50, (256, 256)))
    zeros, ones = rng.integers(0, 9, (2, int(mixing_lm.STARTS[-1]))).astype(np.float32)
    model = mixing_lm.make_model(codes, zeros, ones, [])
    for text in ["", "a", "a b cd", "the cat sat on the mat, aéx ñ", "x y z " * 3, "longer wordings entirely a"]:
        words = [*mixing_lm.tokens(text), mixing_lm.END]
        own = list(dict.fromkeys(words))
        ids = np.array([own.index(w) for w in words])
        keys = mixing_lm.head_keys(ids, np.array([0]), *mixing_lm.edges(own)).tolist()
        heads = [mixing_lm.head_entry(k) for k in keys]
        assert [mixing_lm.head_key(h) for h in heads] == keys
        parts = model.entry_costs(heads).sum(axis=0) + model.entry_costs([mixing_lm.closed(w) for w in words]).sum(axis=0)
        whole = model.entry_costs([mixing_lm.START + b"".join(mixing_lm.closed(w) for w in words)])[0]
        assert np.allclose(parts, whole, rtol=1e-5) and (whole > 0).all()


def test_score_knows_the_token_before(spark, docs):
    """A word begins with the letter that the word before ends in; the same words in another order are less likely."""
    rng = np.random.default_rng(5)

    def chain(n):
        out, last = [], "a"
        for _ in range(n):
            out.append(last + "".join(rng.choice(list("abcdefgh"), 4)))
            last = out[-1][-1]
        return out

    held = next(i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 7 == 2)
    text = chain(300)
    other = next(i for i in range(held + 1, 3000) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = [(i, " ".join(chain(300))) for i in range(300)] + [(held, " ".join(text)), (other, " ".join(sorted(text, key=lambda w: w[::-1])))]
    got = {r.doc_id: r for r in mixing_lm.score(docs(rows)).collect()}
    assert got[held].base_score == pytest.approx(got[other].base_score)
    assert got[held].bits_per_byte < 0.95 * got[other].bits_per_byte


def test_running_tokens_in_columns(monkeypatch):
    rng = random.Random(1)
    texts = ["", " ", "\n", "A\x0b\x0cb\x1f c\x00", "É A日", "\x85a\xa0b c"] + [
        "".join(rng.choice("eTA ,.É日🙂\n\t\r\x0b\x0c\x0e\x08") for _ in range(rng.randrange(40))) for _ in range(300)]
    for cut in (50, mixing_lm.CUT):
        monkeypatch.setattr(mixing_lm, "CUT", cut)
        for column in (pa.chunked_array([texts]), pa.chunked_array([pa.array(texts).slice(3, 100), pa.array(texts).slice(50)]), pa.chunked_array([["", ""]])):
            own, ids, sizes = mixing_lm.running(column)
            want = [[*mixing_lm.tokens(t), mixing_lm.END] for t in column.to_pylist()]
            assert sizes.tolist() == [len(w) for w in want] and len(own) == len(set(own.to_pylist()))
            assert own.take(pa.array(ids)).to_pylist() == [w for words in want for w in words]


def test_earlier_with_keys_of_any_size():
    keys = np.array([5, 1, 5, 5, 1, 0])
    for far in (1, 1 << 40, 1 << 60):
        assert mixing_lm.earlier(keys * far).tolist() == [0, 0, 1, 2, 1, 0]


def test_recall_of_what_followed():
    ids = np.array([0, 1, 0, 1, 0, 2, 0, 0, 1])
    seen, followed = mixing_lm.recall(ids, np.array([6, 3]), 3)
    assert seen.tolist() == [0, 0, 1 / 2, 1 / 3, 2 / 4, 0, 0, 1, 0]
    assert followed.tolist() == [0, 0, 0, 1, 1, 0, 0, 0, 0]


def test_paths_of_many_texts_are_the_single_ones():
    rng = np.random.default_rng(6)
    sizes = np.array([1, 7, 30, 2, 30, 1, 200])
    scores = np.round(rng.normal(size=(sizes.sum(), 4)) * 3).astype(np.float32)  # with ties
    starts = np.cumsum(sizes) - sizes
    for some in (np.arange(7), np.array([1, 3, 6]), np.array([5])):
        want = np.concatenate([language.best_path(scores[a:a + n], 4.0) for a, n in zip(starts[some], sizes[some])])
        assert language.best_paths(scores, starts[some], sizes[some], 4.0).tolist() == want.tolist()
