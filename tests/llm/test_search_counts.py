"""Ranked search, token counts and the divergence audit against plain versions of their definitions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from opsframe.llm import divergence, lexical, queries, token_counts

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, pattern=WORDS):
    return pattern.findall((text or "").translate(LOWER))


# --- ranked search ----------------------------------------------------------------------------------------------

def searched(documents, items, top=20):
    """Brute force over (id, text) documents: sorted (item, rank, id, score)."""
    counts = [(i, Counter(words(t))) for i, t in documents if words(t)]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counts:
            m = 75 + 25 * sum(c.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m))
                    for t in words(text) if t in c)
            if s > 0:
                scores.append((-s, i is None, i))
        scores.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(str(item), n, i, -s) for n, (s, _, i) in enumerate(scores[:top], 1)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((str(r.item_id), r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.fixture
def corpus():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)] + ["Größe", "日本", "x9"]
    weight = [1 / (1 + i) for i in range(len(vocabulary))]
    texts = [" ".join(rng.choices(vocabulary, weight, k=rng.choice([1, 3, 20, 200]))) for _ in range(700)]
    texts += ["W0, w0; w1!", None, "", "!!! --", "rare", "rare rare", "w1 " * 3000, "lone"]
    texts += texts[:40]  # repeated rows: ties
    return [(i * 3 % 1000, t) for i, t in enumerate(texts)] + [(None, "rare w5"), (None, "rare w5"), (7, "rare"), (7, "rare")]


ITEMS = [(1, "w0 w1 w2 w3 rare"), (2, "w7 w7 w9 x9 Größe 日本"), (3, None), (4, ""), (5, "unheard of"), (6, "rare"), (6, "w40 w0 w0"),
         (None, "lone w1"), (8, " ".join(f"w{i}" for i in range(60)))]


@pytest.mark.parametrize("shard, block_bytes", [(1 << 30, 1 << 20), (2000, 60), (1, 1 << 20)])
def test_search_equals_brute_force(spark, docs, corpus, shard, block_bytes):
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, rank string")
    got = lexical.ranked(docs(corpus), items, shard=shard, block_bytes=block_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows_of(got) == searched(corpus, ITEMS)


def test_search_of_empty_tables(spark, docs, corpus):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.ranked(docs([(1, None), (2, "")]), items).count() == 0
    assert lexical.ranked(docs([(1, "a")]).limit(0), items).count() == 0
    assert lexical.ranked(docs(corpus), items.limit(0)).count() == 0


def test_blocks_are_rejected_before_they_are_read():
    """A common term's list has many blocks; candidates from the rare term need one of them."""
    shard = lexical.Shard()
    texts = [b"common " * (1 + i % 3) + (b"rare rare" if i == 5000 else b"") + (b" odd" if i % 900 == 1 else b"") for i in range(9000)]
    for i, t in enumerate(texts):
        shard.add(i, t)
    n, total = len(texts), sum(len(t.split()) for t in texts)
    row = shard.row(n, total)
    lists = lexical.Lists(row)
    lists.open(row, n, total)
    df = dict(zip(lists.names, lists.df.tolist()))
    most = dict(zip(lists.names, np.maximum.reduceat(lists.block_max, lists.first[:-1]).tolist()))
    query = sorted(((lists.names.index(t), lexical.weight(n, df[t]) + 1, (lexical.weight(n, df[t]) + 1) * most[t]) for t in (b"rare", b"odd", b"common")),
                   key=lambda q: -q[2])
    best = lexical.Best(1)
    lexical.search_shard(lists, query, best)
    assert best.ids.tolist() == [5000] and lists.decoded <= 3 < len(lists.base)


def test_blocks_hold_any_width():
    """Gaps and counts of one, two and four bytes come back from their blocks."""
    shard = lexical.Shard()
    for i in range(70_000):
        shard.add(i, b"far" if i in (0, 69_999) else b"x " * 300 if i == 9 else b"y " * 70_000 if i == 10 else b"z")
    lists = lexical.Lists(row := shard.row(70_000, 1_000_000))
    lists.open(row, 70_000, 1_000_000)
    read = {t: lists.blocks(range(int(lists.first[k]), int(lists.first[k + 1]))) for k, t in enumerate(lists.names)}
    assert [read[b"far"][0].tolist(), read[b"x"][1].tolist(), read[b"y"][1].tolist()] == [[0, 69_999], [300], [70_000]]
    assert read[b"z"][0].tolist() == [i for i in range(70_000) if i not in (0, 69_999, 9, 10)]


# --- token counts -----------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    return token_counts.Lengths(token_counts._path(token_counts.TOKENIZER)).tokenizer


def test_counts_equal_the_library(spark, docs, library):
    rng = random.Random(2)
    alphabet = list("abcSTdrev'' \n\t\r  0123.,;:()!?-_<|>é漢字か。、가　 \x1c\x85​ΩЖ᠎٣²½ﬁ")
    special = ["<|endoftext|>", " <|endoftext|>", "'s", "'ll", "don't", "\r\n", "  "]
    texts = ["".join(rng.choice(alphabet) if rng.random() < 0.93 else rng.choice(special) for _ in range(rng.randrange(120))) for _ in range(3000)]
    texts += ["x" * 100_000, "ab1," * 30_000, "漢字。" * 20_000, " " * 50_000, "\n" * 30_001 + "a", "<|endoftext|>" * 9000, "a<|endoftext|>1." * 5000, "", None]
    texts += [r.text for r in queries.documents(spark, "/root/testdata/sf0.01").limit(300).collect()]
    rows = list(enumerate(texts)) + [(None, "no id"), (4, "same id"), (4, "same id")]
    want = sorted((str(i), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for i, t in rows)
    got = token_counts.count_tokens(docs(rows)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert token_counts.count_tokens(docs([(1, "a")]).limit(0)).count() == 0


def test_pieces_make_up_the_text(library):
    text = "It's 12,5 big.  well\x1c \n\n" + "longword" * 9000 + "。1," * 9000 + " end"
    cut = token_counts.pieces(text)
    assert "".join(cut) == text and max(map(len, cut)) < 80_000 and len(cut) >= 7
    assert sum(len(library.encode(p, add_special_tokens=False)) for p in cut) == len(library.encode(text, add_special_tokens=False))


def test_memory_of_pieces_is_bounded(monkeypatch, library):
    monkeypatch.setattr(token_counts, "MEMO", 50)
    lengths = token_counts.Lengths(token_counts._path(token_counts.TOKENIZER))
    for k in range(20):
        texts = [f"word{k} of{k * j} text{j}" for j in range(10)]
        assert lengths.of(texts) == [len(library.encode(t)) for t in texts] and len(lengths.known) <= 50


# --- divergence -------------------------------------------------------------------------------------------------

def audited(rows, least=10, top=10):
    rows = [(lang or "", source or "", words(text, LETTERS)) for _, text, lang, source in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        df = Counter(t for _, _, found in own for t in set(found))
        kept = sorted(t for t, n in df.items() if n >= least)
        sources = sorted({s for _, s, _ in own})
        counts = {s: Counter(t for _, x, found in own if x == s for t in found if df[t] >= least) for s in sources}
        counts[None] = sum(counts.values(), Counter())
        p = {s: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept} for s, c in counts.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], p[None][t]), t) for t in kept if counts[s][t] and p[s][t] > p[None][t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, n) for n, (v, i) in enumerate(found, 1) if part == "pair" or n <= top]
    return sorted(out)


def audit_rows():
    rng = random.Random(4)
    vocabulary = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrs"] + ["größe", "日本", "ÉTÉ", "Zz"]
    rows = []
    for i in range(500):
        lang, source = rng.choice(["en", "en", "de", None, ""]), rng.choice(["s0", "s0", "s1", "s2", None])
        lean = vocabulary[:30] if source == "s1" else vocabulary
        rows.append((i, " ".join(rng.choices(lean, k=rng.randrange(40))) + " 12x9,Y", lang, source))
    rows += [(600, None, "en", "lonely"), (601, "", "fr", "a"), (602, "only few", "fr", "b"), (603, None, None, None), (1, "again again", "en", "s0")]
    return rows


@pytest.mark.parametrize("options", [{}, {"shard_keys": 7, "round_bytes": 500}, {"least": 1}, {"top": 3}])
def test_audit_equals_brute_force(spark, docs, options):
    rows = audit_rows()
    got = sorted(tuple(r) for r in divergence.audit(docs(rows), **options).collect())
    assert got == audited(rows, options.get("least", 10), options.get("top", 10))


def test_small_bounds_inside_tasks(spark, docs, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 5)
    monkeypatch.setattr(divergence, "CELLS", 5)
    monkeypatch.setattr(divergence, "BLOCK", 8)
    monkeypatch.setattr(divergence, "MATRIX", 10)
    rows = audit_rows()
    assert sorted(tuple(r) for r in divergence.audit(docs(rows)).collect()) == audited(rows)


def test_audit_of_empty_table_and_clashing_names(spark, docs):
    assert divergence.audit(docs([(1, "a")]).limit(0)).count() == 0
    rows = [(i, "same words here", "en", f"s{i % 2}") for i in range(20)]
    from pyspark.sql import functions as F
    clash = docs(rows).withColumns({c: F.lit("x") for c in ("slot", "shard", "n", "total", "kinds", "item", "value", "a.b", "term", "part")})
    assert sorted(tuple(r) for r in divergence.audit(clash).collect()) == audited(rows)


def test_perfect_hash_is_minimal_and_checks_keys():
    terms = [f"term{i}".encode() for i in range(5000)]
    table = divergence.PerfectHash(*divergence.build_hash(terms, divergence.hashes(terms)))
    slots = table.slots(terms, divergence.hashes(terms))
    assert sorted(slots.tolist()) == list(range(5000)) and [table.keys[s] for s in slots] == terms
    others = [f"other{i}".encode() for i in range(5000)]
    assert (table.slots(others, divergence.hashes(others)) == -1).all()
    same = np.full(4, 77, np.uint64)  # four terms of one 64-bit hash, and a fifth that is not stored
    table = divergence.PerfectHash(*divergence.build_hash(terms[:4], same))
    assert sorted(table.slots(terms[:4], same).tolist()) == [0, 1, 2, 3] and table.slots(terms[4:5], same[:1]).tolist() == [-1]
    assert divergence.PerfectHash(*divergence.build_hash([], np.zeros(0, np.uint64))).slots([b"x"], divergence.hashes([b"x"])).tolist() == [-1]


def test_shares_of_very_large_counts():
    counts, total = np.array([[0, 5, 10**14]]), np.array([3 * 10**14 + 7])
    assert divergence.shares(counts, total).tolist() == [[1 + 10**9 * (c + 2) // int(total[0]) for c in counts[0].tolist()]]
