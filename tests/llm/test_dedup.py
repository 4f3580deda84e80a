"""Exact and near deduplication, and vectors, against brute force."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from opsframe.llm import exact_dedup, neighbours, simhash

EMPTY = "doc_id long, text string, lang string, source string"


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]+", "", text or "")


def exact_by_hand(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(bare(text), []).append((-len(text or ""), i is None, i if i is not None else 0, i))
    out = []
    for i, text in rows:
        own = groups[bare(text)]
        stays = min(own, key=lambda r: r[:3])[3]
        out.append((i, stays, len(own), i == stays, hashlib.sha256(bare(text).encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, ""), (6, " \t\n"), (7, "x" * 200_000), (8, "x" * 200_000 + " "),
        (9, "one"), (None, "one"), (None, "two"), (None, "two"), (10, "three"), (10, "three"), (11, "a b"), (12, "日 本"), (13, "日本")]


@pytest.mark.parametrize("key_bits", [64, 2])
def test_exact_groups(docs, key_bits):
    """Two-bit keys collide, so only the byte check keeps the texts apart."""
    rows = ROWS + [(100 + i, f"w{i % 40}") for i in range(200)]
    got = exact_dedup.exact_groups(docs(rows), key_bits=key_bits, shard_keys=16)
    assert sorted((tuple(r) for r in got.collect()), key=str) == exact_by_hand(rows)


def test_empty_tables(spark):
    none = spark.createDataFrame([], EMPTY)
    assert exact_dedup.exact_groups(none).count() == 0
    assert simhash.simhash_groups(none).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.near_vectors(vectors).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 30_000])
def test_filter_has_no_false_negatives(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
    made = exact_dedup.build_filter(keys)
    assert exact_dedup.ask_filter(keys, *made).all()
    others = rng.integers(1 << 63, 1 << 64, 20_000, dtype=np.uint64)
    assert exact_dedup.ask_filter(others, *made).mean() < 0.02


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAÄb \t\n\x1c é", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def reach(nodes, linked):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_simhash_groups(docs):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    base = [[words[k] for k in rng.integers(0, 300, 120)] for _ in range(12)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i in range(100, 160):  # copies with a changed word
        text = list(base[i % 12])
        text[int(rng.integers(0, 120))] = "changed"
        rows.append((i, " ".join(text)))
    rows += [(200, None), (201, ""), (202, " "), (203, "ONE word"), (204, "one WORD"), (204, "one WORD"), (None, "one word")]
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_groups(docs(rows), bucket_size=8).collect()}
    prints = [(i, slow_fingerprint(t)) for i, t in rows]
    nodes = {p for _, p in prints}
    label = reach(nodes, [(a, b) for a in nodes for b in nodes if a < b and bin(a ^ b).count("1") <= 4])
    low = {}
    for i, p in prints:
        if i is not None:
            low[label[p]] = min(low.get(label[p], i), i)
    assert got == {(i, f"{p:016x}", low[label[p]]) for i, p in prints}


@pytest.mark.parametrize("bucket_size", [4096, 8])
def test_links_join_every_near_pair(spark, bucket_size):
    """Random fingerprints and a dense ball around one; every pair within four bits must end in one component."""
    rng = np.random.default_rng(5)
    prints = {int(x) for x in rng.integers(0, 1 << 64, 200, dtype=np.uint64)}
    centre = int(rng.integers(0, 1 << 64, dtype=np.uint64))
    for _ in range(150):
        flip = 0
        for b in rng.integers(0, 64, 3):
            flip |= 1 << int(b)
        prints.add(centre ^ flip)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in
             simhash.fingerprint_links(spark.createDataFrame(signed, "fp long").repartition(4), bucket_size=bucket_size).collect()]
    assert reach(prints, links) == reach(prints, [(a, b) for a in prints for b in prints if a < b and bin(a ^ b).count("1") <= 4])


def test_near_vectors(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 32))
    rows = []
    for i in range(600):
        v = centres[i % 40] + (0.02 if i % 3 else 0.6) * rng.normal(size=32)
        rows.append((i, [float(np.float32(x)) for x in v]))
    rows += [(1000 + i, rows[5][1]) for i in range(30)] + [(7, rows[9][1]), (None, rows[9][1])]
    rows += [(2000, None), (2001, [0.0] * 32), (2002, [float("nan")] + [1.0] * 31), (2003, [None] + [1.0] * 31), (2004, [1.0, 2.0]),
             (2005, [float("inf")] + [1.0] * 31), (2006, [])]
    table = spark.createDataFrame([r + ("x",) for r in rows], "vec_id long, embedding array<float>, node string").repartition(3)
    got = neighbours.near_vectors(table, shard=60, largest=100).collect()
    good = [(i, np.array(v, float)) for i, v in rows if v and len(v) == 32 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = np.stack([v for _, v in good])
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    ids = [i for i, _ in good]
    want = sorted(int(n) for n in near.sum(axis=1)) + [0] * 7
    links = sum(r.n_links for r in got)
    assert len(got) == len(rows) and links >= 0.95 * sum(want) and links <= sum(want)
    label = reach(range(len(ids)), [(a, b) for a in range(len(ids)) for b in np.flatnonzero(near[a]) if a < b])
    low = {}
    for k, i in enumerate(ids):
        if i is not None:
            low[label[k]] = min(low.get(label[k], i), i)
    expected = sorted([(i, low[label[k]]) for k, i in enumerate(ids)] + [(i, i) for i in range(2000, 2007)], key=str)
    found = sorted(((r.vec_id, r.component_id) for r in got), key=str)
    assert sum(a == b for a, b in zip(found, expected)) >= 0.97 * len(expected)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert all(r.n_links == 0 and r.kept for r in got if r.vec_id and r.vec_id >= 2000)


def test_dense_groups_lose_no_links(spark):
    """Groups of more near copies than a node has places: a search from one medoid does not enter all of them."""
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(15, 64)), 100, axis=0) + 0.02 * rng.normal(size=(1500, 64))
    rows = [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    found = neighbours.near_vectors(table).cache()
    got = found.collect()
    assert all(r.n_links == 99 and r.component_id == r.vec_id // 100 * 100 for r in got)
    assert neighbours.audit(found, table, every=50) == (30 * 99, 30 * 99)


def test_components_of_paths_and_stars(spark):
    from opsframe.llm.common import components

    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5000, 4000), (7, 7), (5000, 4000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(80)}, 4000: 4000, 5000: 4000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
