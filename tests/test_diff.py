"""Line diffs against the plain table of common lengths, and on long texts."""

import random
import time

import pyarrow as pa

from opsframe.operators import versions


def plain_steps(a, b):
    """Steps read off the whole table: equal lines first, of equal scores the deletion."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in reversed(range(n)):
        for j in reversed(range(m)):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i] == b[j]:
            out.append(("eq", i, j))
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            out.append(("del", i, None))
            i += 1
        else:
            out.append(("add", None, j))
            j += 1
    return out


def test_steps_equal_the_plain_table():
    rng = random.Random(1)
    for _ in range(4000):
        kinds = rng.choice([1, 2, 3, 5, 50])
        a, b = ([rng.randrange(kinds) for _ in range(rng.randrange(15))] for _ in range(2))
        assert versions._middle(a, b, 0) == plain_steps(a, b), (a, b)
    a, b = ([rng.randrange(6) for _ in range(300)] for _ in range(2))  # lines that stand often enough to be kept
    assert versions._middle(a, b, 0) == plain_steps(a, b)


def test_hundred_thousand_lines_in_seconds(spark):
    rng = random.Random(2)
    old = [f"line {rng.randrange(50_000)}" for _ in range(100_000)]
    new = old[40_000:] + ["between"] + old[:40_000]
    for _ in range(10_000):
        new[rng.randrange(len(new))] = f"changed {rng.randrange(100)}"
    sides = [spark.createDataFrame([(1, "\n".join(x))], "doc int, body string") for x in (old, new)]
    began = time.time()
    counts = versions.diff_counts(versions.diff_versions(*sides, "doc", "body"), "doc").first()
    assert time.time() - began < 60
    assert counts.unchanged + counts.removed == 100_000 and counts.unchanged + counts.added == 100_001
    assert 50_000 < counts.unchanged < 60_500


def trimmed_steps(a, b):
    """The plain table between the lines that both texts begin and end with."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    middle = plain_steps(a[head:len(a) - tail], b[head:len(b) - tail])
    shift = lambda x: None if x is None else x + head
    return ([("eq", i, i) for i in range(head)] + [(op, shift(i), shift(j)) for op, i, j in middle]
            + [("eq", len(a) - tail + k, len(b) - tail + k) for k in range(tail)])


def test_many_texts_at_once_equal_the_plain_table():
    rng = random.Random(3)
    sizes = [0, 1, 2, 5, 8, 9, 16, 30, 61, 62, 63, 80]
    old, new = [], []
    for _ in range(1500):
        kinds = rng.choice([1, 2, 3, 5, 50])
        a = [str(rng.randrange(kinds)) for _ in range(rng.choice(sizes))]
        b = [str(rng.randrange(kinds)) for _ in range(rng.choice(sizes))] if rng.random() < 0.5 else [x for x in a if rng.random() < 0.8]
        old.append(a)
        new.append(b)
    got = versions.scripts(pa.array(old, pa.list_(pa.string())), pa.array(new, pa.list_(pa.string()))).to_pylist()
    for a, b, steps in zip(old, new, got):
        assert [(s["op"], s["a"], s["b"]) for s in steps] == trimmed_steps(a, b), (a, b)
    none = pa.array([], pa.list_(pa.string()))
    assert versions.scripts(none, none).to_pylist() == []


def test_texts_are_compared_some_at_a_time(spark):
    texts = pa.array([["a" * 50] * n for n in (3, 0, 1, 90, 0, 0, 2, 4, 0)], pa.list_(pa.string()))
    old, new = texts, texts.take(pa.array([2, 1, 0, 4, 3, 5, 6, 7, 8]))
    for size in (1, 200, 1000, 10**6):
        parts = list(versions.portions(old, new, size))
        assert [x for a, _ in parts for x in a.to_pylist()] == old.to_pylist()
        assert [x for _, b in parts for x in b.to_pylist()] == new.to_pylist()
        for a, b in parts:  # without its last text a portion is below the size
            assert sum(len(line) for side in (a, b) for text in side.to_pylist()[:-1] for line in text) < size
    assert len(list(versions.portions(old, new, 200))) > 3
    assert list(versions.portions(old.slice(0, 0), new.slice(0, 0))) == []
    rows = spark.createDataFrame([(i, "x\n" * 70_000 + str(i)) for i in range(40)], "doc int, body string").coalesce(1)
    changed = rows.selectExpr("doc", "concat('first\n', body, '!') AS body")
    counts = {tuple(r) for r in versions.diff_counts(versions.diff_versions(rows, changed, "doc", "body"), "doc").select("added", "removed", "unchanged").collect()}
    assert counts == {(2, 1, 70_000)}


def test_one_sided_texts_do_not_reach_python(spark, monkeypatch):
    def fail(batches):
        for old, new in batches:
            if len(old.flatten()) + len(new.flatten()):
                raise ValueError("lines were sent to Python")
            yield pa.array([[]] * len(old), pa.list_(pa.struct([("op", pa.string()), ("a", pa.int32()), ("b", pa.int32())])))

    from collections.abc import Iterator
    fail.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    monkeypatch.setattr(versions, "edit_script", versions.F.arrow_udf(fail, versions.OPS))
    old = spark.createDataFrame([(1, "a\nb"), (2, "same"), (4, "")], "doc int, body string")
    new = spark.createDataFrame([(2, "same"), (3, "c\n\nd"), (4, "e")], "doc int, body string")
    got = [tuple(r) for r in versions.diff_versions(old, new, "doc", "body").orderBy("doc", "op_no").collect()]
    assert got == [(1, 1, "del", 1, None, "a"), (1, 2, "del", 2, None, "b"), (2, 1, "eq", 1, 1, "same"), (3, 1, "add", None, 1, "c"),
                   (3, 2, "add", None, 2, ""), (3, 3, "add", None, 3, "d"), (4, 1, "add", None, 1, "e")]
