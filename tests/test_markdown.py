"""Markdown documents read inside their rows: awkward ids, long documents, plans."""

import random
import re

import pytest

from opsframe.operators import mdcorpus

OPERATORS = [mdcorpus.md_blocks, mdcorpus.md_headings, mdcorpus.md_tables, mdcorpus.md_units, mdcorpus.md_links, mdcorpus.md_census, mdcorpus.md_elements]


def blocks_of(text):
    """The blocks of a text, line by line with plain loops: (kind, first line, number of lines)."""
    lines = [t.strip() for t in re.split("\r\n|\r|\n", text)]
    out, i, n = [], 0, len(lines)
    bullet, number, head = r"[-*+]\s+", r"\d+[.)]\s+", r"#{1,6}\s+"
    separates = lambda k: k < n and "|" in lines[k] and "-" in lines[k] and re.fullmatch(r"[\s|:-]+", lines[k])
    plain = lambda t: not (t == "" or re.match(f"{head}|{bullet}|{number}|>|```", t) or re.fullmatch(r"-{3,}|\*{3,}|_{3,}", t))
    while i < n:
        t, start = lines[i], i
        if t == "":
            i += 1
            continue
        if t.startswith("```"):
            i += 1
            while i < n and not lines[i].startswith("```"):
                i += 1
            i = min(i + 1, n)
            kind = "fence"
        elif re.fullmatch(r"-{3,}|\*{3,}|_{3,}", t):
            kind, i = "rule", i + 1
        elif re.match(head, t):
            kind, i = "heading", i + 1
        elif t.startswith(">"):
            kind = "quote"
            while i < n and lines[i].startswith(">"):
                i += 1
        elif "|" in t and separates(i + 1):
            kind = "table"
            while i < n and "|" in lines[i] and not lines[i].startswith("```"):
                i += 1
        elif re.match(bullet, t) or re.match(number, t):
            kind, own = ("ul", bullet) if re.match(bullet, t) else ("ol", number)
            while i < n and re.match(own, lines[i]):
                i += 1
        else:
            kind, i = "paragraph", i + 1
            while i < n and plain(lines[i]) and not ("|" in lines[i] and separates(i + 1)):
                i += 1
        out.append((kind, start + 1, i - start))
    return out


def test_blocks_against_plain_loops(spark):
    rng = random.Random(5)
    piece = ["", "", "text", "more text", "# h", "##no", "- a", "* b", "1. c", "> q", "```", "a | b", "|---|:-:|", "---", "c", "- x | y"]
    texts = ["\n".join(rng.choice(piece) for _ in range(rng.randrange(40))) for _ in range(400)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").repartition(4)
    got = {}
    for r in mdcorpus.md_blocks(rows, "id", "text").orderBy("id", "block_no").collect():
        got.setdefault(r.id, []).append((r.kind, r.first_line, r.n_lines))
    for i, t in enumerate(texts):
        assert got.get(i, []) == blocks_of(t), t


def test_long_document_and_shared_ids(spark):
    long = "\n".join(f"# t{i % 50}\n\ntext {i}\n- item" for i in range(6000))
    rows = spark.createDataFrame([(1, long), (1, "a\n\nb"), (1, "a\n\nb"), (None, "# x"), (None, None), (2, "")], "id int, text string")
    kinds = {}
    for r in mdcorpus.md_blocks(rows, "id", "text").collect():
        kinds[r.id, r.kind] = kinds.get((r.id, r.kind), 0) + 1
    assert kinds == {(1, "heading"): 6000, (1, "paragraph"): 6004, (1, "ul"): 6000, (None, "heading"): 1}
    anchors = [r.anchor for r in mdcorpus.md_headings(rows, "id", "text").filter("id = 1").orderBy("line_no").collect()]
    assert anchors[:51] == [f"t{i}" for i in range(50)] + ["t0-1"] and anchors[-1] == "t49-119"


@pytest.mark.parametrize("operator", OPERATORS)
def test_nothing_is_shuffled(spark, operator):
    rows = spark.createDataFrame([(1, "a")], "id int, text string")
    plan = operator(rows, "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
