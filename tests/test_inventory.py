"""Inventories of real folders, and the archive plan made from them."""

import datetime
import hashlib
import os

from pyspark.sql import functions as F

from opsframe.operators import inventory, order
from opsframe.plans import archive


def make(folder):
    stamp = datetime.datetime(2024, 3, 5, 12, tzinfo=datetime.timezone.utc).timestamp()
    texts = {"a.txt": "one", "_draft.txt": "two", ".env": "three", "sub/b.TXT": "one", "sub/deep/.hidden": "", "sub/node_modules/x.js": "no",
             ".git/config": "no", "big.bin": "x" * 3_000_000}
    for name, text in texts.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
        os.utime(path, (stamp, stamp))
    return {n: t for n, t in texts.items() if "node_modules" not in n and ".git/" not in n}


def test_hidden_files_and_chunked_hashes(spark, tmp_path):
    texts = make(tmp_path)
    got = {r.rel_path: r for r in inventory.file_inventory(spark, str(tmp_path)).collect()}
    assert set(got) == set(texts)
    for name, text in texts.items():
        assert got[name].size == len(text) and got[name].fingerprint == hashlib.sha256(text.encode()).hexdigest()
    flat = inventory.file_inventory(spark, str(tmp_path), recursive=False, with_hash=False)
    assert {r.rel_path for r in flat.collect()} == {n for n in texts if "/" not in n}


def test_archive_names_by_file_time(spark, tmp_path):
    make(tmp_path)
    files = inventory.file_inventory(spark, str(tmp_path))
    plan = {r.rel_path: r.target for r in archive.archive_plan(files).collect()}
    assert plan["a.txt"] == "文档/文档_20240305_002.txt" and plan["sub/b.TXT"] == "_重复文件/sub__b.TXT"
    every = {r.rel_path: r.target for r in archive.archive_plan(files, dedupe=False).collect()}
    assert every["sub/b.TXT"] == "文档/文档_20240305_003.txt"


def test_growing_sides_are_not_broadcast(spark):
    """Only the bounded list of hot keys goes through the driver, however small the sides look."""
    rows = spark.range(1000).selectExpr("id % 100 AS k", "id AS v")
    sizes = rows.groupBy("k").agg(F.count("*").alias("n"))

    def broadcasts(df):
        return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")

    same = order.join_same(rows, sizes, ["k"])
    assert broadcasts(same) == 0 and same.count() == 1000
    attached = order.attach_by_key(rows, sizes, "k", "n", F.col("v"))
    assert broadcasts(attached) == 1 and attached.count() == 1000
