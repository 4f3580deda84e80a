"""Streams whose batches hold a hot key, late rows, repeated batches and keys that are forgotten."""

import datetime as dt

import pytest

from opsframe.streaming import health, ingest, prices
from opsframe.streaming.store import KeyStore

DAY = dt.datetime(2024, 5, 1)
CHECKS = "target string, event_id long, at timestamp, ok boolean, status string, ms double, error string"


def at(minutes):
    return None if minutes is None else DAY + dt.timedelta(minutes=minutes)


@pytest.fixture
def checks(spark):
    def make(rows):
        """(target, id, minutes, ok) with a status that tells the id, and an error on every third id."""
        full = [(t, i, at(m), ok, str(500 + i % 5) if not ok else "200", float(i), "timeout" if not ok and i % 3 == 0 else "") for t, i, m, ok in rows]
        return spark.createDataFrame(full, CHECKS).repartition(4)
    return make


def judged(rows, threshold=2):
    """Brute force: the events and records of checks taken one by one."""
    state, events = {}, []
    for t, i, m, ok in rows:
        s = state.setdefault(t, {"fails": 0, "first": None, "last_ok": None})
        before = s["fails"]
        s["fails"] = 0 if ok else before + 1
        if not ok and m is not None and (s["first"] is None or at(m) < s["first"]):
            s["first"] = at(m)
        s["last_ok"] = at(m) if ok and m is not None else s["last_ok"]
        s["last"] = i
        if (before >= threshold) != (s["fails"] >= threshold):
            events.append((t, i, "recovered" if ok else "outage", s["fails"], before, "200" if ok else "timeout" if i % 3 == 0 else str(500 + i % 5), s["first"]))
    return events, {t: (s["fails"] >= threshold, s["fails"], s["first"], s["last_ok"], s["last"]) for t, s in state.items()}


def run(spark, write, batches, sink):
    for n, b in enumerate(batches):
        write(b, n)
    return spark.read.parquet(sink).collect()


def test_health_hot_target_over_many_slices(spark, checks, tmp_path):
    rows = [("hot" if i % 3 else f"t{i % 7}" if i % 11 else None, i, i * 4, (i * i) % 5 > 1) for i in range(900)]
    write = health.health_writer(f"{tmp_path}/out", f"{tmp_path}/state", buckets=4)
    got = run(spark, write, [checks(rows[:300]), checks(rows[300:301]), checks(rows[301:])], f"{tmp_path}/out")
    events, records = judged(rows)
    assert sorted((str(r.target), r.event_id, r.state, r.streak, r.streak_before, r.cause, r.first_fail_at) for r in got) == sorted(
        (str(e[0]), *e[1:]) for e in events)
    found = {r.target: (r.down, r.consecutive_fail, r.first_fail_at, r.last_ok_at, r.last_id)
             for r in health.records(spark, f"{tmp_path}/state", 4).collect()}
    assert found == records


def test_health_late_and_repeated(spark, checks, tmp_path):
    write = health.health_writer(f"{tmp_path}/out", f"{tmp_path}/state", buckets=2)
    first = [("a", 1, None, False), ("a", 2, 10, False), ("b", 3, 10, True)]
    second = [("a", 4, 5, True), ("a", 2, 10, False), ("a", 5, 11, True), ("b", 6, 9, False), ("b", 7, 12, False)]  # 4, 2 and 6 are late
    write(checks(first), 0)
    write(checks(second), 1)
    once = sorted(map(str, spark.read.parquet(f"{tmp_path}/out").collect()))
    before = sorted(map(str, health.records(spark, f"{tmp_path}/state", 2).collect()))
    write(checks(second), 1)  # the same batch again, as after a failure
    assert sorted(map(str, spark.read.parquet(f"{tmp_path}/out").collect())) == once
    assert sorted(map(str, health.records(spark, f"{tmp_path}/state", 2).collect())) == before
    events, records = judged([*first, ("a", 5, 11, True), ("b", 7, 12, False)])
    assert {(r.target, r.event_id, r.state) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {e[:3] for e in events}
    found = {r.target: (r.down, r.consecutive_fail, r.first_fail_at, r.last_ok_at, r.last_id) for r in health.records(spark, f"{tmp_path}/state", 2).collect()}
    assert found == records


def test_health_forgets_targets(spark, checks, tmp_path):
    day = 24 * 60
    write = health.health_writer(f"{tmp_path}/out", f"{tmp_path}/state", forget_days=7, buckets=1)
    write(checks([("gone", 1, 0, False), ("stays", 2, 0, False)]), 0)
    write(checks([("stays", 3, 5 * day, False)]), 1)
    write(checks([("stays", 4, 8 * day, True), ("gone", 5, 8 * day, False)]), 2)
    got = {(r.target, r.event_id, r.state) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("stays", 3, "outage"), ("stays", 4, "recovered")}  # "gone" starts anew with its second failure
    write(checks([("stays", 6, 20 * day, True)]), 3)
    assert [r.target for r in health.records(spark, f"{tmp_path}/state", 1).collect()] == ["stays"]


def test_prices_follow_the_last_one_known(spark, tmp_path):
    rows = [("hot" if i % 3 else f"n{i % 5}" if i % 13 else None, i, at(i * 7), "" if i % 8 == 3 else f"¥{(i * i) % 9}", i % 10 == 4, i % 10 == 7)
            for i in range(400)]
    schema = "name string, event_id long, at timestamp, price string, blocked boolean, failed boolean"
    last, want = {}, []
    for n, i, _, price, blocked, failed in rows:
        before = last.get(n)
        last[n] = price
        status = ("blocked" if blocked else "error" if failed else "no_price" if not price else "first" if before is None
                  else "changed" if price != before else "unchanged")
        want.append((str(n), i, price, before or "", status))
    write = prices.price_writer(f"{tmp_path}/out", f"{tmp_path}/last", only_changes=False, separate_no_price=True, buckets=4)
    batches = [spark.createDataFrame(part, schema).repartition(3) for part in (rows[:150], rows[100:151], rows[151:])]  # 100-149 come again
    got = run(spark, write, batches, f"{tmp_path}/out")
    assert sorted((str(r.name), r.event_id, r.price, r.prev_price, r.status) for r in got) == sorted(want)
    assert len(list((tmp_path / "last").glob("v=*/bucket=*"))) <= 8  # superseded versions are removed


def test_store_reads_touched_buckets_only(spark, tmp_path):
    store = KeyStore(spark, str(tmp_path), ["k"], "k string, n long", buckets=8)
    store.write(spark.createDataFrame([(f"k{i}", i) for i in range(50)], "k string, n long"), 0)
    one = spark.createDataFrame([("k7", 0)], "k string, n long")
    buckets = store.touched(one)
    assert len(buckets) == 1
    part = store.read(1, buckets)
    assert 0 < part.count() < 50 and part.where("k = 'k7'").count() == 1
    assert store.read(0).count() == 0 and store.read(1).count() == 50 == store.latest().count()


def test_once_per_key_reads_its_own_buckets(spark, tmp_path, monkeypatch):
    """Keys come again in later batches, also after their first row's part is far behind; a repeated batch changes nothing."""
    schema = "id long, phone string, at timestamp, reason string"

    def batch(rows):
        return spark.createDataFrame([(i, p, at(m), "" if p.strip() else "no phone") for i, p, m in rows], schema).repartition(3)

    sink = f"{tmp_path}/out"
    write = ingest.once_writer(sink, ["phone"], ["id"], at="at", late_days=10, buckets=8)
    day = 24 * 60
    batches = [[(1, "a", 0), (2, " a ", 1), (3, "b", 2), (4, "", 3)], [(5, "a", day), (6, "c", day)], [(7, "c", 2 * day), (8, "b", 2 * day), (9, "d", 2 * day)],
               [(10, "d", 13 * day), (11, "a", 13 * day)]]  # "d" and "c" were last written 11 days before, "a" longer
    for n, rows in enumerate(batches):
        write(batch(rows), n)
    write(batch(batches[3]), 3)
    got = spark.read.parquet(sink)
    assert sorted(r.id for r in got.filter("reason = ''").collect()) == [1, 3, 6, 9, 10, 11]
    assert [r.id for r in got.filter("reason <> ''").collect()] == [4]
    read = []
    plain = KeyStore.read
    monkeypatch.setattr(KeyStore, "read", lambda self, batch_id, buckets=None: read.append(buckets) or plain(self, batch_id, buckets))
    write(batch([(12, "zz", 14 * day)]), 4)
    assert [len(b) for b in read] == [1]
    assert not any("/batch=" in f for f in spark.read.parquet(f"{sink}-keys").inputFiles())
