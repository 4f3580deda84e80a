"""Keyed tables: reconciliation, snapshots, health."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsframe.catalog.normalizing import sql_squeeze, sql_stock_number, sql_strip
from opsframe.catalog.registry import given, query
from opsframe.operators import health, reconcile, snapshots
from opsframe.operators.order import time_chunk

given("store_a", """
SELECT p_partkey AS row_key, CASE WHEN p_partkey % 41 = 0 THEN ' ' WHEN p_partkey % 37 = 0 THEN 'S1' ELSE ' S' || CAST(p_partkey AS STRING) END AS sku,
  CASE WHEN p_partkey % 5 = 0 THEN '¥' || cents ELSE cents END AS price, CAST(p_size AS STRING) || '件' AS stock, p_name AS title, p_type AS status
FROM (SELECT *, CAST(CAST(ROUND(p_retailprice * 100) AS BIGINT) AS STRING) AS cents FROM part) q""")
given("store_b", """
SELECT p_partkey AS row_key, 'S' || CAST(p_partkey AS STRING) AS sku,
  CASE WHEN p_partkey % 10 = 0 THEN CAST(cents + 300 AS STRING) WHEN p_partkey % 23 = 0 THEN '' ELSE CAST(cents AS STRING) END AS price,
  CASE WHEN p_partkey % 6 = 0 THEN CAST(p_size + 1 AS STRING) ELSE CAST(p_size AS STRING) END AS stock,
  CASE WHEN p_partkey % 9 = 0 THEN upper(p_name) ELSE p_name || ' ' END AS title, p_type AS status
FROM (SELECT *, CAST(ROUND(p_retailprice * 100) AS BIGINT) AS cents FROM part) q WHERE p_partkey % 8 <> 3
UNION ALL SELECT p_partkey + 1000000, 'X' || CAST(p_partkey AS STRING), '100', '1', p_name, p_type FROM part WHERE p_partkey % 19 = 0""")
given("store_c", """
SELECT row_key, sku, price, stock, title, 'NEW' AS status FROM store_b WHERE row_key % 3 <> 1""")

FIELDS = ["price", "stock", "title", "status"]
NUMERIC = ["price", "stock"]


def _aligned(t, stores, ignore_case=False):
    tables = {s: t.input(s) for s in stores}
    tagged = reconcile.tag_stores(tables, ["sku", *FIELDS], "row_key")
    return reconcile.align(tagged, "sku", FIELDS, stores, NUMERIC, ignore_case)


def _pairs(t, stores, ignore_case=False):
    return reconcile.pair_rows(_aligned(t, stores, ignore_case), stores)


def _summary(t, stores, mode="baseline"):
    return reconcile.summary(reconcile.pair_flags(_aligned(t, stores), stores, FIELDS, NUMERIC, mode), FIELDS)


def _uniq(store: str) -> str:
    return f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY row_key) AS rn
  FROM (SELECT *, {sql_strip('sku')} AS key FROM {store}) WHERE key <> '') WHERE rn = 1)"""


def _side(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS base_store, '{b}' AS other_store, coalesce(b.key, o.key) AS key, b.key IS NOT NULL AS has_b, o.key IS NOT NULL AS has_o,
  {', '.join(f"b.{f} AS b_{f}, o.{f} AS o_{f}" for f in FIELDS)} FROM {_uniq(a)} b FULL JOIN {_uniq(b)} o ON o.key = b.key"""


def _diff_sql(pairs: list[tuple[str, str]]) -> str:
    number = lambda f: f"""
SELECT base_store, other_store, key, '{f}' AS field, CASE WHEN nb IS NULL OR no IS NULL THEN '缺值' ELSE '数值不一致' END AS kind,
  b_{f} AS base, o_{f} AS other, CAST(no - nb AS DOUBLE) AS delta,
  CASE WHEN nb <> 0 THEN CAST(no - nb AS DOUBLE) / abs(CAST(nb AS DOUBLE)) * 100 END AS pct
FROM (SELECT *, {sql_stock_number(f'b_{f}')} AS nb, {sql_stock_number(f'o_{f}')} AS no FROM pairs WHERE has_b AND has_o)
WHERE (nb IS NULL) <> (no IS NULL) OR abs(nb - no) > 0.01"""
    text = lambda f: f"""
SELECT base_store, other_store, key, '{f}', '文本不一致', b_{f}, o_{f}, NULL, NULL FROM pairs
WHERE has_b AND has_o AND {sql_squeeze(f'b_{f}')} <> {sql_squeeze(f'o_{f}')}"""
    parts = [number(f) if f in NUMERIC else text(f) for f in FIELDS]
    return f"""pairs AS ({' UNION ALL '.join(_side(a, b) for a, b in pairs)}),
diffs AS ({' UNION ALL '.join(parts)})"""


_TWO = _diff_sql([("store_a", "store_b")])
_ALL = _diff_sql([("store_a", "store_b"), ("store_a", "store_c"), ("store_b", "store_c")])
_LONE = """
SELECT base_store, other_store, key, '（整条）' AS field, CASE WHEN has_b THEN '仅基准方有' ELSE '仅比对方有' END AS kind,
  CASE WHEN has_b THEN b_title ELSE '' END AS base, CASE WHEN has_b THEN '' ELSE o_title END AS other,
  CAST(NULL AS DOUBLE) AS delta, CAST(NULL AS DOUBLE) AS pct FROM pairs WHERE NOT (has_b AND has_o)"""
_SUMMARY = """
SELECT p.base_store, p.other_store, count(*) FILTER (has_b) AS base_keys, count(*) FILTER (has_o) AS other_keys,
  count(*) FILTER (has_b AND has_o) AS common_keys, count(*) FILTER (has_b AND NOT has_o) AS base_only,
  count(*) FILTER (NOT has_b AND has_o) AS other_only, count(*) FILTER (n > 0) AS diff_keys, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_diffs,
  count(*) FILTER (price) AS diff_price, count(*) FILTER (stock) AS diff_stock, count(*) FILTER (title) AS diff_title,
  count(*) FILTER (status) AS diff_status,
  count(*) FILTER (n > 0) / count(*) FILTER (has_b AND has_o) * 100 AS rate_pct
FROM pairs p LEFT JOIN (SELECT base_store, other_store, key, count(*) AS n, bool_or(field = 'price') AS price, bool_or(field = 'stock') AS stock,
    bool_or(field = 'title') AS title, bool_or(field = 'status') AS status FROM diffs GROUP BY ALL) d
  ON d.base_store = p.base_store AND d.other_store = p.other_store AND d.key = p.key GROUP BY ALL"""


@query("reconcile_detail", f"WITH {_TWO} SELECT * FROM diffs UNION ALL {_LONE}")
def _(t):
    return reconcile.detail(_pairs(t, ["store_a", "store_b"]), FIELDS, NUMERIC)


@query("reconcile_one_sided", f"WITH {_TWO} {_LONE}")
def _(t):
    return reconcile.one_sided(_pairs(t, ["store_a", "store_b"]))


@query("reconcile_summary", f"WITH {_TWO} {_SUMMARY}")
def _(t):
    return _summary(t, ["store_a", "store_b"])


@query("reconcile_all_pairs", f"WITH {_ALL} {_SUMMARY}")
def _(t):
    return _summary(t, ["store_a", "store_b", "store_c"], "all_pairs")


@query("reconcile_baseline", f"WITH {_diff_sql([('store_a', 'store_b'), ('store_a', 'store_c')])} {_SUMMARY}")
def _(t):
    return _summary(t, ["store_a", "store_b", "store_c"])


@query("reconcile_top", f"""
WITH {_TWO} SELECT * FROM diffs WHERE field = 'price' AND delta IS NOT NULL
ORDER BY abs(delta) DESC, base_store, other_store, key LIMIT 10""")
def _(t):
    return reconcile.top_deltas(reconcile.diffs(_pairs(t, ["store_a", "store_b"]), FIELDS, NUMERIC), "price")


@query("reconcile_alert", f"""
WITH {_TWO} SELECT count(*) AS total_diffs, CAST(1 AS BIGINT) AS threshold FROM diffs HAVING count(*) >= 1""")
def _(t):
    return reconcile.diff_alert(_summary(t, ["store_a", "store_b"]))


@query("reconcile_field_selection", f"WITH {_TWO} SELECT * FROM diffs WHERE field IN ('price', 'title')")
def _(t):
    chosen = reconcile.select_fields(FIELDS, only=["price", "title", "status"], ignore=["status"])
    return reconcile.diffs(_pairs(t, ["store_a", "store_b"]), chosen, NUMERIC)


given("store_lower", """
SELECT row_key, CASE WHEN row_key % 2 = 0 THEN lower(sku) ELSE sku END AS sku, price, stock, CASE WHEN row_key % 7 = 0 THEN title || '!' ELSE upper(title) END AS title, status FROM store_b
UNION ALL SELECT row_key + 2000000, lower(sku), price, stock, title || ' again', status FROM store_b WHERE row_key % 10 = 5""")


@query("reconcile_ignore_case", f"""
WITH lowered AS (SELECT 'store_a' AS s, row_key, lower(key) AS key, title FROM {_uniq('store_a')}
  UNION ALL SELECT 'store_lower', row_key, lower(key), title FROM {_uniq('store_lower')}),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s, key ORDER BY row_key DESC) AS rn FROM lowered) WHERE rn = 1)
SELECT 'store_a' AS base_store, 'store_lower' AS other_store, a.key, 'title' AS field, '文本不一致' AS kind, a.title AS base, b.title AS other,
  CAST(NULL AS DOUBLE) AS delta, CAST(NULL AS DOUBLE) AS pct
FROM last a JOIN last b ON a.key = b.key AND a.s = 'store_a' AND b.s = 'store_lower'
WHERE lower({sql_squeeze('a.title')}) <> lower({sql_squeeze('b.title')})""")
def _(t):
    return reconcile.diffs(_pairs(t, ["store_a", "store_lower"], ignore_case=True), ["title"], ignore_case=True)


@query("key_sets", f"""
SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'base_only' WHEN a.key IS NULL THEN 'other_only' ELSE 'common' END AS key_set
FROM {_uniq('store_a')} a FULL JOIN {_uniq('store_b')} b ON a.key = b.key""")
def _(t):
    return reconcile.key_sets(t.store_a, t.store_b, "sku")


given("price_log", """
SELECT event_id, CASE WHEN event_id % 17 <> 4 THEN ts END AS ts, CASE WHEN event_id % 3 = 0 THEN 'hot item' WHEN event_id % 11 = 5 THEN NULL ELSE 'item ' || CAST(user_id AS STRING) END AS name,
  CASE WHEN event_type = 'error' THEN '' ELSE '¥' || CAST(CAST(FLOOR(value / 20) AS BIGINT) AS STRING) END AS price FROM events""")

_CHANGES = """
seen AS (SELECT *, lag(price) OVER w AS prev_price, row_number() OVER w AS n FROM price_log WINDOW w AS (PARTITION BY name ORDER BY ts NULLS FIRST, event_id)),
changes AS (SELECT event_id, name, price, prev_price, CASE WHEN n = 1 AND price = '' THEN 'error' WHEN n = 1 THEN 'first'
  WHEN price <> prev_price THEN 'changed' ELSE 'unchanged' END AS status FROM seen)"""


def _changes(t):
    return snapshots.price_changes(t.price_log, "name", "price", ["ts", "event_id"], time_chunk("ts", 3600))


@query("snapshot_changes", f"WITH {_CHANGES} SELECT event_id, name, price, prev_price, status FROM changes")
def _(t):
    return _changes(t).select("event_id", "name", "price", "prev_price", "status")


given("page_log", """
SELECT event_id, ts, 'page ' || CAST(user_id % 90 AS STRING) AS name, event_type = 'signup' AS blocked, event_type = 'error' AS failed,
  CASE WHEN event_type IN ('error', 'signup') OR (event_type = 'click' AND value < 100) THEN '' ELSE '¥' || CAST(CAST(FLOOR(value / 20) AS BIGINT) AS STRING) END AS price FROM events""")


@query("snapshot_failures", """
SELECT event_id, name, CASE WHEN blocked THEN 'blocked' WHEN failed THEN 'error' WHEN price = '' THEN 'no_price' WHEN n = 1 THEN 'first'
  WHEN price <> prev THEN 'changed' ELSE 'unchanged' END AS status
FROM (SELECT *, lag(price) OVER w AS prev, row_number() OVER w AS n FROM page_log WINDOW w AS (PARTITION BY name ORDER BY ts, event_id))""")
def _(t):
    seen = snapshots.price_changes(t.page_log, "name", "price", ["ts", "event_id"], time_chunk("ts", 3600), blocked="blocked",
                                   failed="failed", separate_no_price=True)
    return seen.select("event_id", "name", "status")


@query("snapshot_ignore_failed", """
SELECT event_id, name, price, prev AS prev_price, CASE WHEN n = 1 THEN 'first' WHEN price <> prev THEN 'changed' ELSE 'unchanged' END AS status
FROM (SELECT *, lag(price) OVER w AS prev, row_number() OVER w AS n FROM page_log WHERE price <> '' WINDOW w AS (PARTITION BY name ORDER BY ts, event_id))""")
def _(t):
    seen = snapshots.price_changes(t.page_log, "name", "price", ["ts", "event_id"], time_chunk("ts", 3600), ignore_failed=True)
    return seen.select("event_id", "name", "price", "prev_price", "status")


@query("snapshot_status_counts", f"""
WITH {_CHANGES} SELECT CASE WHEN status = 'error' THEN 'failed' ELSE status END AS section, count(*) AS n FROM changes GROUP BY 1""")
def _(t):
    return snapshots.status_counts(_changes(t))


@query("snapshot_last", """
SELECT name, event_id AS last_event_id, price AS last_price FROM (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY ts DESC, event_id DESC) AS rn FROM price_log WHERE name <> '') WHERE rn = 1""")
def _(t):
    return snapshots.last_snapshot(t.price_log, "name", ["ts", "event_id"], ["event_id", "price"])


@query("snapshot_compare", """
WITH today AS (SELECT 'item ' || CAST(c_custkey AS VARCHAR) AS name, '¥' || CAST(c_custkey % 25 AS VARCHAR) AS price FROM customer),
last AS (SELECT name, price FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ts DESC, event_id DESC) AS rn FROM price_log) WHERE rn = 1)
SELECT t.name, t.price, CASE WHEN l.name IS NULL THEN 'first' WHEN l.price <> t.price THEN 'changed' ELSE 'unchanged' END AS status,
  coalesce(l.price, '') AS prev_price FROM today t LEFT JOIN last l ON l.name = t.name""")
def _(t):
    today = t.customer.selectExpr("concat('item ', c_custkey) AS name", "concat('¥', c_custkey % 25) AS price")
    return snapshots.compare_snapshot(today, t.price_log, "name", "price", ["ts", "event_id"])


given("hot_checks", """
SELECT event_id, CASE WHEN event_id % 17 <> 4 THEN ts END AS ts, CASE WHEN event_id % 3 = 0 THEN 'site 0' WHEN event_id % 11 <> 5 THEN target END AS target, status, ok AND event_id % 4 <> 1 AS ok, ms FROM checks""")

_HEALTH = """
numbered AS (SELECT *, row_number() OVER w AS rn, coalesce(max(CASE WHEN ok THEN event_id END) OVER w, -1) AS ok_mark,
  min(CASE WHEN NOT ok THEN ts END) OVER w AS first_fail FROM hot_checks WINDOW w AS (PARTITION BY target ORDER BY ts NULLS FIRST, event_id)),
islands AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY target ORDER BY ts NULLS FIRST, event_id) AS island FROM numbered),
streaks AS (SELECT *, CASE WHEN ok THEN 0 ELSE sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY target, island ORDER BY ts NULLS FIRST, event_id) END AS streak FROM islands),
states AS (SELECT *, coalesce(lag(streak) OVER (PARTITION BY target ORDER BY ts NULLS FIRST, event_id), 0) AS streak_before FROM streaks),
edges AS (SELECT *, CASE WHEN ok AND streak_before >= 2 THEN 'recovered' WHEN ok THEN 'ok' WHEN streak >= 2 AND streak_before < 2 THEN 'outage'
  WHEN streak >= 2 THEN 'still_down' ELSE 'below_threshold' END AS state FROM states)"""


def _streaks(t):
    return health.streaks(t.hot_checks, "target", "ok", "ts", ["ts", "event_id"], time_chunk("ts", 3600), ["status", "ms"])


@query("health_streaks", f"""
WITH {_HEALTH} SELECT event_id, target, CAST(streak AS BIGINT) AS streak, CAST(streak_before AS BIGINT) AS streak_before,
  CAST(first_fail AS VARCHAR) AS first_fail_at FROM edges""")
def _(t):
    return _streaks(t).select("event_id", "target", "streak", "streak_before", F.col("first_fail_at").cast("string"))


@query("health_states", f"WITH {_HEALTH} SELECT event_id, streak >= 2 AS down, streak_before >= 2 AS was_down, state FROM edges")
def _(t):
    return health.with_state(_streaks(t), "ok").select("event_id", "down", "was_down", "state")


@query("outage_edges", f"""
WITH {_HEALTH} SELECT event_id, target, state, CAST(streak AS BIGINT) AS streak, CAST(streak_before AS BIGINT) AS streak_before,
  CAST(first_fail AS VARCHAR) AS first_fail_at, status AS cause
FROM edges WHERE state IN ('outage', 'recovered')""")
def _(t):
    return health.outage_edges(_streaks(t), "ok").select("event_id", "target", "state", "streak", "streak_before",
                                                         F.col("first_fail_at").cast("string"), F.col("status").alias("cause"))


@query("health_target_state", f"""
WITH {_HEALTH}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY ts DESC, event_id DESC) AS back FROM edges) WHERE back = 1)
SELECT l.target, l.streak >= 2 AS down, CAST(l.streak AS BIGINT) AS consecutive_fail, CAST(l.first_fail AS VARCHAR) AS first_fail_at,
  (SELECT CAST(max(c.ts) AS VARCHAR) FROM hot_checks c WHERE c.target IS NOT DISTINCT FROM l.target AND c.ok) AS last_ok_at, l.status AS last_status, l.ms AS last_ms
FROM last l""")
def _(t):
    out = health.target_state(_streaks(t), "target", "ok", "ts", ["ts", "event_id"], "status", "ms")
    return out.withColumns({c: F.col(c).cast("string") for c in ("first_fail_at", "last_ok_at")})


@query("health_summary", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS round, count(*) AS total, count(*) FILTER (ok) AS n_ok, count(*) FILTER (NOT ok) AS n_bad,
  count(*) FILTER (ok AND ms > 300) AS n_slow FROM hot_checks GROUP BY 1""")
def _(t):
    return health.round_summary(t.hot_checks, F.to_date("ts"), "ok", "ms", 300)


@query("check_retries", """
SELECT target, round_no AS "check", ok, attempt AS attempts, ms FROM (SELECT *, row_number() OVER (PARTITION BY target, round_no
    ORDER BY CASE WHEN ok THEN 0 ELSE 1 END, CASE WHEN ok THEN attempt ELSE -attempt END) AS rn
  FROM (SELECT *, event_id AS attempt, CAST(ts AS DATE) - DATE '2024-01-01' AS round_no FROM hot_checks)) WHERE rn = 1""")
def _(t):
    attempts = t.hot_checks.withColumns({"attempt": F.col("event_id"), "check": F.datediff(F.to_date("ts"), F.lit("2024-01-01"))})
    return health.combine_attempts(attempts, "target", "check", "attempt", "ok", ["ms"])
