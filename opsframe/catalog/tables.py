"""Row-level table work: duplicates, groups, sorting, required cells, rules, numbering, step lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsframe.catalog.normalizing import sql_form_number, sql_number, sql_strip
from opsframe.catalog.registry import given, query
from opsframe.operators import dedupe, order, quality, rules, summary
from opsframe.plans import forms, steps
from opsframe.sources import exports

given("keyed_events", """
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '  ' WHEN event_id % 3 = 0 THEN 'user 7' ELSE ' u' || CAST(user_id AS STRING) END AS user_key,
  CASE WHEN event_id % 11 = 0 THEN '' ELSE event_type END AS kind, CAST(ROUND(value * 100) AS BIGINT) AS cents
FROM events""")

_KEYED = f"k AS (SELECT *, {sql_strip('user_key')} AS s FROM keyed_events)"


def _dedupe_sql(direction: str) -> str:
    return f"""
WITH {_KEYED} SELECT event_id, user_key, kind, cents FROM (
  SELECT *, row_number() OVER (PARTITION BY s ORDER BY event_id {direction}) AS rn FROM k) WHERE s = '' OR rn = 1"""


@query("dedupe_first", _dedupe_sql("ASC"))
def _(t):
    return dedupe.dedupe(t.keyed_events, "user_key", "event_id")


@query("dedupe_last", _dedupe_sql("DESC"))
def _(t):
    return dedupe.dedupe(t.keyed_events, "user_key", "event_id", "last")


@query("dedupe_composite_last", f"""
WITH {_KEYED} SELECT event_id, user_key, kind, cents, position FROM (
  SELECT *, row_number() OVER (PARTITION BY s, kind ORDER BY event_id DESC) AS rn,
    min(event_id) OVER (PARTITION BY s, kind) AS position FROM k) WHERE rn = 1""")
def _(t):
    return dedupe.dedupe_composite(t.keyed_events, ["user_key", "kind"], "event_id")


@query("duplicate_report", f"""
WITH {_KEYED} SELECT s AS key, count(*) AS n_rows, min(event_id) AS first_at, count(*) - 1 AS n_extra
FROM k WHERE s <> '' GROUP BY s HAVING count(*) > 1""")
def _(t):
    return dedupe.duplicate_keys(t.keyed_events, "user_key", "event_id")


@query("duplicate_rows", f"""
WITH {_KEYED} SELECT event_id, user_key, kind, cents FROM (
  SELECT *, row_number() OVER (PARTITION BY s ORDER BY event_id) AS rn FROM k WHERE s <> '') WHERE rn > 1""")
def _(t):
    return dedupe.duplicate_rows(t.keyed_events, "user_key", "event_id")


given("sale_lines", """
SELECT l_orderkey * 10 + l_linenumber AS row_key,
  CASE WHEN l_orderkey % 9 = 0 THEN ' ' WHEN l_orderkey % 9 = 1 THEN l_returnflag || '/' || l_linestatus ELSE l_returnflag || ':' || l_linestatus END AS city,
  CASE l_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'n/a' WHEN 2 THEN '￥' || cents
    WHEN 3 THEN '¥1,' || substr(cents, length(cents) - 2, 3) ELSE cents END AS amount,
  CASE WHEN l_partkey % 4 = 0 THEN '' ELSE CAST(l_partkey AS STRING) END AS sku
FROM (SELECT *, CAST(CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS STRING) AS cents FROM lineitem) q""")


@query("group_summary", f"""
SELECT CASE WHEN trim(city) = '' THEN '(空)' ELSE trim(city) END AS city, count(*) AS "行数",
  CAST(round(sum(coalesce({sql_number("translate(amount, ',¥$', '')")}, 0)), 2) AS DOUBLE) AS "amount_合计",
  count(*) FILTER (sku <> '') AS "sku_非空数", min(row_key) AS first_at FROM sale_lines GROUP BY 1""")
def _(t):
    return summary.group_summary(t.sale_lines, "city", "row_key", ["amount"], ["sku"])


@query("group_single_sum", f"""
SELECT CASE WHEN trim(city) = '' THEN '（空）' ELSE trim(city) END AS city, count(*) AS "条数",
  CAST(round(sum(coalesce({sql_number("translate(amount, ',', '')")}, 0)), 2) AS DOUBLE) AS "amount_合计",
  min(row_key) AS first_at FROM sale_lines GROUP BY 1""")
def _(t):
    return summary.group_single_sum(t.sale_lines, "city", "row_key", "amount")


@query("split_manifest", """
SELECT regexp_replace(CASE WHEN trim(city) = '' THEN '(空)' ELSE trim(city) END, '[\\\\/:*?"<>|]', '_', 'g') AS part,
  count(*) AS n_rows FROM sale_lines GROUP BY 1""")
def _(t):
    return summary.split_manifest(t.sale_lines, "city")


@query("archive_manifest", """
SELECT CAST(day AS VARCHAR) AS process_date, regexp_replace(status || ':' || channel, '[\\\\/:*?"<>|]', '_', 'g') AS part,
  count(*) AS n_rows FROM facts GROUP BY 1, 2""")
def _(t):
    return summary.archive_manifest(t.facts.withColumn("c", F.concat("status", F.lit(":"), "channel")), "day", "c")


given("mixed_cells", """
SELECT o_orderkey AS row_key, CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN o_orderstatus || '-' || CAST(o_custkey AS STRING)
  WHEN 2 THEN '1,' || lpad(CAST(o_custkey % 1000 AS STRING), 3, '0') WHEN 3 THEN '-' || CAST(o_custkey AS STRING)
  WHEN 4 THEN ' ' || CAST(o_custkey AS STRING) || '.5' ELSE CASE WHEN o_custkey % 2 = 0 THEN '张三' ELSE '阿明' END END AS cell
FROM orders""")


def _position_sql(down: str, collate: str = "") -> str:
    return f"""
SELECT row_key, cell, row_number() OVER (ORDER BY is_text {down}, num {down}, txt {collate} {down}, row_key) AS position
FROM (SELECT *, num IS NULL AS is_text, CASE WHEN num IS NULL THEN trim(cell) END AS txt
      FROM (SELECT *, {sql_number("translate(trim(cell), ',', '')")} AS num FROM mixed_cells))"""


def _positions(t, descending=False, locale=None):
    return summary.number_mixed(t.mixed_cells, "cell", "row_key", "position", descending, locale)


@query("sort_mixed", _position_sql(""))
def _(t):
    return _positions(t)


@query("sort_mixed_descending", _position_sql("DESC"))
def _(t):
    return _positions(t, True)


@query("sort_locale", _position_sql("", "COLLATE zh"))
def _(t):
    return _positions(t, locale="zh")


@query("samples_first", "SELECT row_key, cell FROM mixed_cells ORDER BY row_key LIMIT 10")
def _(t):
    return summary.bounded_sample(t.mixed_cells, "row_key", 10)[0]


@query("samples_rest", "SELECT greatest(count(*) - 10, 0) AS n_rest FROM mixed_cells")
def _(t):
    return summary.bounded_sample(t.mixed_cells, "row_key", 10)[1]


@query("sequence_ids", """
SELECT o_orderkey, 'ORD-20260924-' || CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END AS order_id
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders)""")
def _(t):
    return forms.number_rows(t.orders.select("o_orderkey"), "o_orderkey", "ORD", "2026-09-24")


@query("category_index", """
SELECT path, category, row_number() OVER (PARTITION BY category ORDER BY path) AS index_no
FROM (SELECT CASE WHEN p_partkey % 9 > 0 THEN p_type END AS category, p_brand || '/' || p_name || '-' || CAST(p_partkey AS VARCHAR) AS path FROM part)""")
def _(t):
    paths = t.part.select(F.when(F.col("p_partkey") % 9 > 0, F.col("p_type")).alias("category"),
                          F.concat("p_brand", F.lit("/"), "p_name", F.lit("-"), F.col("p_partkey").cast("string")).alias("path"))
    return order.dense_number(paths, ["path"], "index_no", ["category"])


@query("merge_schema_union", """
SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_mktsegment AS segment, '' AS nation FROM customer
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name, '', CAST(s_nationkey AS VARCHAR) FROM supplier""")
def _(t):
    return exports.merge_exports([
        t.customer.selectExpr("c_custkey AS id", "c_name AS name", "c_mktsegment AS segment"),
        t.supplier.selectExpr("s_suppkey AS id", "s_name AS name", "s_nationkey AS nation")])


@query("alias_columns", "SELECT s_suppkey AS sku, s_name AS title, s_nationkey FROM supplier")
def _(t):
    return exports.alias_columns(t.supplier.select("s_suppkey", F.col("s_name").alias(" 商品名 "), "s_nationkey"),
                                 {"s_suppkey": "sku", "商品名": "title"})


given("holed_rows", """
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN ' ' ELSE event_type END AS a, CASE WHEN event_id % 6 < 3 THEN '' ELSE props END AS b,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'x' END AS c FROM events""")


@query("all_blank_filter", """
SELECT event_id, a, b, c FROM holed_rows WHERE trim(a) <> '' OR b <> '' OR coalesce(c, '') <> ''""")
def _(t):
    return quality.drop_blank_rows(t.holed_rows, ["a", "b", "c"])


_MISSING = "concat_ws('、', CASE WHEN trim(a) = '' THEN 'a' END, CASE WHEN b = '' THEN 'b' END, CASE WHEN coalesce(c, '') = '' THEN 'c' END)"


@query("required_valid", f"SELECT event_id, a, b, c FROM holed_rows WHERE {_MISSING} = ''")
def _(t):
    return quality.require(t.holed_rows, ["a", "b", "c"])[0]


@query("required_rejected", f"SELECT event_id, a, b, c, '缺少必填：' || {_MISSING} AS reason FROM holed_rows WHERE {_MISSING} <> ''")
def _(t):
    return quality.require(t.holed_rows, ["a", "b", "c"])[1]


@query("missing_key", "SELECT event_id, a, b, c, '缺主键「a」' AS reason FROM holed_rows WHERE trim(a) = ''")
def _(t):
    return quality.split_missing_key(t.holed_rows, "a")[1]


given("form_rows", """
SELECT o.o_orderkey AS row_key, n.n_name AS city, o.o_orderstatus AS status, o.o_orderpriority AS note,
  CASE o.o_orderkey % 5 WHEN 0 THEN '¥' || w WHEN 1 THEN w || '元' WHEN 2 THEN '' WHEN 3 THEN '面议' ELSE ' ' || w || '.50' END AS amount,
  '客户' || CAST(c.c_custkey % 700 AS STRING) AS name,
  CASE WHEN o.o_orderkey % 13 = 0 THEN ' ' ELSE '+86 138' || lpad(CAST(c.c_custkey % 700 AS STRING), 8, '0') END AS phone,
  '商品' || CAST(o.o_orderkey % 3 AS STRING) AS product
FROM (SELECT *, CAST(CAST(FLOOR(o_totalprice) AS BIGINT) AS STRING) AS w FROM orders) o
  JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey""")

_AMOUNT = sql_form_number("amount")
PREDICATES = {
    "gt": ("amount", "gt", "100,000", f"coalesce({_AMOUNT} > 100000, false)"),
    "gte": ("amount", "gte", 200000, f"coalesce({_AMOUNT} >= 200000, false)"),
    "lt": ("amount", "lt", "¥50000", f"coalesce({_AMOUNT} < 50000, false)"),
    "lte": ("amount", "lte", 150000, f"coalesce({_AMOUNT} <= 150000, false)"),
    "equals": ("status", "equals", " F ", "status = 'F'"),
    "contains": ("note", "contains", "HIGH", "contains(note, 'HIGH')"),
    "in_list": ("city", "in", ["NATION_1", " NATION_7"], "city IN ('NATION_1', 'NATION_7')"),
    "regex": ("note", "regex", "^[12]-", "regexp_matches(note, '^[12]-')"),
    "bad_regex": ("note", "regex", "([", "false"),
    "not_empty": ("phone", "not_empty", None, "trim(phone) <> ''"),
    "unknown": ("phone", "almost", "x", "false"),
    "no_column": ("ghost", "equals", "", "true"),
}


@query("predicates", "SELECT row_key, " + ", ".join(f"{p[3]} AS p_{n}" for n, p in PREDICATES.items()) + " FROM form_rows")
def _(t):
    df = t.form_rows
    return df.select("row_key", *[rules.predicate(f, op, v, df.columns).alias(f"p_{n}")
                                  for n, (f, op, v, _) in PREDICATES.items()])


ROUTING = [
    {"name": "大客户", "priority": "high", "owner": "负责人A", "match": [{"field": "amount", "op": "gte", "value": 300000}]},
    {"name": "华东区", "priority": "normal", "owner": "负责人B", "match": [
        {"field": "city", "op": "in", "value": ["NATION_1", "NATION_3", "NATION_5"]}, {"field": "status", "op": "equals", "value": "F"}]},
    {"name": "售后咨询", "priority": "low", "owner": "客服组", "match": [{"field": "note", "op": "regex", "value": "LOW$"}]},
]
_ROUTED = f"""
routed AS (SELECT *, CASE WHEN coalesce({_AMOUNT} >= 300000, false) THEN 1
    WHEN city IN ('NATION_1', 'NATION_3', 'NATION_5') AND status = 'F' THEN 2 WHEN regexp_matches(note, 'LOW$') THEN 3 ELSE 4 END AS r,
    {_AMOUNT} AS n FROM form_rows),
tagged AS (SELECT *, (['大客户', '华东区', '售后咨询', '待分配'])[r] AS category, (['负责人A', '负责人B', '客服组', '客服组'])[r] AS owner,
  (['high', 'normal', 'low', 'low'])[r] AS priority FROM routed)"""


@query("route_rows", f"WITH {_ROUTED} SELECT row_key, category, owner, priority FROM tagged")
def _(t):
    return rules.route(t.form_rows, ROUTING).select("row_key", "category", "owner", "priority")


@query("route_summary", f"""
WITH {_ROUTED} SELECT category, count(*) AS n_rows, min(owner) AS owner, min(priority) AS priority,
  CAST(sum(coalesce(n, 0)) AS DOUBLE) AS total FROM tagged GROUP BY category""")
def _(t):
    return rules.route_summary(rules.route(t.form_rows, ROUTING), "amount")


@query("urgent_rows", f"""
WITH {_ROUTED} SELECT row_key, name, product, amount, owner FROM tagged WHERE priority = 'high'
ORDER BY coalesce(n, 0) DESC, row_key LIMIT 10""")
def _(t):
    return rules.urgent(rules.route(t.form_rows, ROUTING), "amount", "row_key").select(
        "row_key", "name", "product", "amount", "owner")


_FORM_CLEAN = f"""
cleaned AS (SELECT row_key, name, product, city, status, note,
  CASE WHEN d LIKE '86%' AND length(d) = 13 THEN substr(d, 3) ELSE d END AS phone,
  CASE WHEN n IS NULL THEN trim(amount) WHEN abs(n - round(n, 0)) < 1e-9 THEN CAST(CAST(n AS BIGINT) AS VARCHAR)
    ELSE CAST(CAST(round(n, 2) AS DECIMAL(38,2)) AS VARCHAR) END AS amount
  FROM (SELECT *, regexp_replace(phone, '[^0-9]', '', 'g') AS d, {_AMOUNT} AS n FROM form_rows)),
valid AS (SELECT *, row_number() OVER (PARTITION BY phone, product ORDER BY row_key DESC) AS rn,
  min(row_key) OVER (PARTITION BY phone, product) AS position FROM cleaned WHERE phone <> '' AND amount <> ''),
form_last AS (SELECT * FROM valid WHERE rn = 1)"""


@query("form_job", f"""
WITH {_FORM_CLEAN}
SELECT row_key, name, product, city, phone, amount,
  'ORD-20260901-' || CASE WHEN k < 10000 THEN lpad(CAST(k AS VARCHAR), 4, '0') ELSE CAST(k AS VARCHAR) END AS order_id,
  CASE WHEN coalesce(n >= 300000, false) THEN '大客户' WHEN city IN ('NATION_1', 'NATION_3', 'NATION_5') AND status = 'F' THEN '华东区'
    WHEN regexp_matches(note, 'LOW$') THEN '售后咨询' ELSE '待分配' END AS category
FROM (SELECT *, row_number() OVER (ORDER BY position) AS k, {_AMOUNT} AS n FROM form_last)""")
def _(t):
    routed, _ = forms.route_forms(t.form_rows, ["name", "phone", "amount"], ["phone", "product"], ROUTING, "row_key",
                                  "2026-09-01")
    return routed.select("row_key", "name", "product", "city", "phone", "amount", "order_id", "category")


@query("form_job_rejects", f"""
WITH {_FORM_CLEAN} SELECT row_key, '缺少必填：' || concat_ws('、', CASE WHEN phone = '' THEN 'phone' END,
  CASE WHEN amount = '' THEN 'amount' END) AS reason FROM cleaned WHERE phone = '' OR amount = ''""")
def _(t):
    _, rejected = forms.route_forms(t.form_rows, ["name", "phone", "amount"], ["phone", "product"], ROUTING, "row_key",
                                    "2026-09-01")
    return rejected.select("row_key", "reason")


STEP_LIST = [
    {"action": "clean", "columns": ["name", "phone", "amount"]},
    {"action": "dedupe", "key": "phone", "keep": "first"},
    {"action": "group", "by": "product", "sum": ["amount"], "count": ["phone"], "output": "summary.csv"},
    {"action": "polish"},
    {"action": "sort", "by": "amount", "order": "desc"},
    {"action": "split", "by": "city", "output_dir": "by_city"},
    {"action": "dedupe", "key": "ghost"},
]
_STEPS = f"""
cleaned AS (SELECT row_key, name, city, product, regexp_replace(phone, '[^0-9]', '', 'g') AS phone,
  CASE WHEN v = '' THEN '' WHEN n IS NULL THEN s WHEN n = floor(n) THEN CAST(CAST(n AS BIGINT) AS VARCHAR)
    ELSE regexp_replace(CAST(CAST(round(n, 2) AS DECIMAL(38,2)) AS VARCHAR), '0$', '') END AS amount
  FROM (SELECT *, {sql_number('v')} AS n FROM (SELECT *, {sql_strip('amount')} AS s, translate({sql_strip('amount')}, ',¥￥$ ', '') AS v FROM form_rows))),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY phone ORDER BY row_key) AS rn FROM cleaned) WHERE phone = '' OR rn = 1)"""


def _run(t):
    rows = t.form_rows.select("row_key", "name", "city", "product", "phone", "amount")
    return steps.run_steps(STEP_LIST, rows, order_by="row_key")


@query("table_steps", f"WITH {_STEPS} SELECT row_key, name, city, product, phone, amount FROM kept")
def _(t):
    return _run(t).table.drop(steps.ORDINAL)


@query("table_steps_groups", f"""
WITH {_STEPS} SELECT product, count(*) AS "行数", CAST(round(sum(coalesce({sql_number("translate(amount, ',¥$', '')")}, 0)), 2) AS DOUBLE) AS "amount_合计",
  count(*) FILTER (phone <> '') AS "phone_非空数" FROM kept GROUP BY product""")
def _(t):
    return _run(t).side["summary.csv"].drop("first_at")


@query("table_steps_split", f"WITH {_STEPS} SELECT city AS part, count(*) AS n_rows FROM kept GROUP BY city")
def _(t):
    return _run(t).side["by_city"]


given("checks", """
SELECT event_id, user_id, ts, 'site ' || CAST(user_id AS STRING) AS target,
  CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 302 ELSE 200 END AS status, props AS body,
  CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN '"k"' ELSE '7' END AS keyword, event_type <> 'error' AS ok,
  CAST(FLOOR(value * 10) AS BIGINT) AS ms FROM events""")


@query("check_expectation", """
SELECT event_id, CASE WHEN keyword <> '' THEN s AND contains(body, keyword) ELSE s END AS ok,
  CASE WHEN keyword <> '' THEN contains(body, keyword) END AS keyword_hit,
  CASE WHEN keyword <> '' AND s AND NOT contains(body, keyword) THEN '页面里找不到关键词「' || keyword || '」'
    WHEN keyword = '' AND NOT s THEN '状态码 ' || CAST(status AS VARCHAR) || '，期望 200/302' ELSE '' END AS error
FROM (SELECT *, status IN (200, 302) AS s FROM checks)""")
def _(t):
    accepted = F.array(F.lit(200), F.lit(302))
    return t.checks.select("event_id", rules.check_result("status", "body", "keyword", accepted).alias("r")).select(
        "event_id", "r.*")


@query("name_filter", "SELECT event_id, target FROM checks WHERE contains(target, '1')")
def _(t):
    return rules.name_filter(t.checks, "target", "1").select("event_id", "target")
