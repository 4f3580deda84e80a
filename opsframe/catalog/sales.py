"""Daily figures from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsframe.catalog.normalizing import sql_kpi_number
from opsframe.catalog.registry import given, query
from opsframe.operators import kpi, quality

given("facts", """
SELECT o_orderkey AS row_key, CAST(o_orderdate AS DATE) AS day, CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
  CASE WHEN o_orderkey % 17 = 0 THEN '  ' ELSE o_orderpriority END AS channel, o_orderstatus AS status
FROM orders""")

_DAILY = """
daily AS (SELECT day, CAST(sum(amount) AS DOUBLE) AS total, count(*) AS n_orders,
  CAST(sum(amount) AS DOUBLE) / count(*) AS avg_amount FROM facts GROUP BY day)"""


def _daily(t):
    return kpi.daily_kpis(t.facts, "day", "amount")


@query("daily_kpis", f"WITH {_DAILY} SELECT CAST(day AS VARCHAR) AS day, total, n_orders, avg_amount FROM daily")
def _(t):
    return _daily(t)


def _compare_sql(join: str) -> str:
    return f"""
SELECT CAST(c.day AS VARCHAR) AS day, c.total, c.n_orders, c.avg_amount, CAST(p.day AS VARCHAR) AS prev_day,
  p.total AS prev_total, p.n_orders AS prev_orders,
  CASE WHEN p.total <> 0 THEN (c.total - p.total) / abs(p.total) * 100 END AS total_pct,
  c.n_orders - p.n_orders AS orders_delta,
  CASE WHEN p.avg_amount <> 0 THEN (c.avg_amount - p.avg_amount) / abs(p.avg_amount) * 100 END AS avg_pct
{join}"""


_PREVIOUS = _compare_sql("""
FROM (SELECT *, lag(day) OVER (ORDER BY day) AS before FROM daily) c LEFT JOIN daily p ON p.day = c.before""")


@query("kpi_previous_day", f"WITH {_DAILY} {_PREVIOUS}")
def _(t):
    return kpi.compare(_daily(t))


@query("kpi_same_day_last_week", f"WITH {_DAILY} " + _compare_sql(
    "FROM daily c LEFT JOIN daily p ON p.day = c.day - 7"))
def _(t):
    return kpi.compare(_daily(t), "same_day_last_week")


@query("kpi_alerts", f"""
WITH {_DAILY}, compared AS ({_PREVIOUS})
SELECT day, 'drop' AS alert, total_pct AS observed, CAST(-20 AS DOUBLE) AS threshold FROM compared WHERE total_pct <= -20
UNION ALL SELECT day, 'rise', total_pct, CAST(50 AS DOUBLE) FROM compared WHERE total_pct >= 50
UNION ALL SELECT day, 'min_amount', total, CAST(300000 AS DOUBLE) FROM compared WHERE total < 300000
UNION ALL SELECT day, 'min_orders', CAST(n_orders AS DOUBLE), CAST(2 AS DOUBLE) FROM compared WHERE n_orders < 2""")
def _(t):
    return kpi.kpi_alerts(kpi.compare(_daily(t)), 20, 50, 300000, 2)


given("busy_facts", "SELECT * FROM facts WHERE extract(day FROM day) <> 13")


@query("kpi_calendar_alerts", """
WITH daily AS (SELECT day, CAST(sum(amount) AS DOUBLE) AS total, count(*) AS n_orders FROM busy_facts GROUP BY day),
days AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM daily), (SELECT max(day) FROM daily), INTERVAL 1 DAY)) AS DATE) AS day),
filled AS (SELECT s.day, coalesce(d.total, 0) AS total, coalesce(d.n_orders, 0) AS n_orders,
  (SELECT max(e.day) FROM daily e WHERE e.day < s.day) AS before FROM days s LEFT JOIN daily d ON d.day = s.day),
compared AS (SELECT f.day, f.n_orders, CASE WHEN p.total <> 0 THEN (f.total - p.total) / abs(p.total) * 100 END AS pct
  FROM filled f LEFT JOIN daily p ON p.day = f.before)
SELECT CAST(day AS VARCHAR) AS day, 'no_data' AS alert, CAST(n_orders AS DOUBLE) AS observed, CAST(0 AS DOUBLE) AS threshold
FROM compared WHERE n_orders = 0
UNION ALL SELECT CAST(day AS VARCHAR), 'drop', pct, CAST(-90 AS DOUBLE) FROM compared WHERE pct <= -90""")
def _(t):
    daily = kpi.daily_kpis(t.busy_facts, "day", "amount")
    return kpi.kpi_alerts(kpi.compare(kpi.fill_calendar(daily)), 90, None)


@query("kpi_breakdown", """
WITH pairs AS (
  SELECT day, 'channel' AS field, CASE WHEN trim(channel) = '' THEN '(未填)' ELSE trim(channel) END AS value, amount FROM facts
  UNION ALL SELECT day, 'status', status, amount FROM facts),
groups AS (SELECT day, field, value, CAST(sum(amount) AS DOUBLE) AS total FROM pairs GROUP BY ALL),
whole AS (SELECT day, CAST(sum(amount) AS DOUBLE) AS day_total FROM facts GROUP BY day)
SELECT CAST(g.day AS VARCHAR) AS day, field, value, total,
  CASE WHEN day_total <> 0 THEN total / day_total * 100 ELSE 0 END AS share_pct,
  CASE WHEN total <= 0 THEN 0 ELSE greatest(CAST(round_even(total / max(total) OVER (PARTITION BY g.day, field) * 20, 0) AS BIGINT), 1) END AS bar
FROM groups g JOIN whole w ON w.day = g.day""")
def _(t):
    return kpi.breakdown(t.facts, "day", "amount", ["channel", "status"])


@query("kpi_top_rows", """
SELECT CAST(day AS VARCHAR) AS day, rank, label, CAST(amount AS DOUBLE) AS amount FROM (
  SELECT day, CASE WHEN trim(channel) = '' THEN '(未填)' ELSE trim(channel) END AS label, amount,
    row_number() OVER (PARTITION BY day ORDER BY amount DESC, row_key) AS rank FROM facts) WHERE rank <= 5""")
def _(t):
    return kpi.top_rows(t.facts, "day", "amount", "channel", "row_key")


@query("kpi_trend", f"""
WITH {_DAILY}
SELECT CAST(day AS VARCHAR) AS day, total, n_orders,
  greatest(CAST(round_even(total / (SELECT max(total) FROM daily) * 18, 0) AS BIGINT), 1) AS bar
FROM daily ORDER BY daily.day DESC LIMIT 7""")
def _(t):
    return kpi.trend(_daily(t))


@query("history_upsert", f"""
WITH {_DAILY},
old AS (SELECT day, total + 1 AS total, n_orders FROM daily WHERE day < DATE '1998-01-01'),
fresh AS (SELECT day, total, n_orders FROM daily WHERE day >= DATE '1997-01-01')
SELECT CAST(coalesce(f.day, o.day) AS VARCHAR) AS day, coalesce(f.total, o.total) AS total,
  coalesce(f.n_orders, o.n_orders) AS n_orders FROM old o FULL JOIN fresh f ON f.day = o.day""")
def _(t):
    daily = _daily(t).select("day", "total", "n_orders")
    old = daily.filter("day < DATE'1998-01-01'").withColumn("total", F.col("total") + 1)
    return kpi.upsert_history(old, daily.filter("day >= DATE'1997-01-01'"))


@query("usable_amount", f"""
SELECT row_key, amount, CAST(v AS DOUBLE) AS amount_value
FROM (SELECT *, {sql_kpi_number('amount')} AS v FROM dirty_amounts) WHERE v IS NOT NULL""")
def _(t):
    return quality.usable_amount(t.dirty_amounts, "amount")
