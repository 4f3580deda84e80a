"""Cell normalisers, cleaning reports and presentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsframe.catalog.registry import given, query
from opsframe.functions import normalize as N
from opsframe.operators import quality

# White space as DuckDB's regular expressions must spell it out.
WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def sql_strip(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^{WS}+|{WS}+$', '', 'g')"


def sql_squeeze(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{WS}+', ' ', 'g'))"


def sql_number(x: str) -> str:
    shape = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
    return f"(CASE WHEN regexp_full_match({x}, '{shape}') THEN TRY_CAST({x} AS DECIMAL(37,9)) END)"


def sql_drop(x: str, chars: str) -> str:
    return f"translate({x}, '{chars}', '')"


def sql_form_number(x: str) -> str:
    text = f"regexp_replace(translate({sql_strip(x)}, ',，', ''), '[^0-9.\\-]', '', 'g')"
    return sql_number(text)


def sql_kpi_number(x: str) -> str:
    s = sql_strip(x)
    negative = f"({s} LIKE '(%' AND {s} LIKE '%)')"
    body = sql_drop(f"(CASE WHEN {negative} THEN substr({s}, 2, length({s}) - 2) ELSE {s} END)", "¥￥$,， %")
    return f"(CASE WHEN {negative} THEN -1 ELSE 1 END * {sql_number(body)})"


def sql_stock_number(x: str) -> str:
    s = sql_strip(x)
    bracket = f"({s} LIKE '(%' AND {s} LIKE '%)')"
    body = sql_drop(f"(CASE WHEN {bracket} THEN substr({s}, 2, length({s}) - 2) ELSE {s} END)",
                    "¥￥$,，  元件个")
    digits = f"regexp_replace(CASE WHEN {body} LIKE '-%' THEN substr({body}, 2) ELSE {body} END, '[^0-9eE+\\-.]', '', 'g')"
    empty = f"{body} IN ('', '-', '--', '—', 'N/A', 'null', 'None')"
    sign = f"CASE WHEN {bracket} OR {body} LIKE '-%' THEN -1 ELSE 1 END"
    return f"(CASE WHEN NOT ({empty}) THEN {sign} * {sql_number(digits)} END)"


given("dirty_phones", """
SELECT c_custkey AS row_key, CASE c_custkey % 9
  WHEN 0 THEN d
  WHEN 1 THEN substr(d, 1, 3) || ' ' || substr(d, 4, 4) || ' ' || substr(d, 8, 4)
  WHEN 2 THEN '+86-' || substr(d, 1, 3) || '-' || substr(d, 4, 4) || '-' || substr(d, 8, 4)
  WHEN 3 THEN ''
  WHEN 4 THEN substr(d, 1, 8)
  WHEN 5 THEN '86' || d
  WHEN 6 THEN 'tel: ' || d || ' ext'
  WHEN 7 THEN 'n/a'
  ELSE '　' || substr(d, 1, 5) || ' ' END AS phone
FROM (SELECT c_custkey, '1' || lpad(CAST((c_custkey * 7919 + 3000000000) % 10000000000 AS STRING), 10, '0') AS d
      FROM customer) q""")


@query("clean_phone_digits11", """
SELECT row_key, d AS value, (d = '' OR length(d) = 11) AS ok
FROM (SELECT row_key, regexp_replace(phone, '[^0-9]', '', 'g') AS d FROM dirty_phones)""")
def _(t):
    c = N.table_phone("phone")
    return t.dirty_phones.select("row_key", c.value.alias("value"), c.ok.alias("ok"))


@query("clean_phone_cn86", """
SELECT row_key, CASE WHEN d LIKE '86%' AND length(d) = 13 THEN substr(d, 3) ELSE d END AS value
FROM (SELECT row_key, regexp_replace(phone, '[^0-9]', '', 'g') AS d FROM dirty_phones)""")
def _(t):
    return t.dirty_phones.select("row_key", N.form_phone("phone").alias("value"))


@query("clean_phone_mobile", f"""
SELECT row_key, CASE WHEN regexp_full_match(d, '1[3-9][0-9]{{9}}') OR length(d) BETWEEN 7 AND 12 THEN d ELSE s END AS value
FROM (SELECT row_key, {sql_strip('phone')} AS s, regexp_replace(phone, '[^0-9]', '', 'g') AS d FROM dirty_phones)""")
def _(t):
    return t.dirty_phones.select("row_key", N.web_phone("phone").alias("value"))


given("dirty_emails", """
SELECT c_custkey AS row_key, CASE c_custkey % 6
  WHEN 0 THEN c_name || '@Example.COM'
  WHEN 1 THEN '  ' || c_name || '@example.com '
  WHEN 2 THEN c_name || ' @ example.com'
  WHEN 3 THEN c_name
  WHEN 4 THEN ''
  ELSE c_name || '@nodomain' END AS email
FROM customer""")


@query("clean_email_table", f"""
SELECT row_key, v AS value, (v = '' OR regexp_full_match(v, '[^@\\s]+@[^@\\s]+\\.[^@\\s]+')) AS ok
FROM (SELECT row_key, lower(replace({sql_strip('email')}, ' ', '')) AS v FROM dirty_emails)""")
def _(t):
    c = N.table_email("email")
    return t.dirty_emails.select("row_key", c.value.alias("value"), c.ok.alias("ok"))


@query("clean_email_form", f"SELECT row_key, replace(lower({sql_strip('email')}), ' ', '') AS value FROM dirty_emails")
def _(t):
    return t.dirty_emails.select("row_key", N.form_email("email").alias("value"))


@query("clean_email_web", f"""
SELECT row_key, CASE WHEN contains(s, '@') THEN lower(s) ELSE s END AS value
FROM (SELECT row_key, {sql_strip('email')} AS s FROM dirty_emails)""")
def _(t):
    return t.dirty_emails.select("row_key", N.web_email("email").alias("value"))


given("dirty_amounts", """
SELECT o_orderkey AS row_key, CASE o_orderkey % 13
  WHEN 0 THEN w || '.' || f
  WHEN 1 THEN '¥' || w || '.' || f
  WHEN 2 THEN CASE WHEN length(w) > 3 THEN substr(w, 1, length(w) - 3) || ',' || substr(w, length(w) - 2, 3)
              ELSE w END || '.' || f
  WHEN 3 THEN '(' || w || '.' || f || ')'
  WHEN 4 THEN w || '元'
  WHEN 5 THEN '　' || w || ' '
  WHEN 6 THEN ''
  WHEN 7 THEN 'N/A'
  WHEN 8 THEN '-' || w || '.' || f
  WHEN 9 THEN '￥' || w || '.50'
  WHEN 10 THEN w || '.' || f || '%'
  WHEN 11 THEN '待定'
  ELSE f || '件' END AS amount
FROM (SELECT o_orderkey, CAST(CAST(FLOOR(c / 100) AS BIGINT) AS STRING) AS w, lpad(CAST(c % 100 AS STRING), 2, '0') AS f
      FROM (SELECT o_orderkey, CAST(ROUND(o_totalprice * 100) AS BIGINT) AS c FROM orders) p) q""")


@query("clean_amount_table", f"""
SELECT row_key, CASE WHEN v = '' THEN '' WHEN n IS NULL THEN s
    WHEN n = floor(n) THEN CAST(CAST(n AS BIGINT) AS VARCHAR)
    ELSE regexp_replace(CAST(CAST(round(n, 2) AS DECIMAL(38,2)) AS VARCHAR), '0$', '') END AS value,
  (v = '' OR n IS NOT NULL) AS ok
FROM (SELECT row_key, s, v, {sql_number('v')} AS n
      FROM (SELECT row_key, {sql_strip('amount')} AS s, translate({sql_strip('amount')}, ',¥￥$ ', '') AS v
            FROM dirty_amounts))""")
def _(t):
    c = N.table_amount("amount")
    return t.dirty_amounts.select("row_key", c.value.alias("value"), c.ok.alias("ok"))


@query("clean_amount_form", f"""
SELECT row_key, CASE WHEN n IS NULL THEN s WHEN abs(n - round(n, 0)) < 1e-9 THEN CAST(CAST(n AS BIGINT) AS VARCHAR)
    ELSE CAST(CAST(round(n, 2) AS DECIMAL(38,2)) AS VARCHAR) END AS value
FROM (SELECT row_key, {sql_strip('amount')} AS s, {sql_form_number('amount')} AS n FROM dirty_amounts)""")
def _(t):
    return t.dirty_amounts.select("row_key", N.form_amount("amount").alias("value"))


@query("clean_amount_kpi", f"SELECT row_key, CAST({sql_kpi_number('amount')} AS DOUBLE) AS value FROM dirty_amounts")
def _(t):
    return t.dirty_amounts.select("row_key", N.kpi_number("amount").alias("value"))


@query("clean_amount_stock", f"SELECT row_key, CAST({sql_stock_number('amount')} AS DOUBLE) AS value FROM dirty_amounts")
def _(t):
    return t.dirty_amounts.select("row_key", N.stock_number("amount").alias("value"))


@query("clean_amount_web", f"""
SELECT row_key, CASE WHEN v = '' THEN '' WHEN n IS NULL THEN s
    ELSE regexp_replace(regexp_replace(CAST(n AS VARCHAR), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') END AS value
FROM (SELECT row_key, s, v, {sql_number('v')} AS n
      FROM (SELECT row_key, {sql_strip('amount')} AS s,
                   regexp_replace({sql_strip('amount')}, '[,￥¥$元]|{WS}', '', 'g') AS v FROM dirty_amounts))""")
def _(t):
    return t.dirty_amounts.select("row_key", N.web_amount("amount").alias("value"))


given("dirty_dates", """
SELECT o_orderkey AS row_key, CASE o_orderkey % 11
  WHEN 0 THEN y || '-' || m || '-' || d
  WHEN 1 THEN y || '/' || CAST(CAST(m AS INT) AS STRING) || '/' || CAST(CAST(d AS INT) AS STRING)
  WHEN 2 THEN y || '.' || m || '.' || d
  WHEN 3 THEN y || '年' || CAST(CAST(m AS INT) AS STRING) || '月' || CAST(CAST(d AS INT) AS STRING) || '日'
  WHEN 4 THEN y || m || d
  WHEN 5 THEN CAST(34700 + o_orderkey % 2000 AS STRING)
  WHEN 6 THEN y || '-02-30'
  WHEN 7 THEN ''
  WHEN 8 THEN y || '-' || m || '-' || d || ' 10:20:30'
  WHEN 9 THEN y || '-' || m || '/' || d
  ELSE 'unknown' END AS day_text
FROM (SELECT o_orderkey, substr(s, 1, 4) AS y, substr(s, 6, 2) AS m, substr(s, 9, 2) AS d
      FROM (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS STRING) AS s FROM orders) p) q""")


def sql_strict_date(s: str) -> str:
    parts = [r"([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})", r"([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})",
             r"([0-9]{4})\.([0-9]{1,2})\.([0-9]{1,2})", r"([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日",
             r"([0-9]{4})([0-9]{2})([0-9]{2})"]
    whens = " ".join(
        f"WHEN regexp_full_match({s}, '{p}') THEN TRY_CAST({sql_iso(s, '^' + p + '$')} AS DATE)" for p in parts)
    return f"(CASE {whens} END)"


def sql_iso(s: str, p: str) -> str:
    return (f"regexp_extract({s}, '{p}', 1) || '-' || lpad(regexp_extract({s}, '{p}', 2), 2, '0') || '-' || "
            f"lpad(regexp_extract({s}, '{p}', 3), 2, '0')")


@query("clean_date_table", f"""
SELECT row_key, coalesce(CAST({sql_strict_date('v')} AS VARCHAR), s) AS value,
  (v = '' OR {sql_strict_date('v')} IS NOT NULL) AS ok
FROM (SELECT row_key, {sql_strip('day_text')} AS s, replace({sql_strip('day_text')}, ' ', '') AS v FROM dirty_dates)""")
def _(t):
    c = N.table_date("day_text")
    return t.dirty_dates.select("row_key", c.value.alias("value"), c.ok.alias("ok"))


def _prefix_sql(p: str) -> str:
    packed = "^([0-9]{4})([0-9]{2})([0-9]{2})$"
    return f"""
SELECT row_key, CASE WHEN regexp_matches(s, '{p}') THEN {sql_iso('s', p)}
    WHEN regexp_matches(s, '{packed}') THEN {sql_iso('s', packed)} ELSE s END AS value
FROM (SELECT row_key, {sql_strip('day_text')} AS s FROM dirty_dates)"""


@query("clean_date_form", _prefix_sql("^([0-9]{4})[-/.年]([0-9]{1,2})[-/.月]([0-9]{1,2})"))
def _(t):
    return t.dirty_dates.select("row_key", N.form_date("day_text").alias("value"))


@query("clean_date_web", _prefix_sql("^([0-9]{4})[^0-9]([0-9]{1,2})[^0-9]([0-9]{1,2})"))
def _(t):
    return t.dirty_dates.select("row_key", N.web_date("day_text").alias("value"))


@query("clean_date_kpi", f"""
SELECT row_key, CAST(coalesce({sql_strict_date('v')},
  CASE WHEN regexp_full_match(v, '[0-9]{{5}}') THEN DATE '1899-12-30' + TRY_CAST(v AS INTEGER) END) AS VARCHAR) AS value
FROM (SELECT row_key, split_part(split_part({sql_strip('day_text')}, ' ', 1), 'T', 1) AS v FROM dirty_dates)""")
def _(t):
    return t.dirty_dates.select("row_key", N.kpi_date("day_text").alias("value"))


@query("clean_text", f"""
SELECT doc_id, {sql_squeeze('text')} AS value, lower({sql_squeeze('text')}) AS folded FROM documents""")
def _(t):
    return t.documents.select("doc_id", N.text("text").alias("value"), N.text("text", True).alias("folded"))


given("dirty_forms", """
SELECT a.row_key, '客户' || CAST(a.row_key AS STRING) || '  甲' AS name, p.phone AS phone, e.email AS email,
  a.amount AS amount, d.day_text AS order_date
FROM dirty_amounts a JOIN dirty_dates d ON a.row_key = d.row_key JOIN orders o ON a.row_key = o.o_orderkey
  JOIN dirty_phones p ON o.o_custkey = p.row_key JOIN dirty_emails e ON o.o_custkey = e.row_key""")

_CLEANED = f"""
cleaned AS (SELECT row_key, name, phone, email, amount, order_date,
  {sql_squeeze('name')} AS name2,
  regexp_replace(phone, '[^0-9]', '', 'g') AS phone2,
  lower(replace({sql_strip('email')}, ' ', '')) AS email2,
  {sql_strip('amount')} AS amount_s, translate({sql_strip('amount')}, ',¥￥$ ', '') AS amount_v,
  {sql_strip('order_date')} AS date_s, replace({sql_strip('order_date')}, ' ', '') AS date_v FROM dirty_forms),
judged AS (SELECT *, {sql_number('amount_v')} AS amount_n, {sql_strict_date('date_v')} AS date_d FROM cleaned),
done AS (SELECT *, CASE WHEN amount_v = '' THEN '' WHEN amount_n IS NULL THEN amount_s
    WHEN amount_n = floor(amount_n) THEN CAST(CAST(amount_n AS BIGINT) AS VARCHAR)
    ELSE regexp_replace(CAST(CAST(round(amount_n, 2) AS DECIMAL(38,2)) AS VARCHAR), '0$', '') END AS amount2,
  coalesce(CAST(date_d AS VARCHAR), date_s) AS date2 FROM judged)"""

_REPORT = """
report AS (
SELECT 'name' AS "column", 'text' AS kind, CAST(0 AS BIGINT) AS n_invalid, count(*) FILTER (name2 <> name) AS n_changed FROM done
UNION ALL SELECT 'phone', 'phone', count(*) FILTER (NOT (phone2 = '' OR length(phone2) = 11)), count(*) FILTER (phone2 <> phone) FROM done
UNION ALL SELECT 'email', 'email', count(*) FILTER (NOT (email2 = '' OR regexp_full_match(email2, '[^@\\s]+@[^@\\s]+\\.[^@\\s]+'))),
  count(*) FILTER (email2 <> email) FROM done
UNION ALL SELECT 'amount', 'amount', count(*) FILTER (NOT (amount_v = '' OR amount_n IS NOT NULL)), count(*) FILTER (amount2 <> amount) FROM done
UNION ALL SELECT 'order_date', 'date', count(*) FILTER (NOT (date_v = '' OR date_d IS NOT NULL)), count(*) FILTER (date2 <> order_date) FROM done)"""

FORM_COLUMNS = ["name", "phone", "email", "amount", "order_date"]


@query("clean_table", f"""
WITH {_CLEANED} SELECT row_key, name2 AS name, phone2 AS phone, email2 AS email, amount2 AS amount, date2 AS order_date
FROM done""")
def _(t):
    return quality.clean(t.dirty_forms, FORM_COLUMNS)


@query("clean_report", f"WITH {_CLEANED}, {_REPORT} SELECT * FROM report")
def _(t):
    return quality.clean_report(t.dirty_forms, FORM_COLUMNS)


@query("changed_cells", f"""
SELECT count(*) FILTER ({sql_strip('phone')} <> phone) + count(*) FILTER ({sql_strip('email')} <> email)
  + count(*) FILTER ({sql_strip('amount')} <> amount) AS n_changed FROM dirty_forms""")
def _(t):
    from opsframe.functions.text import strip

    return quality.changed_cells(t.dirty_forms, {c: strip(c) for c in ("phone", "email", "amount")})


@query("quality_report", f"""
WITH {_CLEANED}, {_REPORT},
keys AS (SELECT {sql_strip('phone')} AS k FROM dirty_forms)
SELECT 'forms' AS table_name, 'invalid' AS check_name, "column" AS column_name, n_invalid AS n FROM report
UNION ALL SELECT 'forms', 'missing_key', 'phone', count(*) FILTER (k = '') FROM keys
UNION ALL SELECT 'forms', 'duplicate', 'phone', coalesce(CAST(sum(n - 1) AS BIGINT), 0)
  FROM (SELECT k, count(*) AS n FROM keys WHERE k <> '' GROUP BY k HAVING count(*) > 1)""")
def _(t):
    return quality.quality_report(t.dirty_forms, "forms", FORM_COLUMNS, "phone", "row_key")


given("signed_cents", """
SELECT o_orderkey AS row_key, CAST(CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN -c ELSE c END AS BIGINT) AS cents
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN CAST(ROUND(o_totalprice) AS BIGINT) * 100
      ELSE CAST(ROUND(o_totalprice * 100) AS BIGINT) END AS c FROM orders) q""")


@query("show_figures", r"""
SELECT row_key, coalesce(format('{:,.2f}', v), '-') AS money,
  coalesce(CASE WHEN p < 0 THEN '' ELSE '+' END || CAST(p AS VARCHAR) || '%', '-') AS percent,
  coalesce(CASE WHEN cents % 100 = 0 THEN format('{:,}', CAST(cents // 100 AS BIGINT)) ELSE format('{:,.2f}', v) END, '-') AS number
FROM (SELECT row_key, cents, cents / 100.0 AS v, CAST(round(CAST(cents AS DECIMAL(28,4)) / 1000, 1) AS DECIMAL(20,1)) AS p
      FROM signed_cents)""")
def _(t):
    cents = F.col("cents").cast("decimal(20,0)")
    value = (cents / 100).cast("decimal(24,2)")
    return t.signed_cents.select(
        "row_key", N.show_money(value).alias("money"), N.show_percent((cents / 1000).cast("decimal(24,4)")).alias("percent"),
        N.show_number(value).alias("number"))
