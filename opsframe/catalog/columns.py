"""Column converters: epochs, text patterns, URLs, payloads, JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsframe.catalog.normalizing import sql_strip
from opsframe.catalog.registry import given, query
from opsframe.functions import epoch, jsoncols, payload, text, urls
from opsframe.operators import snapshots

# --- epochs -----------------------------------------------------------------------------------------------------

given("moments", """
SELECT event_id, CASE event_id % 9 WHEN 0 THEN CAST(s AS STRING) WHEN 1 THEN CAST(s * 1000 + 123 AS STRING)
  WHEN 2 THEN ' ' || substr(CAST(s AS STRING), 1, 1) || ',' || substr(CAST(s AS STRING), 2, 3) || '_' || substr(CAST(s AS STRING), 5, 3) || ' ' || substr(CAST(s AS STRING), 8, 3)
  WHEN 3 THEN '-' || CAST(s AS STRING) WHEN 4 THEN '+' || CAST(s AS STRING) WHEN 5 THEN 'abc' WHEN 6 THEN ''
  WHEN 7 THEN CAST(y AS STRING) || '-' || lpad(CAST(m AS STRING), 2, '0') || '-' || lpad(CAST(1 + event_id % 31 AS STRING), 2, '0') || ' ' || CAST(event_id % 26 AS STRING) || ':05:09'
  ELSE CAST(y AS STRING) || '/' || CAST(1 + event_id % 12 AS STRING) || '/' || CAST(d AS STRING) || 'T7:' || CAST(i AS STRING) END AS moment
FROM (SELECT *, (CAST(d + FLOOR((153 * mm + 2) / 5) + 365 * yy + FLOOR(yy / 4) - FLOOR(yy / 100) + FLOOR(yy / 400) AS BIGINT) - 32045 - 2440588) * 86400
    + h * 3600 + i * 60 + c AS s
  FROM (SELECT *, y + 4800 - a AS yy, m + 12 * a - 3 AS mm FROM (
    SELECT event_id, CAST(year(ts) AS BIGINT) AS y, CAST(month(ts) AS BIGINT) AS m, CAST(day(ts) AS BIGINT) AS d, CAST(hour(ts) AS BIGINT) AS h,
      CAST(minute(ts) AS BIGINT) AS i, CAST(second(ts) AS BIGINT) AS c, CAST(FLOOR((14 - month(ts)) / 12) AS BIGINT) AS a FROM events) p) q) r""")


def _epoch_sql(x: str) -> str:
    t = f"regexp_replace({x}, '[,_\\s]', '', 'g')"
    n = f"(CASE WHEN regexp_full_match({t}, '[+-]?[0-9]+') THEN TRY_CAST(ltrim({t}, '+') AS BIGINT) END)"
    return f"(CASE WHEN length(regexp_replace({t}, '^[+-]', '')) <= 12 THEN {n} * 1000 ELSE {n} END)"


def _datetime_sql(x: str, offset: int) -> str:
    p = r"^([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})(?:[ T]([0-9]{1,2}):([0-9]{1,2})(?::([0-9]{1,2}))?)?$"
    g = lambda i: f"regexp_extract(trim({x}), '{p}', {i})"
    n = lambda i: f"coalesce(TRY_CAST({g(i)} AS BIGINT), 0)"
    day = f"TRY_CAST({g(1)} || '-' || lpad({g(2)}, 2, '0') || '-' || lpad({g(3)}, 2, '0') AS DATE)"
    return (f"(CASE WHEN regexp_matches(trim({x}), '{p}') AND {n(4)} <= 23 AND {n(5)} <= 59 AND {n(6)} <= 59 THEN "
            f"(date_diff('day', DATE '1970-01-01', {day}) * 86400 + {n(4)} * 3600 + {n(5)} * 60 + {n(6)} - {offset} * 60) * 1000 END)")


def _any_sql(x: str, offset: int) -> str:
    plain = f"regexp_full_match(regexp_replace({x}, '[,_\\s]', '', 'g'), '-?[0-9]+')"
    return f"(CASE WHEN {plain} THEN {_epoch_sql(x)} ELSE {_datetime_sql(x, offset)} END)"


@query("epoch_parse", f"""
SELECT event_id, {_epoch_sql('moment')} AS ms, CASE WHEN regexp_full_match(t, '[0-9]+') THEN CASE WHEN length(t) <= 12 THEN 's' ELSE 'ms' END END AS unit
FROM (SELECT *, regexp_replace(regexp_replace(moment, '[,_\\s]', '', 'g'), '^[+-]', '') AS t FROM moments)""")
def _(t):
    return t.moments.select("event_id", epoch.parse_epoch("moment").alias("ms"), epoch.epoch_unit("moment").alias("unit"))


@query("datetime_parse", f"SELECT event_id, {_datetime_sql('moment', 480)} AS ms FROM moments")
def _(t):
    return t.moments.select("event_id", epoch.parse_datetime("moment", 480).alias("ms"))


@query("parse_any", f"SELECT event_id, {_any_sql('moment', -330)} AS ms FROM moments")
def _(t):
    return t.moments.select("event_id", epoch.parse_any("moment", -330).alias("ms"))


_MS = f"m AS (SELECT event_id, {_any_sql('moment', 0)} AS ms FROM moments)"


def _ms(t):
    return t.moments.select("event_id", epoch.parse_any("moment").alias("ms"))


def _at(offset: int) -> str:
    return f"make_timestamp((ms + {offset * 60000}) * 1000)"


@query("epoch_format", f"""
WITH {_MS} SELECT event_id, strftime({_at(480)}, '%Y-%m-%d %H:%M:%S') AS local, strftime({_at(-330)}, '%Y-%m-%dT%H:%M:%S') || '-05:30' AS iso,
  strftime({_at(0)}, '%Y-%m-%dT%H:%M:%S.%gZ') AS utc FROM m""")
def _(t):
    return _ms(t).select("event_id", epoch.format_local("ms", 480).alias("local"), epoch.format_iso("ms", -330).alias("iso"),
                         epoch.format_iso_utc("ms").alias("utc"))


@query("weekday", f"""
WITH {_MS} SELECT event_id, (['星期日', '星期一', '星期二', '星期三', '星期四', '星期五', '星期六'])[dayofweek({_at(480)}) + 1] AS weekday FROM m""")
def _(t):
    return _ms(t).select("event_id", epoch.weekday("ms", 480).alias("weekday"))


_PARTS = "s // 86400 AS d, s % 86400 // 3600 AS h, s % 3600 // 60 AS mi, s % 60 AS sec"


@query("duration", f"""
WITH {_MS}, q AS (SELECT event_id, ms - 1704067200000 AS diff, CAST(abs(ms - 1704067200000) // 1000 AS BIGINT) AS s FROM m),
p AS (SELECT *, {_PARTS} FROM q)
SELECT event_id, diff AS ms, CASE WHEN diff < 0 THEN -1 ELSE 1 END AS sign, d AS days, s // 3600 AS hours, s // 60 AS minutes, s AS seconds,
  CASE WHEN diff IS NOT NULL THEN concat_ws(' ', CASE WHEN d > 0 THEN d || ' 天' END, CASE WHEN h > 0 THEN h || ' 小时' END, CASE WHEN mi > 0 THEN mi || ' 分钟' END,
    CASE WHEN sec > 0 OR s = 0 THEN sec || ' 秒' END) END AS text FROM p""")
def _(t):
    start = F.lit(1704067200000).cast("bigint")
    return _ms(t).select("event_id", epoch.duration_between(start, "ms").alias("d")).select("event_id", "d.*")


@query("relative_age", f"""
WITH {_MS}, q AS (SELECT event_id, ms - 1704100000000 AS diff, CAST(abs(ms - 1704100000000) // 1000 AS BIGINT) AS s FROM m),
p AS (SELECT *, {_PARTS} FROM q),
b AS (SELECT *, concat_ws(' ', CASE WHEN d > 0 THEN d || ' 天' END, CASE WHEN h > 0 THEN h || ' 小时' END, CASE WHEN d = 0 AND mi > 0 THEN mi || ' 分钟' END,
    CASE WHEN s < 3600 AND sec > 0 THEN sec || ' 秒' END) AS body FROM p)
SELECT event_id, CASE WHEN diff IS NULL THEN NULL WHEN body = '' THEN '此刻' ELSE body || CASE WHEN diff >= 0 THEN '后' ELSE '前' END END AS age FROM b""")
def _(t):
    return _ms(t).select("event_id", epoch.relative_age("ms", F.lit(1704100000000).cast("bigint")).alias("age"))


# --- patterns ---------------------------------------------------------------------------------------------------

EMAIL = text.PATTERN_LIBRARY["email"]


@query("pattern_matches", r"""
SELECT doc_id, pos - 1 AS pos, match FROM (SELECT doc_id, unnest(m) AS match, generate_subscripts(m, 1) AS pos FROM (
  SELECT doc_id, regexp_extract_all(text, '(?i)[a-z]{5,}ion\b', 0) AS m FROM documents))""")
def _(t):
    return t.documents.select("doc_id", F.posexplode(text.matches("text", r"[a-z]{5,}ion\b", "i")).alias("pos", "match"))


@query("pattern_first", r"""
SELECT doc_id, regexp_extract_all(text, '\d+', 0)[1] AS match FROM documents WHERE regexp_matches(text, '\d+')""")
def _(t):
    found = text.matches("text", r"\d+", first_only=True)
    return t.documents.select("doc_id", F.explode(found).alias("match"))


_GROUPS = r"([A-Za-z]+)(ing|ed)([,.])?"


@query("pattern_groups", f"""
SELECT doc_id, generate_subscripts(m, 1) - 1 AS pos, unnest(m) AS match, unnest(a) AS g1, unnest(b) AS g2, unnest(c) AS g3 FROM (
  SELECT doc_id, regexp_extract_all(text, '{_GROUPS}', 0) AS m, regexp_extract_all(text, '{_GROUPS}', 1) AS a,
    regexp_extract_all(text, '{_GROUPS}', 2) AS b, regexp_extract_all(text, '{_GROUPS}', 3) AS c FROM documents)""")
def _(t):
    found = text.match_groups("text", _GROUPS, 3)
    return t.documents.select("doc_id", F.posexplode(found).alias("pos", "m")).select("doc_id", "pos", "m.*")


@query("pattern_replace", r"SELECT doc_id, regexp_replace(text, '(\w+)@(\w+)', '\2 at \1', 'g') AS replaced FROM documents")
def _(t):
    return t.documents.select("doc_id", text.replace_pattern("text", r"(\w+)@(\w+)", "$2 at $1").alias("replaced"))


@query("pattern_census", " UNION ALL ".join(
    f"SELECT doc_id, '{n}' AS pattern, len(regexp_extract_all(text, '{p}', 0)) AS n FROM documents"
    for n, p in text.PATTERN_LIBRARY.items()))
def _(t):
    return text.pattern_census(t.documents, "doc_id", "text")


given("patterned", """
SELECT page_id, html, CASE WHEN page_id % 8 = 7 THEN '([' ELSE CASE page_id % 3 WHEN 0 THEN 'href="([^"]*)"' WHEN 1 THEN '<title>(.*?)</title>' ELSE '([0-9]+)px' END END AS pattern FROM pages""")


@query("pattern_totals", r"SELECT doc_id, len(regexp_extract_all(text, '[a-z]+', 0)) AS n FROM documents")
def _(t):
    """Long documents hold many thousands of matches, and all of them are returned."""
    return t.documents.select("doc_id", F.size(text.matches("text", "[a-z]+")).cast("bigint").alias("n"))


@query("user_pattern", """
SELECT page_id, generate_subscripts(m, 1) - 1 AS pos, unnest(m) AS hit FROM (SELECT page_id, regexp_extract_all(html, pattern, 1) AS m FROM patterned WHERE pattern <> '([')""")
def _(t):
    found = text.matches("html", F.col("pattern"), group=1)
    return t.patterned.select("page_id", F.posexplode(found).alias("pos", "hit"))


@query("html_escape", """
SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM pages""")
def _(t):
    return t.pages.select("page_id", text.html_escape("html").alias("escaped"))


given("price_pages", """
SELECT page_id, html || CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN '<b>¥ ' || p || '</b><i>¥' || p || '.50</i><b>¥' || p || '</b>'
  WHEN 2 THEN '<b>' || p || '元</b> 1,280 人' WHEN 3 THEN '<b>￥1,' || lpad(p, 3, '0') || '.00</b><b>$' || p || '</b><b>$' || p || '</b>'
  ELSE '<b>￥1234' || p || '</b><u>¥' || chr(160) || p || '.25</u><u>¥' || chr(160) || p || '.25</u><s>' || p || '　元</s>' END AS html FROM (SELECT page_id, html, CAST(page_id % 900 AS STRING) AS p FROM pages) q""")
# The price pattern is a fixed value, spelled here for the other engine.
_HITS = """
hits AS (SELECT page_id, unnest(h) AS hit, generate_subscripts(h, 1) AS pos FROM (
  SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '(?:[¥￥$][\\s\\x{A0}\\x{202F}\\x{3000}]?(\\pN{1,3}(?:,\\pN{3})*(?:\\.\\pN{1,2})?|\\pN+(?:\\.\\pN{1,2})?))|(?:\\pN+(?:\\.\\pN{1,2})?[\\s\\x{A0}\\x{202F}\\x{3000}]?元)', 0),
    lambda x: replace(trim(x), ' ', '')), lambda x: x <> '') AS h FROM price_pages)),
counted AS (SELECT page_id, hit, count(*) AS n, min(pos) AS first FROM hits GROUP BY ALL)"""


@query("price_mode", f"""
WITH {_HITS} SELECT p.page_id, c.hit AS price, coalesce(c.total, 0) AS n_hits FROM price_pages p LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, first) AS rn, CAST(sum(n) OVER (PARTITION BY page_id) AS BIGINT) AS total FROM counted) c
  ON c.page_id = p.page_id AND c.rn = 1""")
def _(t):
    return snapshots.main_price(t.price_pages, "page_id", "html")


@query("price_samples", f"WITH {_HITS} SELECT page_id, pos - 1 AS pos, hit FROM hits WHERE pos <= 10")
def _(t):
    return t.price_pages.select("page_id", F.posexplode(snapshots.price_samples("html")).alias("pos", "hit"))


# --- URLs -------------------------------------------------------------------------------------------------------

def _component_sql(x: str) -> str:
    out = f"url_encode({x})"
    for a, b in (("%21", "!"), ("%27", "''"), ("%28", "("), ("%29", ")"), ("%2A", "*")):
        out = f"replace({out}, '{a}', '{b}')"
    return out


def _keep_sql(x: str) -> str:
    out = _component_sql(x)
    for a, b in (("%2F", "/"), ("%3A", ":"), ("%3F", "?"), ("%26", "&"), ("%3D", "="), ("%23", "#")):
        out = f"replace({out}, '{a}', '{b}')"
    return out


@query("url_encode", f"""
SELECT doc_id, {_component_sql('text')} AS component, replace({_keep_sql('text')}, '%20', '+') AS kept FROM documents""")
def _(t):
    return t.documents.select("doc_id", urls.encode_component("text").alias("component"),
                              urls.encode_component("text", True, True).alias("kept"))


given("broken_urls", """
SELECT page_id, url, CASE page_id % 6 WHEN 0 THEN url || '%E4%BD%A0' WHEN 1 THEN url || '%zz' WHEN 2 THEN url || '%'
  WHEN 3 THEN url || 'a+b%20c' WHEN 4 THEN url || '%E5' ELSE url || '%EF%BF%BD' END AS coded FROM pages""")


@query("url_decode", """
SELECT page_id, CASE page_id % 6 WHEN 0 THEN url || '你' WHEN 3 THEN url || 'a+b c' WHEN 5 THEN url || chr(65533) END AS decoded,
  CASE page_id % 6 WHEN 0 THEN url || '你' WHEN 3 THEN url || 'a b c' WHEN 5 THEN url || chr(65533) END AS form FROM broken_urls""")
def _(t):
    return t.broken_urls.select("page_id", urls.decode("coded").alias("decoded"), urls.decode("coded", True).alias("form"))


given("links", """
SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN url || '?q=1&q=2&flag&=v&e=%E4%BD%A0&bad=%zz' WHEN 2 THEN url || '&&x=a=b'
  WHEN 3 THEN 'a=' || CAST(page_id AS STRING) || '&b=2' WHEN 4 THEN url || '?m=1#f?n=2' ELSE replace(url, '?', '#') END AS link FROM pages""")
_DECODE = "CASE WHEN contains({0}, '%zz') THEN {0} ELSE url_decode(replace({0}, '+', '%2B')) END"
_PARAMS = f"""
cut AS (SELECT page_id, link, split_part(link, '#', 1) AS s FROM links),
qs AS (SELECT *, CASE WHEN contains(s, '?') THEN substr(s, position('?' IN s) + 1) WHEN contains(s, '=') AND NOT contains(s, '/') AND NOT contains(s, ':') THEN s ELSE '' END AS q FROM cut),
parts AS (SELECT page_id, unnest(l) AS p, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT page_id, list_filter(string_split(q, '&'), lambda x: x <> '') AS l FROM qs)),
kv AS (SELECT page_id, pos, CASE WHEN contains(p, '=') THEN substr(p, 1, position('=' IN p) - 1) ELSE p END AS a,
  CASE WHEN contains(p, '=') THEN substr(p, position('=' IN p) + 1) ELSE '' END AS b FROM parts),
params AS (SELECT page_id, pos, {_DECODE.format('a')} AS k, {_DECODE.format('b')} AS v FROM kv)"""


@query("url_params", f"WITH {_PARAMS} SELECT * FROM params")
def _(t):
    return t.links.select("page_id", F.posexplode(urls.query_params("link")).alias("pos", "p")).select(
        "page_id", "pos", "p.k", "p.v")


@query("url_base_hash", """
SELECT page_id, split_part(split_part(link, '#', 1), '?', 1) AS base,
  CASE WHEN contains(link, '#') THEN substr(link, position('#' IN link)) ELSE '' END AS hash FROM links""")
def _(t):
    return t.links.select("page_id", urls.base_of("link").alias("base"), urls.hash_of("link").alias("hash"))


@query("url_rebuild", f"""
WITH {_PARAMS} SELECT l.page_id, coalesce(string_agg({_component_sql('k')} || '=' || {_component_sql('v')}, '&' ORDER BY pos), '') AS rebuilt
FROM links l LEFT JOIN params p ON p.page_id = l.page_id GROUP BY l.page_id""")
def _(t):
    return t.links.select("page_id", urls.build_query(urls.query_params("link")).alias("rebuilt"))


@query("url_pairs_text", f"""
WITH {_PARAMS} SELECT l.page_id, coalesce(string_agg(k || '=' || v, chr(10) ORDER BY pos), '') AS pairs,
  count(k) AS n_back FROM links l LEFT JOIN params p ON p.page_id = l.page_id GROUP BY l.page_id""")
def _(t):
    pairs = urls.pairs_to_text(urls.query_params("link"))
    back = F.size(urls.text_to_pairs(F.col("pairs")))
    return t.links.select("page_id", pairs.alias("pairs")).withColumn("n_back", back)


@query("url_batch_quality", """
SELECT count(*) FILTER (page_id % 6 <> 9) AS n_done, count(*) FILTER (page_id % 6 IN (1, 2, 4)) AS n_bad FROM broken_urls""")
def _(t):
    return t.broken_urls.select(urls.batch_convert("coded", encode=False).alias("r")).agg(
        F.count_if("r.counted").alias("n_done"), F.count_if("r.bad").alias("n_bad"))


@query("url_batch", """
SELECT page_id, CASE page_id % 6 WHEN 0 THEN url || '你' WHEN 3 THEN url || 'a+b c' WHEN 5 THEN url || chr(65533) ELSE '（解不开：' || coded || '）' END AS out
FROM broken_urls""")
def _(t):
    return t.broken_urls.select("page_id", urls.batch_convert("coded", encode=False)["out"].alias("out"))


# --- payloads ---------------------------------------------------------------------------------------------------

@query("b64_encode", """
SELECT doc_id, b AS plain, rtrim(translate(b, '+/', '-_'), '=') AS urlsafe, rtrim(regexp_replace(b, '(.{76})', '\\1' || chr(10), 'g'), chr(10)) AS wrapped
FROM (SELECT doc_id, base64(encode(text)) AS b FROM documents)""")
def _(t):
    return t.documents.select("doc_id", payload.b64_encode("text").alias("plain"),
                              payload.b64_encode("text", True, True).alias("urlsafe"),
                              payload.b64_encode("text", wrap=76).alias("wrapped"))


@query("b64_decode", """
SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN NULL ELSE text END AS decoded FROM documents""")
def _(t):
    """Encoded in turn plainly, URL-safe without padding, wrapped, with stray spaces, and damaged."""
    which = F.col("doc_id") % 5
    coded = (F.when(which == 0, payload.b64_encode("text")).when(which == 1, payload.b64_encode("text", True, True))
             .when(which == 2, payload.b64_encode("text", wrap=76))
             .when(which == 3, F.concat(F.lit(" "), payload.b64_encode("text"), F.lit("\n")))
             .otherwise(F.concat(payload.b64_encode("text"), F.lit("*"))))
    return t.documents.select("doc_id", F.decode(payload.b64_decode(coded), "UTF-8").alias("decoded"))


@query("payload_class", """
SELECT doc_id, CASE WHEN octet_length(b) = 0 THEN true WHEN s IS NULL THEN false ELSE length(s) > 0 AND NOT contains(s, chr(65533))
  AND (u - 2.0 * (length(s) - length(regexp_replace(s, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')))) / u > 0.6 END AS is_text
FROM (SELECT *, length(s) + (length(s) - length(regexp_replace(s, '[\\x{10000}-\\x{10FFFF}]', '', 'g'))) AS u FROM (
  SELECT doc_id, b, TRY(decode(b)) AS s FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN encode(text) WHEN 1 THEN unhex(sha256(text))
    WHEN 2 THEN encode(text || repeat(chr(1), 20 + doc_id % 3000)) ELSE encode(repeat(chr(1), 90) || text) END AS b FROM documents)))""")
def _(t):
    which = F.col("doc_id") % 4
    raw = (F.when(which == 0, F.col("text").cast("binary")).when(which == 1, F.unhex(F.sha2("text", 256)))
           .when(which == 2, F.concat("text", F.repeat(F.lit("\x01"), (F.lit(20) + F.col("doc_id") % 3000).cast("int"))).cast("binary"))
           .otherwise(F.concat(F.lit("\x01" * 90), "text").cast("binary")))
    return t.documents.select("doc_id", raw.alias("raw")).select("doc_id", payload.is_likely_text("raw").alias("is_text"))


@query("data_uri", """
SELECT item_id, 'data:' || CASE WHEN item_id % 3 = 0 THEN 'application/octet-stream' ELSE 'text/plain' END || ';base64,' || base64(encode(text)) AS uri,
  CASE WHEN item_id % 3 = 0 THEN 'application/octet-stream' ELSE 'text/plain' END AS mime, text AS body FROM benchmark""")
def _(t):
    mime = F.when(F.col("item_id") % 3 == 0, "").otherwise("text/plain")
    uri = t.benchmark.select("item_id", payload.data_uri(mime, payload.b64_encode("text")).alias("uri"))
    parts = uri.withColumn("p", payload.parse_data_uri("uri"))
    return parts.select("item_id", "uri", "p.mime", F.decode(payload.b64_decode("p.b64"), "UTF-8").alias("body"))


given("files", """
SELECT doc_id, text, n_chars, source || '/' || lang || '/f' || CAST(doc_id AS STRING) || CASE doc_id % 11 WHEN 0 THEN '.TXT' WHEN 1 THEN '.jpg' WHEN 2 THEN '.tar.gz'
  WHEN 3 THEN '' WHEN 4 THEN '.csv' WHEN 5 THEN '.json' WHEN 6 THEN '.PDF' WHEN 7 THEN '.mp3' WHEN 8 THEN '.mov' WHEN 9 THEN '.md' ELSE '.zip' END AS path
FROM documents""")


@query("mime_of", "SELECT doc_id, CASE lower(split_part(path, '.', -1)) " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in payload.MEDIA_TYPES.items()) + " ELSE 'application/octet-stream' END AS mime FROM files")
def _(t):
    return t.files.select("doc_id", payload.media_type("path").alias("mime"))


# --- JSON -------------------------------------------------------------------------------------------------------

given("json_cells", """
SELECT event_id, CASE event_id % 12 WHEN 0 THEN props WHEN 1 THEN props || 'x' WHEN 2 THEN '[' || props || ', 1, null]' WHEN 3 THEN '"' || event_type || '"'
  WHEN 4 THEN 'null' WHEN 5 THEN CAST(user_id AS STRING) WHEN 6 THEN 'true' WHEN 7 THEN '' WHEN 8 THEN '{"z": {"y": [1, {"b": "é", "a": false}], "x": null}, "id": ' || CAST(event_id AS STRING) || '}'
  WHEN 9 THEN '{"open": ' WHEN 10 THEN '1,2' ELSE ' {} ' END AS cell FROM events""")
_JSON_KIND = """CASE json_type(cell) WHEN 'ARRAY' THEN '数组' WHEN 'OBJECT' THEN '对象' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'object' ELSE 'number' END"""


@query("json_validity", f"""
SELECT event_id, json_valid(cell) AS valid, CASE WHEN json_valid(cell) THEN {_JSON_KIND} END AS kind,
  CASE WHEN json_valid(cell) THEN CASE json_type(cell) WHEN 'ARRAY' THEN json_array_length(cell) WHEN 'OBJECT' THEN len(json_keys(cell)) ELSE 0 END END AS n_keys,
  length(cell) AS n_chars FROM json_cells""")
def _(t):
    return t.json_cells.select("event_id", jsoncols.validate("cell").alias("v")).select("event_id", "v.*")


@query("json_census", f"""
SELECT CASE WHEN json_valid(cell) THEN {_JSON_KIND} ELSE 'invalid' END AS kind, count(*) AS n FROM json_cells GROUP BY 1""")
def _(t):
    return t.json_cells.groupBy(F.coalesce(jsoncols.kind("cell"), F.lit("invalid")).alias("kind")).agg(F.count("*").alias("n"))


@query("json_canonical", """
SELECT event_id, CASE event_id % 12 WHEN 0 THEN replace(props, ' ', '') WHEN 2 THEN '[' || replace(props, ' ', '') || ',1,null]' WHEN 3 THEN cell WHEN 4 THEN cell
  WHEN 5 THEN cell WHEN 6 THEN cell WHEN 8 THEN '{"id":' || CAST(event_id AS VARCHAR) || ',"z":{"x":null,"y":[1,{"a":false,"b":"é"}]}}' WHEN 11 THEN '{}' END AS canonical
FROM (SELECT j.*, e.props FROM json_cells j JOIN events e ON e.event_id = j.event_id)""")
def _(t):
    return t.json_cells.select("event_id", jsoncols.canonical("cell").alias("canonical"))


@query("json_minify", """
SELECT event_id, CASE WHEN json_valid(cell) THEN CAST(json(cell) AS VARCHAR) END AS minified FROM json_cells""")
def _(t):
    return t.json_cells.select("event_id", jsoncols.minify("cell").alias("minified"))


@query("json_escape", """
SELECT doc_id, substr(q, 2, length(q) - 2) AS escaped, text AS back FROM (SELECT doc_id, text, CAST(to_json(text) AS VARCHAR) AS q FROM documents)""")
def _(t):
    return t.documents.select("doc_id", jsoncols.escape("text").alias("escaped")).withColumn(
        "back", jsoncols.unescape("escaped"))


given("json_lists", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '[' || props || ', {"type": "' || event_type || '", "k": null}, 7]'
  WHEN 2 THEN '[{"flag": true, "type": "a,b"}]' ELSE '[]' END AS cell FROM events""")


@query("json_to_table", """
SELECT event_id, generate_subscripts(l, 1) - 1 AS pos, coalesce(json_extract_string(unnest(l), '$.k'), '') AS k,
  coalesce(json_extract_string(unnest(l), '$.type'), '') AS type, coalesce(json_extract_string(unnest(l), '$.flag'), '') AS flag
FROM (SELECT event_id, json_extract(CASE WHEN cell LIKE '[%' THEN cell ELSE '[' || cell || ']' END, '$[*]') AS l FROM json_lists)""")
def _(t):
    return jsoncols.json_to_table(t.json_lists, "cell", "event_id", ["k", "type", "flag"])


_MEMBERS = """
members AS (SELECT event_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS m FROM (
  SELECT event_id, json_extract(CASE WHEN cell LIKE '[%' THEN cell ELSE '[' || cell || ']' END, '$[*]') AS l FROM json_lists)),
named AS (SELECT event_id, pos, m, generate_subscripts(k, 1) - 1 AS kpos, unnest(k) AS key FROM (
  SELECT event_id, pos, m, json_keys(m) AS k FROM members WHERE json_type(m) = 'OBJECT'))"""


@query("json_members", f"""
WITH {_MEMBERS} SELECT event_id, pos, key, coalesce(json_extract_string(m, '$."' || key || '"'), '') AS value FROM named""")
def _(t):
    return jsoncols.json_members(t.json_lists, "cell", "event_id")


@query("json_key_union", f"""
WITH {_MEMBERS} SELECT key, row_number() OVER (ORDER BY first) AS key_no FROM (
  SELECT key, min({{'e': event_id, 'p': pos, 'k': kpos}}) AS first FROM named GROUP BY key)""")
def _(t):
    from opsframe.operators.order import dense_number

    keys = jsoncols.object_keys(t.json_lists, "cell", "event_id")
    return dense_number(keys, ["first_at"], "key_no").select("key", "key_no")


@query("rows_to_json", """
SELECT c_custkey, json_object('c_name', c_name, 'c_mktsegment', c_mktsegment, 'c_nationkey', CAST(c_nationkey AS VARCHAR)) AS json,
  json_array(c_name, c_mktsegment) AS bare FROM customer""")
def _(t):
    cols = ["c_name", "c_mktsegment", "c_nationkey"]
    named = jsoncols.rows_to_json(t.customer, cols)
    return jsoncols.rows_to_json(named, cols[:2], header=False, out="bare").select("c_custkey", "json", "bare")
