"""Files written and read back, and streams replayed from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.catalog import keyed, sales, tables
from opsframe.catalog.registry import Tables, given, query
from opsframe.operators import inventory, kpi
from opsframe.plans import steps
from opsframe.session import shared_dir
from opsframe.sources import exports, sinks
from opsframe.streaming import daily, health, ingest, prices
from opsframe.streaming.jobs import run_available


def fresh(t: Tables) -> str:
    """A new folder where all executors can write."""
    return f"{shared_dir(t.spark)}/opsframe/{uuid.uuid4().hex}"


# --- files ------------------------------------------------------------------------------------------------------

given("customer_cells", """
SELECT CAST(c_custkey AS STRING) AS id, '客户, ' || c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment END AS segment,
  '"' || CAST(c_nationkey AS STRING) || '"' AS nation, c_custkey % 3 AS kind FROM customer""")
ALIAS = {"编号": "id", "客户名": "name"}


def _write_exports(t: Tables) -> str:
    """The customers as three kinds of export: plain, GB18030 with semicolons, and tab-separated with a further column in a
    folder below, in files whose names begin with an underscore."""
    root = fresh(t)
    c = t.customer_cells
    sinks.save_table(c.filter("kind = 0"), f"{root}/a", ["id", "name", "segment"], "csv")
    chinese = c.filter("kind = 1").select(F.col("id").alias("编号"), F.col("name").alias("客户名"), "segment")
    sinks.save_table(chinese, f"{root}/b", None, "csv", encoding="GB18030", sep=";")
    sinks.save_table(c.filter("kind = 2"), f"{root}/c/deep", ["id", "nation", "name"], "csv", sep="\t")
    _underscore(t, f"{root}/c/deep")
    return root


def _underscore(t: Tables, folder: str) -> None:
    """Give the files of a folder names that a file scan would pass over."""
    path = t.spark._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(t.spark._jsc.hadoopConfiguration())
    for found in system.globStatus(path(folder, "part-*")):
        system.rename(found.getPath(), path(folder, "_" + found.getPath().getName()))


@query("io_read_exports", """
SELECT id, name, CASE WHEN kind = 2 THEN '' ELSE segment END AS segment, CASE WHEN kind = 2 THEN nation ELSE '' END AS nation FROM customer_cells""")
def _(t):
    rows = exports.read_exports(t.spark, _write_exports(t), recursive=True, alias=ALIAS)
    return rows.select("id", "name", "segment", "nation")


given("customer_notes", """
SELECT c_custkey, c_name || ', "' || c_mktsegment || '"' AS title, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name || '
' || c_mktsegment || '

"' || CAST(c_nationkey AS STRING) END AS note FROM customer""")


@query("io_quoted_splits", """
SELECT row_number() OVER (ORDER BY c_custkey) AS place, CAST(c_custkey AS VARCHAR) AS id, title, note FROM customer_notes""")
def _(t):
    """One file with line breaks and quotes inside its cells, read by many tasks."""
    root = fresh(t)
    rows = t.customer_notes.select(F.col("c_custkey").cast("string").alias("id"), "title", "note")
    sinks.save_table(rows.orderBy(F.col("id").cast("bigint")).coalesce(1), root, None, "csv")
    found = exports.read_exports(t.spark, root, split=16384)
    return found.select(F.col("__row__").alias("place"), "id", "title", "note")


@query("io_required_columns", "SELECT id, name, segment FROM customer_cells WHERE kind <> 2")
def _(t):
    rows = exports.read_exports(t.spark, _write_exports(t), recursive=True, alias=ALIAS, required=["segment"])
    return rows.select("id", "name", "segment")


@query("io_profile", """
SELECT DISTINCT CASE kind WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'deep' END AS folder,
  CASE WHEN kind = 1 AND octet_length(encode(name)) > length(name) THEN 'GB18030' ELSE 'UTF-8' END AS encoding,
  CASE kind WHEN 0 THEN ',' WHEN 1 THEN ';' ELSE chr(9) END AS sep,
  CASE kind WHEN 0 THEN 'id,name,segment' WHEN 1 THEN '编号;客户名;segment' ELSE 'id' || chr(9) || 'nation' || chr(9) || 'name' END AS header
FROM customer_cells""")
def _(t):
    found = exports.profile_files(t.spark, _write_exports(t), recursive=True)
    return found.select(F.element_at(F.split("file", "/"), -2).alias("folder"), "encoding", "sep", "header").distinct()


@query("io_provenance", "SELECT count(*) AS n_rows, count(*) AS n_places, true AS numbered FROM customer_cells")
def _(t):
    rows = exports.read_exports(t.spark, _write_exports(t), recursive=True, alias=ALIAS)
    files = rows.groupBy("__source__").agg(F.count("*").alias("n"), F.max("__row__").alias("last"),
                                           F.countDistinct("__row__").alias("places"))
    return files.agg(F.sum("n").alias("n_rows"), F.sum("places").alias("n_places"),
                     F.bool_and(F.col("n") == F.col("last")).alias("numbered"))


given("gate_rows", """
SELECT c_custkey AS row_key, 'n' || CAST(c_nationkey AS STRING) AS nation, CASE WHEN c_nationkey % 3 = 0 THEN NULL WHEN c_nationkey % 3 = 1 AND c_acctbal < 9999999
  THEN '待定' ELSE '¥' || CAST(c_custkey AS STRING) END AS amount FROM customer""")


@query("io_file_gate", """
SELECT nation || '.csv' AS file, CASE WHEN count(amount) = 0 THEN '缺列「amount」，现有列：row_key/nation' ELSE '没有可用金额行' END AS reason
FROM gate_rows GROUP BY nation HAVING count(*) FILTER (amount LIKE '¥%') = 0""")
def _(t):
    """One file per nation: a third lacks the column, a third has no usable amount in it."""
    root = fresh(t)
    rows = t.gate_rows
    wide = rows.filter("amount IS NOT NULL").withColumn("part", F.col("nation"))
    thin = rows.filter("amount IS NULL").withColumn("part", F.col("nation")).drop("amount")
    path = t.spark._jvm.org.apache.hadoop.fs.Path
    for part, folder in ((wide, f"{root}/wide"), (thin, f"{root}/thin")):
        part.repartition("part").write.partitionBy("part").option("header", "true").csv(folder)
        system = path(folder).getFileSystem(t.spark._jsc.hadoopConfiguration())
        for found in system.globStatus(path(folder, "part=*/part-*.csv")):  # name each file after its nation
            source = found.getPath()
            system.rename(source, path(source.getParent(), source.getParent().getName().removeprefix("part=") + ".csv"))
    read = exports.read_exports(t.spark, root, recursive=True)
    return exports.rejected_files(exports.profile_files(t.spark, root, recursive=True), read, "amount")


@query("table_steps_files", f"""
WITH {tables._STEPS.replace("PARTITION BY phone ORDER BY row_key", "PARTITION BY phone ORDER BY row_key % 2, row_key")}
SELECT CAST(row_key AS VARCHAR) AS row_key, name, city, product, phone, amount, CASE row_key % 2 WHEN 0 THEN 'a.csv' ELSE 'b.csv' END AS source FROM kept""")
def _(t):
    """Step lists from files to files: two exports merged, cleaned, deduplicated in the order of files and rows, and saved."""
    root = fresh(t)
    rows = t.form_rows.select("row_key", "name", "city", "product", "phone", "amount")
    path = t.spark._jvm.org.apache.hadoop.fs.Path
    system = path(root).getFileSystem(t.spark._jsc.hadoopConfiguration())
    system.mkdirs(path(root, "in"))
    for part, name in enumerate(["a.csv", "b.csv"]):
        sinks.save_table(rows.filter(F.col("row_key") % 2 == part).orderBy("row_key").coalesce(1), f"{root}/{part}", None, "csv")
        system.rename(system.globStatus(path(f"{root}/{part}", "part-*"))[0].getPath(), path(f"{root}/in", name))
    steps.run_steps([
        {"action": "merge"}, {"action": "clean", "columns": ["name", "phone", "amount"]}, {"action": "dedupe", "key": "phone"},
        {"action": "save", "output": "done.csv"},
    ], spark=t.spark, input_dir=f"{root}/in", output_dir=f"{root}/out")
    done = t.spark.read.option("header", "true").option("escape", '"').csv(f"{root}/out/done.csv")
    return done.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("row_key", "name", "city", "product", "phone", "amount")],
                       F.col("__source__").alias("source"))


@query("io_history", "SELECT count(*) AS n_rows, CAST(sum(s_suppkey) AS BIGINT) AS total, CAST(0 AS BIGINT) AS n_missing FROM supplier")
def _(t):
    root = fresh(t)
    schema = "s_suppkey bigint, s_name string"
    sinks.append_snapshot(t.supplier, f"{root}/log", ["s_suppkey", "s_name"])
    missing = exports.read_history(t.spark, f"{root}/none", schema)
    both = exports.read_history(t.spark, f"{root}/log", schema).withColumn("m", F.lit(0)).unionByName(
        missing.withColumn("m", F.lit(1)))
    return both.agg(F.count("*").alias("n_rows"), F.sum("s_suppkey").alias("total"), F.sum("m").cast("bigint").alias("n_missing"))


@query("io_save_append", "SELECT o_orderstatus, 2 * count(*) AS n FROM orders GROUP BY 1")
def _(t):
    root = fresh(t)
    sinks.save_table(t.orders, root, ["o_orderkey", "o_orderstatus"])
    sinks.append_snapshot(t.orders, root, ["o_orderkey", "o_orderstatus"])
    return t.spark.read.parquet(root).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("io_split", """
SELECT regexp_replace(CASE WHEN trim(city) = '' THEN '(空)' ELSE trim(city) END, '[\\\\/:*?"<>|]', '_', 'g') AS part, count(*) AS n_rows FROM sale_lines GROUP BY 1""")
def _(t):
    root = fresh(t)
    sinks.split_by(t.sale_lines, "city", root)
    written = t.spark.read.option("header", "true").csv(root)
    return written.groupBy("part").agg(F.count("*").alias("n_rows"))


@query("io_archive", """
SELECT CAST(CAST(date_trunc('month', day) AS DATE) AS VARCHAR) AS process_date, status AS part, count(*) AS n_rows FROM facts GROUP BY 1, 2""")
def _(t):
    root = fresh(t)
    sinks.archive_by_category(t.facts.withColumn("day", F.trunc("day", "month")), root, "day", "status", "parquet")
    written = t.spark.read.parquet(root)
    return written.groupBy(F.col("process_date").cast("string").alias("process_date"), "part").agg(F.count("*").alias("n_rows"))


@query("io_rejects", "SELECT event_id, '缺主键「a」' AS reason FROM holed_rows WHERE trim(a) = ''")
def _(t):
    from opsframe.operators import quality

    root = fresh(t)
    sinks.reject_table(quality.split_missing_key(t.holed_rows, "a")[1], root, ["reason", "event_id", "b"])
    return t.spark.read.schema("event_id bigint, b string, reason string").option("header", "true").option(
        "escape", '"').csv(root).select("event_id", "reason")


@query("io_history_upsert", f"""
WITH {sales._DAILY} SELECT CAST(day AS VARCHAR) AS day, total, n_orders FROM daily""")
def _(t):
    days = kpi.daily_kpis(t.facts, "day", "amount").select("day", "total", "n_orders")
    stale = days.filter("day < DATE'1998-01-01'").withColumn("total", F.lit(0.0))
    return sinks.upsert_history(stale, days, fresh(t))


@query("io_inventory", """
SELECT '.txt' AS ext, '文档' AS category, CAST(sum(octet_length(encode(html)) + 1) AS BIGINT) AS bytes, true AS all_differ FROM pages""")
def _(t):
    root = fresh(t)
    t.pages.select("html").write.text(root)
    files = inventory.classify(inventory.file_inventory(t.spark, root), "rel_path", "size")
    files = files.filter("ext = '.txt'")  # beside them lie the writer's own marks
    return files.groupBy("ext", "category").agg(
        F.sum("size").alias("bytes"), (F.countDistinct("fingerprint") == F.count("*")).alias("all_differ"))


# --- streams ----------------------------------------------------------------------------------------------------

def replay(t: Tables, rows: DataFrame, slices: list[str], build, fmt: str = "parquet", mode: str = "append",
           each_batch=None) -> str:
    """Write the rows slice by slice into an inbox and run the stream after each, with state kept in between."""
    root = fresh(t)
    inbox, sink, checkpoint = f"{root}/inbox", f"{root}/out", f"{root}/state"
    # a stream keeps its number of state partitions for life: more than one per core only adds state files here
    setting = "spark.sql.shuffle.partitions"
    before = t.spark.conf.get(setting)
    t.spark.conf.set(setting, str(min(int(before), t.spark.sparkContext.defaultParallelism)))
    try:
        for where in slices:
            sinks.save_table(rows.filter(where), inbox, None, fmt, "append")
            run_available(build(inbox), checkpoint, sink, mode, each_batch(sink) if each_batch else None)
    finally:
        t.spark.conf.set(setting, before)
    return sink


THIRDS = ["day(ts) < 11 OR ts IS NULL", "day(ts) BETWEEN 11 AND 20", "day(ts) > 20"]


def _check_stream(t: Tables, sink_of=lambda sink: sink) -> str:
    rows = t.hot_checks.select("event_id", "ts", "target", "ok", "status", "ms")

    def build(inbox):
        stream = t.spark.readStream.schema(rows.schema).parquet(inbox)
        return stream.select("target", "event_id", F.col("ts").cast("timestamp").alias("at"), "ok", "status", "ms", F.lit("").alias("error"))

    return replay(t, rows, THIRDS, build, each_batch=lambda sink: health.health_writer(sink, f"{sink}-targets", buckets=16))


@query("stream_health", f"""
WITH {keyed._HEALTH} SELECT event_id, target, state, CAST(streak AS BIGINT) AS streak, CAST(streak_before AS BIGINT) AS streak_before,
  CAST(first_fail AS VARCHAR) AS first_fail_at, CAST(status AS VARCHAR) AS cause FROM edges WHERE state IN ('outage', 'recovered')""")
def _(t):
    return t.spark.read.parquet(_check_stream(t)).select(
        "event_id", "target", "state", "streak", "streak_before", F.col("first_fail_at").cast("string"), "cause")


@query("stream_health_records", f"""
WITH {keyed._HEALTH}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY ts DESC NULLS LAST, event_id DESC) AS back FROM edges) WHERE back = 1)
SELECT l.target, l.streak >= 2 AS down, CAST(l.streak AS BIGINT) AS consecutive_fail, CAST(l.first_fail AS VARCHAR) AS first_fail_at,
  (SELECT CAST(max(c.ts) AS VARCHAR) FROM hot_checks c WHERE c.target IS NOT DISTINCT FROM l.target AND c.ok) AS last_ok_at,
  CAST(l.status AS VARCHAR) AS last_status, CAST(l.ms AS DOUBLE) AS last_ms, CAST(l.ts AS VARCHAR) AS last_at, l.event_id AS last_id
FROM last l""")
def _(t):
    found = health.records(t.spark, f"{_check_stream(t)}-targets", 16)
    return found.withColumns({c: F.col(c).cast("string") for c in ("first_fail_at", "last_ok_at", "last_at")})


def _price_stream(t: Tables, rows: DataFrame, **options) -> DataFrame:
    def build(inbox):
        return t.spark.readStream.schema(rows.schema).parquet(inbox).withColumn("at", F.col("ts").cast("timestamp"))

    sink = replay(t, rows, THIRDS, build, each_batch=lambda sink: prices.price_writer(sink, f"{sink}-last", buckets=16, **options))
    return t.spark.read.parquet(sink).drop("batch", "at")


@query("stream_prices", f"""
WITH {keyed._CHANGES} SELECT event_id, name, price, coalesce(prev_price, '') AS prev_price, status FROM changes WHERE status <> 'unchanged'""")
def _(t):
    return _price_stream(t, t.price_log)


@query("stream_price_failures", """
SELECT event_id, name, price, coalesce(prev, '') AS prev_price, CASE WHEN blocked THEN 'blocked' WHEN failed THEN 'error' WHEN price = '' THEN 'no_price'
    WHEN n = 1 THEN 'first' WHEN price <> prev THEN 'changed' ELSE 'unchanged' END AS status
FROM (SELECT *, lag(price) OVER w AS prev, row_number() OVER w AS n FROM page_log WINDOW w AS (PARTITION BY name ORDER BY ts, event_id))""")
def _(t):
    return _price_stream(t, t.page_log, only_changes=False, separate_no_price=True)


@query("stream_daily", f"WITH {sales._DAILY} SELECT CAST(day AS VARCHAR) AS day, total, n_orders FROM daily")
def _(t):
    """Every day is spread over all batches, so most facts of a batch are years late."""
    rows = t.facts.select("row_key", "day", "amount")
    folder = replay(t, rows, ["row_key % 3 = 0", "row_key % 3 = 1", "row_key % 3 = 2"],
                    lambda inbox: t.spark.readStream.schema(rows.schema).parquet(inbox),
                    each_batch=lambda sink: daily.history_adder(sink, "day", "amount"))
    return daily.latest_history(t.spark, folder)


# Batches in time order; the days at the borders come in two parts.
BORDERS = ["day < DATE'1996-12-30' OR (day = DATE'1996-12-30' AND row_key % 2 = 0)",
           "(day = DATE'1996-12-30' AND row_key % 2 = 1) OR (day > DATE'1996-12-30' AND day < DATE'1999-07-01')",
           "day >= DATE'1999-07-01'"]


@query("stream_alerts", f"""
WITH {sales._DAILY}, compared AS ({sales._PREVIOUS}), closed AS (SELECT * FROM compared WHERE CAST(day AS DATE) <= (SELECT max(CAST(day AS DATE)) - 3 FROM compared))
SELECT CAST(day AS VARCHAR) AS day, 'drop' AS alert, total_pct AS observed, CAST(-20 AS DOUBLE) AS threshold FROM closed WHERE total_pct <= -20
UNION ALL SELECT CAST(day AS VARCHAR), 'rise', total_pct, CAST(50 AS DOUBLE) FROM closed WHERE total_pct >= 50
UNION ALL SELECT CAST(day AS VARCHAR), 'min_amount', total, CAST(300000 AS DOUBLE) FROM closed WHERE total < 300000
UNION ALL SELECT CAST(day AS VARCHAR), 'min_orders', CAST(n_orders AS DOUBLE), CAST(2 AS DOUBLE) FROM closed WHERE n_orders < 2""")
def _(t):
    """Days within the watermark's two days of the end are still open and raise nothing."""
    rows = t.facts.select("row_key", "day", "amount")

    def build(inbox):
        stream = t.spark.readStream.schema(rows.schema).parquet(inbox)
        return daily.daily_kpi_stream(stream.withColumn("at", F.col("day").cast("timestamp")), "at", "amount")

    folder = replay(t, rows, BORDERS, build, each_batch=lambda sink: daily.alert_writer(sink, f"{sink}-days", 20, 50, 300000, 2))
    return t.spark.read.parquet(folder).drop("batch")


FORM_SCHEMA = "row_key bigint, city string, status string, note string, amount string, name string, phone string, product string"
FORM_TEXT = ["city", "status", "note", "amount", "name", "phone", "product"]


def _forms_stream(t: Tables, keys=()):
    def build(inbox):
        rows = ingest.inbox(t.spark, inbox, FORM_SCHEMA)
        return ingest.ingest_stream(rows, FORM_TEXT, ["name", "phone", "amount"], tables.ROUTING)

    once = (lambda sink: ingest.once_writer(sink, keys, ["row_key"])) if keys else None
    return t.spark.read.parquet(replay(t, t.form_rows, ["row_key % 2 = 0", "row_key % 2 = 1"], build, fmt="csv", each_batch=once))


@query("stream_ingest", f"""
WITH {tables._FORM_CLEAN}
SELECT row_key, phone, amount, CASE WHEN phone = '' OR amount = '' THEN '缺少必填：' || concat_ws('、', CASE WHEN phone = '' THEN 'phone' END,
    CASE WHEN amount = '' THEN 'amount' END) ELSE '' END AS reason,
  CASE WHEN coalesce({tables._AMOUNT} >= 300000, false) THEN '大客户' WHEN city IN ('NATION_1', 'NATION_3', 'NATION_5') AND status = 'F' THEN '华东区'
    WHEN regexp_matches(note, 'LOW$') THEN '售后咨询' ELSE '待分配' END AS category FROM cleaned""")
def _(t):
    return _forms_stream(t).select("row_key", "phone", "amount", "reason", "category")


@query("stream_ingest_once", f"""
WITH {tables._FORM_CLEAN} SELECT phone, product, row_key FROM (
  SELECT *, row_number() OVER (PARTITION BY phone, product ORDER BY row_key % 2, row_key) AS n FROM cleaned WHERE phone <> '' AND amount <> '') WHERE n = 1""")
def _(t):
    return _forms_stream(t, ["phone", "product"]).filter("reason = ''").select("phone", "product", "row_key")
