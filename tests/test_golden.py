"""Worked examples with known answers, end to end."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from opsframe.functions import normalize
from opsframe.operators import dedupe, health, inventory, kpi, mdcorpus, quality, reconcile, rules, snapshots, summary, versions
from opsframe.operators.order import dense_number, dense_number_by_id, time_chunk, with_previous
from opsframe.plans import archive, forms, steps
from opsframe.sources import exports

SHOP = """name,phone,email,city,product,amount,date,note
张 伟,138 0013 8000,ZhangWei@QQ.com ,上海,企业版年费,"12,800",2026/9/1,老客户续费
李娜,139-0013-9000,lina@163.com,杭州,维修服务,680,2026年9月2日,机器报错E12
王强,+86-137-0013-7000,wangqiang@gmail.com,北京,标准版,3200,2026.9.3,新签
赵敏,13600136000,zhaomin@qq.com,上海,标准版,"3,200",20260905,
陈静,13500135000,,广州,维修服务,"1,050",2026-09-05,上门
刘洋,13400134000,liuyang@foxmail.com,南京,企业版年费,"15,600",2026/9/6,招投标用
孙丽,13300133000,sunli@qq.com,成都,标准版,3200,2026/9/7,
周涛,13200132000,zhoutao@qq.com,上海,配件,260,2026/9/8,加急
吴敏,13100131000,wumin@qq.com,苏州,配件,,2026/9/9,金额待确认
郑浩,13000130000,zhenghao@qq.com,杭州,标准版,3200,2026/9/10,
"""
WEB = """name,phone,email,city,product,amount,date,note
张 伟,13800138000,ZhangWei@QQ.com,上海,企业版年费,"12,800",2026/9/1,网站重复提交
何秀,15900159000,hexiu@qq.com,西安,标准版,3200,2026/9/11,
马云飞,15800158000,mayunfei@qq.com,上海,配件,"1,880",2026/9/12,
林芳,,linfang@qq.com,深圳,标准版,3200,2026/9/13,电话缺失
何秀,159 0015 9000,hexiu@qq.com,西安,配件,120,2026/9/14,同一个人第二个产品
"""
ROUTING = [
    {"name": "大客户", "priority": "high", "owner": "负责人A", "match": [{"field": "amount", "op": "gte", "value": 10000}]},
    {"name": "华东区", "priority": "normal", "owner": "负责人B",
     "match": [{"field": "city", "op": "in", "value": ["上海", "杭州", "南京", "苏州"]}]},
    {"name": "售后咨询", "priority": "normal", "owner": "客服组",
     "match": [{"field": "product", "op": "contains", "value": "维修"}]},
    {"name": "待分配", "priority": "low", "owner": "客服组", "match": []},
]


def test_form_job(spark, tmp_path):
    (tmp_path / "orders-shop.csv").write_bytes(b"\xef\xbb\xbf" + SHOP.encode())
    (tmp_path / "orders-web.CSV").write_bytes(WEB.encode("gb18030"))
    rows = exports.read_exports(spark, str(tmp_path))
    assert rows.count() == 15
    # order_by: file, then row, as one number per row
    rows = dense_number(rows, ["__source__", "__row__"], "place")
    routed, rejected = forms.route_forms(rows, ["name", "phone", "amount"], ["phone", "product"], ROUTING, "place", "2026-09-23")
    got = routed.orderBy("order_id").collect()
    assert [r.order_id[-4:] for r in got] == [f"{i:04d}" for i in range(1, 13)]
    assert (got[0].note, got[0].email, got[0].date) == ("网站重复提交", "zhangwei@qq.com", "2026-09-01")
    assert [(r["__source__"], r["__row__"], r.reason) for r in rejected.orderBy("place").collect()] == [
        ("orders-shop.csv", 9, "缺少必填：amount"), ("orders-web.CSV", 4, "缺少必填：phone")]
    totals = {r.category: (r.n_rows, r.total) for r in rules.route_summary(routed, "amount").collect()}
    assert {k: v[0] for k, v in totals.items()} == {"大客户": 2, "华东区": 5, "待分配": 4, "售后咨询": 1}
    assert sum(v[1] for v in totals.values()) == 48390
    assert [r.amount for r in rules.urgent(routed, "amount", "order_id").collect()] == ["15600", "12800"]


# The rows of the worked examples below, and the answers the tests expect of them.
SALES = """20260923|DD20260923001|广州|外卖|¥1,041.32
20260923|DD20260923002|北京|团购|¥956.95
20260923|DD20260923003|广州|门店| 614.18 
20260923|DD20260923004|广州|门店|1346.95
20260923|DD20260923005|北京|电商|1624.85
20260923|DD20260923006|广州|门店|758.42
20260923|DD20260923901|深圳|电商|
20260923|DD20260923902|广州|电商|(380.00)
20260923|DD20260923903||门店|520.00
2026年09月24日|DD20260924001|深圳|电商|1620.10
2026年09月24日|DD20260924002|深圳|外卖| 1,632.74 
2026年09月24日|DD20260924003|北京|门店| 1,355.51 
2026年09月24日|DD20260924004|杭州|门店|1,201.25
2026年09月24日|DD20260924005|北京|门店|1,412.15
2026年09月24日|DD20260924006|北京|外卖|¥1,441.87
2026年09月24日|DD20260924007|北京|团购|1180.61
2026年09月24日|DD20260924008|杭州|门店|¥780.84
2026年09月24日|DD20260924009|北京|团购| 1,184.87 
2026年09月24日|DD20260924010|广州|外卖|¥946.97
2026年09月24日|DD20260924011|北京|电商| 588.83 
2026年09月24日|DD20260924012|上海|电商|626.51
2026年09月24日|DD20260924901|深圳|电商|
2026年09月24日|DD20260924902|广州|电商|(380.00)
2026年09月24日|DD20260924903||门店|520.00"""


def test_daily_figures(spark):
    raw = spark.createDataFrame([(i, *line.split("|")) for i, line in enumerate(SALES.split("\n"))],
                                "place int, date string, order_id string, city string, channel string, amount string")
    facts = quality.usable_amount(raw, "amount").withColumn("day", normalize.kpi_date("date"))
    last = kpi.compare(kpi.daily_kpis(facts, "day", "amount_value")).orderBy(F.desc("day")).first()
    assert (str(last.day), last.total, last.n_orders, round(last.avg_amount, 2)) == ("2026-09-24", 14112.25, 14, 1008.02)
    assert (last.prev_total, last.prev_orders) == (6482.67, 8)
    assert (round(last.total_pct, 1), last.orders_delta, round(last.avg_pct, 1)) == (117.7, 6, 24.4)
    alerts = kpi.kpi_alerts(kpi.compare(kpi.daily_kpis(facts, "day", "amount_value"))).collect()
    assert [(a.alert, round(a.observed, 1)) for a in alerts] == [("rise", 117.7)]
    parts = {(r.field, r.value): (r.total, round(r.share_pct, 1), r.bar)
             for r in kpi.breakdown(facts, "day", "amount_value", ["city", "channel"]).filter("day = '2026-09-24'").collect()}
    assert parts["city", "北京"] == (7163.84, 50.8, 20) and parts["city", "(未填)"] == (520.0, 3.7, 1)
    assert parts["channel", "团购"] == (2365.48, 16.8, 9)
    tops = kpi.top_rows(facts, "day", "amount_value", "order_id", "place").filter("day = '2026-09-24'").orderBy("rank").collect()
    assert [t.amount for t in tops] == [1632.74, 1620.1, 1441.87, 1412.15, 1355.51]


def stores(spark):
    schema = "place int, sku string, title string, price string, stock string, status string"
    delta = {1: 100, 2: 50, 3: 300, 4: 20, 5: 10, 6: 5}
    a, b = [], []
    for i in range(1, 41):
        sku, price = (f" S{i:03d} " if i == 20 else f"S{i:03d}"), 1000 + 10 * i
        a.append((i, sku, f"商品{i:03d}", f"¥{price:,.2f}", f"{100 + i}件", "在售"))
        if i <= 35:
            b.append((i, sku, f"商品{i:03d}" + ("（专供）" if i in (10, 11) else ""), "" if i == 14 else str(price + delta.get(i, 0)),
                      str(100 + i - (3 if i in (7, 8, 9, 12) else 0)), "下架" if i == 13 else "在售"))
    b += [(i, f"S{i:03d}", f"商品{i:03d}", str(1000 + 10 * i), str(100 + i), "在售") for i in range(41, 45)]
    a += [(98, "", "没编码的商品", "¥1,111.00", "5件", "在售"), (99, "S021", "商品021 重复行", "¥1,210.00", "121件", "在售")]
    return {"A": spark.createDataFrame(a, schema), "B": spark.createDataFrame(b, schema),
            "C": spark.createDataFrame(b[:30], schema)}


def test_reconcile(spark):
    fields, numeric = ["price", "stock", "title", "status"], ["price", "stock"]
    tables = stores(spark)
    both = {k: tables[k] for k in "AB"}
    aligned = reconcile.align(reconcile.tag_stores(both, ["sku", *fields], "place"), "sku", fields, "AB", numeric)
    pairs = reconcile.pair_rows(aligned, "AB")
    s = reconcile.summary(reconcile.pair_flags(aligned, "AB", fields, numeric), fields).first()
    assert (s.base_keys, s.other_keys, s.common_keys, s.base_only, s.other_only) == (40, 39, 35, 5, 4)
    assert (s.n_diffs, s.diff_keys, s.rate_pct) == (14, 14, 40.0)
    assert (s.diff_price, s.diff_stock, s.diff_title, s.diff_status) == (7, 4, 2, 1)
    detail = reconcile.detail(pairs, fields, numeric)
    assert detail.count() == 23
    assert detail.filter("key = 'S014'").first().kind == "缺值"
    top = reconcile.top_deltas(detail, "price").collect()
    assert [t.key for t in top] == ["S003", "S001", "S002", "S004", "S005", "S006"]
    assert (top[0].delta, round(top[0].pct, 1)) == (300.0, 29.1)
    assert [(d.key, d.n_extra) for d in dedupe.duplicate_keys(tables["A"], "sku", "place").collect()] == [("S021", 1)]
    assert quality.split_missing_key(tables["A"], "sku")[1].count() == 1
    tagged = reconcile.tag_stores(tables, ["sku", *fields], "place")
    three = reconcile.pair_flags(reconcile.align(tagged, "sku", fields, "ABC", numeric), "ABC", fields, numeric, "all_pairs")
    assert reconcile.summary(three, fields).count() == 3


def test_web_table(spark):
    rows = [("A001", "138 0013 8000", "ZhangWei@QQ.com", "上海", "1,200", "2026/9/1"),
            ("A002", "139-0013-9000", "lina@gmail.com", "北京", "980", "2026年9月2日"),
            ("A003", " 13800138000 ", "zhangwei@qq.com", "上海", "1500", "2026.9.3"),
            ("A004", "1371234", "bad-email", "广州", "800", "2026-09-04"),
            ("B001", "13611112222", "chenjing@163.com", "广州", "2,300", "20260905"),
            ("B002", "13500001111", "yangfan@qq.com", "北京", "￥1200", "2026/9/6"),
            ("B003", "136 1111 2222", "chenjing@163.com", "广州", "700", "2026-09-07")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "place int, `订单号` string, `手机` string, `邮箱` string, `城市` string, `金额` string, `日期` string")
    done = quality.clean(df, ["手机", "邮箱", "金额", "日期"], "web")
    first = done.orderBy("place").collect()
    assert [r["日期"] for r in first[:5]] == ["2026-09-01", "2026-09-02", "2026-09-03", "2026-09-04", "2026-09-05"]
    assert first[5]["金额"] == "1200" and first[3]["邮箱"] == "bad-email"
    kept = dedupe.dedupe(done, "手机", "place")
    assert [r["金额"] for r in summary.sort_mixed(kept, "金额", "place", True).collect()] == ["2300", "1200", "1200", "980", "800"]
    groups = {r["城市"]: (r["条数"], r["金额_合计"]) for r in summary.group_single_sum(kept, "城市", "place", "金额").collect()}
    assert groups == {"北京": (2, 2180.0), "上海": (1, 1200.0), "广州": (2, 3100.0)}


def test_mixed_sort_is_stable(spark):
    cells = ["b", "10", "", "2", "1,000", "a", "2", "x"]
    df = spark.createDataFrame(list(enumerate(cells)), "place int, c string").repartition(5)
    number = lambda v: (0, float(v.replace(",", ""))) if v.replace(",", "").isdigit() else (1, v)
    for down in (False, True):
        want = sorted(enumerate(cells), key=lambda t: number(t[1]), reverse=down)
        assert [tuple(r) for r in summary.sort_mixed(df, "c", "place", down).collect()] == want


def test_three_rounds_of_checks(spark):
    rounds = {"官网首页": "111", "慢接口": "111", "超时接口": "000", "支付回调": "001"}
    rows = [(n, r, f"2026-09-24 10:0{r}:00", flags[r] == "1", 200, 900 if n == "慢接口" else 50)
            for n, flags in rounds.items() for r in range(3)]
    checks = spark.createDataFrame(rows, "name string, no int, at string, ok boolean, status int, ms int").withColumn("ts", F.col("at").cast("timestamp"))
    found = health.streaks(checks, "name", "ok", "ts", ["ts", "no"], time_chunk("ts", 60), ["status", "ms"])
    states = {(r.name, r.no): r.state for r in health.with_state(found, "ok").collect()}
    assert [states["支付回调", i] for i in range(3)] == ["below_threshold", "outage", "recovered"]
    assert [states["超时接口", i] for i in range(3)] == ["below_threshold", "outage", "still_down"]
    assert health.outage_edges(found, "ok").filter("no = 1").count() == 2
    final = {r.name: r for r in health.target_state(found, "name", "ok", "ts", ["ts", "no"], "status", "ms").collect()}
    assert final["支付回调"].consecutive_fail == 0 and final["超时接口"].down
    assert final["支付回调"].first_fail_at is not None  # never reset
    per_round = {r["round"]: (r.n_ok, r.n_bad, r.n_slow) for r in health.round_summary(checks, F.col("no"), "ok", "ms", 800).collect()}
    assert per_round == {0: (2, 2, 1), 1: (2, 2, 1), 2: (3, 1, 1)}


def test_streaks_do_not_depend_on_slices_or_partitions(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["hot", "hot", "hot", "cold"]), rng.random() < 0.5, i * 40) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, name string, ok boolean, s int").withColumn("ts", F.timestamp_seconds("s"))
    want, run = {}, {}
    for i, name, ok, _ in rows:
        want[i] = run[name] = 0 if ok else run.get(name, 0) + 1
    for seconds, parts in ((1, 7), (3600, 3), (10 ** 9, 1)):
        got = health.streaks(df.repartition(parts, "id"), "name", "ok", "ts", ["ts", "id"], time_chunk("ts", seconds))
        assert {r.id: r.streak for r in got.collect()} == want


def test_previous_values_cross_slices(spark):
    df = spark.createDataFrame([(i, "k", str(i // 3), i * 1000) for i in range(20)], "id int, k string, v string, s int").withColumn(
        "ts", F.timestamp_seconds("s"))
    got = {r.id: r.prev_v for r in with_previous(df, "k", ["ts", "id"], ["v"], time_chunk("ts", 3600)).collect()}
    assert got == {i: None if i == 0 else str((i - 1) // 3) for i in range(20)}


def test_dense_numbers(spark):
    df = spark.range(0, 5000, 3).selectExpr("id", "cast(id % 2 as string) AS g", "concat('p', lpad(id, 6, '0')) AS path").repartition(9)
    got = sorted((r.id, r.n) for r in dense_number_by_id(df, "id", "n", width=256).collect())
    assert got == [(i, k) for k, i in enumerate(range(0, 5000, 3), 1)]
    grouped = dense_number(df, ["path"], "n", ["g"]).collect()
    for g in "01":
        assert [r.n for r in sorted((r for r in grouped if r.g == g), key=lambda r: r.path)] == list(range(1, 1 + sum(r.g == g for r in grouped)))


def test_ranges_of_any_order(spark):
    """Small ranges, NULLs, falling and mixed orders, structs and collated text against a plain window."""
    rows = [(i, None if i % 7 == 0 else (i * 37) % 50, None if i % 11 == 0 else f"t{(i * 13) % 30}", i % 3 == 0) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, a int, b string, c boolean").withColumn("s", F.struct("a", "b")).withColumn("z", F.collate("b", "zh")).repartition(7)
    for keys, groups in (([("a", True), "id"], []), (["b", ("a", True), ("id", True)], []), (["s", "id"], ["c"]), ([("z", True), "id"], ["a"]), (["id"], ["b", "c"])):
        order = [F.col(k[0]).desc() if isinstance(k, tuple) else F.col(k) for k in keys]
        both = dense_number(df, keys, "n", groups, per_range=64).withColumn("m", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
        assert both.count() == 2000 and both.filter("n <> m").count() == 0, keys
    assert dense_number(df.limit(0), ["id"], "n").count() == 0


def test_numbering_reads_its_input_once(spark):
    df = spark.range(0, 5000, 3).withColumn("v", F.col("id") * 2)
    numbered = dense_number_by_id(df.filter("v % 5 <> 1"), "id", "n", width=256)
    numbered.collect()
    final = numbered._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in final and "RDDScan" not in final  # no checkpoint, one shuffle of the rows


def test_inventory(spark):
    files = [("照片/DSC_0001.jpg", "photo-a-content"), ("照片/DSC_0002.jpg", "photo-b-content"), ("照片/DSC_0001_副本.jpg", "photo-a-content"),
             ("照片/logo.PNG", "logo-content"), ("合同/合同-张三.docx", "contract-a-content"), ("合同/扫描件.pdf", "scanned-pdf-content"),
             ("合同/扫描件_空白.pdf", ""), ("报表/8月销售.xlsx", "sales-august-content"), ("报表/8月销售 - 副本.xlsx", "sales-august-content"),
             ("杂项/backup 2026.zip", "zip-content"), ("杂项/readme.txt", "readme-content")]
    df = spark.createDataFrame(files, "rel_path string, body string").select(
        "rel_path", F.sha2("body", 256).alias("fingerprint"), F.octet_length("body").alias("size"))
    marked = inventory.mark_duplicates(inventory.classify(df, "rel_path", "size"), "rel_path", "fingerprint")
    assert {r.category: r.n for r in inventory.category_tally(marked).collect()} == {"图片": 3, "文档": 4, "表格": 1, "压缩包": 1, "_重复文件": 2}
    assert {r.rel_path: r.original for r in marked.filter("is_duplicate").collect()} == {
        "报表/8月销售.xlsx": "报表/8月销售 - 副本.xlsx", "照片/DSC_0001_副本.jpg": "照片/DSC_0001.jpg"}
    assert marked.filter("size_flag = 'empty'").count() == 1 and marked.filter("size_flag = 'tiny'").count() == 10
    plan = {r.rel_path: r.target for r in archive.archive_plan(df, day=F.lit("2026-09-24").cast("date")).collect()}
    assert plan["照片/logo.PNG"] == "图片/图片_20260924_003.png"
    assert plan["照片/DSC_0001_副本.jpg"] == "_重复文件/照片__DSC_0001_副本.jpg"


def test_collisions_match_a_walk_in_path_order(spark):
    rng = random.Random(3)
    names = ["a.txt", "a(2).txt", "a(3).txt", "b.txt"]
    rows = [(f"d{i:02d}/x", "t/" + rng.choice(names)) for i in range(24)]
    taken, want = set(), {}
    for path, target in rows:
        k, cand = 1, target
        while cand in taken:
            k += 1
            cand = target.replace(".txt", f"({k}).txt")
        taken.add(cand)
        want[path] = cand
    df = spark.createDataFrame(rows, "path string, target string").repartition(4)
    assert {r.path: r.target for r in archive.resolve_collisions(df, "path").collect()} == want
    assert archive.resolve_collisions(df, "path", "skip").count() == len({t for _, t in rows})


def longest_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_line_diff(spark):
    rng = random.Random(11)
    cases = [("甲\n乙\n丙", "甲\n乙\n丙"), ("甲\n乙", "甲\n乙\n丙"), ("甲\n乙\n丙", "甲\n丙"), ("一\n二\n三", "一\n二改\n三"), ("", "新")]
    cases += [("\n".join(rng.choices("abcd", k=rng.randint(1, 14))), "\n".join(rng.choices("abcd", k=rng.randint(1, 14)))) for _ in range(40)]
    old = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "doc int, body string")
    new = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(cases)], "doc int, body string")
    ops = versions.diff_versions(old, new, "doc", "body").orderBy("doc", "op_no").collect()
    for i, (a, b) in enumerate(cases):
        mine = [o for o in ops if o.doc == i]
        assert [o.line for o in mine if o.op != "add"] == (a.split("\n") if a else [])
        assert [o.line for o in mine if o.op != "del"] == (b.split("\n") if b else [])
        assert sum(o.op == "eq" for o in mine) == longest_common(a.split("\n") if a else [], b.split("\n") if b else [])
    counts = {r.doc: (r.added, r.removed, r.unchanged) for r in versions.diff_counts(
        versions.diff_versions(old, new, "doc", "body"), "doc").collect()}
    assert [counts[i] for i in range(5)] == [(0, 0, 3), (1, 0, 2), (0, 1, 2), (1, 1, 2), (1, 0, 0)]


def blocks(spark, source):
    df = spark.createDataFrame([(1, source)], "doc int, body string")
    return [(r.kind, r.text) for r in mdcorpus.md_blocks(df, "doc", "body").orderBy("block_no").collect()]


def test_markdown_blocks(spark):
    assert blocks(spark, "# 一\n## 二\n正文\n第二行\n\n另一段") == [("heading", "一"), ("heading", "二"), ("paragraph", "正文\n第二行"), ("paragraph", "另一段")]
    assert blocks(spark, "* a\n+ b\n1. 甲\n2. 乙") == [("ul", "a\nb"), ("ol", "甲\n乙")]
    assert blocks(spark, "```python\n# x | y\n|--|\n```\n---\n> 甲\n>乙") == [("fence", "# x | y\n|--|"), ("rule", ""), ("quote", "甲\n乙")]
    assert blocks(spark, "前文\n| A | B |\n|---|---|\n| 1 | 2 |\n# a | b\n尾") == [("paragraph", "前文"), ("table", "| A | B |\n| 1 | 2 |\n# a | b"), ("paragraph", "尾")]
    assert blocks(spark, "| A | B |\n| 1 | 2 |")[0][0] == "paragraph"
    assert blocks(spark, "####### 七个")[0] == ("paragraph", "####### 七个")
    assert blocks(spark, "\n\n\n") == []
    df = spark.createDataFrame([(1, "# 甲\n# 甲\n# 甲\n# !!"), (2, "# 甲")], "doc int, body string")
    got = mdcorpus.md_headings(df, "doc", "body").orderBy("doc", "line_no").collect()
    assert [r.anchor for r in got] == ["甲", "甲-1", "甲-2", "section", "甲"]


def test_price_page_and_status(spark):
    page = spark.createDataFrame([(1, "¥299.00 ¥199.00 ¥199.00"), (2, "¥5 ¥7"), (3, "none")], "id int, html string")
    assert {r.id: r.price for r in snapshots.main_price(page, "id", "html").collect()} == {1: "¥199.00", 2: "¥5", 3: None}
    log = spark.createDataFrame([("a", 1, "¥199.00"), ("b", 1, "¥5"), ("b", 2, "")], "name string, run int, price string")
    today = spark.createDataFrame([("a", "¥159.00"), ("b", ""), ("c", ""), ("d", "¥1")], "name string, price string")
    got = {r.name: (r.status, r.prev_price) for r in snapshots.compare_snapshot(today, log, "name", "price", ["run"]).collect()}
    assert got == {"a": ("changed", "¥199.00"), "b": ("unchanged", ""), "c": ("error", ""), "d": ("first", "")}


def test_step_notes(spark):
    df = spark.createDataFrame([(1, "x")], "id int, city string")
    result = steps.run_steps([{"action": "sort", "by": "ghost"}, {"action": "polish"}, {"action": "group", "by": "city"}], df, order_by="id")
    assert [n[2].split(":")[0] for n in result.notes] == ["skipped", "skipped", "group_by_city.csv", "result.csv"]


def test_ragged_and_quoted_exports(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id; name ;note\n1;"x;""y""";"two\nlines"\n2;short\n;;\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("id\tname\textra\n3\tz\tq\textra\n", encoding="utf-8")
    (tmp_path / "c.csv").write_bytes("id,name\n4,臺灣\n".encode("big5"))
    rows = exports.read_exports(spark, str(tmp_path)).orderBy("id").collect()
    assert [(r.id, r.name, r.note, r.extra) for r in rows[:3]] == [("1", 'x;"y"', "two\nlines", ""), ("2", "short", "", ""), ("3", "z", "", "q")]
    (tmp_path / "d.csv").write_text("id,v.1\n5,dot\n", encoding="utf-8")
    dotted = exports.read_exports(spark, str(tmp_path)).filter("id = '5'")
    assert quality.clean(dotted, ["id", "v.1"]).first()["v.1"] == "dot"
    assert rows[0].asDict().keys() == {"id", "name", "note", "extra", "__source__", "__row__"}


def test_split_reading_keeps_row_numbers(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.csv").write_text("id,v\n" + "".join(f"{name}{i},{i}\n" for i in range(3000)), encoding="utf-8")
    rows = exports.read_exports(spark, str(tmp_path), split=4096)
    assert rows.filter("__row__ <> cast(v as bigint) + 1").count() == 0
    assert rows.count() == 6000


def test_dedupe_rules(spark):
    rows = [(1, "a", "x"), (2, "", "x"), (3, " a ", "y"), (4, "", "x"), (5, "b", "x")]
    df = spark.createDataFrame(rows, "id int, k string, v string")
    assert sorted(r.id for r in dedupe.dedupe(df, "k", "id").collect()) == [1, 2, 4, 5]
    assert sorted(r.id for r in dedupe.dedupe(df, "k", "id", "last").collect()) == [2, 3, 4, 5]
    again = dedupe.dedupe(dedupe.dedupe(df, "k", "id"), "k", "id")
    assert again.count() == 4
    composite = dedupe.dedupe_composite(df, ["k", "v"], "id")
    assert sorted((r.position, r.id) for r in composite.collect()) == [(1, 1), (2, 4), (3, 3), (5, 5)]
