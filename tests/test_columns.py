"""Literal cases of the column functions."""

from pyspark.sql import functions as F

from opsframe.functions import epoch, jsoncols, normalize, payload, text, urls
from opsframe.operators import mdcorpus


def test_stock_number(cells):
    given = ["¥1,299.00", "1 299", "(380)", "120件", "99元", "-45", "", "N/A", "待定", "12.5%", "--5", "(-5)"]
    got = [None if v is None else float(v) for v in cells(given, normalize.stock_number)]
    assert got == [1299, 1299, -380, 120, 99, -45, None, None, None, 12.5, 5, -5]


def test_kpi_and_form_numbers(cells):
    given = ["¥1,041.32", " 614.18 ", "(380.00)", "", "--", "nan", "1d", "5%", "1_000"]
    kpi, form = zip(*cells(given, normalize.kpi_number, normalize.form_number))
    show = lambda xs: [None if v is None else float(v) for v in xs]
    assert show(kpi) == [1041.32, 614.18, -380, None, None, None, None, 5, None]
    assert show(form) == [1041.32, 614.18, 380, None, None, None, 1, 5, 1000]


def test_amount_texts(cells):
    given = ["1,200", "￥1200", "12.50", "1.999", "bad", ""]
    assert cells(given, lambda c: normalize.table_amount(c).value) == ["1200", "1200", "12.5", "2.0", "bad", ""]
    assert cells(given, lambda c: normalize.table_amount(c).ok) == [True, True, True, True, False, True]
    assert cells(given, normalize.form_amount) == ["1200", "1200", "12.50", "2.00", "bad", ""]
    assert cells(given, normalize.web_amount) == ["1200", "1200", "12.5", "1.999", "bad", ""]


def test_phones(cells):
    given = ["138 0013 8000", "+86-137-0013-7000", "1371234", "１２3", "abc"]
    assert cells(given, lambda c: normalize.table_phone(c).value) == ["13800138000", "8613700137000", "1371234", "１２3", ""]
    assert cells(given, lambda c: normalize.table_phone(c).ok) == [True, False, False, False, True]
    assert cells(given, normalize.form_phone) == ["13800138000", "13700137000", "1371234", "１２3", ""]
    assert cells(given, normalize.web_phone) == ["13800138000", "+86-137-0013-7000", "1371234", "１２3", "abc"]


def test_dates(cells):
    given = ["2026/9/1", "2026年9月2日", "2026.9.3", "20260905", "2026-02-30", "2026-13-45 x", "2026-9/1", ""]
    assert cells(given, lambda c: normalize.table_date(c).value) == [
        "2026-09-01", "2026-09-02", "2026-09-03", "2026-09-05", "2026-02-30", "2026-13-45 x", "2026-9/1", ""]
    assert cells(given, lambda c: normalize.table_date(c).ok) == [True, True, True, True, False, False, False, True]
    assert cells(given, normalize.form_date)[4:7] == ["2026-02-30", "2026-13-45", "2026-09-01"]
    assert [str(d) for d in cells(["46268", "2026-09-24T10:00", "0000-01-01"], normalize.kpi_date)] == [
        "2026-09-03", "2026-09-24", "None"]


def test_name_guessing():
    assert normalize.guess_kind("Order_Date", "table") == "date"
    assert normalize.guess_kind("hotel", "table") == "phone"  # substring rule
    assert normalize.guess_kind("金额", "web") == "amount"
    assert normalize.guess_kind("总价", "table") == "text"


def test_strip_and_lines(cells):
    assert cells(["　a b\xa0", "\t"], text.strip) == ["a b", ""]
    assert cells(["a\r\nb\r\n", "a\rb", "a\nb\n", "", "\n"], text.lines) == [["a", "b"], ["a", "b"], ["a", "b"], [], [""]]


def test_epochs(cells):
    assert cells(["1700000000", "1700000000123", "1,700_000 000", "-5", "x", ""], epoch.parse_epoch) == [
        1700000000000, 1700000000123, 1700000000000, -5000, None, None]
    assert cells(["2026-02-30", "2026-02-28 24:00", "2026/1/2T3:4", "0099-01-01"], epoch.parse_datetime) == [
        None, None, 1767323040000, None]
    assert cells(["0"], lambda c: epoch.format_iso(epoch.parse_epoch(c), -330)) == ["1969-12-31T18:30:00-05:30"]
    assert cells(["x"], lambda c: epoch.weekday(epoch.parse_epoch(c))) == [None]


def test_urls(cells):
    assert cells(["%E5", "%zz", "a+b", "%E4%BD%A0", "%EF%BF%BD"], urls.decode) == [None, None, "a+b", "你", "�"]
    assert cells(["a+b"], lambda c: urls.decode(c, plus=True)) == ["a b"]
    assert cells(["中 文!'()*~-_."], urls.encode_component) == ["%E4%B8%AD%20%E6%96%87!'()*~-_."]
    pairs = cells(["https://a.com/?a=1&b=2&a=3&flag&=v#z", "a=1", "https://a.com", "x"], urls.query_params)
    assert [[tuple(p) for p in row] for row in pairs] == [
        [("a", "1"), ("b", "2"), ("a", "3"), ("flag", ""), ("", "v")], [("a", "1")], [], []]


def test_base64(cells):
    assert cells(["", "f", "fo", "foo", "foob"], payload.b64_encode) == ["", "Zg==", "Zm8=", "Zm9v", "Zm9vYg=="]
    decoded = cells(["Zg", "Zm8=", "Zm 9v\n", "Zm9v-_", "****", "Z", "a==="], payload.b64_decode)
    assert [None if b is None else bytes(b) for b in decoded] == [b"f", b"fo", b"foo", b"foo\xfb", None, None, b""]
    assert cells(["a" * 57 + "b" * 57], lambda c: F.length(payload.b64_encode(c, wrap=76))) == [153]


def test_json(cells):
    given = ['{"a":1}', '{"a":1}x', "[1,2]", "null", "", "1,2", '{"b":[1,{"z":null,"y":2}],"a":"é"}']
    assert cells(given, jsoncols.is_valid) == [True, False, True, True, False, False, True]
    assert cells(given[-1:], jsoncols.canonical) == ['{"a":"é","b":[1,{"y":2,"z":null}]}']
    spaced = '{ "b" : [ 1 , "a  \\" b" ] ,\n "a":"%s" }' % ("x \\n" * 20000)
    assert cells([spaced, "{ ]"], jsoncols.minify) == ['{"b":[1,"a  \\" b"],"a":"%s"}' % ("x \\n" * 20000), None]
    tricky = ['say "hi"\n', "\x1b[0m", "back\\slash \\u001B"]
    assert cells(tricky, jsoncols.escape) == ['say \\"hi\\"\\n', "\\u001b[0m", "back\\\\slash \\\\u001B"]
    assert cells(tricky, lambda c: jsoncols.unescape(jsoncols.escape(c))) == tricky[:1] + tricky[1:]


def test_groups_that_took_no_part(cells):
    got = cells(["ab a"], lambda c: text.match_groups(c, r"(a)(b)?(x*)", 3))[0]
    assert [(m["match"], m["g1"], m["g2"], m["g3"]) for m in got] == [("ab", "a", "b", ""), ("a", "a", None, "")]


def test_prices(cells):
    page = "<p>¥199.00</p><p>¥ 199.00</p>市场价 ¥299.00 已有 1,280 人 ¥1299.00"
    assert cells([page], text.price_hits) == [["¥199.00", "¥199.00", "¥299.00", "¥129"]]
    assert cells([page], lambda c: text.price_hits(c, long_amounts=True))[0][-1] == "¥1299.00"


def test_template_and_extension(cells):
    values = {"category": F.lit("图片"), "index": F.lit(7), "big": F.lit(12345)}
    assert cells(["x"], lambda c: text.render("{category}_{index:03d}_{big:03d}_{who}", values)) == ["图片_007_12345_{who}"]
    assert cells(["a.tar.GZ", ".bashrc", "x/y.PNG", "a."], text.extension) == [".GZ", "", ".PNG", "."]


def test_inline_markup(cells):
    given = ["`a*b*c`", "**粗** 和 `码`", "a *斜* b", "~~删~~", "[文字](http://x.com)", "![说明](a.png)", "<script>"]
    assert cells(given, mdcorpus.inline_html) == [
        "<code>a*b*c</code>", "<strong>粗</strong> 和 <code>码</code>", "a <em>斜</em> b", "<del>删</del>",
        '<a href="http://x.com" target="_blank" rel="noopener">文字</a>', '<img src="a.png" alt="说明">', "&lt;script&gt;"]


def test_large_and_small_numbers(cells):
    from opsframe.functions import normalize as N

    got = cells(["123456789012345678901.5", "0.000000001", "1" * 40, "-7.10"], N.table_number)
    assert [None if g is None else g.normalize() for g in got] == [
        __import__("decimal").Decimal(x) if x else None for x in ("123456789012345678901.5", "1E-9", None, "-7.1")]
    assert cells(["1" * 40], lambda c: N.table_amount(c).ok) == [False]


def test_json_keys(spark):
    from opsframe.functions import jsoncols

    rows = spark.createDataFrame([(1, """{"it's": 1, "a": 2, "a": 3, "q\\"x'": 4}""")], "i int, c string")
    assert rows.select(jsoncols.is_valid("c")).first()[0]
    table = jsoncols.json_to_table(rows, "c", "i", ["it's", "a", "q\"x'"]).first()
    assert (table["it's"], table["a"], table["q\"x'"]) == ("1", "3", "4")
    assert {(r.key, r.value) for r in jsoncols.json_members(rows, "c", "i").collect()} == {("it's", "1"), ("a", "3"), ("q\"x'", "4")}


def test_bad_patterns_match_nothing(spark):
    from pyspark.sql import functions as F

    from opsframe.functions import text
    from opsframe.operators import rules

    rows = spark.createDataFrame([("ab", "(a"), ("ab", "(a)"), ("ab", None)], "t string, p string")
    assert [r[0] for r in rows.select(text.matches("t", F.col("p"))).collect()] == [[], ["a"], []]
    assert not rows.select(rules.predicate("t", "regex", "([")).first()[0]


def test_prices_behind_other_spaces(cells):
    from opsframe.functions import text

    assert cells(["¥\u00a0199.00 x", "￥\u202f5", "12\u3000元"], text.price_hits) == [["¥\u00a0199.00"], ["￥\u202f5"], ["12\u3000元"]]


def test_long_diff_keeps_common_lines(spark):
    from opsframe.operators import versions

    lines = [str(i) for i in range(2100)]
    old = spark.createDataFrame([(1, "\n".join(["x", *lines])), (2, "only old")], "doc int, body string")
    new = spark.createDataFrame([(1, "\n".join([*lines, "y"])), (3, "only\nnew")], "doc int, body string")
    got = {r.doc: (r.added, r.removed, r.unchanged) for r in versions.diff_counts(versions.diff_versions(old, new, "doc", "body"), "doc").collect()}
    assert got == {1: (1, 1, 2100), 2: (0, 1, 0), 3: (2, 0, 0)}


def test_null_keys_keep_their_rows(spark):
    from pyspark.sql import functions as F

    from opsframe.operators import order

    rows = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "k string, n int")
    got = {(r.k, r.n): r.no for r in order.dense_number(rows, ["n"], "no", ["k"]).collect()}
    assert got == {(None, 1): 1, (None, 2): 2, ("a", 1): 1}
    seen = order.with_previous(rows, "k", ["n"], ["n"], F.lit(0))
    assert {(r.k, r.n): r.prev_n for r in seen.collect()} == {(None, 1): None, (None, 2): 1, ("a", 1): None}
