"""Cell normalisers.  Profiles that look alike differ on purpose: each source system has its own rules."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from opsframe.functions.text import blank_if_null, is_blank, squeeze, strip

# 28 digits before the point and nine behind it, all exact; what does not fit is no number and is marked as such.
MONEY = "decimal(37,9)"

# Which column names mean which kind of cell, tried in the order written.
KEYWORDS = {
    "table": {
        "phone": ["phone", "mobile", "tel", "手机", "电话"],
        "email": ["email", "mail", "邮箱"],
        "amount": ["amount", "money", "price", "fee", "total", "金额", "价格", "总额"],
        "date": ["date", "time", "日期", "时间"],
    },
    "form": {
        "phone": ["phone", "mobile", "tel", "手机", "电话"],
        "email": ["email", "mail", "邮箱"],
        "date": ["date", "time", "日期", "时间"],
        "amount": ["amount", "money", "price", "金额", "价格", "总价", "付款"],
    },
    "web": {
        "phone": ["手机", "电话", "mobile", "phone", "tel"],
        "email": ["邮箱", "邮件", "mail"],
        "date": ["日期", "时间", "date", "time"],
        "amount": ["金额", "价格", "价", "钱", "额", "amount", "price", "fee", "cost"],
    },
}

# Accepted shapes.
EMAIL_SHAPE = r"(?U)^[^@\s]+@[^@\s]+\.[^@\s]+$"
NUMBER_SHAPE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


class Cleaned(NamedTuple):
    value: Column
    ok: Column


def guess_kind(name: str, profile: str = "table") -> str:
    """Kind of a column from its name; ``text`` when no keyword occurs."""
    low = name.lower()
    for kind, words in KEYWORDS[profile].items():
        if any(w in low for w in words):
            return kind
    return "text"


# --- numbers ----------------------------------------------------------------------------------------------------

def guarded_number(text: Column, dtype: str = MONEY) -> Column:
    """Cast only what looks like a number: Spark alone would also take ``1d`` and ``nan``.

    The input is named once (an extract, not a test and a cast), so a long chain before it is not computed twice.
    """
    return F.regexp_extract(text, NUMBER_SHAPE, 0).try_cast(dtype)


def _without(c: Column, chars: str) -> Column:
    return F.translate(c, chars, "")


def _plain_decimal(d: Column) -> Column:
    """Decimal as text without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(d.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def table_number(c: Column | str) -> Column:
    return guarded_number(_without(strip(c), ",¥￥$ "))


def table_amount(c: Column | str) -> Cleaned:
    """Whole amounts as integers, others rounded to cents; anything else is kept and marked invalid."""
    raw = strip(c)
    n = table_number(c)
    cents = F.round(n, 2)
    text = F.when(n == F.floor(n), n.cast("decimal(38,0)").cast("string")).otherwise(
        F.regexp_replace(cents.cast("decimal(38,2)").cast("string"), "0$", "")
    )
    empty = _without(raw, ",¥￥$ ") == ""
    return Cleaned(F.when(empty, "").when(n.isNull(), raw).otherwise(text), empty | n.isNotNull())


def form_number(c: Column | str) -> Column:
    """Keeps digits, dot and minus only, so ``(380)`` reads as 380."""
    text = F.regexp_replace(_without(strip(c), ",，"), r"[^0-9.\-]", "")
    return guarded_number(text)


def form_amount(c: Column | str) -> Column:
    n = form_number(c)
    whole = F.abs(n - F.round(n, 0)) < F.lit(1e-9)
    text = F.when(whole, F.round(n, 0).cast("decimal(38,0)").cast("string")).otherwise(
        F.round(n, 2).cast("decimal(38,2)").cast("string")
    )
    return F.coalesce(text, strip(c))


def kpi_number(c: Column | str) -> Column:
    """Accounting style: brackets are negative, currency signs, separators and percent signs are dropped."""
    signed = F.regexp_replace(strip(c), r"(?s)^\((.*)\)$", "-$1")
    body = F.regexp_replace(_without(signed, "¥￥$,， %"), r"^--", "")
    return guarded_number(body)


def stock_number(c: Column | str) -> Column:
    """As :func:`kpi_number` but also drops units and stray characters (``120件`` is 120, ``12.5%`` is 12.5).

    A bracketed amount is negative with or without a minus of its own; two minus signs cancel out.
    """
    marked = F.regexp_replace(strip(c), r"(?s)^\((.*)\)$", "~$1")
    body = _without(marked, "¥￥$,， \u00a0元件个")
    signed = F.regexp_replace(F.regexp_replace(body, r"^~?--", ""), r"^~-?", "-")
    return guarded_number(F.regexp_replace(signed, r"[^0-9eE+\-.]", ""))


def web_amount(c: Column | str) -> Column:
    s = strip(c)
    text = F.regexp_replace(s, r"(?U)[,\s￥¥$元]", "")
    n = guarded_number(text)
    return F.when(text == "", "").otherwise(F.coalesce(_plain_decimal(n), s))


def plain_number(c: Column | str, drop: str = ",") -> Column:
    """Lenient number used by sorting and grouping: only the given characters are dropped."""
    return guarded_number(_without(strip(c), drop))


# --- phone, email, text -----------------------------------------------------------------------------------------

def table_phone(c: Column | str) -> Cleaned:
    digits = F.regexp_replace(blank_if_null(c), r"(?U)\D", "")
    return Cleaned(digits, digits.rlike("^(.{11})?$"))


def form_phone(c: Column | str) -> Column:
    digits = F.regexp_replace(blank_if_null(c), r"(?U)\D", "")
    china = digits.startswith("86") & (F.length(digits) == 13)
    return F.when(china, F.substring(digits, 3, 11)).otherwise(digits)


def web_phone(c: Column | str) -> Column:
    s = strip(c)
    digits = F.regexp_replace(s, r"[^0-9]", "")
    usable = digits.rlike(r"^1[3-9][0-9]{9}$") | F.length(digits).between(7, 12)
    return F.when(usable, digits).otherwise(s)


def table_email(c: Column | str) -> Cleaned:
    v = F.lower(F.replace(strip(c), F.lit(" "), F.lit("")))
    return Cleaned(v, (v == "") | v.rlike(EMAIL_SHAPE))


def form_email(c: Column | str) -> Column:
    return F.replace(F.lower(strip(c)), F.lit(" "), F.lit(""))


def web_email(c: Column | str) -> Column:
    s = strip(c)
    return F.when(s.contains("@"), F.lower(s)).otherwise(s)


def text(c: Column | str, ignore_case: bool = False) -> Column:
    s = squeeze(c)
    return F.lower(s) if ignore_case else s


# --- dates ------------------------------------------------------------------------------------------------------

# Accepted date shapes.  The separator must be the same on both sides.
DATE_SEPARATED = r"^([0-9]{4})([-/.])([0-9]{1,2})\2([0-9]{1,2})$"
DATE_CHINESE = r"^([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日$"
DATE_PACKED = r"^([0-9]{4})([0-9]{2})([0-9]{2})$"
FORM_DATE = r"(?s)^([0-9]{4})[-/.年]([0-9]{1,2})[-/.月]([0-9]{1,2}).*$"
WEB_DATE = r"(?s)^([0-9]{4})[^0-9]([0-9]{1,2})[^0-9]([0-9]{1,2}).*$"


def strict_date(s: Column) -> Column:
    """Date of a text in one of five whole-cell shapes; NULL when the day does not exist."""
    dashed = F.regexp_replace(s, DATE_CHINESE, "$1-$2-$3")
    dashed = F.regexp_replace(dashed, DATE_SEPARATED, "$1-$3-$4")
    dashed = F.regexp_replace(dashed, DATE_PACKED, "$1-$2-$3")
    return F.regexp_extract(dashed, r"^(?!0000)[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", 0).try_cast("date")


def table_date(c: Column | str) -> Cleaned:
    raw = strip(c)
    packed = F.replace(raw, F.lit(" "), F.lit(""))
    d = strict_date(packed)
    return Cleaned(F.coalesce(d.cast("string"), raw), (packed == "") | d.isNotNull())


def _prefix_date(c: Column | str, pattern: str) -> Column:
    """Pads what looks like a date at the start of the cell; the calendar is not checked."""
    dashed = F.regexp_replace(F.regexp_replace(strip(c), pattern, "$1-$2-$3"), DATE_PACKED, "$1-$2-$3")
    month = F.regexp_replace(dashed, r"^([0-9]{4})-([0-9])-([0-9]{1,2})$", "$1-0$2-$3")
    return F.regexp_replace(month, r"^([0-9]{4}-[0-9]{2})-([0-9])$", "$1-0$2")


def form_date(c: Column | str) -> Column:
    return _prefix_date(c, FORM_DATE)


def web_date(c: Column | str) -> Column:
    return _prefix_date(c, WEB_DATE)


def kpi_date(c: Column | str) -> Column:
    """Date part of a cell, spreadsheet day numbers included."""
    s = F.substring_index(F.substring_index(strip(c), " ", 1), "T", 1)
    serial = F.regexp_extract(s, r"^[0-9]{5}$", 0).try_cast("int")
    return F.coalesce(strict_date(s), F.date_add(F.lit("1899-12-30").cast("date"), serial))


# --- presentation -----------------------------------------------------------------------------------------------

def show_money(c: Column | str, missing: str = "-") -> Column:
    v = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.format_number(v.cast("decimal(38,2)"), 2), F.lit(missing))


def show_percent(c: Column | str, missing: str = "-") -> Column:
    v = F.col(c) if isinstance(c, str) else c
    one = F.round(v, 1).cast("decimal(20,1)")
    return F.coalesce(F.concat(F.when(one < 0, "").otherwise("+"), one.cast("string"), F.lit("%")), F.lit(missing))


def show_number(c: Column | str, missing: str = "-") -> Column:
    v = (F.col(c) if isinstance(c, str) else c).cast(MONEY)
    whole = F.abs(v - F.round(v, 0)) < F.lit(1e-9)
    return F.coalesce(F.when(whole, F.format_number(v, 0)).otherwise(F.format_number(v, 2)), F.lit(missing))


# --- by kind ----------------------------------------------------------------------------------------------------

def blank_after_clean(c: Column | str, kind: str) -> Column:
    """Whether cleaning a cell leaves nothing, told from the raw cell at the price of one short search."""
    return ~blank_if_null(c).rlike(r"(?U)\d") if kind == "phone" else is_blank(c)


def clean_cell(c: Column | str, kind: str, profile: str = "table") -> Cleaned:
    """Cleaned value and validity of one cell; only the table profile judges validity."""
    fine = F.lit(True)
    if profile == "table":
        rules = {"phone": table_phone, "email": table_email, "amount": table_amount, "date": table_date}
        return rules[kind](c) if kind in rules else Cleaned(squeeze(c), fine)
    if profile == "form":
        rules = {"phone": form_phone, "email": form_email, "amount": form_amount, "date": form_date}
        return Cleaned(rules[kind](c) if kind in rules else squeeze(c), fine)
    rules = {"phone": web_phone, "email": web_email, "amount": web_amount, "date": web_date}
    return Cleaned(rules[kind](c) if kind in rules else strip(c), fine)
