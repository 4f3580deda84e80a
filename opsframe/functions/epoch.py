"""Epoch and date-time expressions with fixed UTC offsets (minutes, east positive)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opsframe.functions.text import blank_if_null, col, strip

# Weekday names from Sunday, and the accepted date-time shape.
WEEKDAYS = ["星期日", "星期一", "星期二", "星期三", "星期四", "星期五", "星期六"]
DATETIME = r"^([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})(?:[ T]([0-9]{1,2}):([0-9]{1,2})(?::([0-9]{1,2}))?)?$"


def _packed(c: Column | str) -> Column:
    return F.regexp_replace(blank_if_null(c), r"(?U)[,_\s]", "")


def parse_epoch(c: Column | str, unit: str = "auto") -> Column:
    """Milliseconds of an epoch text; up to 12 digits count as seconds unless a unit is given."""
    t = _packed(c)
    digits = F.regexp_replace(t, r"^[+-]", "")
    n = F.when(t.rlike(r"^[+-]?[0-9]+$"), t).try_cast("bigint")
    seconds = F.length(digits) <= 12 if unit == "auto" else F.lit(unit == "s")
    return F.when(seconds, F.try_multiply(n, F.lit(1000).cast("bigint"))).otherwise(n)


def epoch_unit(c: Column | str) -> Column:
    digits = F.regexp_replace(_packed(c), r"^[+-]", "")
    return F.when(digits.rlike("^[0-9]+$"), F.when(F.length(digits) <= 12, "s").otherwise("ms"))


def parse_datetime(c: Column | str, offset: int = 0) -> Column:
    """Milliseconds of a wall-clock text that belongs to the given offset; NULL when the moment does not exist."""
    t = strip(c)
    part = lambda g: F.regexp_extract(t, DATETIME, g)
    number = lambda g: F.when(part(g) == "", F.lit(0)).otherwise(part(g).try_cast("int"))
    # years below 100 are rejected, as two-digit years would be
    iso = F.when(~part(1).startswith("00"), F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")))
    day = F.when(t.rlike(DATETIME), iso).try_cast("date")
    in_range = (number(4) <= 23) & (number(5) <= 59) & (number(6) <= 59)
    seconds = F.unix_date(day).cast("bigint") * 86400 + number(4) * 3600 + number(5) * 60 + number(6) - offset * 60
    return F.when(in_range, seconds * 1000)


def parse_any(c: Column | str, offset: int = 0) -> Column:
    """Plain digits are an epoch, anything else a date-time."""
    plain = _packed(c).rlike(r"^-?[0-9]+$")
    return F.when(plain, parse_epoch(c)).otherwise(parse_datetime(c, offset))


def wall_clock(ms: Column | str, offset: int = 0) -> Column:
    """Zone-free timestamp shown by a clock at the offset."""
    seconds = (col(ms) + F.lit(offset * 60000)).cast("decimal(18,0)") / F.lit(1000).cast("decimal(4,0)")
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return zero + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def format_local(ms: Column | str, offset: int = 0) -> Column:
    return F.date_format(wall_clock(ms, offset), "yyyy-MM-dd HH:mm:ss")


def format_iso(ms: Column | str, offset: int = 0) -> Column:
    zone = f"{'+' if offset >= 0 else '-'}{abs(offset) // 60:02d}:{abs(offset) % 60:02d}"
    return F.concat(F.date_format(wall_clock(ms, offset), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(zone))


def format_iso_utc(ms: Column | str) -> Column:
    return F.date_format(wall_clock(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def weekday(ms: Column | str, offset: int = 0) -> Column:
    names = F.array(*[F.lit(d) for d in WEEKDAYS])
    return F.when(col(ms).isNotNull(), F.element_at(names, F.dayofweek(wall_clock(ms, offset).cast("date"))))


def _parts(seconds: Column) -> tuple[Column, Column, Column, Column]:
    whole = lambda c: F.floor(c).cast("bigint")
    return whole(seconds / 86400), whole(seconds % 86400 / 3600), whole(seconds % 3600 / 60), seconds % 60


def _unit(n: Column, label: str, show: Column) -> Column:
    return F.when(show, F.concat(n.cast("string"), F.lit(" " + label)))


def duration_between(a: Column | str, b: Column | str) -> Column:
    """Struct with the signed milliseconds, whole days/hours/minutes/seconds and a readable text."""
    ms = col(b) - col(a)
    seconds = F.floor(F.abs(ms) / 1000).cast("bigint")
    d, h, m, s = _parts(seconds)
    text = F.concat_ws(
        " ",
        _unit(d, "天", d > 0), _unit(h, "小时", h > 0), _unit(m, "分钟", m > 0),
        _unit(s, "秒", (s > 0) | (seconds == 0)),
    )
    total = lambda unit: F.floor(seconds / unit).cast("bigint")
    text = F.when(ms.isNotNull(), text)
    return F.struct(
        ms.alias("ms"), F.when(ms < 0, -1).otherwise(1).alias("sign"), total(86400).alias("days"),
        total(3600).alias("hours"), total(60).alias("minutes"), seconds.alias("seconds"), text.alias("text"),
    )


def relative_age(ms: Column | str, reference_ms: Column | str) -> Column:
    """Age text against a reference time: days with hours, minutes only within a day, seconds only within an hour."""
    diff = col(ms) - col(reference_ms)
    seconds = F.floor(F.abs(diff) / 1000).cast("bigint")
    d, h, m, s = _parts(seconds)
    body = F.concat_ws(
        " ",
        _unit(d, "天", d > 0), _unit(h, "小时", h > 0), _unit(m, "分钟", (d == 0) & (m > 0)),
        _unit(s, "秒", (seconds < 3600) & (s > 0)),
    )
    return F.when(diff.isNull(), None).when(body == "", "此刻").otherwise(F.concat(body, F.when(diff >= 0, "后").otherwise("前")))
