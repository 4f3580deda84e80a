"""Rules as data: predicates and first-match routing, compiled to one expression."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.functions.normalize import form_number
from opsframe.functions.text import blank_if_null, is_blank, is_pattern, strip

# Where a row goes when no rule claims it.
DEFAULT_ROUTE = {"name": "待分配", "owner": "客服组", "priority": "low"}

NUMERIC = {
    "gt": lambda a, b: a > b,
    "gte": lambda a, b: a >= b,
    "lt": lambda a, b: a < b,
    "lte": lambda a, b: a <= b,
}


def predicate(field: str, op: str, value: object = None, columns: Sequence[str] | None = None) -> Column:
    """One condition as a never-NULL boolean.  A field the table lacks reads as empty text."""
    cell = F.lit("") if columns is not None and field not in columns else F.col(field)
    text = strip(cell)
    op = (op or "equals").lower()
    if op in NUMERIC:
        hit = NUMERIC[op](form_number(cell), form_number(F.lit(str(value))))
    elif op == "equals":
        hit = text == F.lit(str(value).strip())
    elif op == "contains":
        hit = blank_if_null(cell).contains(str(value))
    elif op == "in":
        hit = text.isin([str(v).strip() for v in value])
    elif op == "regex":
        hit = blank_if_null(cell).rlike(str(value)) if is_pattern(str(value)) else F.lit(False)
    elif op == "not_empty":
        hit = ~is_blank(cell)
    else:
        hit = F.lit(False)
    return F.coalesce(hit, F.lit(False))


def all_of(conditions: Sequence[Mapping], columns: Sequence[str] | None = None) -> Column:
    hit = F.lit(True)
    for c in conditions or []:
        hit = hit & predicate(c.get("field", ""), c.get("op", "equals"), c.get("value"), columns)
    return hit


def route(df: DataFrame, rules: Sequence[Mapping], category: str = "category", owner: str = "owner",
          priority: str = "priority") -> DataFrame:
    """Tag each row with the first rule whose conditions all hold; a rule without conditions takes everything."""
    names = [r.get("name", DEFAULT_ROUTE["name"]) for r in rules]
    owners = [r.get("owner", "") for r in rules]
    ranks = [r.get("priority", "normal") for r in rules]
    which = F.lit(len(rules))
    for i in reversed(range(len(rules))):
        which = F.when(all_of(rules[i].get("match"), df.columns), i).otherwise(which)
    pick = lambda values, last: F.element_at(
        F.array(*[F.lit(v) for v in [*values, last]]), F.col("_rule") + 1)
    return (
        df.withColumn("_rule", which)
        .withColumn(category, pick(names, DEFAULT_ROUTE["name"]))
        .withColumn(owner, pick(owners, DEFAULT_ROUTE["owner"]))
        .withColumn(priority, pick(ranks, DEFAULT_ROUTE["priority"]))
        .drop("_rule")
    )


def route_summary(df: DataFrame, amount: str) -> DataFrame:
    """Rows, owner, priority and amount per category.

    The rows are aggregated with owner and priority as keys (hash based); only those few rows see the text minimum.
    """
    parts = df.groupBy("category", "owner", "priority").agg(
        F.count("*").alias("_n"), F.sum(F.coalesce(form_number(amount), F.lit(0))).alias("_sum"))
    return parts.groupBy("category").agg(
        F.sum("_n").alias("n_rows"), F.min("owner").alias("owner"), F.min("priority").alias("priority"),
        F.sum("_sum").cast("double").alias("total"))


def urgent(df: DataFrame, amount: str, order_by: str, n: int = 10, priority: str = "high") -> DataFrame:
    """The report's urgent list: high-priority rows by amount."""
    value = F.coalesce(form_number(amount), F.lit(0))
    return df.filter(F.col("priority") == priority).orderBy(value.desc(), order_by).limit(n)


def check_result(status: Column | str, body: Column | str, keyword: Column | str, accepted: Column) -> Column:
    """Struct ``ok, keyword_hit, error`` of one endpoint check; an empty keyword is not configured."""
    s = F.col(status) if isinstance(status, str) else status
    kw = blank_if_null(keyword)
    wants = kw != ""
    status_ok = F.coalesce(F.array_contains(accepted, s), F.lit(False))
    hit = F.contains(blank_if_null(body), kw)
    error = (
        F.when(wants & status_ok & ~hit, F.concat(F.lit("页面里找不到关键词「"), kw, F.lit("」")))
        .when(~wants & ~status_ok,
              F.concat(F.lit("状态码 "), s.cast("string"), F.lit("，期望 "),
                       F.array_join(F.transform(accepted, lambda x: x.cast("string")), "/")))
        .otherwise("")
    )
    ok = F.when(wants, status_ok & hit).otherwise(status_ok)
    return F.struct(ok.alias("ok"), F.when(wants, hit).alias("keyword_hit"), error.alias("error"))


def name_filter(df: DataFrame, name: str, part: str) -> DataFrame:
    return df.filter(F.col(name).contains(part)) if part else df
