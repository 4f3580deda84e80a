"""Field-by-field reconciliation of keyed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.functions.normalize import stock_number, text
from opsframe.functions.text import blank_if_null, lines, strip

# Kinds of difference.
MISSING_VALUE = "缺值"
NUMBER_DIFFERS = "数值不一致"
TEXT_DIFFERS = "文本不一致"
WHOLE_ROW = "（整条）"
ONLY_BASE = "仅基准方有"
ONLY_OTHER = "仅比对方有"


def select_fields(fields: Sequence[str], only: Sequence[str] = (), ignore: Sequence[str] = ()) -> list[str]:
    return [f for f in fields if (not only or f in only) and f not in ignore]


def tag_stores(tables: dict[str, DataFrame], columns: Sequence[str], order_by: str) -> DataFrame:
    """All tables as one, with a ``store`` column; a column a table lacks is NULL there."""
    out = None
    for name, df in tables.items():
        cells = [(F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")).alias(c)
                 for c in columns]
        part = df.select(F.lit(name).alias("store"), F.col(order_by).alias("_ord"), *cells)
        out = part if out is None else out.unionByName(part)
    return out


def _parsed(field: str) -> str:
    return f"{field}_number"


def align(tagged: DataFrame, key: str, fields: Sequence[str], stores: Sequence[str], numeric: Sequence[str] = (),
          ignore_case: bool = False) -> DataFrame:
    """One row per key with every store's record side by side (NULL where a store lacks the key).

    One aggregation does three jobs: it drops repeated keys (first row wins), aligns the stores and shuffles each row
    once.  It combines on the map side, so a key repeated very often does not gather in one task.  Numeric fields are
    parsed here, once per row, and not once per compared pair.
    """
    record = F.struct(*[F.col(f) for f in fields], *[stock_number(f).alias(_parsed(f)) for f in fields if f in numeric])
    k = strip(key)
    rows = tagged.select(k.alias("key"), "store", "_ord", record.alias("_rec")).filter("key <> ''")
    if ignore_case:
        # rows are unique per exact key first; among keys that differ in case the later row wins
        rows = rows.groupBy("store", "key").agg(F.min_by("_rec", "_ord").alias("_rec"), F.min("_ord").alias("_ord"))
        rows = rows.withColumn("key", F.lower("key"))
    pick = F.max_by if ignore_case else F.min_by
    return rows.groupBy("key").agg(*[
        pick("_rec", F.when(F.col("store") == s, F.col("_ord"))).alias(_column(i)) for i, s in enumerate(stores)])


def _column(i: int) -> str:
    return f"_s{i}"


def store_pairs(stores: Sequence[str], mode: str = "baseline") -> list[tuple[int, int]]:
    n = len(stores)
    if mode == "all_pairs":
        return [(i, j) for i in range(n) for j in range(i + 1, n)]
    return [(0, j) for j in range(1, n)]


def pair_rows(aligned: DataFrame, stores: Sequence[str], mode: str = "baseline") -> DataFrame:
    """One row per key and compared pair in which at least one side has the key."""
    pairs = [F.struct(F.lit(stores[i]).alias("base_store"), F.lit(stores[j]).alias("other_store"),
                      F.col(_column(i)).alias("b"), F.col(_column(j)).alias("o"))
             for i, j in store_pairs(stores, mode)]
    out = aligned.select("key", F.inline(F.array(*pairs)))
    return out.filter(F.col("b").isNotNull() | F.col("o").isNotNull())


def _differs(b: Column, o: Column, field: str, numeric: bool, tolerance: float, ignore_case: bool) -> Column:
    """Whether two records differ in a field; never NULL."""
    if not numeric:  # equal cells are settled without normalising them
        raw_b, raw_o = blank_if_null(b[field]), blank_if_null(o[field])
        return (raw_b != raw_o) & (text(raw_b, ignore_case) != text(raw_o, ignore_case))
    nb, no = b[_parsed(field)], o[_parsed(field)]
    far = F.coalesce(F.abs(nb - no) > F.lit(tolerance).cast("decimal(37,9)"), F.lit(False))
    return (nb.isNull() != no.isNull()) | far


def field_diff(field: str, numeric: bool, tolerance: float = 0.01, ignore_case: bool = False) -> Column:
    """NULL when the two values agree, else ``struct(field, kind, base, other, delta, pct)``."""
    raw_b, raw_o = F.col("b")[field], F.col("o")[field]
    b, o = blank_if_null(raw_b), blank_if_null(raw_o)

    def diff(kind: str, delta: Column, pct: Column) -> Column:
        return F.struct(F.lit(field).alias("field"), F.lit(kind).alias("kind"), b.alias("base"), o.alias("other"),
                        delta.cast("double").alias("delta"), pct.cast("double").alias("pct"))

    none = F.lit(None)
    if not numeric:  # equal cells are settled without normalising them
        return F.when((b != o) & (text(b, ignore_case) != text(o, ignore_case)), diff(TEXT_DIFFERS, none, none))
    nb, no = F.col("b")[_parsed(field)], F.col("o")[_parsed(field)]
    delta = (no - nb).cast("double")
    pct = F.when(nb != 0, delta / F.abs(nb).cast("double") * 100.0)
    return F.when(nb.isNull() != no.isNull(), diff(MISSING_VALUE, none, none)).when(
        F.abs(nb - no) > F.lit(tolerance).cast("decimal(37,9)"), diff(NUMBER_DIFFERS, delta, pct))


def diffs(pairs: DataFrame, fields: Sequence[str], numeric: Sequence[str] = (), tolerance: float = 0.01,
          ignore_case: bool = False) -> DataFrame:
    """Long table of differing fields for keys both sides have."""
    both = pairs.filter(F.col("b").isNotNull() & F.col("o").isNotNull())
    found = F.filter(F.array(*[field_diff(f, f in numeric, tolerance, ignore_case) for f in fields]),
                     lambda d: d.isNotNull())
    return both.select("base_store", "other_store", "key", F.inline(found))


def one_sided(pairs: DataFrame, title: str = "title") -> DataFrame:
    """Keys only one side has, with that side's title."""
    lone = pairs.filter(F.col("b").isNull() | F.col("o").isNull())
    base_only = F.col("o").isNull()
    return lone.select(
        "base_store", "other_store", "key", F.lit(WHOLE_ROW).alias("field"),
        F.when(base_only, ONLY_BASE).otherwise(ONLY_OTHER).alias("kind"),
        F.when(base_only, blank_if_null(F.col("b")[title])).otherwise("").alias("base"),
        F.when(base_only, "").otherwise(blank_if_null(F.col("o")[title])).alias("other"),
        F.lit(None).cast("double").alias("delta"), F.lit(None).cast("double").alias("pct"))


def detail(pairs: DataFrame, fields: Sequence[str], numeric: Sequence[str] = (), tolerance: float = 0.01,
           ignore_case: bool = False, title: str = "title") -> DataFrame:
    return diffs(pairs, fields, numeric, tolerance, ignore_case).unionByName(one_sided(pairs, title))


def pair_flags(aligned: DataFrame, stores: Sequence[str], fields: Sequence[str], numeric: Sequence[str] = (), mode: str = "baseline",
               tolerance: float = 0.01, ignore_case: bool = False) -> DataFrame:
    """One row of flags per key and compared pair: which side has the key, and for each field whether the two differ.

    The records are compared where they stand side by side, so no record is copied for the pairs it belongs to.
    """
    def flags(i: int, j: int) -> Column:
        b, o = F.col(_column(i)), F.col(_column(j))
        both = b.isNotNull() & o.isNotNull()
        return F.struct(F.lit(stores[i]).alias("base_store"), F.lit(stores[j]).alias("other_store"), b.isNotNull().alias("has_b"), o.isNotNull().alias("has_o"),
                        *[(both & _differs(b, o, f, f in numeric, tolerance, ignore_case)).alias(f"d_{f}") for f in fields])

    pairs = F.array(*[flags(i, j) for i, j in store_pairs(stores, mode)])
    return aligned.select(F.inline(pairs)).filter("has_b OR has_o")


def summary(flags: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Sizes, differing keys and differences per field for each pair of :func:`pair_flags`, in one aggregation."""
    n_diff = sum((F.col(f"d_{f}").cast("int") for f in fields), F.lit(0))
    flags = flags.withColumn("_n", n_diff)
    count = lambda c: F.count_if(c)
    out = flags.groupBy("base_store", "other_store").agg(
        count(F.col("has_b")).alias("base_keys"), count(F.col("has_o")).alias("other_keys"),
        count(F.col("has_b") & F.col("has_o")).alias("common_keys"),
        count(F.col("has_b") & ~F.col("has_o")).alias("base_only"),
        count(~F.col("has_b") & F.col("has_o")).alias("other_only"),
        count(F.col("_n") > 0).alias("diff_keys"), F.sum("_n").cast("bigint").alias("n_diffs"),
        *[count(F.col(f"d_{f}")).alias(f"diff_{f}") for f in fields])
    rate = F.when(F.col("common_keys") > 0, F.col("diff_keys") / F.col("common_keys") * 100).otherwise(0.0)
    return out.withColumn("rate_pct", rate)


def top_deltas(found: DataFrame, field: str, n: int = 10) -> DataFrame:
    """The report's largest differences of one numeric field; ties keep key order."""
    rows = found.filter((F.col("field") == field) & F.col("delta").isNotNull())
    return rows.orderBy(F.abs("delta").desc(), "base_store", "other_store", "key").limit(n)


def diff_alert(pair_summary: DataFrame, threshold: int = 1) -> DataFrame:
    """One row when all pairs together reach the threshold."""
    return pair_summary.agg(F.sum("n_diffs").alias("total_diffs")).filter(F.col("total_diffs") >= threshold).withColumn(
        "threshold", F.lit(threshold).cast("bigint"))


def key_sets(base: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Distinct keys with the set they belong to: common, base_only or other_only."""
    keys = base.select(strip(key).alias("key"), F.lit(1).alias("side")).unionByName(
        other.select(strip(key).alias("key"), F.lit(2).alias("side"))).filter("key <> ''")
    sides = keys.groupBy("key").agg(F.bit_or("side").alias("sides"))
    return sides.select("key", F.when(F.col("sides") == 3, "common").when(F.col("sides") == 1, "base_only")
                        .otherwise("other_only").alias("key_set"))


def line_multiset_diff(old: DataFrame, new: DataFrame, doc: str, body: str) -> DataFrame:
    """Added, removed and unchanged line counts per document, ignoring line order.

    Equal lines are counted before anything is compared, so copies of one line never meet as rows.
    """
    side = lambda df, sign: df.select(doc, F.explode(lines(body)).alias("line"), F.lit(sign).alias("sign"))
    counted = side(old, -1).unionByName(side(new, 1)).groupBy(doc, "line").agg(
        F.count_if(F.col("sign") < 0).alias("n_old"), F.count_if(F.col("sign") > 0).alias("n_new"))
    none = F.lit(0)
    return counted.groupBy(doc).agg(
        F.sum(F.greatest(F.col("n_new") - F.col("n_old"), none)).alias("added"),
        F.sum(F.greatest(F.col("n_old") - F.col("n_new"), none)).alias("removed"),
        F.sum(F.least("n_old", "n_new")).alias("unchanged"))
