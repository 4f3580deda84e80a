"""Order-dependent building blocks that do not put one key, or the whole table, into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsframe.functions.text import named

RANGE = 1 << 20  # blocks summed in one task
#: Rows per range of a sorted numbering, ranges at most, sampled rows per range.
PER_RANGE, MOST_RANGES, SAMPLE = 50_000, 4096, 20

NO_TIME = -(2 ** 62)  # a row without a time, or without an id, comes before all others

SortKey = str | tuple[str, bool]


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which NULL keys meet each other; the keys come from the left.

    Both sides grow with the input, and sizes guessed from packed files are far too low, so neither is ever broadcast.
    """
    names = {k: f"_same{i}" for i, k in enumerate(keys)}
    on = F.lit(True)
    for k, n in names.items():
        on = on & F.col(k).eqNullSafe(F.col(n))
    return left.join(right.withColumnsRenamed(names).hint("merge"), on).drop(*names.values())


def _plain_keys(df: DataFrame, order_by: Sequence[SortKey]) -> list[tuple[str, bool]]:
    """Names and directions; a struct sorts by its fields, one after the other."""
    out = []
    for key in order_by:
        name, down = (key, False) if isinstance(key, str) else key
        kind = df.select(name).schema[0].dataType
        fields = [f"{name}.`{f.name}`" for f in kind.fields] if isinstance(kind, T.StructType) else [name]
        out += [(f, down) for f in fields]
    return out


def _splitters(df: DataFrame, keys: list[tuple[str, bool]], per_range: int) -> list[Row]:
    """Borders of ranges of about ``per_range`` rows in the order of the keys, from a sample of at most some ten thousand rows.

    They only decide how evenly the work is dealt: any borders give the same numbers.
    """
    keyed = df.select(*[F.col(k).alias(f"k{i}") for i, (k, _) in enumerate(keys)])
    n = keyed.count()
    ranges = min(MOST_RANGES, -(-n // per_range))
    if ranges < 2:
        return []
    order = [F.col(f"k{i}").desc() if down else F.col(f"k{i}") for i, (_, down) in enumerate(keys)]
    sample = keyed.sample(fraction=min(1.0, SAMPLE * ranges / n), seed=7)
    placed = sample.withColumn("_at", F.row_number().over(Window.orderBy(*order)))  # a sample: one task is enough
    step = max(1, min(SAMPLE, n // ranges))
    return placed.filter(F.col("_at") % step == 0).orderBy("_at").drop("_at").collect()


def _range_of(df: DataFrame, keys: list[tuple[str, bool]], borders: list[Row]) -> Column:
    """Number of borders at or before a row, found by bisection; NULLs come first, and last in a falling order."""
    if not borders:
        return F.lit(0)
    kinds = [f.dataType for f in df.select(*[F.col(k).alias(f"k{i}") for i, (k, _) in enumerate(keys)]).schema]
    table = F.array(*[F.struct(*[F.lit(v).cast(kind).alias(f"k{i}") for i, (v, kind) in enumerate(zip(b, kinds))]) for b in borders])

    def precedes(border: Column) -> Column:
        out = F.lit(False)
        for i, (name, down) in reversed(list(enumerate(keys))):
            c, v = F.col(name), border[f"k{i}"]
            first = (c.isNotNull() & v.isNull()) | F.coalesce(c > v, F.lit(False)) if down else (
                (c.isNull() & v.isNotNull()) | F.coalesce(c < v, F.lit(False)))
            out = first | (c.eqNullSafe(v) & out)
        return out

    def halve(state: Column, _: Column) -> Column:
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        lower = precedes(F.element_at(table, middle + 1))
        open_ = state["low"] < state["high"]
        return F.struct(F.when(open_ & ~lower, middle + 1).otherwise(state["low"]).alias("low"),
                        F.when(open_ & lower, middle).otherwise(state["high"]).alias("high"))

    steps = F.sequence(F.lit(1), F.lit(len(borders).bit_length()))
    found = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(len(borders)).alias("high")), halve, lambda s: s["low"])
    return F.coalesce(found, F.lit(0))  # never NULL, or a join's test for it would be pushed below the keys and compute them at each step


def _placed(df: DataFrame, part: Column, keys: list[str], order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Rows with ``_numbering_part`` and their place ``_numbering_local`` in it (per group), and the sizes ``_numbering_n`` of all parts.

    Both come from one shuffle: each asks for all columns, so that neither is cut down to its own.  Should the shuffle run
    twice, the result is the same, because parts follow from the rows' values.
    """
    rows = df.withColumn("_numbering_part", part).repartition("_numbering_part")
    whole = F.xxhash64(*[named(c) for c in df.columns])
    sizes = rows.groupBy(*keys, "_numbering_part").agg(F.count("*").alias("_numbering_n"), F.max(whole).alias("_numbering_all")).filter("_numbering_all IS NOT NULL").drop("_numbering_all")
    w = Window.partitionBy(*keys, "_numbering_part").orderBy(*order)
    local = rows.withColumns({"_numbering_local": F.row_number().over(w), "_numbering_all": F.max(whole).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return local.filter("_numbering_all IS NOT NULL").drop("_numbering_all"), sizes


def dense_number(df: DataFrame, order_by: Sequence[SortKey], out: str, partition_by: Sequence[str] = (),
                 per_range: int = PER_RANGE) -> DataFrame:
    """1, 2, 3, ... in the given (unique) order, over the table or per group, without a one-task window.

    ``order_by`` holds column names, or pairs of a name and whether it falls.  The order is cut into ranges at sampled
    borders, written into the plan as values, so a row's range is the same whenever and wherever it is computed: no copy
    of the rows is kept, and a lost executor's rows come back to the same places.  A row's number is its place in its range
    plus the sizes of the same group's ranges before it, so one group may own most rows.
    """
    groups = list(partition_by)
    keys = _plain_keys(df, [*groups, *order_by])
    borders = _splitters(df, keys, per_range)
    order = [F.col(k).desc() if down else F.col(k) for k, down in keys[len(groups):]]
    local, sizes = _placed(df, _range_of(df, keys, borders), groups, order)
    # one row per range and group, so the running total may use a plain window
    before = Window.partitionBy(*groups).orderBy("_numbering_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_numbering_before", F.coalesce(F.sum("_numbering_n").over(before), F.lit(0))).drop("_numbering_n")
    if groups:
        numbered = join_same(local, offsets, [*groups, "_numbering_part"])
    else:
        numbered = local.join(F.broadcast(offsets), "_numbering_part")  # one row per range, at most MOST_RANGES + 1
    return numbered.select(*[named(c) for c in df.columns], (F.col("_numbering_local") + F.col("_numbering_before")).alias(out))


def dense_number_by_id(df: DataFrame, id_col: str, out: str, width: int = 1 << 18) -> DataFrame:
    """1, 2, 3, ... in the order of a unique whole-number id.

    Ids are cut into blocks of ``width``, so no block can hold more than ``width`` rows; block sizes and rows come from one
    shuffle of the input.  Sparse ids make as many blocks as rows, so blocks are summed within ranges of ``RANGE`` blocks
    first; the only whole-table window runs over one row per range.
    """
    local, sizes = _placed(df, F.coalesce(F.floor(F.col(id_col) / width), F.lit(NO_TIME)), [], [F.col(id_col)])
    sizes = sizes.withColumn("_numbering_range", F.floor(F.col("_numbering_part") / RANGE))
    inside = Window.partitionBy("_numbering_range").orderBy("_numbering_part").rowsBetween(Window.unboundedPreceding, -1)
    above = Window.orderBy("_numbering_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sizes.groupBy("_numbering_range").agg(F.sum("_numbering_n").alias("_numbering_sum")).select(
        "_numbering_range", F.coalesce(F.sum("_numbering_sum").over(above), F.lit(0)).alias("_numbering_above"))
    within = sizes.select("_numbering_part", "_numbering_range", F.coalesce(F.sum("_numbering_n").over(inside), F.lit(0)).alias("_numbering_inside"))
    offsets = within.join(ranges.hint("merge"), "_numbering_range").select("_numbering_part", (F.col("_numbering_inside") + F.col("_numbering_above")).alias("_numbering_before"))
    return local.join(offsets.hint("merge"), "_numbering_part").select(*[named(c) for c in df.columns], (F.col("_numbering_local") + F.col("_numbering_before")).alias(out))


def time_chunk(ts: str, seconds: int) -> Column:
    """Number of the fixed time slice a row falls into; slices bound how much of one key a task sorts."""
    return F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / seconds)


def after_last(df: DataFrame, known: DataFrame, key: str, at: str, id_col: str, chunk: Column) -> DataFrame:
    """Add ``us`` (the time as a number) and ``slice``, and leave out rows at or before the last one known of their key.

    ``known`` has one row per key with ``last_us`` and ``last_id``.  It meets one row per (key, slice), and these meet the
    rows, so a key with many rows is spread over its slices.
    """
    rows = df.withColumns({"us": F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(NO_TIME)), "slice": chunk})
    last = known.select(F.col(key).alias("_key"), "last_us", "last_id")
    cuts = rows.groupBy(key, "slice").agg(F.count("*").alias("_n")).join(last, F.col(key).eqNullSafe(F.col("_key")), "left")
    both = join_same(rows, cuts.select(key, "slice", "last_us", "last_id"), [key, "slice"])
    later = (F.col("us") > F.col("last_us")) | ((F.col("us") == F.col("last_us")) & (F.col(id_col) > F.col("last_id")))
    return both.filter(F.col("last_us").isNull() | later).drop("last_us", "last_id")


def expired(at: str, newest, days: int) -> Column:
    """Whether a time lies more than ``days`` before the newest one; without either nothing has expired."""
    return F.coalesce(F.col(at) < F.lit(newest).cast("timestamp") - F.make_dt_interval(F.lit(days)), F.lit(False))


def with_previous(df: DataFrame, key: str, order_by: Sequence[str], columns: Sequence[str], chunk: Column,
                  prefix: str = "prev_", before: DataFrame | None = None) -> DataFrame:
    """Add each row's previous values of the same key (NULL on the first row).

    Rows are windowed per (key, time slice); only the last row of every slice travels on to the next slice, so a key
    that owns a third of the table is spread over all its slices.  ``before`` may give, one row per key, the values that
    came before the table's first row.
    """
    sliced = df.withColumn("_chunk", chunk)
    slice_window = Window.partitionBy(key, "_chunk").orderBy(*order_by)
    values = F.struct(*[F.col(c) for c in columns])
    local = sliced.withColumn("_last", F.lag(values).over(slice_window))
    tails = sliced.groupBy(key, "_chunk").agg(F.max_by(values, F.struct(*order_by)).alias("_tail"))
    tails = tails.withColumn("_carry", F.lag("_tail").over(Window.partitionBy(key).orderBy("_chunk"))).drop("_tail")
    if before is not None:
        held = before.select(F.col(key).alias("_key"), values.alias("_held"))
        tails = tails.join(held, F.col(key).eqNullSafe(F.col("_key")), "left").select(
            key, "_chunk", F.coalesce("_carry", "_held").alias("_carry"))
    joined = join_same(local, tails, [key, "_chunk"])
    seen = F.coalesce("_last", "_carry")
    for c in columns:
        joined = joined.withColumn(prefix + c, seen[c])
    return joined.withColumn(prefix + "exists", seen.isNotNull()).drop("_chunk", "_last", "_carry")


def attach_by_key(df: DataFrame, lookup: DataFrame, key: str, rows_col: str, spread_by: Column,
                  hot_rows: int = 5_000_000, how: str = "left") -> DataFrame:
    """Join a one-row-per-key lookup whose ``rows_col`` tells how many rows of ``df`` carry the key.

    Keys above ``hot_rows`` are salted.  There can be at most ``rows / hot_rows`` of them, which bounds the broadcast
    list of hot keys; every other key takes the ordinary join, by a shuffle: the lookup may hold a row for each row of ``df``.
    """
    salts = F.ceil(F.col(rows_col) / hot_rows).cast("int")
    hot = lookup.filter(F.col(rows_col) > hot_rows).select(key, salts.alias("_salts"))
    salted = df.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread_by), F.col("_salts")).cast("int"))
    ).drop("_salts")
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
    return salted.join(copies.hint("merge"), [key, "_salt"], how).drop("_salt")
