"""Where every file of an inventory should go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsframe.functions.text import base_name, category, extension, flatten_path, render, stem
from opsframe.operators import inventory
from opsframe.operators.order import dense_number
from opsframe.session import ensure_checkpoints

TEMPLATE = "{category}_{date}_{index:03d}"  # fixed values: defaults of the archive plan
DUPLICATE_CLASS = "重复件"
DUPLICATE_FOLDER = "_重复文件"
DATE_FORMAT = "yyyyMMdd"


def archive_plan(files: DataFrame, path: str = "rel_path", size: str = "size", fingerprint: str = "fingerprint",
                 mtime: str | None = "mtime", template: str = TEMPLATE, duplicates: str = "separate",
                 day: Column | None = None, date_format: str = DATE_FORMAT, keep_name: bool = False,
                 lowercase_ext: bool = True, conflict: str = "rename", dedupe: bool = True) -> DataFrame:
    """``path, target, category, size, fingerprint, original`` for every archived file.

    The index counts non-duplicates per category in path order.  It comes from range-sorted runs, so one category
    owning most files is still numbered by many tasks.  Without ``dedupe`` every file is an original.  Targets that collide get ``(2)``, ``(3)``, ... in path order.
    """
    ensure_checkpoints(files.sparkSession)
    # the narrow inventory is used several times below; without this every use would read and hash the files again
    listed = files.select(path, size, fingerprint, *([mtime] if mtime in files.columns else [])).checkpoint()
    if dedupe:
        marked = inventory.mark_duplicates(listed, path, fingerprint)
    else:
        marked = listed.withColumns({"original": F.col(path), "is_duplicate": F.lit(False)})
    ext = extension(path)
    out_ext = F.lower(ext) if lowercase_ext else ext
    marked = marked.withColumns({"category": category(F.lower(ext)), "_ext": out_ext})
    originals = dense_number(marked.filter("NOT is_duplicate"), [path], "_index", ["category"])
    when = day if day is not None else F.col(mtime)
    part = lambda fmt: F.date_format(when, fmt)
    values = {
        "name": stem(path), "ext": F.col("_ext"), "category": F.col("category"), "date": part(date_format),
        "year": part("yyyy"), "month": part("MM"), "day": part("dd"), "index": F.col("_index"), "size": F.col(size),
        "hash8": F.substring(fingerprint, 1, 8),
    }
    name = base_name(path) if keep_name else F.concat(render(template, values), F.col("_ext"))
    kept = originals.select(path, F.concat("category", F.lit("/"), name).alias("target"), "category", size, fingerprint,
                            "original")
    if duplicates == "separate":
        side = marked.filter("is_duplicate").select(
            path, F.concat(F.lit(DUPLICATE_FOLDER + "/"), flatten_path(path)).alias("target"),
            F.lit(DUPLICATE_CLASS).alias("category"), size, fingerprint, "original")
        kept = kept.unionByName(side)
    return resolve_collisions(kept, path, conflict)


def _candidate(counter: Column) -> Column:
    ext = extension(base_name("_wanted"))
    bare = F.substring("_wanted", F.lit(1), F.length("_wanted") - F.length(ext))
    return F.when(counter == 1, F.col("_wanted")).otherwise(
        F.concat(bare, F.lit("("), counter.cast("string"), F.lit(")"), ext))


def resolve_collisions(plan: DataFrame, path: str, conflict: str = "rename") -> DataFrame:
    """Every target is held by its first file in path order; with ``rename`` the others try the next counter.

    Files that want the same name start at their place among them (no earlier counter can be free for them), so rounds
    beyond the first happen only where a counted name meets a file that already bears it.
    """
    if conflict == "overwrite":
        return plan
    if conflict == "skip":
        first = Window.partitionBy("target").orderBy(path)
        return plan.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").drop("_nth")
    taken_twice = plan.groupBy("target").agg(F.count("*").alias("_n")).filter("_n > 1")
    if taken_twice.isEmpty():
        return plan
    placed = dense_number(plan.withColumnRenamed("target", "_wanted"), [path], "_try", ["_wanted"])
    while True:
        placed = placed.withColumn("target", _candidate(F.col("_try"))).checkpoint()
        holders = placed.groupBy("target").agg(F.min(path).alias("_holder"), F.count("*").alias("_n"))
        contested = holders.filter("_n > 1").drop("_n")
        if contested.isEmpty():
            return placed.drop("_wanted", "_try")
        lost = F.col("_holder").isNotNull() & (F.col(path) != F.col("_holder"))
        placed = placed.join(contested.hint("merge"), "target", "left").withColumn(
            "_try", F.when(lost, F.col("_try") + 1).otherwise(F.col("_try"))).drop("_holder", "target")
