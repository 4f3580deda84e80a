"""A table job described as a list of steps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.operators import dedupe, quality, summary
from opsframe.sources import exports, sinks

DESCENDING = {"desc", "down", "倒序", "降序"}  # fixed values
ORDINAL = "_ord"


@dataclass
class StepResult:
    """Main table, side tables by output name, and one note per step."""

    table: DataFrame | None
    side: dict[str, DataFrame] = field(default_factory=dict)
    notes: list[tuple[int, str, str]] = field(default_factory=list)

    def note(self, no: int, action: str, text: str) -> None:
        self.notes.append((no, action, text))

    def columns(self) -> list[str]:
        return [c for c in self.table.columns if c != ORDINAL] if self.table is not None else []


def _with_ordinal(df: DataFrame, order_by: str | None) -> DataFrame:
    if ORDINAL in df.columns:
        return df
    if order_by:
        return df.withColumn(ORDINAL, F.col(order_by))
    if "__source__" in df.columns and "__row__" in df.columns:
        return df.withColumn(ORDINAL, F.struct("__source__", "__row__"))
    return df.withColumn(ORDINAL, F.monotonically_increasing_id())


def _merge(r: StepResult, no: int, step: Mapping, ctx: Mapping) -> None:
    if r.table is None:
        r.table = exports.read_exports(ctx["spark"], ctx["input_dir"], step.get("pattern", "*.csv"), drop_blank=False)
    r.table = _with_ordinal(r.table, ctx.get("order_by"))
    r.note(no, "merge", "merged")


def _clean(r: StepResult, no: int, step: Mapping, ctx: Mapping) -> None:
    wanted = step.get("columns") or r.columns()
    targets = [c for c in r.columns() if c in wanted]
    # the invalid-cell counts are one aggregate over the table as it was
    r.side[f"clean_{no}"] = quality.clean_report(r.table, targets, ctx.get("profile", "table"), ctx.get("kinds"))
    r.table = quality.clean(r.table, targets, ctx.get("profile", "table"), ctx.get("kinds"))
    r.note(no, "clean", f"{len(targets)} columns")


def _dedupe(r: StepResult, no: int, step: Mapping, ctx: Mapping) -> None:
    key = step.get("key") or step.get("by")
    r.table = dedupe.dedupe(r.table, key, ORDINAL, step.get("keep", "first"))
    r.note(no, "dedupe", key)


def _group(r: StepResult, no: int, step: Mapping, ctx: Mapping) -> None:
    name = step.get("output") or f"group_by_{step['by']}.csv"
    r.side[name] = summary.group_summary(r.table, step["by"], ORDINAL, step.get("sum") or [], step.get("count") or [])
    r.note(no, "group", name)


def _sort(r: StepResult, no: int, step: Mapping, ctx: Mapping) -> None:
    down = str(step.get("order", "asc")).lower() in DESCENDING
    r.table = summary.sort_mixed(r.table, step["by"], ORDINAL, down)
    r.note(no, "sort", step["by"])


def _split(r: StepResult, no: int, step: Mapping, ctx: Mapping) -> None:
    name = step.get("output_dir") or f"by_{step['by']}"
    data = r.table.drop(ORDINAL)
    if ctx.get("output_dir"):
        r.side[name] = sinks.split_by(data, step["by"], f"{ctx['output_dir']}/{name}")
    else:
        r.side[name] = summary.split_manifest(data, step["by"])
    r.note(no, "split", name)


def _save(r: StepResult, no: int, step: Mapping, ctx: Mapping) -> None:
    name = step.get("output", "result.csv")
    if ctx.get("output_dir"):
        sinks.save_table(r.table, f"{ctx['output_dir']}/{name}", r.columns(), "csv")
    r.note(no, "save", name)


STEPS = {"merge": _merge, "clean": _clean, "dedupe": _dedupe, "group": _group, "sort": _sort, "split": _split,
         "save": _save}
NEEDS_COLUMN = {"dedupe": ("key", "by"), "group": ("by",), "sort": ("by",), "split": ("by",)}


def run_steps(steps: Sequence[Mapping], table: DataFrame | None = None, **context) -> StepResult:
    """Run the steps in order; nothing executes before a sink does.

    Grouping and splitting give side tables and leave the main table alone.  Unknown steps, and steps naming a column
    the table lacks, are skipped with a note.  Context: ``spark``, ``input_dir``, ``output_dir``, ``order_by`` (unique
    column giving the input order), ``profile``, ``kinds``.
    """
    r = StepResult(None if table is None else _with_ordinal(table, context.get("order_by")))
    for no, step in enumerate(steps, 1):
        action = (step.get("action") or "").lower()
        if action not in STEPS:
            r.note(no, action, "skipped: unknown step")
            continue
        named = next((step[k] for k in NEEDS_COLUMN.get(action, ()) if step.get(k)), None)
        if action in NEEDS_COLUMN and named not in r.columns():
            r.note(no, action, f"skipped: no column {named}")
            continue
        STEPS[action](r, no, step, context)
    if r.table is not None and not any((s.get("action") or "").lower() == "save" for s in steps):
        _save(r, len(steps) + 1, {}, context)
    return r
