"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from opsframe import catalog
from opsframe.session import local_session

HEADLINE = [
    "daily_kpis", "kpi_previous_day", "kpi_breakdown", "kpi_top_rows", "clean_table", "clean_report", "clean_date_table",
    "predicates", "route_rows", "form_job", "table_steps", "dedupe_first", "dedupe_composite_last", "group_summary",
    "sort_mixed", "sequence_ids", "reconcile_detail", "reconcile_summary", "reconcile_all_pairs", "snapshot_changes",
    "health_streaks", "outage_edges", "content_duplicates", "archive_plan", "pattern_census", "pattern_matches",
    "price_mode", "url_encode", "b64_encode", "json_validity", "md_blocks", "md_headings", "doc_diff_lcs",
    "doc_diff_multiset",
]


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def duckdb_times(folder: str, names: list[str], repeats: int) -> dict[str, float]:
    """Seconds of the SQL twins on the same files (BENCH_DUCKDB=1), for comparison."""
    import duckdb

    from opsframe.catalog.registry import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    twins, out = catalog.oracles(), {}
    for name in (n for n in names if n in twins):
        seconds = []
        for _ in range(repeats):
            start = time.perf_counter()
            con.execute(twins[name]).fetchall()
            seconds.append(time.perf_counter() - start)
        out[name] = round(statistics.median(seconds), 3)
    return out


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cores, shuffle_partitions=cores)
    times = {}
    for name in names:
        run(spark, name, folder)  # warm-up: class loading and code generation
        times[name] = round(statistics.median(run(spark, name, folder) for _ in range(repeats)), 3)
        print(f"{name} {times[name]}", file=sys.stderr)
    if os.environ.get("BENCH_DUCKDB"):
        print(json.dumps({"duckdb": duckdb_times(folder, names, repeats)}), file=sys.stderr)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": folder.rstrip("/").split("sf")[-1]}))


if __name__ == "__main__":
    main()
