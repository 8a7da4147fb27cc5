"""Time the headline queries and print one JSON line.

BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES (comma separated, or `all`) choose
the tables, the local cores and the queries.
"""

from __future__ import annotations

import json
import os
import time

from sluiceflow.plans.catalog import all_queries
from sluiceflow.session import build_session, clear_scratch

HEADLINE = [
    "pipe_knn_border", "pipe_pairs", "pipe_identify", "pipe_search", "pipe_sort_search", "pipe_cost_report",
    "pipe_compress", "pipe_training", "pipe_accuracy", "sort_range", "top_n", "renumber", "concurrency",
    "stage_concurrency", "cumulative_cost", "box_summary", "ecdf", "rank_histogram", "pivot_merge", "knn_merge",
    "range_bin", "point_in_polygon", "map_cross", "missing_tasks", "stage_rollup", "compute_cost", "threshold_sweep",
    "minimizer", "scan_fasta", "scan_fastq", "scan_spectra", "stream_barrier", "stream_overdue",
]


def run(spark, query, directory: str) -> float:
    began = time.perf_counter()
    query(spark, directory).write.format("noop").mode("overwrite").save()
    took = time.perf_counter() - began
    clear_scratch(spark)
    return took


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        "bench", master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(queries) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    run(spark, queries["copy"], directory)  # starts the JVM's code paths and the Python workers
    run(spark, queries["run_app"], directory)
    times = {name: round(run(spark, queries[name], directory), 3) for name in names}
    total = round(sum(times.values()), 3)
    scale = os.path.basename(directory.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times, "sf": float(scale)}))
    spark.stop()


if __name__ == "__main__":
    main()
