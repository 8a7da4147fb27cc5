"""Run registered queries against their SQL on the same parquet tables.

`python -m tests.compare [names…]` prints one line per query.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{directory}/{table}.parquet'")
    return connection


def plain(value):
    """A value both engines' results can be compared on."""
    if value is None:
        return None
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, (list, tuple)) or type(value).__name__ == "ndarray":
        return [plain(v) for v in value]
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items()}
    if hasattr(value, "item"):
        return plain(value.item())
    return value


def rows_of(columns: list[str], rows) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


def kind(name: str) -> str:
    name = name.lower()
    known = {"varchar": "string", "timestamp_ntz": "timestamp", "integer": "int"}
    return known.get(name, name)


def compare(spark, connection, directory: str, run, sql: str | None) -> str:
    frame = run(spark, directory)
    got = frame.collect()
    if sql is None:
        return f"rows={len(got)} (no SQL)"
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    want = cursor.fetchall()
    if sorted(frame.columns) != sorted(names):
        return f"FAIL columns {sorted(frame.columns)} != {sorted(names)}"
    mismatched = [
        (n, t, types[n]) for n, t in frame.dtypes
        if kind(t) != kind(types[n]) and not t.startswith(("array", "struct"))
    ]
    left, right = rows_of(frame.columns, got), rows_of(names, want)
    if left != right:
        only_left = sorted(set(left) - set(right))[:3]
        only_right = sorted(set(right) - set(left))[:3]
        return f"FAIL values spark={len(left)} sql={len(right)} only spark {only_left} only sql {only_right}"
    if mismatched:
        return f"FAIL types {mismatched}"
    return f"ok rows={len(got)}"


def main(names: list[str]) -> int:
    from sluiceflow.plans.catalog import all_oracles, all_queries
    from sluiceflow.session import build_session

    directory = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(directory)
    queries, oracles = all_queries(), all_oracles()
    failed = 0
    for name in names or queries:
        began = time.time()
        try:
            outcome = compare(spark, connection, directory, queries[name], oracles.get(name))
        except Exception as error:  # noqa: BLE001 - report and go on to the next query
            outcome = "FAIL " + str(error)[: int(os.environ.get("ERR", "400"))]
        failed += outcome.startswith("FAIL")
        print(f"{name:22s} {time.time() - began:6.2f}s {outcome}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
