"""Run the queries against their SQL counterparts: ``python tools/check.py [--sf 0.01] [name ...]``."""

import argparse
import os
import sys
import tempfile
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ridgelog.catalog import all_oracles, all_queries  # noqa: E402
from ridgelog.session import build_session, release_scratch  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def normal(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def compare(frame, connection, sql):
    """'' when equal, else the first difference."""
    found = connection.sql(sql)
    names, expected_names = frame.columns, found.columns
    if sorted(names) != sorted(expected_names):
        return f"columns {sorted(names)} != {sorted(expected_names)}"
    ours = rows_of(names, [tuple(r) for r in frame.collect()])
    expected = rows_of(expected_names, found.fetchall())
    if len(ours) != len(expected):
        return f"rows {len(ours)} != {len(expected)}; first ours {ours[:2]}, expected {expected[:2]}"
    for a, b in zip(ours, expected):
        if a != b:
            return f"ours {a} != expected {b}"
    types = [(n, type(x), type(y)) for n, x, y in zip(sorted(names), ours[0], expected[0]) if type(x) is not type(y)] if ours else []
    return f"types {types}" if types else ""


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = build_session(
        master="local[8]", **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="ridgelog-check-")}
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    queries, oracles = all_queries(), all_oracles()
    failed = 0
    for name, build in queries.items():
        if args.names and not any(n in name for n in args.names):
            continue
        start = time.time()
        try:
            frame = build(spark, sf_dir)
            if name in oracles:
                problem = compare(frame, connection, oracles[name])
                rows = ""
            else:
                rows, problem = f" rows={frame.count()}", ""
        except Exception as error:  # noqa: BLE001
            problem, rows = f"{type(error).__name__}: {str(error)[:600]}", ""
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.2f}s{rows} {problem}", flush=True)
    release_scratch(spark)
    print(f"{failed} failed of {len(queries)}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
