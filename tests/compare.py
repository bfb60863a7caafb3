"""Run catalogue queries next to their SQL: ``python tests/compare.py FOLDER [NAME ...]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    """One value in a form both engines share; numbers keep every digit."""
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr_key)


def repr_key(row):
    return tuple((v is None, str(type(v).__name__ in ("int", "float")), float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else 0, str(v)) for v in row)


def differences(spark, connection, folder, run, sql) -> list[str]:
    df = run(spark, folder)
    mine, got = rows_of(df.columns, df.collect())
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs, want = rows_of(names, cursor.fetchall())
    if mine != theirs:
        return [f"columns {mine} and {theirs}"]
    if len(got) != len(want):
        return [f"{len(got)} rows and {len(want)}"]
    return [f"{a} and {b}" for a, b in zip(got, want) if a != b]


def main(folder: str, *chosen: str) -> int:
    import __spark_entry__ as entry_points
    from fleetstats.session import build_session

    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    connection, oracles, bad = duck(folder), entry_points.oracle_sql(), 0
    for name, run in entry_points.queries().items():
        if chosen and name not in chosen:
            continue
        began = time.time()
        try:
            found = differences(spark, connection, folder, run, oracles[name])
        except Exception as error:
            found = [f"{type(error).__name__}: {str(error)[:1500]}"]
        bad += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name} {time.time() - began:.2f}s", *found[:2], flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(*sys.argv[1:]) else 0)
