"""Compare registered queries with their check SQL on one folder of tables.

Run as a script: ``python tests/compare.py [folder] [query ...]``.
"""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def check_database(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return ("f", "nan" if math.isnan(value) else repr(value))
    if isinstance(value, bool) or value is None:
        return ("b", repr(value))
    return (type(value).__name__, repr(value))


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def differences(frame, connection, sql) -> list[str]:
    """Empty when column names and all rows agree, whatever their order."""
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(frame.columns):
        return [f"columns {sorted(frame.columns)} != {sorted(names)}"]
    want = rows_of(names, result.fetchall())
    got = rows_of(frame.columns, frame.collect())
    if len(got) != len(want):
        return [f"{len(got)} rows, check has {len(want)}"]
    pairs = [(g, w) for g, w in zip(got, want) if g != w]
    notes = [f"{len(pairs)} of {len(want)} rows differ"] if pairs else []
    for g, w in pairs[:2]:
        notes += [f"  {sorted(names)[n]}: {a} != {b}" for n, (a, b) in enumerate(zip(g, w)) if a != b]
    return notes


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from __spark_entry__ import oracle_sql, queries
    from tocsin.session import build_session

    spark = build_session(
        master="local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("OFF")
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    known, database, bad = oracle_sql(), check_database(folder), 0
    for name, make in queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            notes = differences(make(spark, folder), database, known[name]) if name in known else ["no SQL"]
        except Exception as failure:  # show it and go on with the next query
            notes = [str(failure)[:600]]
        bad += bool(notes)
        print("ok  " if not notes else "BAD ", name, round(time.time() - start, 2), *notes[:12], sep=" ", flush=True)
    print("differing:", bad)
