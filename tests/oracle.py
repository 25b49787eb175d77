"""Compare registered queries with their oracle SQL: python -m tests.oracle [sf_dir] [name ...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path).split(".")[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _kind(value) -> str:
    if value is None:
        return "null"
    return type(value).__name__


def _cell(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return repr(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf: str, fn, sql: str) -> tuple[str, float, float, int]:
    """Return (problem or '', spark seconds, duckdb seconds, rows)."""
    t0 = time.time()
    df = fn(spark, sf)
    got = df.collect()
    t1 = time.time()
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    if sorted(df.columns) != sorted(want_cols):
        return f"columns {sorted(df.columns)} != {sorted(want_cols)}", t1 - t0, t2 - t1, len(got)
    a, b = rows_of(df.columns, got), rows_of(want_cols, want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}", t1 - t0, t2 - t1, len(got)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} rows differ, first {bad[0]}", t1 - t0, t2 - t1, len(got)
    return "", t1 - t0, t2 - t1, len(got)


def session():
    from attestry.session import build_session

    spark = build_session(
        "attestry-tests",
        "local[8]",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="12g",
        spark__attestry__textPartitions="8",
        spark__ui__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf = args[0] if args and "/" in args[0] else "/root/testdata/sf0.01"
    names = [a for a in args if "/" not in a]
    spark, con = session(), connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if names and not any(n in name for n in names):
            continue
        try:
            if name in oracles:
                problem, s, d, n = compare(spark, con, sf, fn, oracles[name])
            else:
                t0 = time.time()
                n, problem, d = fn(spark, sf).count(), "", 0.0
                s = time.time() - t0
        except Exception as err:  # report and go on
            problem, s, d, n = f"{type(err).__name__}: {str(err)[:1500]}", 0.0, 0.0, 0
        failed += bool(problem)
        mark = "FAIL" if problem else ("ok  " if name in oracles else "rows")
        print(f"{mark} {name} rows={n} spark={s:.2f}s duckdb={d:.2f}s {problem[:1800]}", flush=True)
    print(f"failed: {failed}")


if __name__ == "__main__":
    main()
