"""Compares queries with their SQL run by DuckDB on the same tables; also a command: python -m tests.oracle DIR [NAME...]."""

from __future__ import annotations

import datetime
import glob
import math
import os
import sys
import time

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return con


def plain(x: object) -> object:
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, dict):
        return tuple(plain(v) for v in x.values())
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    return x


def rows_of(columns: list[str], rows: list) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


def differences(spark, sf_dir: str, query, sql: str, con=None) -> list[str]:
    """Empty if the query and its SQL give the same columns and the same rows."""
    df = query(spark, sf_dir)
    rel = (con or connect(sf_dir)).sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return [f"columns {sorted(df.columns)} and {sorted(rel.columns)}"]
    a, b = rows_of(df.columns, df.collect()), rows_of(rel.columns, rel.fetchall())
    if a == b:
        return []
    from collections import Counter

    x, y = Counter(a), Counter(b)
    return [f"{len(a)} and {len(b)} rows", *[f"only query: {r}" for r in list((x - y))[:3]], *[f"only SQL: {r}" for r in list((y - x))[:3]]]


def main(sf_dir: str, names: list[str]) -> None:
    import __spark_entry__ as e
    from loomfacts.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    qs, sqls, con, bad = e.queries(), e.oracle_sql(), connect(sf_dir), 0
    for n in names or list(qs):
        t = time.time()
        try:
            if n in sqls:
                d = differences(spark, sf_dir, qs[n], sqls[n], con)
                bad += bool(d)
                print(n, "ok" if not d else d, f"{time.time() - t:.1f}s", flush=True)
            else:
                print(n, "rows", qs[n](spark, sf_dir).count(), f"{time.time() - t:.1f}s", flush=True)
        except Exception as x:  # noqa: BLE001
            bad += 1
            print(n, "ERROR", str(x)[:600], flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
