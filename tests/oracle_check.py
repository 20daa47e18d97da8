"""Run registered queries beside their SQL and compare rows. Usage: oracle_check.py [sf_dir] [name part ...]"""
from __future__ import annotations

import math
import pathlib
import sys
import time

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def cell(v):
    if v is None:
        return ""
    if isinstance(v, bool):
        return f"b{v}"
    if isinstance(v, float):
        return "" if math.isnan(v) else f"f{v!r}"
    if isinstance(v, int):
        return f"i{v}"
    return f"s{v}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def compare(spark, con, name, fn, sql, folder):
    """Returns (ok, message)."""
    began = time.time()
    df = fn(spark, folder)
    got = [tuple(row) for row in df.collect()]
    took = time.time() - began
    if sql is None:
        return True, f"rows={len(got)} {took:.1f}s (no SQL)"
    rel = con.execute(sql)
    columns, want = [d[0] for d in rel.description], rel.fetchall()
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(columns)}"
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    sql_took = time.time() - began - took
    if a != b:
        odd = [(x, y) for x, y in zip(a, b) if x != y][:2]
        return False, f"rows {len(a)} vs {len(b)}; first differences {odd}"
    return len(a) > 0, f"rows={len(a)} {took:.1f}s sql {sql_took:.1f}s"


def main():
    from __spark_entry__ import oracle_sql, queries
    from paneltide.session import local_session
    args = sys.argv[1:]
    folder = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark, con, sql, bad = local_session("oracle-check"), connect(folder), oracle_sql(), []
    for name, fn in queries().items():
        if args and not any(a in name for a in args):
            continue
        try:
            ok, note = compare(spark, con, name, fn, sql.get(name), folder)
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
