"""Compare registered queries with their SQL in DuckDB: python tests/check_oracle.py [names...]."""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

import __spark_entry__ as entry
from keepsift.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v)
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int):
        return f"i{v}"
    if False:
        return str(v)
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, folder, name):
    """None if equal, else what differs."""
    df = entry.queries()[name](spark, folder)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None, len(got), "rows only"
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    want = rows(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(cols)}", len(got), "sql"
    if got != want:
        a, b = set(map(repr, got)), set(map(repr, want))
        return f"rows {len(got)} != {len(want)}\n   spark {sorted(a - b)[:2]}\n   sql   {sorted(b - a)[:2]}", len(got), "sql"
    return None, len(got), "sql"


if __name__ == "__main__":
    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    tz = os.environ.get("CHECK_TZ", "UTC")
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.sql.session.timeZone": tz})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = []
    names = sys.argv[1:] or list(entry.queries())
    for n in names:
        t0 = time.time()
        try:
            diff, count, kind = compare(spark, con, folder, n)
        except Exception as e:  # noqa: BLE001
            diff, count, kind = f"{type(e).__name__}: {str(e)[:700]}", -1, "?"
        print(f"{'ok ' if diff is None else 'BAD'} {n} rows={count} {kind} {time.time() - t0:.1f}s", flush=True)
        if diff:
            bad.append(n)
            print("   ", diff, flush=True)
    print(f"{len(names) - len(bad)} of {len(names)} fine; bad: {bad}")
