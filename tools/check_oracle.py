"""Run registered queries in Spark and their oracle SQL in DuckDB; compare results.

usage: python tools/check_oracle.py [sf_dir] [key-substring ...]
Rows are compared as multisets over columns sorted by name; floats exactly and, if that
fails, after rounding to 6 significant digits (reported separately).
"""

from __future__ import annotations

import collections
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tillroll.catalog import oracle_sql, queries  # noqa: E402
from tillroll.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v, approx=False):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if approx and v != 0:
            return float(f"{v:.6g}")
        return v
    if hasattr(v, "item"):
        return norm(v.item(), approx)
    return v


def rows_of(cols, records, approx):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return collections.Counter(tuple(norm(r[i], approx) for i in order) for r in records)


def main():
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    pats = [a for a in args if not a.startswith("/")]
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, sqls = queries(), oracle_sql()
    keys = [k for k in qs if not pats or any(p in k for p in pats)]
    ok = bad = 0
    for k in keys:
        t0 = time.time()
        try:
            df = qs[k](spark, sf)
            scols = df.columns
            srows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL-SPARK {k}: {type(e).__name__}: {str(e)[:400]}")
            traceback.print_exc(limit=2)
            bad += 1
            continue
        ts = time.time() - t0
        if k not in sqls:
            print(f"ROWS-ONLY  {k}: {len(srows)} rows  {ts:.1f}s")
            continue
        try:
            cur = con.execute(sqls[k])
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL-SQL   {k}: {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        if sorted(scols) != sorted(dcols):
            print(f"COLS       {k}: spark={scols} sql={dcols}")
            bad += 1
            continue
        a, b = rows_of(scols, srows, False), rows_of(dcols, drows, False)
        if a == b:
            print(f"OK         {k}: {len(srows)} rows  {ts:.1f}s")
            ok += 1
            continue
        a2, b2 = rows_of(scols, srows, True), rows_of(dcols, drows, True)
        tag = "APPROX" if a2 == b2 else "MISMATCH"
        print(f"{tag:10} {k}: spark {len(srows)} rows, sql {len(drows)} rows")
        sa, sb = a - b, b - a
        cols = sorted(scols)
        print("   cols:", cols)
        for r in list(sa)[:3]:
            print("   spark-only:", r)
        for r in list(sb)[:3]:
            print("   sql-only:  ", r)
        bad += 1
    print(f"done: {ok} ok, {bad} not ok, of {len(keys)}")


if __name__ == "__main__":
    main()
