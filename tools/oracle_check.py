"""Run registered queries on Spark and their DuckDB twins; compare results.

    python tools/oracle_check.py [--sf DIR] [name-substring ...]

Compares row count, column names and an order-insensitive multiset of rows
(exactly, and with floats rounded to 9 significant digits).
"""
from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from quarry.model import FIXTURE_TABLES  # noqa: E402
from quarry.plans.registry import ORACLE_SQL, QUERIES, load_all  # noqa: E402
from quarry.session import get_spark  # noqa: E402


def norm(v, rounded):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}") if rounded else v
    if isinstance(v, decimal.Decimal):
        return float(v) if not rounded else float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x, rounded) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x, rounded)) for k, x in v.items()))
    if isinstance(v, (bytes, bytearray, memoryview)):
        return bytes(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(cols, rows, rounded):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i], rounded) for i in order) for r in rows), key=repr)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    load_all()
    spark = get_spark("local[8]", shuffle_partitions=8)
    con = duckdb.connect()
    for t in FIXTURE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{a.sf}/{t}.parquet')")
    names = [n for n in QUERIES if not a.names or any(s in n for s in a.names)]
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            df = QUERIES[n](spark, a.sf)
            cols = df.columns
            srows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {n}: spark error {type(e).__name__}: {str(e)[:800]}")
            traceback.print_exc(limit=3)
            continue
        st = time.time() - t0
        if n not in ORACLE_SQL:
            print(f"ROWS {n}: {len(srows)} rows ({st:.1f}s) [no oracle]")
            continue
        try:
            res = con.execute(ORACLE_SQL[n])
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {n}: duckdb error {str(e)[:500]}")
            continue
        if sorted(cols) != sorted(dcols):
            bad += 1
            print(f"FAIL {n}: columns spark={sorted(cols)} duck={sorted(dcols)}")
            continue
        if len(srows) != len(drows):
            bad += 1
            print(f"FAIL {n}: rows spark={len(srows)} duck={len(drows)}")
            continue
        exact = rows_of(cols, srows, False) == rows_of(dcols, drows, False)
        if exact:
            print(f"OK   {n}: {len(srows)} rows ({st:.1f}s)")
            continue
        close = rows_of(cols, srows, True) == rows_of(dcols, drows, True)
        if close:
            print(f"NEAR {n}: {len(srows)} rows, equal after float rounding ({st:.1f}s)")
            continue
        bad += 1
        s1, d1 = rows_of(cols, srows, True), rows_of(dcols, drows, True)
        diff = [(x, y) for x, y in zip(s1, d1) if x != y][:3]
        print(f"FAIL {n}: values differ, cols={sorted(cols)} first diffs={diff}")
    print(f"{len(names) - bad}/{len(names)} ok")
    spark.stop()


if __name__ == "__main__":
    main()
