"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tools/check_oracle.py [sf_dir] [name-substring ...]
Comparison: same column names, same row count, same multiset of rows (columns
sorted by name, values compared exactly after the query's own rounding).
"""

from __future__ import annotations

import json
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, ".")

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    rows = []
    for r in df[cols].itertuples(index=False):
        out = []
        for v in r:
            if isinstance(v, float) and v != v:
                v = None
            elif v is pd.NaT or v is pd.NA:
                v = None
            elif hasattr(v, "tolist"):
                v = v.tolist()
            if isinstance(v, list):
                v = tuple(v)
            out.append(v)
        rows.append(tuple(out))
    return sorted(rows, key=lambda t: tuple((x is None, "number" if isinstance(x, (int, float)) else str(type(x)), x if x is not None else 0) if not isinstance(x, tuple) else (False, "t", str(x)) for x in t))


def compare(sdf: pd.DataFrame, ddf: pd.DataFrame) -> str:
    if sorted(sdf.columns) != sorted(ddf.columns):
        return f"columns differ: spark-only {sorted(set(sdf.columns)-set(ddf.columns))[:5]} duck-only {sorted(set(ddf.columns)-set(sdf.columns))[:5]}"
    if len(sdf) != len(ddf):
        return f"rows differ: spark {len(sdf)} duck {len(ddf)}"
    a, b = norm(sdf), norm(ddf)
    for i, (x, y) in enumerate(zip(a, b)):
        if x != y:
            cols = sorted(sdf.columns)
            diff = [(c, p, q) for c, p, q in zip(cols, x, y) if p != q]
            return f"value mismatch at sorted row {i}: {diff[:4]}"
    return "ok"


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 and sys.argv[1].startswith("/") else "/root/testdata/sf0.01"
    pats = [a for a in sys.argv[1:] if not a.startswith("/")]
    from prismlake.session import get_session
    from prismlake.plans.catalog import all_queries
    spark = get_session()
    con = duck(sf_dir)
    res = {}
    for name, q in all_queries().items():
        if pats and not any(p in name for p in pats):
            continue
        if name in os.environ.get("EXCLUDE", "").split(","):
            continue
        t0 = time.time()
        try:
            sdf = q.spark(spark, sf_dir).toPandas()
            ts = time.time() - t0
            sql = q.oracle()
            if sql is None:
                status = f"rows-only ({len(sdf)} rows)"
            else:
                t1 = time.time()
                ddf = con.execute(sql).df()
                status = compare(sdf, ddf)
                status += f" [duck {time.time()-t1:.1f}s]"
        except Exception as e:  # noqa: BLE001
            ts = time.time() - t0
            status = f"ERROR {type(e).__name__}: {str(e)[:300]}"
        res[name] = status
        print(f"{name:32s} {ts:6.1f}s  {status}", flush=True)
    bad = {k: v for k, v in res.items() if not (v.startswith("ok") or v.startswith("rows-only"))}
    print(json.dumps({"total": len(res), "bad": len(bad)}))


if __name__ == "__main__":
    main()
