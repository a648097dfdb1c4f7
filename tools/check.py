"""Run registered queries and compare them with their SQL in DuckDB.

    python tools/check.py [sf_dir] [name-substring ...]
"""

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from sumveil.catalog import all_entries
from sumveil.session import build_session


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else f"{v:.6g}" if v != int(v) or abs(v) > 1e15 else str(int(v)) + ".0"
    return f"{type(v).__name__}:{v}"


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session("check")
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    bad = 0
    for name, e in all_entries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        t = time.time()
        try:
            df = e.run(spark, sf)
            cols = sorted(df.columns)
            rows = sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
            spent = time.time() - t
            if not e.sql:
                print(f"ROWS {name} {len(rows)} {spent:.2f}s", flush=True)
                continue
            cur = con.execute(e.sql)
            names = [d[0] for d in cur.description]
            at = [names.index(c) for c in cols] if sorted(names) == cols else None
            if at is None:
                bad += 1
                print(f"BAD  {name} columns {cols} vs {sorted(names)}", flush=True)
                continue
            want = sorted(tuple(_norm(r[i]) for i in at) for r in cur.fetchall())
            if rows == want:
                print(f"ok   {name} {len(rows)} {spent:.2f}s", flush=True)
            else:
                bad += 1
                diff = [(a, b) for a, b in zip(rows, want) if a != b][:2]
                print(f"BAD  {name} {len(rows)} vs {len(want)} {cols} {diff}", flush=True)
        except Exception as x:  # noqa: BLE001
            bad += 1
            print(f"ERR  {name} {type(x).__name__} {str(x)[:1200]}", flush=True)
    print("failed:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
