"""Runs registered queries beside their SQL in DuckDB: python tests/oracle.py [FOLDER] NAME..."""

from __future__ import annotations

import glob
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(x):
        if isinstance(x, float):
            return "nan" if x != x else f"{x:.6g}"
        if hasattr(x, "isoformat"):
            return x.isoformat()[:26].replace("+00:00", "")
        if isinstance(x, (list, tuple)):
            return "[" + ",".join(map(cell, x)) + "]"
        return str(x)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, name: str, folder: str) -> str:
    import __spark_entry__ as e
    import duckdb

    df = e.queries()[name](spark, folder)
    ours = normal(df.collect(), df.columns)
    if name not in e.oracle_sql():
        return f"rows only: {len(ours)}"
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        at = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.sql(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM read_parquet('{at}')")
    r = con.sql(e.oracle_sql()[name])
    theirs = normal(r.fetchall(), r.columns)
    if sorted(df.columns) != sorted(r.columns):
        return f"MISMATCH columns {sorted(df.columns)} {sorted(r.columns)}"
    if ours != theirs:
        a, b = set(ours) - set(theirs), set(theirs) - set(ours)
        return f"MISMATCH {len(ours)} against {len(theirs)} rows; only ours {sorted(a)[:3]}; only SQL {sorted(b)[:3]}"
    return f"ok: {len(ours)} rows"


if __name__ == "__main__":
    from lexigrove.shared import local_session

    args = sys.argv[1:]
    folder = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    for n in names:
        began = time.time()
        try:
            said = compare(spark, n, folder)
        except Exception as x:  # noqa: BLE001
            said = f"ERROR {type(x).__name__} {str(x)[:1500]}"
        print(f"{n}: {said} ({time.time() - began:.1f} s)", flush=True)
    os._exit(0)
