"""Run registered queries next to their SQL twins and compare the rows.

usage: python tools/check_twins.py [sf_dir] [name ...]
"""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
from pressweave.catalog import load_all  # noqa: E402
from pressweave.session import get_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([norm(r[i]) for i in order] for r in rows), key=str)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    queries, oracles = load_all()
    names = sys.argv[2:] or list(queries)
    if names[0].startswith("@"):
        mod = "pressweave.catalog." + names[0][1:]
        names = [n for n, f in queries.items() if f.__module__ == mod]
    spark = get_session("check")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            df = queries[name](spark, sf)
            got = df.collect()
        except Exception as e:  # report and go on
            bad += 1
            print(f"FAIL {name}: spark {type(e).__name__}: {str(e)[:700]}", flush=True)
            continue
        t1 = time.time()
        if name not in oracles:
            print(f"rows {name}: {len(got)} rows {t1 - t0:.1f}s", flush=True)
            continue
        try:
            cur = con.execute(oracles[name])
            cols = [d[0] for d in cur.description]
            want = cur.fetchall()
        except Exception as e:
            bad += 1
            print(f"FAIL {name}: sql {str(e)[:700]}", flush=True)
            continue
        t2 = time.time()
        if sorted(cols) != sorted(df.columns):
            bad += 1
            print(f"FAIL {name}: columns {sorted(df.columns)} vs {sorted(cols)}", flush=True)
            continue
        a, b = rows_of(df.columns, got), rows_of(cols, want)
        if a != b:
            bad += 1
            diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
            print(f"FAIL {name}: {len(a)} vs {len(b)} rows; {sorted(cols)} {str(diff)[:900]}", flush=True)
        else:
            print(f"ok   {name}: {len(a)} rows {t1 - t0:.1f}s (sql {t2 - t1:.1f}s)", flush=True)
    print("bad:", bad)
    spark.stop()


main()
