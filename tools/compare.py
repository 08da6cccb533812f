"""Run queries and their SQL side by side: python tools/compare.py [sf_dir] [name ...]"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from strandlake.plans import all_queries  # noqa: E402
from strandlake.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    if isinstance(v, int):
        return str(v)
    return str(v)


def digest(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = sorted("|".join(cell(r[i]) for i in order) for r in rows)
    return hashlib.md5("\n".join(text).encode()).hexdigest(), text


def main():
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    catalog = all_queries()
    names = [n for n in catalog if not args or any(n.startswith(a) for a in args)]
    spark = local_session(int(os.environ.get("CORES", "8")))
    con = duck(sf_dir)
    bad = []
    for name in names:
        run, sql = catalog[name]
        t0 = time.time()
        try:
            df = run(spark, sf_dir)
            rows = [tuple(r) for r in df.collect()]
        except Exception as e:  # report and go on
            print(f"FAIL  {name}: {str(e)[:1500]}", flush=True)
            bad.append(name)
            continue
        t1 = time.time()
        if not sql:
            print(f"rows  {name}: {len(rows)} rows {t1 - t0:.1f}s", flush=True)
            continue
        try:
            cur = con.execute(sql)
            want = cur.fetchall()
        except Exception as e:
            print(f"SQL   {name}: {str(e)[:1500]}", flush=True)
            bad.append(name)
            continue
        cols = [d[0] for d in cur.description]
        a, ta = digest(rows, df.columns)
        b, tb = digest(want, cols)
        same = a == b and sorted(cols) == sorted(df.columns)
        print(f"{'ok   ' if same else 'DIFF '} {name}: {len(rows)} / {len(want)} rows, spark {t1 - t0:.1f}s sql {time.time() - t1:.1f}s", flush=True)
        if not same:
            bad.append(name)
            print("   ", sorted(df.columns), sorted(cols))
            sa, sb = set(ta), set(tb)
            print("    only spark:", sorted(sa - sb)[:3])
            print("    only sql:  ", sorted(sb - sa)[:3])
    print("bad:", bad)


if __name__ == "__main__":
    main()
