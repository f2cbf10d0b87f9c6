"""Compare registered queries with their SQL checks: python -m tests.compare [prefix ...] [--sf DIR]."""
from __future__ import annotations

import os
import sys
import time
import traceback

import duckdb
import numpy as np
import pandas as pd

from tapeloom.plans.all_queries import CHECKS, QUERIES, check_sql
from tapeloom.session import build_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda k: cols[k])

    def cell(v):
        if v is None:
            return None
        if isinstance(v, (bool, np.bool_)):
            return bool(v)
        if isinstance(v, (float, np.floating)):
            return None if v != v else float(v) + 0.0
        return v
    out = [tuple(cell(r[k]) for k in order) for r in rows]
    return sorted(out, key=repr), [cols[k] for k in order]


def compare(spark, con, name, sf_dir):
    t0 = time.time()
    df = QUERIES[name](spark, sf_dir)
    got = df.collect()
    t1 = time.time()
    if name not in CHECKS:
        return "rows-only", f"{len(got)} rows, spark {t1 - t0:.1f}s"
    res = con.execute(check_sql(name))
    cols = [d[0] for d in res.description]
    want = res.fetchall()
    t2 = time.time()
    a, ca = norm([tuple(x) for x in got], df.columns)
    b, cb = norm(want, cols)
    info = f"{len(a)} rows, spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s"
    if ca != cb:
        return "COLUMNS", f"{ca} vs {cb}"
    if len(a) != len(b):
        extra = [x for x in a[:2000] if x not in set(b)][:2]
        return "ROWCOUNT", f"{len(a)} vs {len(b)} {info}; spark-only {extra}; duck-only {[x for x in b[:2000] if x not in set(a)][:2]}"
    if a == b:
        types = [type(v).__name__ for v in a[0]] if a else []
        tb = [type(v).__name__ for v in b[0]] if b else []
        nulls = [ca[k] for k in range(len(ca)) if all(row[k] is None for row in a)]
        note = f" TYPES {list(zip(ca, types, tb))}" if types != tb else ""
        return "EMPTY" if not a else "ok", info + note + (f" all-null {nulls}" if nulls else "")
    sa, sb = set(a), set(b)
    da, db = [x for x in a if x not in sb], [x for x in b if x not in sa]
    show = "\n".join(f"    S {x}\n    D {y}" for x, y in list(zip(da, db))[:3])
    return "VALUES", f"{len(da)} of {len(a)} rows differ; {info}\n    {ca}\n{show}"


def main():
    args = sys.argv[1:]
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    names = [n for n in QUERIES if not args or any(n.startswith(p) for p in args)]
    spark = build_session("compare")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    bad = 0
    for n in names:
        try:
            status, info = compare(spark, con, n, sf)
        except Exception as e:
            status, info = "ERROR", str(e)[:1200]
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += status not in ("ok", "rows-only")
        print(f"{status:9} {n:32} {info}", flush=True)
    print(f"{len(names)} queries, {bad} not ok")
    os._exit(1 if bad else 0)


if __name__ == "__main__":
    main()
