"""Run registered queries in Spark and DuckDB and compare them.

``python -m tests.oracle [sf] [name-substring ...]``
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

ROOT = os.environ.get("SF_ROOT", "/root/testdata")


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, (list, tuple)):
        return repr([_norm(u) for u in v])
    return str(v)


_KIND = {"int": "int", "bigint": "int", "smallint": "int", "tinyint": "int", "hugeint": "int", "integer": "int",
         "ubigint": "int", "double": "double", "float": "double", "string": "text", "varchar": "text", "boolean": "bool"}


def compare(spark, con, q, sf_dir):
    """Empty string when equal, else what differs."""
    df = q.build(spark, sf_dir)
    got = df.collect()
    cols = sorted(df.columns)
    if q.sql is None:
        return "" if got else "no rows"
    rel = con.execute(q.sql)
    names = [d[0] for d in rel.description]
    kinds = {d[0]: _KIND.get(str(d[1]).lower(), str(d[1]).lower()) for d in rel.description}
    want = rel.fetchall()
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    mine = {n: _KIND.get(t, t) for n, t in df.dtypes}
    diff = {n: (mine[n], kinds[n]) for n in cols if mine[n] != kinds[n]}
    a = sorted(tuple(_norm(r[c]) for c in cols) for r in got)
    at = [names.index(c) for c in cols]
    b = sorted(tuple(_norm(r[i]) for i in at) for r in want)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(bad)} of {len(a)} rows differ, {cols}: {bad[:2]}"
    if not a:
        return "no rows"
    return f"types {diff}" if diff else ""


def main(argv):
    from signalframe.plans import QUERIES
    from signalframe.session import build_session

    sf = argv[0] if argv else "sf0.001"
    spark = build_session("oracle", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"{ROOT}/{sf}"
    con = connect(sf_dir)
    bad = 0
    for name, q in QUERIES.items():
        if len(argv) > 1 and not any(a in name for a in argv[1:]):
            continue
        t = time.time()
        try:
            why = compare(spark, con, q, sf_dir)
        except Exception as e:  # report and go on
            why = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(why)
        print(f"{'FAIL' if why else 'ok  '} {name} {time.time() - t:.1f}s {why}", flush=True)
    print("failures:", bad)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
