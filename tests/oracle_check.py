"""Run every report in Spark and its oracle SQL in DuckDB and compare results.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck_connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v
    if isinstance(v, decimal.Decimal):
        return str(v.normalize()) if v == v.to_integral() else str(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def spark_to_duck(t: str) -> str:
    simple = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
              "timestamp_ntz": "TIMESTAMP", "date": "DATE", "boolean": "BOOLEAN"}
    if t in simple:
        return simple[t]
    if t.startswith("decimal"):
        return t.upper().replace(" ", "")
    return t


def _key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


def compare(spark_rows, spark_cols, duck_rows, duck_cols):
    problems = []
    if sorted(spark_cols) != sorted(duck_cols):
        problems.append(f"columns differ: spark={spark_cols} duck={duck_cols}")
        return problems
    order = sorted(spark_cols)
    si = [spark_cols.index(c) for c in order]
    di = [duck_cols.index(c) for c in order]
    s = sorted((tuple(norm(r[i]) for i in si) for r in spark_rows), key=_key)
    d = sorted((tuple(norm(r[i]) for i in di) for r in duck_rows), key=_key)
    if len(s) != len(d):
        problems.append(f"row count spark={len(s)} duck={len(d)}")
    bad = [(a, b) for a, b in zip(s, d) if a != b]
    if bad:
        problems.append(f"{len(bad)} rows differ; first: spark={bad[0][0]} duck={bad[0][1]} cols={order}")
    return problems


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    from cxlens.session import local_session
    import __spark_entry__ as E
    spark = local_session(8)
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck_connect(sf_dir)
    failed = []
    for name in (names or sorted(qs)):
        t0 = time.time()
        df = qs[name](spark, sf_dir)
        srows = [tuple(r) for r in df.collect()]
        t1 = time.time()
        if name not in sqls:
            print(f"{name:30s} spark {len(srows)} rows (no oracle)")
            continue
        cur = con.execute(sqls[name])
        dcols = [x[0] for x in cur.description]
        drows = cur.fetchall()
        t2 = time.time()
        probs = compare(srows, df.columns, drows, dcols)
        dtypes = dict(zip(dcols, [str(x[1]) for x in cur.description]))
        tmis = {c: (t, dtypes.get(c)) for c, t in df.dtypes if spark_to_duck(t) != dtypes.get(c)}
        if tmis:
            print(f"    type mismatch {name}: {tmis}")
        stypes = dict(df.dtypes)
        status = "OK " if not probs else "BAD"
        print(f"{status} {name:30s} rows={len(srows):6d} spark={t1 - t0:5.2f}s duck={t2 - t1:5.2f}s")
        if probs:
            failed.append(name)
            for p in probs:
                print("     ", p)
            print("      spark types:", stypes)
            print("      duck types:", dict(zip(dcols, [str(x[1]) for x in cur.description])))
    print("FAILED:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
