"""Spark-vs-DuckDB comparison used by the tests and by hand.

Mirrors the driver's gate: same row count, same column names, same
order-insensitive multiset of rows (doubles compared after rounding).

    python -m tests.harness /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, places=6):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, places) + 0.0)
    if v is None:
        return None
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return repr(v) if not isinstance(v, str) else v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir, show=3):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    rel = con.execute(sql)
    d_cols = [c[0] for c in rel.description]
    d_rows = rel.fetchall()
    t2 = time.time()
    problems = []
    if sorted(s_cols) != sorted(d_cols):
        problems.append(f"columns spark={s_cols} duck={d_cols}")
    if len(s_rows) != len(d_rows):
        problems.append(f"rows spark={len(s_rows)} duck={len(d_rows)}")
    if not problems:
        a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
        if a != b:
            only_s = list((a - b).elements())[:show]
            only_d = list((b - a).elements())[:show]
            problems.append(f"values differ: spark-only={only_s} duck-only={only_d}")
    return problems, len(s_rows), t1 - t0, t2 - t1


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from popweave.session import local_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    spark = local_session(8)
    con = duck(sf_dir)
    qs, orc = E.queries(), E.oracle_sql()
    bad = 0
    for name in names or list(qs):
        if name not in orc:
            df = qs[name](spark, sf_dir)
            print(f"{name:32s} rows-only {df.count()}")
            continue
        try:
            problems, n, ts, td = compare(spark, con, name, qs[name], orc[name], sf_dir)
        except Exception as e:  # noqa: BLE001
            problems, n, ts, td = [f"error: {type(e).__name__}: {str(e)[:600]}"], -1, 0, 0
        status = "OK " if not problems else "BAD"
        bad += bool(problems)
        print(f"{status} {name:32s} rows={n:7d} spark={ts:6.2f}s duck={td:6.2f}s {' | '.join(problems)}")
    print(f"{bad} mismatches")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
