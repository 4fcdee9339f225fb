"""Compare registered queries with their SQL in DuckDB.

Run as ``python -m tests.oracle [sf_dir] [name ...]`` for a report.
"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if hasattr(v, "asDict"):
        return tuple((k, _cell(x)) for k, x in sorted(v.asDict().items()))
    if isinstance(v, dict):
        return tuple((k, _cell(x)) for k, x in sorted(v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, fn, sql, sf_dir):
    """(ok, message) of one query."""
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if sql is None:
        return True, f"rows={len(got)} spark={t1 - t0:.1f}s (no SQL)"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = _rows(cols, cur.fetchall())
    note = f"rows={len(got)}/{len(want)} spark={t1 - t0:.1f}s duck={time.time() - t1:.1f}s"
    if sorted(cols) != sorted(df.columns):
        return False, f"{note} columns {sorted(df.columns)} != {sorted(cols)}"
    if got != want:
        a, b = set(map(repr, got)), set(map(repr, want))
        return False, (
            f"{note}\n   only spark {len(a - b)}: {sorted(a - b)[:2]}\n"
            f"   only sql {len(b - a)}: {sorted(b - a)[:2]}"
        )
    return True, note


def main() -> int:
    from pressgraph.registry import load_all
    from pressgraph.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, (fn, sql) in load_all().items():
        if names and not any(n in name for n in names):
            continue
        try:
            ok, note = compare(spark, con, fn, sql, sf_dir)
        except Exception as e:  # report and go on
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name}: {note}"[:3000], flush=True)
    print(f"{bad} failing")
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main())
