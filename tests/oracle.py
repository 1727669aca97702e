"""Compare registered queries with their checking SQL in DuckDB.

    python tests/oracle.py [name-prefix ...]      # CHECK_SF_DIR, default sf0.01
"""

import datetime as dt
import decimal
import math
import os
import pathlib
import sys
import time

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def plain(v):
    """One comparable form for a value of either engine."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(int(v)) if v == int(v) and abs(v) < 1e15 else repr(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{plain(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, folder, name, fn, sql):
    start = time.time()
    df = fn(spark, folder)
    got = rows_of(df.columns, df.collect())
    spent = time.time() - start
    if sql is None:
        return None, f"{len(got)} rows, no SQL"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    if got != want:
        extra, lost = sorted(set(got) - set(want))[:3], sorted(set(want) - set(got))[:3]
        return False, f"rows {len(got)} vs {len(want)}\n   spark {sorted(names)}: {str(extra)[:900]}\n   sql: {str(lost)[:900]}"
    return True, f"{len(got)} rows (spark {spent:.1f}s)"


def main(prefixes):
    from quern.core import get_session
    from quern.workload import QUERIES, SQL

    folder = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark = get_session("check", cores="8")
    con = connect(folder)
    bad = []
    for name, fn in QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            ok, note = compare(spark, con, folder, name, fn, SQL.get(name))
        except Exception as exc:  # report and go on with the other queries
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:1200]}"
        if ok is False:
            bad.append(name)
        print(f"{'ok  ' if ok else 'rows' if ok is None else 'BAD '} {name} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{len(bad)} bad: {bad}")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
