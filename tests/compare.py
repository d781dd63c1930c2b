"""Compares every query with its SQL: columns, rows and values, without order."""

import glob
import os
import sys
from datetime import date, datetime
from decimal import Decimal

import duckdb


def plain(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    if isinstance(v, Decimal):
        return round(float(v), 9)
    if isinstance(v, datetime | date):
        return v.isoformat()
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


def connect(sf: str):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    return c


def differences(spark, con, name, query, sql, sf) -> str:
    """'' if equal, else what differs."""
    df = query(spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} and {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    if got != want:
        a, b = set(got), set(want)
        return f"rows {len(got)} and {len(want)}; only here {sorted(a - b, key=repr)[:3]}; only by SQL {sorted(b - a, key=repr)[:3]}"
    return ""


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import time

    import __spark_entry__ as entry
    from sporlake.session import local_session

    spark = local_session(8)
    sf = sys.argv[1]
    con = connect(sf)
    q, s = entry.queries(), entry.oracle_sql()
    bad = 0
    for n in sys.argv[2:] or q:
        t = time.time()
        try:
            if n in s:
                r = differences(spark, con, n, q[n], s[n], sf)
            else:
                r = f"(no SQL) rows {q[n](spark, sf).count()}"
        except Exception as e:  # noqa: BLE001
            r = "ERROR " + str(e)[:600]
        bad += bool(r) and not r.startswith("(no")
        if r:
            print(f"{n}: {r[:900]} [{time.time() - t:.1f}s]", flush=True)
    print("queries", len(q), "with SQL", len(set(q) & set(s)), "SQL without query", set(s) - set(q), "bad", bad)
