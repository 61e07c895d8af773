"""Runs queries next to their expected SQL and compares values."""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v


def normal(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, f, text) -> str | None:
    """None when equal, else a description of the first difference."""
    df = f(spark, sf_dir)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(text)
    cols = [c[0] for c in cur.description]
    want = normal(cur.fetchall(), cols)
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(cols)}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    if not want:
        return "no rows on either side"
    for g, w in zip(got, want):
        if g != w:
            return f"got {g}, expected {w}"
    return None


def main(sf_dir, names):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as E
    from helicase.session import build_session

    spark = build_session(master="local[8]")
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    qs, oracle = E.queries(), E.oracle_sql()
    for n, f in qs.items():
        if names and not any(n.startswith(x) for x in names):
            continue
        t = time.time()
        try:
            if n in oracle:
                bad = compare(spark, con, sf_dir, f, oracle[n])
            else:
                bad = None if f(spark, sf_dir).count() else "no rows"
        except Exception as e:  # noqa: BLE001
            bad = f"{type(e).__name__}: {str(e)[:700]}"
        print(("ok  " if bad is None else "BAD ") + f"{n} {time.time() - t:.1f}s", "" if n in oracle else "(rows only)", bad or "", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
