"""Run registered queries in Spark and their oracle SQL in DuckDB, compare.

Usage: python tests/oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    return v


def frame_rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    rows = [tuple(_norm(v) for v in r) for r in df[cols].astype(object).itertuples(index=False)]
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, con, name, build, sql, sf_dir):
    s = build(spark, sf_dir).toPandas()
    d = con.execute(sql).df()
    if sorted(s.columns) != sorted(d.columns):
        return f"columns differ: spark={sorted(s.columns)} sql={sorted(d.columns)}"
    if len(s) != len(d):
        return f"rows differ: spark={len(s)} sql={len(d)}"
    rs, rd = frame_rows(s), frame_rows(d)
    for a, b in zip(rs, rd):
        if a != b:
            return f"value differ: spark={a} sql={b}"
    return None


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from gridspark.session import get_session
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    spark = get_session(shuffle_partitions=8)
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for n in names or list(qs):
        if n not in sqls:
            print(f"{n}: no oracle (rows-only)")
            continue
        try:
            err = compare(spark, con, n, qs[n], sqls[n], sf_dir)
        except Exception as e:  # noqa: BLE001
            err = f"error: {type(e).__name__}: {str(e)[:400]}"
        bad += err is not None
        print(f"{n}: {'OK' if err is None else err}", flush=True)
    print(f"{bad} mismatches")


if __name__ == "__main__":
    main(sys.argv[1:])
