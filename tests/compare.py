"""Runs queries against their SQL and reports differences: ``python tests/compare.py [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if v is None:
        return "null"
    if isinstance(v, (int,)) and not isinstance(v, bool):
        return str(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def differences(spark_df, con, sql):
    got = canonical(spark_df.columns, spark_df.collect())
    cur = con.execute(sql)
    want = canonical([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns differ: {got[0]} / {want[0]}"
    if got[1] != want[1]:
        a, b = set(got[1]) - set(want[1]), set(want[1]) - set(got[1])
        return f"rows {len(got[1])}/{len(want[1])}; only spark {sorted(a)[:3]}; only sql {sorted(b)[:3]}"
    return None


def main() -> None:
    from hazlake.session import local_session

    import __spark_entry__ as contract

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    oracles = contract.oracle_sql()
    for name, fn in contract.queries().items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                t2 = time.time()
                bad = differences(df, con, oracles[name])
                print(name, "OK" if bad is None else bad, f"build {t2 - t:.1f}s total {time.time() - t:.1f}s", flush=True)
            else:
                print(name, "rows only:", df.count(), f"{time.time() - t:.1f}s", flush=True)
        except Exception as e:  # report and go on to the next query
            print(name, "ERROR", str(e)[:1500], flush=True)


if __name__ == "__main__":
    main()
