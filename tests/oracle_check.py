"""Compare registered queries with their SQL equivalents in DuckDB.

usage: python tests/oracle_check.py [sf_dir] [name ...]
"""
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None when both hold the same rows, order aside."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    columns = sorted(got.columns)

    def norm(df):
        df = df[columns].copy()
        for c in columns:
            if df[c].dtype.kind in "fc":
                df[c] = df[c].round(6) + 0.0
        return df.sort_values(columns).reset_index(drop=True)
    a, b = norm(got), norm(want)
    for c in columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            i = (~same).idxmax()
            return f"column {c}: {(~same).sum()} differ, e.g. {a.loc[i].to_dict()} != {b.loc[i].to_dict()}"
        if (a[c].dtype.kind in "fO") != (b[c].dtype.kind in "fO") and not a[c].isna().any():
            return f"column {c}: type {a[c].dtype} != {b[c].dtype}"
    return None


def main():
    from __spark_entry__ import oracle_sql, queries
    from tidegraph.session import local_session
    args = sys.argv[1:]
    sf = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark, con, sql = local_session(8), connect(sf), oracle_sql()
    failed = []
    for name, fn in queries().items():
        if args and name not in args:
            continue
        start = time.time()
        try:
            got = fn(spark, sf).toPandas()
            spark_sec = time.time() - start
            start = time.time()
            verdict = difference(got, con.sql(sql[name]).df()) if name in sql else "no SQL"
        except Exception as e:
            verdict, spark_sec, got = f"{type(e).__name__}: {str(e)[:600]}", 0, []
        ok = verdict is None or verdict == "no SQL"
        if not ok:
            failed.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name:32} rows={len(got):8} spark={spark_sec:6.2f}s "
              f"duckdb={time.time() - start:6.2f}s {verdict or ''}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
