"""Compares queries with DuckDB on the same tables: python -m tests.oracle SF NAME..."""

from __future__ import annotations

import os
import sys

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def expected(sql: str, sf_dir: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.execute(sql).df()


def difference(spark, name: str, query, sql: str, sf_dir: str) -> str | None:
    """None if rows and columns agree."""
    got, want = query(spark, sf_dir).toPandas(), expected(sql, sf_dir)
    if sorted(got.columns) != sorted(want.columns):
        return f"{name}: columns {list(got.columns)}, not {list(want.columns)}"
    columns = sorted(want.columns)
    got, want = (x[columns].sort_values(columns, kind="stable").reset_index(drop=True) for x in (got, want))
    if len(got) != len(want):
        return f"{name}: {len(got)} rows, not {len(want)}"
    for c in columns:
        a, b = got[c], want[c]
        bad = ~((a == b) | (a.isna() & b.isna()))
        if a.dtype != b.dtype:
            return f"{name}: {c} is {a.dtype}, not {b.dtype}"
        if bad.any():
            return f"{name}: {c} differs in {bad.sum()} of {len(a)} rows: {a[bad].head(3).tolist()}, not {b[bad].head(3).tolist()}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    session = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    qs, sqls = entry.queries(), entry.oracle_sql()
    for n in sys.argv[2:] or sqls:
        try:
            said = difference(session, n, qs[n], sqls[n], f"/root/testdata/{sys.argv[1]}") if n in sqls else f"{n}: {qs[n](session, f'/root/testdata/{sys.argv[1]}').count()} rows, no SQL"
        except Exception as e:  # noqa: BLE001
            said = f"{n}: {type(e).__name__} {str(e)[:300]}"
        print(said or f"{n}: equal", flush=True)
