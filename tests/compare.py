"""Runs a registered query and its SQL on the same tables and compares rows."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def sql_rows(sf_dir: str, sql: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con.execute(sql).df()


def _plain(v):
    if pd.isna(v):
        return None
    if isinstance(v, float):
        return round(v, 6)
    return v.item() if hasattr(v, "item") else v


def rows_of(df):
    columns = sorted(df.columns)
    return sorted((tuple(_plain(v) for v in r) for r in df[columns].itertuples(index=False)), key=repr)


def differences(spark_df, sql_df, show: int = 3):
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} and {sorted(sql_df.columns)}"
    a, b = rows_of(spark_df), rows_of(sql_df)
    if a == b:
        return None
    sa, sb = set(a), set(b)
    return f"{len(a)} and {len(b)} rows; only Spark {list(sa - sb)[:show]}; only SQL {list(sb - sa)[:show]}"
