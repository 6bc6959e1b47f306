"""A query's rows against DuckDB's for its SQL."""

import glob
import os

import duckdb


def plain(value):
    value = value.item() if hasattr(value, "item") else value
    if value is None or value != value:
        return "None"
    return str(value)


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())


def sql_rows(sql, sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    found = con.sql(sql)
    columns = found.columns
    return sorted(columns), sorted(tuple(plain(v) for _, v in sorted(zip(columns, r))) for r in found.fetchall())
