"""Compare registered queries with their SQL."""

from __future__ import annotations

import glob
import os

import duckdb

TESTDATA = os.environ.get("TESTDATA", "/root/testdata")


def open_tables(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _kind(value):
    if isinstance(value, bool):
        return "bool"
    return type(value).__name__


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def rows_of_sql(con, sql):
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    rows = cur.fetchall()
    return [cols[k] for k in order], sorted((tuple(r[k] for k in order) for r in rows), key=repr)


def compare(df, con, sql) -> str | None:
    """None when both give the same columns, types and rows, else what differs."""
    names, got = rows_of_spark(df)
    names_sql, want = rows_of_sql(con, sql)
    if names != names_sql:
        return f"columns {names} and {names_sql}"
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    if not got:
        return "no rows"
    kinds = [{_kind(r[k]) for r in got} ^ {_kind(r[k]) for r in want} for k in range(len(names))]
    if any(kinds):
        return f"types {list(zip(names, kinds))}"
    if got != want:
        first = next((g, w) for g, w in zip(got, want) if g != w)
        return f"first difference {first}"
    return None
