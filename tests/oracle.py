"""Run a registered query and its SQL, and compare names, types and values."""

from __future__ import annotations

import glob
import os

import duckdb

WHOLE = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def spark_rows(df):
    order = sorted(df.columns)
    types = {c: WHOLE.get(t, t) for c, t in df.dtypes}
    rows = df.select(*[f"`{c}`" for c in order]).collect()
    return types, sorted((tuple(map(repr, r)) for r in rows))


def sql_rows(con, sql: str):
    names = [(r[0], r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()]
    order = sorted(n for n, _ in names)
    quoted = ", ".join('"' + n.replace('"', '""') + '"' for n in order)
    rows = con.execute(f"SELECT {quoted} FROM ({sql}) AS result").fetchall()
    return dict(names), sorted((tuple(map(repr, r)) for r in rows))


def difference(df, con, sql: str) -> str | None:
    """None if both sides agree, else what differs."""
    left_types, left = spark_rows(df)
    right_types, right = sql_rows(con, sql)
    if left_types != right_types:
        return f"types differ: {sorted(set(left_types.items()) ^ set(right_types.items()))}"
    if len(left) != len(right):
        return f"{len(left)} rows against {len(right)}"
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(left)} rows differ, first {wrong[0]}"
    return None
