"""Run a registered query and its SQL side by side and compare the values."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None:
        return "∅"
    if isinstance(value, float):
        return "∅" if math.isnan(value) else f"{value:.6f}"
    if isinstance(value, bool):
        return str(value)
    if hasattr(value, "isoformat"):
        return value.isoformat()[:26]
    return str(value)


def normal_rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def run_sql(con, sql: str):
    cursor = con.execute(sql)
    return [c[0] for c in cursor.description], [str(c[1]) for c in cursor.description], cursor.fetchall()


def compare(df, con, sql: str) -> tuple[bool, str]:
    columns, kinds, rows = run_sql(con, sql)
    if sorted(df.columns) != sorted(columns):
        return False, f"columns {sorted(df.columns)} != {sorted(columns)}"
    mine = normal_rows(df.columns, df.collect())
    want = normal_rows(columns, rows)
    types = dict(zip(columns, kinds))
    names = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE",
             "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}
    bad = [
        f"{n}: {k} / {types[n]}" for n, k in df.dtypes if names.get(k, k.upper()) != types[n]
    ]
    note = f" [types {bad}]" if bad else ""
    if mine == want:
        return not bad, f"{len(mine)} rows{note}"
    only_mine = [r for r in mine if r not in set(want)][:2]
    only_want = [r for r in want if r not in set(mine)][:2]
    return False, f"{len(mine)} / {len(want)} rows; mine {only_mine}; sql {only_want}{note}"


def rows(df, *columns):
    """Plain tuples in a stable order."""
    out = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in out.collect()), key=repr)
