"""Compare registered queries with their SQL the way the driver does: names, types, values."""

from __future__ import annotations

import datetime as dt
import glob
import os

import duckdb

TYPES = {
    "string": "VARCHAR",
    "int": "INTEGER",
    "bigint": "BIGINT",
    "smallint": "SMALLINT",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp": "TIMESTAMP",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _value(v):
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, float):
        return round(v, 6)
    return v


def _canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(_value(r[i])) for i in order) for r in rows)


def compare(df, con, sql: str) -> list[str]:
    """Differences between a DataFrame and a DuckDB statement (empty if none)."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    expected = cur.fetchall()
    problems = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    for name, kind in df.dtypes:
        if TYPES.get(kind, kind) != types[name]:
            problems.append(f"type of {name}: {kind} != {types[name]}")
    got = [tuple(r) for r in df.collect()]
    if len(got) != len(expected):
        problems.append(f"rows {len(got)} != {len(expected)}")
    a, b = _canon(df.columns, got), _canon(names, expected)
    if a != b:
        only_a, only_b = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
        problems.append(f"values differ ({len(set(a) - set(b))}/{len(set(b) - set(a))}): spark {only_a} sql {only_b}")
    return problems
