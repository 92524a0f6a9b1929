"""Compares a Spark result with DuckDB's result of the matching SQL, ignoring row order."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, float)):
        if isinstance(value, float) and (math.isnan(value) or math.isinf(value)):
            return str(value)
        return f"{float(value) + 0.0:.5f}" if not float(value).is_integer() else str(int(value))
    return str(value)


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def difference(df, con, sql):
    """None when equal, else a short description."""
    columns, rows = df.columns, [tuple(r) for r in df.collect()]
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = result.fetchall()
    if sorted(columns) != sorted(names):
        return f"columns {sorted(columns)} != {sorted(names)}"
    if len(rows) != len(expected):
        return f"{len(rows)} rows, expected {len(expected)}"
    got, want = _sorted_rows(columns, rows), _sorted_rows(names, expected)
    for a, b in zip(got, want):
        if a != b:
            return f"first difference:\n  {str(a)[:600]}\n  {str(b)[:600]}"
    return None
