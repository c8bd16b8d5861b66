"""Rows of a query and of its DuckDB SQL, made comparable."""

import math
from pathlib import Path

import duckdb


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, float):
        return round(x, 6) + 0.0
    if isinstance(x, int):
        return x
    if hasattr(x, "as_tuple"):
        return round(float(x), 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    return str(x)


def ordered(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=lambda r: tuple((v is None, str(type(v)), v) if v is not None else (True, "", "") for v in r))


def close(a, b):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a == b


def duck(sf_dir):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        src = f"{f}/*.parquet" if f.is_dir() else str(f)
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{src}')")
    return con


def differences(df, con, sql):
    """What differs between a DataFrame and a SQL result; empty if nothing does."""
    got, want = df.collect(), con.execute(sql)
    names = [c[0] for c in want.description]
    want = want.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    a, b = ordered(df.columns, got), ordered(names, want)
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if not all(close(u, v) for u, v in zip(x, y))]
    return f"{len(bad)} of {len(a)} rows, such as {bad[0][0]} against {bad[0][1]}" if bad else ""
