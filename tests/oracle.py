"""Runs a query on Spark and its SQL on DuckDB, over the same tables, and compares the rows."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = Path(sf_dir) / f"{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}/*.parquet')" if p.is_dir() else f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    """A comparable form: numbers to nine digits, nested rows as tuples."""
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(names: list[str], data) -> list[str]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in (plain(r[i]) for i in order))) for r in data)


def compare(df, sql: str, con: duckdb.DuckDBPyConnection) -> str:
    """Empty if the rows agree, else what differs."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    mine, theirs = rows(df.columns, df.collect()), rows(names, cur.fetchall())
    if mine == theirs:
        return ""
    only = [r for r in mine if r not in set(theirs)][:3]
    missing = [r for r in theirs if r not in set(mine)][:3]
    return f"{len(mine)} rows and {len(theirs)}; only here {only}; only there {missing}"
