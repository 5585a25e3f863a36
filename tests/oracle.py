"""Holds a Spark query against its DuckDB SQL on the same parquet tables."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    """A value that compares across engines; floats to 9 significant digits."""
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if isinstance(value, decimal.Decimal):
        value = float(value) if value % 1 else int(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    return value


def expected(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    """Columns (sorted) and rows (sorted) of a DuckDB query over a directory of tables."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(plain(r[i]) for i in order) for r in cur.fetchall()]
    return [names[i] for i in order], sorted(rows, key=repr)


def got(df) -> tuple[list[str], list[tuple]]:
    """The same of a Spark frame."""
    names = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    return names, sorted(rows, key=repr)


def difference(df, sf_dir: str, sql: str) -> str:
    """Empty if both agree; else what differs first."""
    a, b = got(df), expected(sf_dir, sql)
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"{len(a[1])} rows and {len(b[1])}"
    for x, y in zip(*(z[1] for z in (a, b))):
        if x != y:
            return f"{x}\n{y}"
    return ""
