"""Row comparison between a Spark result and the same query in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

from granary.sources.tables import TABLE_NAMES


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLE_NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def norm(v, digits=None):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if digits is not None and v != 0 and not math.isinf(v):
            return float(f"{v:.{digits}g}")
        return v + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x, digits) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), norm(x, digits)) for k, x in v.items()))
    return v


def rows_of(columns, rows, digits=None):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(norm(r[i], digits) for i in order) for r in rows),
        key=lambda r: tuple((x is None, str(type(x)), x if not isinstance(x, tuple) else str(x)) for x in r),
    )


def compare(df, sql, con):
    """Empty string when equal, else what differs ('~' prefix: only beyond 9 digits)."""
    rel = con.sql(sql)
    want_cols, want = rel.columns, rel.fetchall()
    got_cols = df.columns
    got = [tuple(r) for r in df.collect()]
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} vs {sorted(want_cols)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    a, b = rows_of(got_cols, got), rows_of(want_cols, want)
    if a == b:
        types = {}
        for c, x in zip(sorted(got_cols), range(len(got_cols))):
            for r, s in zip(a, b):
                if r[x] is not None and type(r[x]) is not type(s[x]):
                    types[c] = (type(r[x]).__name__, type(s[x]).__name__)
                    break
        return f"types {types}" if types else ""
    a9, b9 = rows_of(got_cols, got, 9), rows_of(want_cols, want, 9)
    mark = "~" if a9 == b9 else ""
    if not mark:
        a, b = a9, b9
    for r, s in zip(a, b):
        if r != s:
            return f"{mark}{r} vs {s}"
    return "?"
