"""Compare a registered query with its SQL on DuckDB."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os
from collections import Counter

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, int):
        return value
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    if isinstance(value, (dt.datetime, dt.date)):
        return value
    return value


def difference(spark_df, con, sql: str) -> str | None:
    """None when columns and the multiset of rows are equal, else a short account."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    order = sorted(names)
    rows = spark_df.select(*[f"`{n}`" for n in order]).collect()
    positions = [names.index(n) for n in order]
    ours = Counter(tuple(_plain(v) for v in r) for r in rows)
    theirs = Counter(tuple(_plain(r[p]) for p in positions) for r in expected)
    if ours == theirs:
        for r, e in ((rows, expected),):
            if r and e:
                ours_types = [type(v).__name__ for v in r[0]]
                their_types = [type(e[0][p]).__name__ for p in positions]
                bad = [(n, a, b) for n, a, b in zip(order, ours_types, their_types)
                       if a != b and "NoneType" not in (a, b) and {a, b} != {"Row", "dict"}]
                if bad:
                    return f"types differ: {bad}"
        return None
    return (f"{sum(ours.values())} rows, expected {sum(theirs.values())}; only ours "
            f"{list((ours - theirs).items())[:3]}; only expected {list((theirs - ours).items())[:3]}")
