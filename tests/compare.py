"""Row-for-row comparison of a Spark result with its SQL on the same tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return names, sorted(plain, key=lambda t: tuple((v is None, str(type(v)), str(v)) for v in t))


def differences(df, con, sql: str, limit: int = 5) -> list:
    names, ours = rows_of(df.columns, [tuple(x) for x in df.collect()])
    cur = con.execute(sql)
    other_names, theirs = rows_of([d[0] for d in cur.description], cur.fetchall())
    if names != other_names:
        return [("columns", names, other_names)]
    out = [] if len(ours) == len(theirs) else [("rows", len(ours), len(theirs))]
    for a, b in zip(ours, theirs):
        if a != b:
            out.append((a, b))
            if len(out) >= limit:
                break
    return out
