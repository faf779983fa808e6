"""Run a query and its checking SQL side by side and compare whole results."""

from __future__ import annotations

import datetime
import glob
import math
import os

from pyspark.sql import DataFrame


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _plain(x)) for k, x in v.items()))
    return v


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def difference(df: DataFrame, con, sql: str) -> str | None:
    """None when both sides agree, else a short description."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    order = sorted(names)
    theirs = sorted(
        (tuple(_plain(r[names.index(c)]) for c in order) for r in cur.fetchall()), key=repr)
    ours = sorted((tuple(_plain(r[c]) for c in order) for r in df.collect()), key=repr)
    if len(ours) != len(theirs):
        other = set(theirs)
        extra = [r for r in ours if r not in other][:2]
        return f"rows {len(ours)} != {len(theirs)}; only in ours e.g. {extra!r:.600}"
    if ours == theirs:
        return None
    mine, other = set(ours), set(theirs)
    return f"{len(mine - other)} rows differ of {len(ours)}; ours {order} {sorted(mine - other, key=repr)[:2]!r:.600} " \
        f"theirs {sorted(other - mine, key=repr)[:2]!r:.600}"
