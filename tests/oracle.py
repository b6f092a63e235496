"""Runs a query and its SQL twin over the same tables and compares rows as bags."""

from __future__ import annotations

import os
from collections import Counter

import duckdb

import __spark_entry__

DATA = os.environ.get("TEXTLOOM_DATA", "/root/testdata")


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def duck(sql: str, sf: str):
    con = duckdb.connect()
    for f in os.listdir(f"{DATA}/{sf}"):
        t = f.removesuffix(".parquet")
        p = f"{DATA}/{sf}/{f}"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    order = sorted(range(len(cols)), key=cols.__getitem__)
    return [cols[i] for i in order], Counter(tuple(norm(r[i]) for i in order) for r in cur.fetchall())


def compare(spark, name: str, sf: str = "sf0.001") -> int:
    df = __spark_entry__.queries()[name](spark, f"{DATA}/{sf}")
    cols = sorted(df.columns)
    mine = Counter(tuple(norm(x) for x in r) for r in df.select(*cols).collect())
    their_cols, theirs = duck(__spark_entry__.oracle_sql()[name], sf)
    assert cols == their_cols, (name, cols, their_cols)
    diff = list((mine - theirs).items())[:3], list((theirs - mine).items())[:3]
    assert mine == theirs, (name, sum(mine.values()), sum(theirs.values()), diff)
    return sum(mine.values())
