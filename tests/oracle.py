"""Run queries beside their SQL and compare rows exactly."""

from __future__ import annotations

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    return v


def compare(df, con, sql):
    """None if equal, else a text telling the difference."""
    table = con.execute(sql)
    names = [d[0] for d in table.description]
    expected = table.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    order = sorted(names)
    got = [tuple(r[c] for c in order) for r in df.collect()]
    at = [names.index(c) for c in order]
    want = [tuple(r[i] for i in at) for r in expected]
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    got.sort(key=repr)
    want.sort(key=repr)
    if got != want or [[type(v) for v in r] for r in got] != [[type(v) for v in r] for r in want]:
        diff = [(g, w) for g, w in zip(got, want, strict=True) if repr(g) != repr(w)]
        return f"{len(diff)} rows differ; {order}\n  spark {diff[0][0] if diff else got[0]}\n  sql   {diff[0][1] if diff else want[0]}"
    return None
