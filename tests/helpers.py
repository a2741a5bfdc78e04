"""Comparison of query results with DuckDB."""

from __future__ import annotations

import os

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def canonical(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, list | tuple):
        return str([canonical(x) for x in v])
    return str(v)


def compare(df, con, sql: str) -> None:
    got = df.collect()
    rel = con.sql(sql)
    names = sorted(rel.columns)
    assert names == sorted(df.columns)
    at = [rel.columns.index(n) for n in names]
    want = sorted(tuple(canonical(r[i]) for i in at) for r in rel.fetchall())
    assert sorted(tuple(canonical(r[n]) for n in names) for r in got) == want
