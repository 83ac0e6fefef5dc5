"""Runs a query and its SQL on the same tables and compares rows as bags."""

from collections import Counter
from pathlib import Path

import duckdb

SMALL = "/root/testdata/sf0.001"


def rows_of(df):
    names = sorted(df.columns)
    return Counter(map(tuple, df.select(*[f"`{n}`" for n in names]).collect()))


def sql_rows(sql, sf=SMALL):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    out = con.execute(sql)
    names = [c[0] for c in out.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(r[i] for i in order) for r in out.fetchall())


def assert_same(df, sql, sf=SMALL):
    got, want = rows_of(df), sql_rows(sql, sf)
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3], sum(got.values()), sum(want.values()))
