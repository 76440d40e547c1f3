"""Spark results beside DuckDB's on the same tables."""

from pathlib import Path

import duckdb


def connect(d):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in Path(d).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    show = lambda x: round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else x
    return sorted((tuple(show(r[i]) for i in order) for r in data), key=repr)


def same(df, con, sql):
    r = con.execute(sql)
    cols = [x[0] for x in r.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(cols, r.fetchall())
