"""Comparison of a query with its SQL over the same tables."""

from pathlib import Path

import duckdb


def connection(sf: str):
    con = duckdb.connect()
    for p in Path(sf).iterdir():
        con.sql(f"CREATE VIEW {p.name.split('.')[0]} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows(frame, columns):
    plain = lambda v: None if v is None or v != v else float(v) if isinstance(v, float) else v
    return sorted(str(tuple(map(plain, r))) for r in frame[columns].itertuples(index=False, name=None))


def assert_same(con, got, sql):
    want, got = con.sql(sql).df(), got.toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want, columns)
