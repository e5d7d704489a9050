"""Query results against DuckDB."""

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in Path(sf_dir).iterdir():
        con.sql(f"CREATE VIEW {f.name.split('.')[0]} AS SELECT * FROM '{f}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return value.item() if hasattr(value, "item") else value


def rows(frame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=repr)


def assert_same(spark_df, con, sql: str) -> int:
    ours, theirs = spark_df.toPandas(), con.sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    a, b = rows(ours), rows(theirs)
    assert len(a) == len(b)
    assert a == b
    return len(a)
