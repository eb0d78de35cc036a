"""A query's rows against those of DuckDB on the same tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def rows_of(frame) -> list[tuple]:
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(tuple, frame.where(frame.notna(), None).values.tolist()), key=repr)


def assert_same(found: DataFrame, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for path in Path(sf_dir).iterdir():
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    expected = con.sql(sql).df()
    got = found.toPandas()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows_of(got) == rows_of(expected)
