"""Runs a query and its SQL on the same tables and compares their rows."""

from __future__ import annotations

import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _plain(value):
    if value is None or value != value:
        return "~"
    if isinstance(value, float):
        return f"{value:.9g}"
    if hasattr(value, "item"):
        return _plain(value.item())
    return f"{float(value):.9g}" if isinstance(value, int) and not isinstance(value, bool) else str(value)


def rows(frame) -> list[tuple[str, ...]]:
    columns = sorted(frame.columns)
    return sorted(tuple(_plain(v) for v in r) for r in frame[columns].itertuples(index=False, name=None))


def compare(spark, query, sql: str) -> None:
    own = query(spark, SF).toPandas()
    con = duckdb.connect()
    for name in os.listdir(SF):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    other = con.execute(sql).fetchdf()
    assert sorted(own.columns) == sorted(other.columns)
    assert rows(own) == rows(other)
