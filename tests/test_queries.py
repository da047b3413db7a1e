from __future__ import annotations

import pytest

import __spark_entry__
from hexsupport.plans import algebra, geometry, places
from tests.oracle import SF, compare

QUERIES = algebra.QUERIES | geometry.QUERIES | places.QUERIES
SQL = algebra.SQL | geometry.sql() | places.sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_the_rows_of_its_sql(spark, name):
    compare(spark, QUERIES[name], SQL[name])


TOY_SQL = geometry.toy_sql()


@pytest.mark.parametrize("name", sorted(TOY_SQL))
def test_toy_run_gives_the_rows_of_its_sql(spark, name):
    compare(spark, geometry.TOY_RUNS[name], TOY_SQL[name])


def test_every_core_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_every_query_is_registered():
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_render(spark):
    row = geometry.render_boundaries(spark, SF).first()
    assert row.wkt.startswith("MULTIPOLYGON (((") and '"MultiPolygon"' in row.geojson
