"""Every query that has SQL gives the same rows as DuckDB."""

import pytest

from conftest import LARGER_SF, SF, rows_of
from plantflow import registry


# Fits refuse fewer than 48 usable hours, more than the smallest tables have.
FITS = ("degradation", "regression_quality")


@pytest.mark.parametrize("name", FITS)
def test_fit_matches_sql(spark, larger_duck, name):
    check(spark, larger_duck, name, LARGER_SF)


@pytest.mark.parametrize("name", sorted(set(registry.oracles()) - set(FITS)))
def test_query_matches_sql(spark, duck, name):
    check(spark, duck, name, SF)


def check(spark, duck, name, sf_dir):
    got = registry.queries()[name](spark, sf_dir).toArrow()
    want = duck.execute(registry.oracles()[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)
    assert rows_of(got, columns) == rows_of(want, columns)


def test_entry_runs(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns[:2] == ["point_uri", "bucket"]
    assert df.limit(1).count() == 1
