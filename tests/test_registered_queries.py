"""Every registered query against its SQL on DuckDB."""

import pytest

import __spark_entry__ as entry_points
from catalog.compare import compare, connect

QUERIES = entry_points.queries()
ORACLE = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(name, spark, con, sf_dir):
    result = compare(spark, con, QUERIES[name], ORACLE[name], sf_dir)
    assert result["status"] in ("EXACT", "CLOSE"), result


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs_without_sql(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).columns


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.count() > 0 and "canonical_path" in df.columns
