"""Every query with a SQL counterpart gives the same rows on Spark and DuckDB."""

import pytest
from conftest import SMALL

from checks import duckdb_sql, spark_queries
from checks.compare import difference, oracle

CONNECTION = oracle(SMALL)
WITHOUT_SQL = {"model_predict", "model_eval", "batch_predict_trained"}


@pytest.mark.parametrize("name", [n for n in spark_queries.QUERIES if n not in WITHOUT_SQL])
def test_same_rows(spark, name):
    problem = difference(spark_queries.QUERIES[name](spark, SMALL), CONNECTION,
                         duckdb_sql.QUERIES[name])
    assert problem is None, problem


def test_entry_module(spark):
    import __spark_entry__ as driver
    assert driver.entry(spark).count() == 26
    assert set(duckdb_sql.QUERIES) == set(spark_queries.QUERIES) - WITHOUT_SQL
    assert set(spark_queries.QUERIES) <= set(driver.queries())
    assert set(duckdb_sql.QUERIES) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", ["kani_mean5_many", "kani_global_many"])
def test_the_cut_to_five_drops_competitors(name):
    """Without the cut the second view gives other scores, so its queries do test it."""
    medium = oracle("/root/testdata/sf0.01")
    sql = duckdb_sql.QUERIES[name]
    assert "place <= 5" in sql or "<= 5" in sql
    uncut = sql.replace("<= 5", "<= 50")
    assert sorted(medium.execute(sql).fetchall(), key=str) != sorted(medium.execute(uncut).fetchall(), key=str)
