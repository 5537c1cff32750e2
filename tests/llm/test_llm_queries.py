"""The registered queries against their SQL, and the guard that leaves them out."""

import pytest
from conftest import SMALL

from checks.compare import difference, oracle
from pricelane.llm import queries, sql


@pytest.mark.parametrize("name", sorted(sql.QUERIES))
def test_same_rows(spark, name):
    problem = difference(queries.QUERIES[name](spark, SMALL), oracle(SMALL), sql.QUERIES[name])
    assert problem is None, problem


def test_registered():
    import __spark_entry__ as driver
    names = set(driver.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(sql.QUERIES) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", ["op7_exact_dedup", "op10_mixing"])
def test_native_plans(spark, name):
    plan = queries.QUERIES[name](spark, SMALL)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "ExistingRDD", "Cartesian"))
