"""Every named query against its SQL in DuckDB."""

import pytest
from checking import duckdb_result, open_duckdb, spark_result

from staygrid.catalog.oracle import ORACLE
from staygrid.catalog.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
# No query may pair everything with everything or leave the JVM.
UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "MapInPandas")


@pytest.fixture(scope="module")
def con():
    return open_duckdb(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in UNWANTED:
        assert bad not in plan, bad
    assert spark_result(df) == duckdb_result(con, ORACLE[name])
