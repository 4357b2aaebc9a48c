"""Every registered query with SQL agrees with DuckDB on the smallest driver tables; the others give rows."""

import pytest

import __spark_entry__ as contract
from tests.oracle import compare, duck, rows

SF = "/root/testdata/sf0.001"
QUERIES = contract.queries()
ORACLE = contract.oracle_sql()
# Streaming and extraction jobs run at this scale as well, but they are checked by ``python -m tests.oracle``.
SLOW = {n for n in QUERIES if n.startswith(("stream_", "ast_", "shadow_"))}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(set(ORACLE) - SLOW))
def test_equals_sql(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLE[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - SLOW))
def test_gives_rows(spark, name):
    frame = QUERIES[name](spark, SF).toPandas()
    rows(frame)
    assert len(frame)


def test_contract_shape():
    assert set(ORACLE) <= set(QUERIES)
    assert len(QUERIES) > 150


def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.columns[0] == "path" and frame.count() > 0
