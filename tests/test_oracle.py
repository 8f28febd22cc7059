"""Every registered query against its independent SQL oracle (DuckDB) on the driver tables."""

import os

import pytest

from stockroom.plans.catalog import REGISTRY
from stockroom.plans.oracle import ORACLE
from stockroom.plans.verify import compare, duckdb_conn

from conftest import SF_SMALL

SF = os.environ.get("STOCKROOM_TEST_SF", SF_SMALL)


@pytest.fixture(scope="module")
def con():
    return duckdb_conn(SF)


@pytest.mark.parametrize("key", sorted(REGISTRY))
def test_query_matches_oracle(spark, con, key):
    res = compare(spark, SF, key, con)
    if key not in ORACLE:
        assert res["status"] == "no-oracle" and res["spark_rows"] > 0
        return
    assert res["status"] in ("exact", "approx"), res


def test_every_key_is_registered_in_entry():
    import __spark_entry__ as e

    assert set(REGISTRY) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
