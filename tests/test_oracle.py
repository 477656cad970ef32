"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest

from meritflow.plans.check import compare, rows_of
from meritflow.plans.oracle import oracle_sql
from meritflow.plans.queries import QUERIES

from conftest import SF_SMALL

ORACLE = oracle_sql()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n in ORACLE))
def test_query_matches_oracle(spark, duck_small, name):
    assert compare(spark, name, SF_SMALL, duck_small, verbose=True)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in ORACLE))
def test_query_without_oracle_runs(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert df.count() >= 0


def test_entry_contract(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.columns == ["netuid", "uid", "score", "weight", "weight_u16"]
    assert df.count() > 0
    qs, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(qs)
    assert "reward_to_weights" in sql
