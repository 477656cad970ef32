"""Plan-level guarantees: no cartesian products or nested-loop joins, scans are pruned."""

import pytest

from meritflow.plans.queries import QUERIES

from conftest import SF_SMALL

BATCH = sorted(n for n in QUERIES if not n.startswith("stream_"))


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_or_nested_loop_join(spark, name):
    plan = physical(QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_flagship_prunes_and_pushes_down(spark):
    # the scores that the flagship writes once before its league aggregates
    plan = physical(QUERIES["ema_final"](spark, SF_SMALL))
    import re
    # the scans read only what eligibility, leagues and rewards need
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    customer = [x for x in scans if "c_custkey" in x]
    assert customer and not any("c_name" in x for x in customer)
    assert "PushedFilters: [IsNotNull(user_id)]" in plan
    # the population filter is pushed to the events side before the shuffle
    assert "pmod(user_id" in plan


def test_price_dimension_is_broadcast(spark):
    plan = physical(QUERIES["token_cost"](spark, SF_SMALL))
    import re
    assert "BroadcastHashJoin" in plan
    # only the two columns the cost needs are read from lineitem
    assert re.search(r"FileScan parquet \[l_partkey#\d+L,l_quantity#\d+\]", plan)
