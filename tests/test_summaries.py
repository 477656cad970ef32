"""Merged group summaries against numpy, and plans without league windows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meritflow.operators import summaries, weights
from meritflow.plans.queries import QUERIES

from conftest import SF_SMALL

LEAGUE_QUERIES = ["l1_normalise", "cap_weights", "process_weights", "process_weights_quantile", "emit_u16", "reward_to_weights"]


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(7)
    return {None: rng.normal(size=300).tolist(), 1: (10.0 ** rng.uniform(-300, 300, 400)).tolist(), 2: [5.0] * 70 + [1.0, 9.0],
            3: [3.5], 4: rng.integers(0, 4, 500).astype(float).tolist(), 5: [-math.inf, *rng.exponential(size=90), math.inf],
            6: [5e-324, 1e-323, 0.0, -0.0, 1.5e-323] * 10, 7: [1.7976931348623157e308, -1.7976931348623157e308, 1.0, 2.0] * 9}


def table(spark, groups):
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [(8, float("nan")), (8, None), (1, None), (2, float("nan"))]
    return spark.createDataFrame(rows, "g int, v double").repartition(5)


@pytest.mark.parametrize("bins,few", [(2, 1), (7, 3), (1_024, 4_096)])
def test_quantiles_match_numpy(spark, groups, bins, few):
    """The fraction differs from group to group, and refinement runs for many rounds."""
    share = lambda m: F.try_divide(F.pmod(m * 7, F.lit(11)), F.lit(10))
    got = {r.g: r.q for r in summaries.quantiles(table(spark, groups), "g", "v", share, "q", bins, few).collect()}
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        if len(vs) * 7 % 11 <= 10 and g != 5:
            want = np.quantile(np.array(vs), len(vs) * 7 % 11 / 10)
            assert got[g] == pytest.approx(want, rel=1e-12, abs=0), g


def test_quantile_between_infinities(spark, groups):
    got = summaries.quantiles(table(spark, {5: groups[5]}), "g", "v", lambda m: F.lit(0.5), "q", 4, 2)
    assert {r.g: r.q for r in got.collect()}[5] == pytest.approx(np.median(groups[5]))


@pytest.mark.parametrize("flush", [1, 100_000])
def test_largest_values(spark, groups, flush):
    finite = {g: vs for g, vs in groups.items() if g != 5}
    df = table(spark, finite).where("v IS NOT NULL AND NOT isnan(v)")
    kind = "g int, n bigint, total double, top array<double>"
    parts = df.mapInPandas(summaries._fold("g", "v", 6, flush), kind)
    assert max(map(len, (r.top for r in parts.collect()))) <= 6
    got = {r.g: r for r in summaries.largest_values(df, "g", "v", 6).collect()}
    assert got.keys() == finite.keys()
    for g, vs in finite.items():
        assert got[g].n == len(vs) and got[g].top == sorted(vs, reverse=True)[:6]
        if g not in (1, 7):
            assert got[g].total == pytest.approx(sum(vs))


def test_totals_of_a_null_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), (1, 5.0)], "g int, v double")
    assert sorted((r.g or 0, r.v, r.s) for r in summaries.with_totals(df, "g", s=F.sum("v")).collect()) == [(0, 1.0, 4.0), (0, 3.0, 4.0), (1, 5.0, 5.0)]


@pytest.mark.parametrize("name", LEAGUE_QUERIES)
def test_no_league_window(spark, name):
    plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "netuid" in plan and "Window [" not in plan


def test_nan_weights_count_as_none(spark):
    rows = [(1, i, float("nan") if i < 3 else float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "g int, uid int, raw double")
    got = {r.uid: r.w for r in weights.process_weights(df, "g", "uid", "raw", "w").collect()}
    assert sorted(got) == list(range(3, 30)) and sum(got.values()) == pytest.approx(1)


def test_emission_guards(spark):
    bad = lambda rows: weights.emit_u16(spark.createDataFrame(rows, "g int, uid int, w double"), "g", "uid", "w").collect()
    for rows in ([(0, 0, float("nan"))], [(0, 0, None)], [(0, None, 1.0)], [(0, -1, 1.0)], [(0, 1, -0.5), (0, 2, 1.0)]):
        with pytest.raises(Exception):
            bad(rows)
    assert bad([]) == [] and bad([(0, 1, 0.0)]) == []
    lists = lambda rows: weights.emit_lists(spark.createDataFrame(rows, "g int, u array<int>, w array<double>"), "g", "u", "w").collect()
    assert [tuple(r) for r in lists([(1, [3, 4], [0.5, 0.25]), (2, [], [])])] == [(1, 3, 0.5), (1, 4, 0.25)]
    for rows in ([(1, [3], [0.5, 0.25])], [(1, [3], None)], [(1, None, None)]):
        with pytest.raises(Exception, match="same length"):
            lists(rows)


def test_largest_weight_column(spark):
    rng = np.random.default_rng(1)
    rows = [(g, i, float(x)) for g in range(6) for i, x in enumerate(rng.exponential(size=8 + 7 * g) ** g)]
    df = spark.createDataFrame(rows, "g int, uid int, x double")
    got = weights.cap_weights(df, "g", "x", "w", largest="most").groupBy("g").agg(F.max("w").alias("a"), F.max("most").alias("b"))
    for r in got.collect():
        assert r.a == pytest.approx(r.b, rel=1e-12)
