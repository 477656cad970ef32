"""Invariants of SURVEY section 5 on real query output (sf0.01)."""

from pyspark.sql import functions as F

from meritflow.plans.queries import QUERIES

from conftest import SF_CHECK


def test_processed_weights_sum_to_one_and_respect_cap(spark):
    w = QUERIES["process_weights"](spark, SF_CHECK)
    g = w.groupBy("netuid").agg(F.sum("weight").alias("s"), F.max("weight").alias("m"), F.count("*").alias("n")).collect()
    assert g
    for r in g:
        assert abs(r.s - 1.0) < 1e-6
        if r.n * 0.1 > 1:
            assert r.m <= 0.1 + 1e-6


def test_u16_range_and_max(spark):
    u = QUERIES["emit_u16"](spark, SF_CHECK)
    for r in u.groupBy("netuid").agg(F.min("weight_u16").alias("lo"), F.max("weight_u16").alias("hi")).collect():
        assert 1 <= r.lo and r.hi == 65535


def test_flagship_weights(spark):
    f = QUERIES["reward_to_weights"](spark, SF_CHECK)
    for r in f.groupBy("netuid").agg(F.sum("weight").alias("s"), F.max("weight_u16").alias("hi")).collect():
        assert abs(r.s - 1.0) < 1e-6 and r.hi == 65535


def test_elo_zero_sum_per_problem(spark):
    e = QUERIES["elo_rank"](spark, SF_CHECK)
    for r in e.groupBy("round").agg(F.sum("rating").alias("s"), F.count("*").alias("n"),
                                    F.max("rank").alias("mr")).collect():
        assert abs(r.s - 1200.0 * r.n) < 1e-3 and r.mr == r.n


def test_test_buckets_add_up(spark):
    b = QUERIES["test_buckets"](spark, SF_CHECK)
    total = b.agg(F.sum("n_tests")).first()[0]
    from meritflow.operators import grading
    from meritflow.sources import views
    o = grading.test_outcomes(views.test_results(spark, SF_CHECK), ["submission_id"], ["ts", "event_id"])
    assert total == o.filter(F.col("run") == "after").count()


def test_trueskill_scores_in_unit_interval(spark):
    t = QUERIES["trueskill_rank"](spark, SF_CHECK)
    r = t.agg(F.min("ts_score").alias("lo"), F.max("ts_score").alias("hi"), F.min("sigma").alias("s")).first()
    assert 0.0 < r.lo and r.hi < 1.0 and r.s > 0
