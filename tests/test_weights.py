"""Weights: cap, process and u16 emission on hand-worked cases and by their invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meritflow.config import WeightConfig
from meritflow.operators import weights


def run_cap(spark, xs, limit=0.1):
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(xs)], "g int, uid int, x double")
    out = weights.cap_weights(df, "g", "x", "w", limit=limit).orderBy("uid").toPandas()
    return out["w"].to_numpy()


# values -> weights, worked out by hand: with c the cut value, c / (capped * c + rest) = limit
CAPPED = [
    ([1.0] * 5, [0.2] * 5),                                              # 5 * 0.1 <= 1: uniform
    ([0.0] * 20, [0.05] * 20),                                           # nothing to share: uniform
    (list(range(1, 21)), [x / 210 for x in range(1, 21)]),               # 20 / 210 is below the limit
    ([100.0] + [1.0] * 19, [0.1] + [0.9 / 19] * 19),
    ([50.0, 40.0, 30.0] + [1.0] * 30, [0.1] * 3 + [0.7 / 30] * 30),
]


@pytest.mark.parametrize("xs,want", CAPPED)
def test_cap_by_hand(spark, xs, want):
    assert np.allclose(run_cap(spark, xs), want, atol=1e-6)


@pytest.mark.parametrize("seed", [3, 4])
def test_cap_invariants(spark, seed):
    xs = np.random.default_rng(seed).exponential(size=40) ** 3
    got = run_cap(spark, xs)
    assert abs(got.sum() - 1) < 1e-9 and got.max() <= 0.1 + 1e-6
    assert (np.diff(got[np.argsort(xs)]) >= -1e-12).all()                # order is kept
    free = got < got.max() - 1e-9
    assert np.allclose(got[free] / xs[free], (got[free] / xs[free])[0])  # what is not cut keeps its proportions
    assert np.allclose(run_cap(spark, got), got, atol=1e-5)              # a fixed point


def process(spark, w, **cfg):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(w)], "g int, uid int, raw double")
    out = weights.process_weights(df, "g", "uid", "raw", "w", WeightConfig(min_allowed_weights=10, **cfg))
    return {r.uid: r.w for r in out.collect()}


def test_process_too_few_uids_is_uniform(spark):
    assert process(spark, [0.3, 0.0, 5.0, 1.0, 0.0, 2.0]) == pytest.approx({i: 1 / 6 for i in range(6)})
    assert process(spark, [0.0] * 12) == pytest.approx({i: 1 / 12 for i in range(12)})


def test_process_too_few_positive_tops_up_everyone(spark):
    got = process(spark, [1.0] * 6 + [0.0] * 24)          # 1.00001 six times, 0.00001 for the rest
    big, low = {round(got[i], 9) for i in range(6)}, {round(got[i], 9) for i in range(6, 30)}
    assert len(got) == 30 and len(big) == len(low) == 1 and sum(got.values()) == pytest.approx(1)
    assert got[0] == pytest.approx(0.1, rel=0.03) and got[29] == pytest.approx(0.4 / 24, rel=0.03)


def test_process_drops_below_the_quantile(spark):
    # 20 positive values 1..20: fraction 20000 / 65535, position 19 * 0.30518 = 5.798, quantile 6.798;
    # 7..20 stay; 19 and 20 are cut at 18.75, the other twelve share 0.8 by their values, 150 in all
    got = process(spark, list(range(1, 21)) + [0.0] * 5, exclude_quantile=20000)
    want = {i: (i + 1) * 0.8 / 150 for i in range(6, 18)} | {18: 0.1, 19: 0.1}
    assert got == pytest.approx(want, abs=1e-6)


def test_process_quantile_never_goes_below_the_minimum(spark):
    # 12 positive values, 10 must stay: the fraction is 2 / 12, position 11 / 6 = 1.833, quantile 2.833
    got = process(spark, list(range(1, 13)), exclude_quantile=65535)
    assert sorted(got) == list(range(2, 12))


def test_u16_half_even_and_zero_drop(spark):
    # 65535 * w / max: 0.5 -> 0, 1.5 -> 2, 2.5 -> 2; tiny weight rounds to 0 and is dropped
    rows = [(0, 0, 1.0), (0, 1, 0.5 / 65535), (0, 2, 1.5 / 65535), (0, 3, 2.5 / 65535), (1, 0, 0.0)]
    df = spark.createDataFrame(rows, "g int, uid int, w double")
    out = {(r.g, r.uid): r.weight_u16 for r in weights.emit_u16(df, "g", "uid", "w").collect()}
    assert out == {(0, 0): 65535, (0, 2): 2, (0, 3): 2}


def test_u16_negative_raises(spark):
    df = spark.createDataFrame([(0, 0, -1.0), (0, 1, 1.0)], "g int, uid int, w double")
    with pytest.raises(Exception):
        weights.emit_u16(df, "g", "uid", "w").collect()


def test_l1_normalise(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 1, -3.0), (1, 0, 0.0)], "g int, uid int, v double")
    got = {(r.g, r.uid): r.w for r in weights.l1_normalise(df, "g", "v", "w").collect()}
    assert got == {(0, 0): 0.25, (0, 1): -0.75, (1, 0): 0.0}
