"""EMA closed form vs the sequential fold; resets; decay; last-write-wins."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meritflow.functions.math import exp_decay
from meritflow.operators import scoring


def fold(rs, alpha=0.1, s=0.0):
    for r in rs:
        s = alpha * (0.0 if math.isnan(r) else r) + (1 - alpha) * s
    return s


def test_ema_blocks_equal_fold(spark):
    rng = np.random.default_rng(5)
    rows = []
    for uid in range(4):
        n = int(rng.integers(1, 60))
        for step in sorted(rng.choice(500, n, replace=False)):
            rows.append((uid, int(step), float(rng.random() * 10)))
    rows.append((9, 3, float("nan")))
    df = spark.createDataFrame(rows, "uid int, step int, r double")
    out = {r.uid: (r.score, r.n_updates) for r in
           scoring.ema_final(df, "uid", ["step"], "r", block=(F.col("step") / 37).cast("int")).collect()}
    for uid in set(u for u, _, _ in rows):
        rs = [r for u, s, r in sorted(rows) if u == uid]
        assert abs(out[uid][0] - fold(rs)) < 1e-12
        assert out[uid][1] == len(rs)


def test_ema_with_reset(spark):
    # hotkey a, a, b (reset), b, a (reset): score restarts from 0 at each change
    rows = [(1, 1, "a", 1.0), (1, 2, "a", 2.0), (1, 3, "b", 3.0), (1, 4, "b", 4.0), (1, 5, "a", 5.0),
            (2, 1, "x", 1.0), (2, 2, "x", 1.0)]
    df = spark.createDataFrame(rows, "uid int, step int, hotkey string, r double")
    out = {r.uid: r for r in scoring.ema_with_reset(df, "uid", ["step"], "hotkey", "r").collect()}
    assert out[1].hotkey == "a" and out[1].n_resets == 2 and abs(out[1].score - fold([5.0])) < 1e-12
    assert out[2].n_resets == 0 and abs(out[2].score - fold([1.0, 1.0])) < 1e-12


def test_decay_points(spark):
    df = spark.createDataFrame([(0.0,), (900.0,), (1800.0,), (2500.0,)], "x double")
    got = [r[0] for r in df.select(exp_decay(1800.0, F.col("x"))).collect()]
    assert got[0] == 1.0 and abs(got[1] - math.exp(-1.0)) < 1e-15 and got[2] == 0.0 and got[3] == 0.0


def test_latest_per_key(spark):
    df = spark.createDataFrame([(1, 1, 10, "a"), (1, 1, 20, "b"), (1, 2, 5, "c")], "k int, r int, ts int, v string")
    got = {(r.k, r.r): r.v for r in scoring.latest_per_key(df, ["k", "r"], ["ts"]).collect()}
    assert got == {(1, 1): "b", (1, 2): "c"}


def test_resume_equals_a_single_run(spark):
    rows = [(u, i, float((7 * u + 3 * i) % 11)) for u in (1, 2) for i in range(20)] + [(3, 15, 4.0)]
    df = spark.createDataFrame(rows, "u long, i long, r double")
    whole = {r.u: r.score for r in scoring.ema_final(df, "u", "i", "r", block="i").collect()}
    half = scoring.ema_final(df.filter("i < 9"), "u", "i", "r", block="i").unionByName(
        spark.createDataFrame([(4, 0.5, 3)], "u long, score double, n_updates long"))
    both = {r.u: (r.score, r.n_updates) for r in scoring.ema_final(
        df.filter("i >= 9"), "u", "i", "r", block="i", initial="score", start=half).collect()}
    for u in (1, 2, 3):
        assert abs(both[u][0] - whole[u]) < 1e-12
    assert both[4] == (0.5, 0)                      # no new rows: the score stays


def test_only_labelled_tasks_move_scores(spark):
    df = spark.createDataFrame([(1, "labelled_issue"), (2, "open_issue"), (3, None)], "u long, task_type string")
    assert [r.u for r in scoring.labelled_only(df).collect()] == [1]


def test_hotkey_changes_from_and_to_null(spark):
    df = spark.createDataFrame([(1, 2, "a", 1.0), (1, 3, None, 2.0), (1, 4, "b", 3.0), (1, 5, "b", 4.0), (2, 1, None, 5.0)],
                               "u long, t long, h string, r double")
    got = {r.u: (r.h, r.n_resets) for r in scoring.ema_with_reset(df, "u", ["t"], "h", "r").collect()}
    assert got == {1: ("b", 2), 2: (None, 0)}


def sequential(rows):
    """(hotkey, resets, score) per uid, one row after the other."""
    out = {}
    for uid, _, hotkey, r in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        held, resets, s = out.get(uid, (hotkey, 0, 0.0))
        if held != hotkey:
            resets, s = resets + 1, 0.0
        out[uid] = (hotkey, resets, 0.1 * (0.0 if r is None or math.isnan(r) else r) + 0.9 * s)
    return out


@pytest.mark.parametrize("size", [1, 7, 200_000])
def test_runs_merge_to_the_sequential_fold(spark, monkeypatch, size):
    """A busy uid over many tasks, null uids and hotkeys, NaN and null rewards, folds of any length."""
    rng = np.random.default_rng(size)
    rows = [(None if u == 3 else 10**17 + u, int(t), [None, "a", "b"][int(rng.integers(0, 3))] if rng.random() < 0.2 else "a",
             [None, float("nan"), float(rng.random())][min(2, int(rng.integers(0, 9)))])
            for u in range(4) for t in rng.permutation(400 if u == 1 else 25)]
    monkeypatch.setattr(scoring, "_runs", lambda *a, run=scoring._runs: run(*a, size))
    df = spark.createDataFrame(rows, "u long, t long, h string, r double").repartition(6)
    want = sequential(rows)
    got = {r.u: (r.h, r.n_resets, r.score) for r in scoring.ema_with_reset(df, "u", ["t"], "h", "r").collect()}
    assert {u: x[:2] for u, x in got.items()} == {u: x[:2] for u, x in want.items()}
    assert all(abs(got[u][2] - want[u][2]) < 1e-12 for u in want)


def test_resets_carry_on_from_a_state(spark):
    rows = [(1, 5, "a", 1.0), (2, 5, "b", 1.0), (3, 5, None, 1.0)]
    state = [(1, "a", 0.5), (2, "a", 0.5), (3, None, 0.5), (4, "z", 0.5), (5, "z", float("nan"))]
    got = {r.u: (r.h, r.n_resets, round(r.score, 12)) for r in scoring.ema_with_reset(
        spark.createDataFrame(rows, "u long, t long, h string, r double"), "u", ["t"], "h", "r",
        start=spark.createDataFrame(state, "u long, h string, score double")).collect()}
    assert got == {1: ("a", 0, 0.55), 2: ("b", 1, 0.1), 3: (None, 0, 0.55), 4: ("z", 0, 0.5), 5: ("z", 0, 0.0)}


def test_reset_fold_has_no_window_and_no_checkpoint(spark):
    df = spark.createDataFrame([(1, 1, "a", 1.0)], "u long, t long, h string, r double")
    plan = scoring.ema_with_reset(df, "u", ["t"], "h", "r")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("MapInArrow") == 1
