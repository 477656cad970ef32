"""Deadline join, TTL hold, epoch trigger, rubric and test buckets on hand cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from meritflow.operators import grading, timing

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def ts(sec):
    return T0 + dt.timedelta(seconds=sec)


def test_deadline_boundaries(spark):
    req = spark.createDataFrame([(1, 7, ts(100)), (2, 7, ts(5000)), (3, 8, ts(10)), (4, 9, ts(1790))],
                                "req_id long, k long, ts timestamp_ntz")
    resp = spark.createDataFrame([(10, 7, ts(100)), (11, 7, ts(150)), (12, 7, ts(5000 + 1800)),
                                  (13, 8, ts(1809.999999)), (14, 9, ts(1801)), (15, 9, ts(3000))],
                                 "resp_id long, k long, ts timestamp_ntz")
    got = {r.req_id: (r.resp_id, r.status_code) for r in timing.deadline_join(req, resp, "k", 1800.0).collect()}
    # same-instant response counts; exactly at the deadline is late; next-bucket responses are found
    assert got == {1: (10, 200), 2: (None, 408), 3: (13, 200), 4: (14, 200)}


def test_epoch_triggers(spark):
    rows = [(1, i, ts(s)) for i, s in enumerate([0, 600, 1212, 1300, 2500, 2513])]
    df = spark.createDataFrame(rows, "u long, id long, ts timestamp_ntz")
    got = [r.due for r in timing.epoch_triggers(df, "u", "ts", "id", 100, 12).orderBy("id").collect()]
    # blocks 0, 50, 101, 108, 208, 209: fire at 101 (>100 after 0), then at 208 (>100 after 101)
    assert got == [False, False, True, False, True, False]


@pytest.mark.parametrize("width", [8192, 500, 40])
def test_epoch_triggers_skewed_and_null_keys(spark, width):
    import random
    random.seed(5)
    rows, s = [], 0.0
    for i in range(1500):
        s += random.expovariate(1 / 80.0) * (300 if i % 200 == 0 else 1)
        rows.append((1 if i % 7 else (2 if i % 2 else None), i, ts(s)))
    df = spark.createDataFrame(rows, "u long, id long, ts timestamp_ntz").repartition(5)
    got = {r.id: r.due for r in timing.epoch_triggers(df, "u", "ts", "id", slice_blocks=width).collect()}
    marks, want = {}, {}
    for u, i, t in rows:
        block = int((t - ts(0)).total_seconds() // 12)
        want[i] = u in marks and block - marks[u] > 100
        if u not in marks or want[i]:
            marks[u] = block
    assert got == want and sum(got.values()) > 50


def test_ttl_hold(spark):
    df = spark.createDataFrame([("a", ts(0), 1.0), ("a", ts(5), 2.0), ("a", ts(13), 3.0), ("b", ts(1), 9.0)],
                               "k string, ts timestamp_ntz, v double")
    got = sorted((r.k, r.bucket, r.held_value) for r in timing.ttl_hold(df, "k", "ts", "v", 12).collect())
    assert [g[2] for g in got] == [1.0, 1.0, 3.0, 9.0]


def test_rubric(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0, 0.0, [], "x"), (0.5, 0.5, 0.5, 0.5, [1.0, 0.0], "x"),
                                (1.0, 1.0, 1.0, 0.0, [1.0], ""), (1.0, 1.0, 1.0, 0.0, [1.0], None),
                                (1.0, 1.0, 1.0, 0.0, [1.0], "+# only a comment")],
                               "a double, l double, b double, g double, c array<double>, p string")
    got = [r[0] for r in df.select(grading.rubric_score("a", "l", "b", "g", "c", "p")).collect()]
    assert abs(got[0] - 1.0) < 1e-12
    assert abs(got[1] - (0.3 * .5 + 0.25 * .5 + 0.05 * .5 + 0.2 * .5 + 0.2 * .5)) < 1e-12
    assert got[2] == 0.25 and got[3] == 0.25 and got[4] == 0.25


def test_test_buckets(spark):
    rows = [(1, "before", "t1", "passed", 1), (1, "after", "t1", "passed", 2),
            (1, "before", "t2", "passed", 1), (1, "after", "t2", "failed", 2),
            (1, "before", "t3", "failed", 1), (1, "after", "t3", "passed", 2),
            (1, "before", "t4", "skipped", 1), (1, "after", "t4", "failed", 2),    # skipped = not seen
            (1, "before", "t5", "passed", 1),                                       # vanished: dropped
            (1, "after", "t6", "passed", 2), (1, "after", "t6", "failed", 3)]       # last wins
    df = spark.createDataFrame(rows, "sub int, run string, test_id string, status string, ts int")
    o = grading.test_outcomes(df, ["sub"], ["ts"])
    got = {r.test_id: r.bucket for r in grading.classify_tests(o, ["sub"]).collect()}
    assert got == {"t1": "PASS_TO_PASS", "t2": "PASS_TO_FAIL", "t3": "FAIL_TO_PASS", "t4": "NEW_FAIL",
                   "t6": "NEW_FAIL"}


def test_judgement_valid(spark):
    df = spark.createDataFrame([(True, False, False), (True, True, False), (False, False, False)], "a boolean, b boolean, d boolean")
    assert [r[0] for r in df.select(grading.judgement_valid("a", "b", "d")).collect()] == [True, False, False]


def test_pick_zip_tolerance_template(spark):
    from meritflow.functions.nested import fill_template
    from meritflow.operators import population as pop
    steps = spark.range(50).withColumnRenamed("id", "step")
    opts = spark.createDataFrame([(0, "r0"), (1, "r1"), (2, "r2")], "opt int, repo string")
    p1 = {r.step: r.repo for r in pop.pick_per_step(steps, opts, "step", "opt", 3, seed="s").collect()}
    p2 = {r.step: r.repo for r in pop.pick_per_step(steps, opts, "step", "opt", 3, seed="s").collect()}
    assert p1 == p2 and set(p1.values()) == {"r0", "r1", "r2"}
    z = spark.createDataFrame([(1, [10, 11], ["x", "y"])], "k int, uids array<int>, patches array<string>")
    assert [(r.pos, r.uids, r.patches) for r in pop.zip_parallel(z, "uids", "patches").collect()] == [(0, 10, "x"), (1, 11, "y")]
    t = spark.createDataFrame([(1.0, 1.0000001)], "a double, b double")
    assert t.select(pop.within_tolerance("a", "b", 1e-6)).first()[0]
    f = spark.createDataFrame([("fix it", None)], "s string, c string")
    assert f.select(fill_template("Problem: {statement}\nChecks: {checks}.", statement="s", checks="c")).first()[0] == \
        "Problem: fix it\nChecks: ."
    import pytest
    with pytest.raises(ValueError):
        pop.require_nonempty(steps.limit(0), "no valid file pairs")


def test_priority_rank_exact_with_hot_groups(spark):
    import random
    from pyspark.sql import Window
    from meritflow.operators import population as pop
    random.seed(2)
    rows = []
    for i in range(3000):
        rnd = 0 if i % 3 else random.randrange(1, 4)               # round 0 is hot
        stake = None if i % 5 == 0 else random.choice([0.0, 5.0, 7.5, 100.0])
        rows.append((i * 7, rnd, stake))
    df = spark.createDataFrame(rows, "event_id long, round long, caller_stake double")
    got = {r.event_id: r.serve_rank for r in pop.priority(df, block=64).collect()}
    w = Window.partitionBy("round").orderBy(F.col("p").desc(), "event_id")
    exp = {r.event_id: r.rk for r in df.withColumn("p", F.coalesce("caller_stake", F.lit(0.0)))
           .withColumn("rk", F.row_number().over(w)).collect()}
    assert got == exp


def test_grader_registry(spark):
    subs = spark.createDataFrame([(1, "x"), (2, "")], "sid int, patch string")
    rub = spark.createDataFrame([(1, 1.0, 1.0, 1.0, 0.0, []), (2, 1.0, 1.0, 1.0, 0.0, [1.0])],
                                "sid int, addresses double, logical double, brevity double, bugs double, checklist array<double>")
    assert "float" in grading.GRADERS

    @grading.register_grader("constant")
    def constant(submissions, _rubric, key):
        return submissions.select(*key, F.lit(0.5).alias("score"))

    got = {r.sid: r.score for r in grading.GRADERS["float"](subs, rub, ["sid"]).collect()}
    assert abs(got[1] - 1.0) < 1e-12 and got[2] == 0.25
    assert {r.score for r in grading.GRADERS["constant"](subs, rub, ["sid"]).collect()} == {0.5}


def test_gate_rules_order_and_hook(spark):
    from meritflow.config import PopulationConfig
    from meritflow.operators import population as pop
    reg = spark.createDataFrame([(1, "hk1", True, 10.0), (2, "hk2", False, 5.0), (3, "hk2", True, 1.0)],
                                "uid long, hotkey string, validator_permit boolean, stake double")
    req = spark.createDataFrame([(10, None), (11, "nobody"), (12, "hk1"), (13, "hk2")], "event_id long, caller_hotkey string")
    got = {r.event_id: (r.blocked, r.reason, r.caller_uid) for r in pop.gate_requests(req, reg).collect()}
    assert got[10] == (True, "Missing dendrite or hotkey", None)
    assert got[11] == (True, "Unrecognized hotkey", None)
    assert got[12] == (False, "Hotkey recognized!", 1)
    assert got[13] == (False, "Hotkey recognized!", 2)          # duplicate hotkey -> smallest uid
    strict = {r.event_id: r.reason for r in
              pop.gate_requests(req, reg, PopulationConfig(force_validator_permit=True)).collect()}
    assert strict[13] == "Non-validator hotkey" and strict[12] == "Hotkey recognized!"
    hooked = {r.event_id: r.reason for r in pop.gate_requests(
        req, reg, extra_rules=[(F.col("caller_stake") < 8.0, "Stake too low")]).collect()}
    assert hooked[13] == "Stake too low" and hooked[12] == "Hotkey recognized!"


def test_status_split_failed_call(spark):
    from meritflow.operators import population as pop
    df = spark.createDataFrame([(1, 200, False), (1, 408, False), (2, 200, True), (2, 200, True)],
                               "r int, code int, raised boolean")
    got = {r.r: (r.n_ok, r.n_failed) for r in pop.status_split(df, "r", F.col("code") == 200, F.col("raised")).collect()}
    assert got == {1: (1, 1), 2: (0, 2)}


def test_row_grader_is_polymorphic_and_folds_whole_submissions(spark):
    rubric = "s string, addresses double, logical double, brevity double, bugs double, checklist array<double>"
    rows = [("a", 1.0, 1.0, 1.0, 0.0, [1.0, 0.0]), ("b", 0.5, 0.0, 0.0, 1.0, []), ("c", 1.0, 1.0, 1.0, 0.0, None), ("d", 1.0, 1.0, 1.0, 0.0, [1.0])]
    subs = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("d", "")], "s string, patch string")
    table = spark.createDataFrame(rows, rubric)
    got = grading.GRADERS["rows"](subs, table, ["s"])
    want = grading.GRADERS["float"](subs, table, ["s"])
    assert dict(got.dtypes) == {"s": "string", "score": "double"}
    assert {r.s: pytest.approx(r.score) for r in want.collect()} == {r.s: r.score for r in got.collect()}
    assert grading.GRADERS["rows"](subs.limit(0), table, ["s"]).count() == 0


def test_payload_pages_hold_every_row_once(spark):
    import json
    from pyspark.sql import functions as F
    from meritflow.functions import nested
    rows = [(g, f"k{i % 50}", "x" * (i % 30)) for g in (1, None) for i in range(120)] + [(2, None, None)]
    df = spark.createDataFrame(rows, "g int, k string, v string").select("g", F.struct("k", "v").alias("row"))
    pages = nested.payload_pages(df, "g", "row", F.col("row.k"), 500).collect()
    got = sorted(str((p.g, r.get("k"), r.get("v"))) for p in pages for r in json.loads(p.payload))
    assert got == sorted(map(str, rows))
    assert sum(p.g == 1 for p in pages) > 5 and [p.payload for p in pages if p.g == 2] == ["[{}]"]


def test_pick_per_step_by_either_join(spark):
    from meritflow.operators import population as pop
    steps = spark.range(50).toDF("step")
    options = spark.createDataFrame([(i, f"o{i}") for i in range(7)], "idx long, name string")
    small, big = (sorted(map(tuple, pop.pick_per_step(steps, options, "step", "idx", seed="s", broadcast_rows=n).select("step", "name").collect()))
                  for n in (100, 1))
    assert small == big and len({n for _, n in small}) == 7
    with pytest.raises(ValueError, match="no options"):
        pop.pick_per_step(steps, options.limit(0), "step", "idx")
