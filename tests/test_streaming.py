"""Streams over several micro-batches equal their batch twins."""

import os
import tempfile

import pytest

from meritflow.plans import queries as Q
from meritflow.plans import stream_queries as S
from meritflow.plans.check import rows_of

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def split_tables(spark):
    """events and conversations re-written as several time-ordered parts (test input only)."""
    import time
    from pyspark.sql import functions as F
    base = tempfile.mkdtemp(prefix="meritflow-stream-")
    ev = spark.read.parquet(os.path.join(SF_SMALL, "events.parquet"))
    # one file per time slice, written in order: the file source takes files oldest first
    for lo, hi in [(0, 8), (8, 16), (16, 24), (24, 32)]:
        part = ev.filter((F.dayofmonth("ts") > lo) & (F.dayofmonth("ts") <= hi))
        part.coalesce(1).write.mode("append").parquet(os.path.join(base, "events"))
        time.sleep(1.1)
    cv = spark.read.parquet(os.path.join(SF_SMALL, "conversations.parquet"))
    for lo, hi in [(0, 1), (1, 3), (3, 100)]:
        cv.filter((F.col("turn") >= lo) & (F.col("turn") < hi)).coalesce(1).write.mode("append").parquet(
            os.path.join(base, "conversations"))
        time.sleep(1.1)
    return base


def same(a, b):
    return rows_of(a.toPandas()) == rows_of(b.toPandas())


def test_epoch_due_stream(spark, split_tables):
    s = S.stream_epoch_due(spark, SF_SMALL, folder=os.path.join(split_tables, "events"))
    assert same(s, Q.epoch_due(spark, SF_SMALL))


def test_ema_stream(spark, split_tables):
    s = S.stream_ema(spark, SF_SMALL, folder=os.path.join(split_tables, "events"))
    assert same(s, Q.ema_final(spark, SF_SMALL))


def test_chunks_stream(spark, split_tables):
    s = S.stream_chunks(spark, SF_SMALL, folder=os.path.join(split_tables, "conversations"))
    assert same(s, Q.stream_join_chunks(spark, SF_SMALL))


def test_gate_stream(spark, split_tables):
    s = S.stream_gate_requests(spark, SF_SMALL, folder=os.path.join(split_tables, "events"))
    assert same(s, Q.gate_requests(spark, SF_SMALL))


def test_population_resync_multi_batch(spark):
    import time
    from pyspark.sql import functions as F
    base = tempfile.mkdtemp(prefix="meritflow-orders-")
    o = spark.read.parquet(os.path.join(SF_SMALL, "orders.parquet"))
    for y in (1995, 1997, 1999, 2001):
        o.filter((F.year("o_orderdate") >= y) & (F.year("o_orderdate") < y + 2)).coalesce(1).write.mode("append").parquet(base)
        time.sleep(1.1)
    s = S.stream_population_resync(spark, SF_SMALL, folder=base)
    b = Q.ema_reset(spark, SF_SMALL).select("uid", "hotkey", "n_resets")
    assert same(s, b)


def test_deadline_stream_and_recent_duplicates(spark):
    import datetime as dt
    from pyspark.sql import functions as F
    from meritflow.operators import timing
    from meritflow.streaming import stateful as st
    from meritflow.streaming.runner import run_to_table
    base = tempfile.mkdtemp(prefix="meritflow-dl-")
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, "view", 7, t0), (2, "purchase", 7, t0 + dt.timedelta(minutes=10)),
            (3, "view", 8, t0 + dt.timedelta(minutes=1)), (4, "purchase", 8, t0 + dt.timedelta(minutes=31)),
            (5, "view", 7, t0 + dt.timedelta(minutes=2)),
            (6, "view", 9, t0 + dt.timedelta(hours=5))]          # closes the watermark for the others
    df = spark.createDataFrame(rows, "event_id long, event_type string, user_id long, ts timestamp_ntz")
    import time
    # three files -> three micro-batches: data, the closing event, one more to apply the watermark
    df.filter("event_id < 6").coalesce(1).write.mode("append").parquet(base + "/ev")
    time.sleep(1.1)
    df.filter("event_id = 6").coalesce(1).write.mode("append").parquet(base + "/ev")
    time.sleep(1.1)
    # the global watermark is the minimum over both inputs: close the response side too
    df.filter("event_id = 6").withColumn("event_id", F.lit(7).cast("long")).withColumn(
        "event_type", F.lit("purchase")).withColumn("ts", F.lit(t0 + dt.timedelta(hours=6))).coalesce(1).write.mode(
        "append").parquet(base + "/ev")
    time.sleep(1.1)
    df.filter("event_id = 6").withColumn("event_id", F.lit(8).cast("long")).withColumn(
        "ts", F.lit(t0 + dt.timedelta(hours=7))).coalesce(1).write.mode("append").parquet(base + "/ev")
    sdf = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(base + "/ev")
    req = sdf.filter("event_type = 'view'").select(F.col("event_id").alias("req_id"), "user_id", "ts")
    resp = sdf.filter("event_type = 'purchase'").select(F.col("event_id").alias("resp_id"), "user_id", "ts")
    out = run_to_table(spark, st.deadline_join_stream(req, resp, "user_id", "30 minutes", "10 minutes"), "dl_test")
    pairs = {(r.req_id, r.resp_id) for r in out.collect()}
    assert (1, 2) in pairs and (5, 2) in pairs and (3, None) in pairs
    batch = {r.req_id: r.status_code for r in timing.deadline_join(
        df.filter("event_type = 'view'").select(F.col("event_id").alias("req_id"), "user_id", "ts"),
        df.filter("event_type = 'purchase'").select(F.col("event_id").alias("resp_id"), "user_id", "ts"),
        "user_id").collect()}
    assert batch == {1: 200, 3: 408, 5: 200, 6: 408}


def test_recent_duplicates_over_batches_and_late_rows(spark):
    """Waiting rows are decided by the watermark, in time order whatever their order of arrival."""
    import datetime as dt
    import random
    import time
    from meritflow.operators import timing
    from meritflow.streaming import stateful as st
    from meritflow.streaming.runner import run_to_table
    rnd = random.Random(4)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, rnd.choice(["a", "b", None]), "p", t0 + dt.timedelta(seconds=60 * i + rnd.randint(-400, 400), microseconds=i)) for i in range(200)]
    rows += [(200, "late", "p", t0 - dt.timedelta(days=1))]
    schema = "id long, caller string, prompt string, ts timestamp_ntz"
    base = tempfile.mkdtemp(prefix="meritflow-dup-")
    end = [(-1, "z", "z", t0 + dt.timedelta(days=2))]
    for part in (rows[:70], rows[70:140], rows[140:], end):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(base)
        time.sleep(0.05)
    sdf = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(base)
    got = run_to_table(spark, st.recent_duplicates_stream(sdf, ["caller", "prompt"], "ts", "id", 900, "15 minutes"), "dup_test")
    assert got.select("_batch").distinct().count() > 2
    got = {r.id: r.accepted for r in got.where("id >= 0").collect()}
    assert 200 not in got                                   # behind the watermark
    last, want = {}, {}
    for i, caller, _, ts in sorted(rows[:200], key=lambda r: (r[3].replace(microsecond=0), r[0])):
        s = ts.replace(microsecond=0)
        want[i] = caller not in last or (s - last[caller]).total_seconds() >= 900
        last[caller] = s if want[i] else last[caller]
    assert got == want
    batch = timing.recent_duplicates(spark.createDataFrame(rows[:200], schema), ["caller", "prompt"], "ts", "id", 900)
    assert {r.id: r.accepted for r in batch.collect()} == want


def test_time_slices_make_several_batches(spark):
    out = S.time_slices(spark, SF_SMALL, "events", "ts", "event_id", parts=4, disorder=60.0)
    rows = spark.read.parquet(out)
    assert len(rows.inputFiles()) >= 4 and rows_of(rows.toPandas()) == rows_of(spark.read.parquet(os.path.join(SF_SMALL, "events.parquet")).toPandas())


def test_a_population_change_between_batches_changes_the_verdict(spark):
    from pyspark.sql import functions as F
    from meritflow.streaming import live
    base = tempfile.mkdtemp(prefix="meritflow-live-")
    members = "hotkey string, uid long, validator_permit boolean, stake double"
    run = live.gate_batches(f"{base}/pop", f"{base}/out", lambda b: b)
    asks = lambda *rows: spark.createDataFrame(list(rows), "event_id long, round long, caller_hotkey string")
    live.publish_population(spark.createDataFrame([("a", 1, True, 5.0), ("b", 2, True, 9.0)], members), f"{base}/pop", 0)
    run(asks((1, 0, "a"), (2, 0, "b"), (3, 0, "c")), 0)
    live.publish_population(spark.createDataFrame([("a", 1, True, 50.0), ("c", 3, True, 1.0)], members), f"{base}/pop", 1)
    run(asks((4, 0, "b"), (5, 0, "c"), (6, 24, "a")), 1)
    run(asks((4, 0, "b"), (5, 0, "c"), (6, 24, "a")), 1)                       # replayed
    run(asks(), 2)
    got = {r.event_id: (r.blocked, r.serve_rank) for r in live.verdicts(spark, f"{base}/out").collect()}
    assert got == {1: (False, 2), 2: (False, 1), 3: (True, None), 4: (True, None), 5: (False, 3), 6: (False, 1)}
    assert [r[0] for r in live.current_version(spark, f"{base}/pop").select(F.max("stake")).collect()] == [50.0]


def test_trueskill_stream_equals_batch(spark, split_tables):
    s = S.stream_trueskill(spark, SF_SMALL, folder=os.path.join(split_tables, "events"))
    assert same(s, Q.trueskill_rank(spark, SF_SMALL))


def test_ttl_hold_stream_multi_batch(spark, split_tables):
    from pyspark.sql import functions as F
    from meritflow.functions.math import epoch_us, floor_div
    s = S.stream_ttl_hold(spark, SF_SMALL, folder=os.path.join(split_tables, "events"))
    ev = spark.read.parquet(os.path.join(SF_SMALL, "events.parquet"))
    b = (ev.withColumn("bucket", floor_div(epoch_us("ts"), 12_000_000))
           .groupBy("event_type", "bucket")
           .agg(F.min_by("value", F.struct("ts", "event_id")).alias("held_value"), F.count(F.lit(1)).alias("n_calls")))
    assert same(s, b)


@pytest.fixture(scope="module")
def reversed_tables(spark):
    """events, orders and conversations as parts whose latest rows come first."""
    import time
    from pyspark.sql import functions as F
    base = tempfile.mkdtemp(prefix="meritflow-reversed-")
    cuts = {"events": F.dayofmonth("ts"), "orders": F.year("o_orderdate") - 1990, "conversations": F.col("turn") * 7}
    for name, at in cuts.items():
        rows = spark.read.parquet(os.path.join(SF_SMALL, f"{name}.parquet"))
        for lo, hi in [(14, 1000), (7, 14), (-1, 7)]:
            rows.filter((at >= lo) & (at < hi)).coalesce(1).write.mode("append").parquet(f"{base}/{name}.parquet")
            time.sleep(1.1)
    for name in ("customer", "nation", "supplier"):
        spark.read.parquet(os.path.join(SF_SMALL, f"{name}.parquet")).write.parquet(f"{base}/{name}.parquet")
    return f"file://{base}"


@pytest.mark.parametrize("stream,twin,columns", [
    ("stream_epoch_due", "epoch_due", None), ("stream_ema", "ema_final", None), ("stream_chunks", "stream_join_chunks", None),
    ("stream_ttl_hold", None, None), ("stream_trueskill", "trueskill_rank", None), ("stream_token_batches", "stream_token_batches", None), ("stream_gate_requests", "gate_requests", None),
    ("stream_population_resync", "ema_reset", ["uid", "hotkey", "n_resets"])])
def test_streams_on_a_storage_uri_in_reverse_time_order(spark, reversed_tables, stream, twin, columns):
    got = Q.QUERIES[stream](spark, reversed_tables)
    if twin is None:
        assert got.count() > 0
        return
    want = Q.QUERIES[twin](spark, SF_SMALL)
    assert same(got.select(*(columns or want.columns)), want.select(*(columns or want.columns)))


def test_chunks_leave_the_state_when_complete(spark):
    import time
    base = tempfile.mkdtemp(prefix="meritflow-chunks-")
    rows = [[(1, 1, "world", True), (2, 0, "x", False)], [(1, 0, "hello ", False)], [(2, 5, "late end", True)]]
    for part in rows:
        spark.createDataFrame(part, "k long, seq long, t string, fin boolean").coalesce(1).write.mode("append").parquet(base)
        time.sleep(1.1)
    from meritflow.streaming import stateful as st
    from meritflow.streaming.runner import latest_by_batch, run_to_table
    sdf = spark.readStream.schema("k long, seq long, t string, fin boolean").option("maxFilesPerTrigger", 1).parquet(base)
    out = latest_by_batch(run_to_table(spark, st.chunk_accumulator(sdf, "k", "seq", "t", "fin"), "ends", "update"), ["k"])
    got = {r.k: (r.completion, r.complete) for r in out.collect()}
    assert got == {1: ("hello world", True), 2: ("xlate end", False)}


def test_messages_wait_for_all_chunks_and_ignore_repeats(spark):
    import time
    from pyspark.sql import functions as F
    from meritflow.streaming import processors as pr
    schema = "c long, s long, t string, e boolean"
    base = tempfile.mkdtemp(prefix="meritflow-msg-")
    parts = [[(1, 1, "b", None), (2, 0, "x\ny", None), (3, 0, "open", None)], [(1, 2, None, True), (1, 1, "b", None), (4, 0, None, True)],
             [(1, 0, "a", None), (2, 1, None, True)]]
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(base)
        time.sleep(0.05)
    stream = lambda: pr.messages(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(base), "c", "s", "t", "e")
    out = pr.run_processor(spark, stream, "msg_test", idle_batches=False)
    assert {r.c: (r.completion, r.n_chunks, r._batch) for r in out.collect()} == {1: ("ab", 2, 2), 2: ("xy", 1, 2), 4: ("", 0, 1)}
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_rounds_close_by_timer_and_late_responses_are_dropped(spark):
    import datetime as dt
    import time
    from meritflow.streaming import processors as pr
    t0, schema = dt.datetime(2024, 1, 1), "uid long, id long, ts timestamp_ntz, reward double, ok boolean"
    at = lambda minutes: t0 + dt.timedelta(minutes=minutes)
    base = tempfile.mkdtemp(prefix="meritflow-rounds-")
    parts = [[(1, 1, at(10), 1.0, True), (1, 2, at(50), 2.0, True), (1, 3, at(70), 4.0, True)],
             [(1, 4, at(40), 9.0, True), (1, 5, at(200), float("nan"), True), (2, 6, at(200), 1.0, False)],
             [(1, 7, at(20), 100.0, True), (1, 8, at(1000), 1.0, True)], [(9, 9, at(9000), 1.0, True)]]
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(base)
        time.sleep(0.05)

    def stream():
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(base)
        return pr.round_scores(pr.watermarked(rows, "ts", "30 minutes"), "uid", "ts", "id", "reward", "ok")

    got = sorted((r.uid, r.rnd % 24, round(r.score, 9), r.n_updates) for r in pr.run_processor(spark, stream, "rounds_test").where("uid < 9").collect())
    s = [0.2, 0.1 * 4 + 0.9 * 0.2]
    assert got == [(1, 0, round(s[0], 9), 1), (1, 1, round(s[1], 9), 2), (1, 3, round(0.9 * s[1], 9), 3),
                   (1, 16, round(0.1 + 0.81 * s[1], 9), 4), (2, 3, 0.0, 0)]


def test_keys_of_a_slot_share_a_call():
    """Keys, null too, are numbered within their slot's state, and each keeps its own rows."""
    import numpy as np
    import pandas as pd
    from meritflow.streaming import runner, stateful
    assert runner.SLOTS < 10_000
    keys = ["b"]
    rows, own = stateful._numbered(keys, [pd.Series(["a", None, "b"], dtype=object), pd.Series(["a"], dtype=object)],
                                   [np.array([[1, 1], [2, 2], [3, 3]]), np.array([[4, 4]])])
    assert keys == ["b", "a", None]
    assert {keys[k]: x[:, 0].tolist() for k, x in stateful._split(own, rows)} == {"b": [3], "a": [1, 4], None: [2]}
    assert list(stateful._split(np.zeros(0, np.int64), np.zeros((0, 2), np.int64))) == []
