"""Registered queries that run as Structured Streaming jobs over the table folders.

Each runs its stream to completion (``availableNow``) into the shared checkpoint
folder and returns what it wrote; its result must equal the batch twin's, so it is
checked with the batch twin's oracle SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import population as pop
from ..operators import scoring, timing
from ..sources import views
from ..sources.tables import table_path
from ..streaming import live
from ..streaming import processors as pr
from ..streaming import stateful as st
from ..streaming.runner import arrivals, latest_by_batch, run_to_table, table_stream, time_slices


def _batch():
    """The batch twins, whose module registers the queries of this one."""
    from . import queries
    return queries


def stream_epoch_due(spark: SparkSession, d: str, folder: str | None = None) -> DataFrame:
    # several batches of rows up to half an hour late; a folder of any order needs a lateness beyond it
    lateness = "400 days" if folder else "1 hour"
    folder = folder or time_slices(spark, d, "events", "ts", "event_id", parts=3, disorder=1_800.0)
    ev = table_stream(spark, d, "events", max_files=2, folder=folder)
    s = st.epoch_trigger_stream(ev, "user_id", "ts", "event_id", 100, 12, lateness=lateness)
    out = latest_by_batch(run_to_table(spark, s, "epoch_due", "update"), ["event_id"])
    return out.select("user_id", "event_id", "block", "due")


def stream_ema(spark: SparkSession, d: str, folder: str | None = None) -> DataFrame:
    # several batches of rows up to half an hour late: a round closes three rounds on
    open_rounds = 24 * 366 if folder else 3
    folder = folder or time_slices(spark, d, "events", "ts", "event_id", parts=3, disorder=1_800.0)
    ev = table_stream(spark, d, "events", max_files=2, folder=folder)
    r = views.responses_of(ev).join(_batch().eligible_population(spark, d), "uid", "inner")   # stream-static join
    r = (r.withColumn("reward", scoring.reward(F.col("score"), F.col("process_time")))
          .withColumn("valid", F.col("patch").isNotNull() & (F.col("patch") != "")))
    s = st.ema_stream(r, "uid", "round", "ts", "event_id", "reward", "valid", alpha=0.1, open_rounds=open_rounds)
    out = latest_by_batch(run_to_table(spark, s, "ema", "update"), ["uid"])
    return out.select("uid", F.round("score", 9).alias("score"), "n_updates")


def stream_scores(spark: SparkSession, d: str) -> DataFrame:
    """Moving-average scores whose rounds are closed by timers as the watermark passes them (STM3):
    events in several batches, up to half an hour late."""
    beat = _heartbeat(spark, d, "view")
    folder = time_slices(spark, d, "events", "ts", "event_id", parts=4, disorder=1_800.0, closing=beat)

    def scores() -> DataFrame:
        ev = pr.watermarked(table_stream(spark, d, "events", max_files=2, folder=folder), "ts", "1 hour")
        r = views.responses_of(ev, "_et").join(_batch().eligible_population(spark, d), "uid", "inner")   # stream-static join
        r = (r.withColumn("reward", scoring.reward(F.col("score"), F.col("process_time")))
              .withColumn("valid", F.col("patch").isNotNull() & (F.col("patch") != "")))
        return pr.round_scores(r, "uid", "ts", "event_id", "reward", "valid")

    closed = pr.run_processor(spark, scores, "scores")
    last = closed.groupBy("uid").agg(F.max(F.struct("rnd", "score", "n_updates")).alias("m")).where("m.n_updates > 0")
    return last.select("uid", F.round("m.score", 9).alias("score"), F.col("m.n_updates").alias("n_updates"))


def stream_messages(spark: SparkSession, d: str) -> DataFrame:
    """Conversations put together from their turns, which arrive over several batches with an end
    message behind them (STM1)."""
    turns = spark.read.parquet(table_path(d, "conversations"))
    ends = turns.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn")).select(
        "conv_id", "turn", F.lit("end").alias("role"), F.lit(None).cast("string").alias("text"))
    folder = arrivals(spark, turns.unionByName(ends), F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3)), 3, "messages")

    def joined() -> DataFrame:
        c = table_stream(spark, d, "conversations", max_files=2, folder=folder)
        return pr.messages(c.withColumn("_end", F.col("role") == "end"), "conv_id", "turn", "text", "_end")

    return pr.run_processor(spark, joined, "messages", idle_batches=False).drop("_batch")


def _mixed_turns(spark: SparkSession, d: str) -> str:
    """The conversations' turns in three sets of files, in any order."""
    return arrivals(spark, spark.read.parquet(table_path(d, "conversations")), F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3)), 3, "turns")


def stream_chunks(spark: SparkSession, d: str, folder: str | None = None) -> DataFrame:
    c = table_stream(spark, d, "conversations", max_files=2, folder=folder or _mixed_turns(spark, d))
    out = latest_by_batch(run_to_table(spark, st.chunk_accumulator(c, "conv_id", "turn", "text"), "chunks", "update"),
                          ["conv_id"])
    return out.select("conv_id", "completion", "n_chunks")


def stream_ttl_hold(spark: SparkSession, d: str, folder: str | None = None) -> DataFrame:
    ev = table_stream(spark, d, "events", folder=folder)
    s = st.ttl_hold_stream(ev, "event_type", "ts", "event_id", "value", 12, "1 minute")
    out = latest_by_batch(run_to_table(spark, s, "ttl_hold", "update"), ["event_type", "bucket"])
    return out.select("event_type", "bucket", "held_value", "n_calls")


def stream_log_lines(spark: SparkSession, d: str, folder: str | None = None) -> DataFrame:
    ev = table_stream(spark, d, "events", folder=folder)
    return run_to_table(spark, _batch().log_lines_of(ev), "log_lines").drop("_batch")


def stream_published(spark: SparkSession, d: str) -> DataFrame:
    """Log lines published in transactions; the whole stream is replayed, and nothing doubles (SRC9)."""
    import uuid
    from ..session import scratch_path
    from ..sources import published as pb
    base = scratch_path(spark, f"streams/published/{uuid.uuid4().hex}")
    folder = time_slices(spark, d, "events", "ts", "event_id", parts=3)
    lines = _batch().log_lines_of(table_stream(spark, d, "events", max_files=2, folder=folder))
    for run in ("first", "replay"):
        pb.publish_stream(lines, f"{base}/table", f"{base}/checkpoint-{run}")
    return pb.published(spark, f"{base}/table", lines.schema)


def stream_gate_requests(spark: SparkSession, d: str, folder: str | None = None) -> DataFrame:
    ev = table_stream(spark, d, "events", folder=folder)
    return run_to_table(spark, _batch().gate_of(ev, views.registered_miners(spark, d)), "gate").drop("_batch")


def stream_gate_live(spark: SparkSession, d: str) -> DataFrame:
    """Requests judged and ranked against a population that changes in mid-stream (STM7, TOP5, UDF3).

    Half of the events arrive and are judged; then the population is published anew, with
    other members and stakes, and the stream goes on from its checkpoint with the rest.  The
    caller's priority falls with its distance from a round thousand of stake.
    """
    import uuid
    from ..session import scratch_path
    base = scratch_path(spark, f"streams/gate-live/{uuid.uuid4().hex}")
    hook = -F.abs(F.pmod(F.floor("caller_stake"), F.lit(1_000)) - 500).cast("double")
    rules = [(F.col("caller_stake") < 0.0, "stake below zero")]
    m = views.miners(spark, d)
    eras = [(range(0, 2), m.where(F.pmod("uid", F.lit(11)) != 0)),
            (range(2, 4), m.where(F.pmod("uid", F.lit(7)) != 0).withColumn("stake", F.col("stake") - 1_000.0))]
    folder = None
    for version, (slices, population) in enumerate(eras):
        live.publish_population(population, f"{base}/population", version)
        folder = time_slices(spark, d, "events", "ts", "event_id", parts=4, folder=folder, only=slices)
        ev = table_stream(spark, d, "events", max_files=2, folder=folder)
        q = (ev.writeStream.foreachBatch(live.gate_batches(f"{base}/population", f"{base}/out", views.requests_of, extra_rules=rules, priority=hook))
               .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
        q.awaitTermination()
    return live.verdicts(spark, f"{base}/out")


def stream_population_resync(spark: SparkSession, d: str, folder: str | None = None) -> DataFrame:
    import uuid
    from ..session import scratch_path
    o = table_stream(spark, d, "orders", max_files=2, folder=folder or time_slices(spark, d, "orders", "o_orderdate", "o_orderkey", parts=3))
    held = F.when(F.pmod(F.col("o_orderkey"), F.lit(11)) != 0, F.col("o_orderpriority"))      # now and then a uid has none
    snaps = o.select(F.pmod(F.col("o_custkey"), F.lit(64)).alias("uid"), held.alias("hotkey"),
                     F.col("o_orderdate").alias("snap_ts"), F.col("o_orderkey").alias("snap_seq"))
    run, order = uuid.uuid4().hex, ["snap_ts", "snap_seq"]
    base = scratch_path(spark, f"streams/population/{run}/table")
    q = (st.population_resync(snaps, base, "uid", "hotkey", order)
           .option("checkpointLocation", scratch_path(spark, f"streams/population/{run}/checkpoint"))
           .trigger(availableNow=True).start())
    q.awaitTermination()
    landed = spark.read.schema(snaps.schema).parquet(base)
    return st.current_population(landed, "uid", "hotkey", order)


def stream_batch_tokens(spark: SparkSession, d: str, folder: str | None = None) -> DataFrame:
    from ..functions import nested as nst
    c = table_stream(spark, d, "conversations", folder=folder)
    t = c.select("conv_id", "turn", nst.tokens("text").alias("toks"))
    b = t.select("conv_id", "turn", F.inline(nst.token_batches(F.col("toks"), 3)))
    b = b.select("conv_id", "turn", F.col("idx").cast("bigint").alias("idx"), "batch", "is_last")
    return run_to_table(spark, b, "batch_tokens").drop("_batch")


def stream_trueskill(spark: SparkSession, d: str, folder: str | None = None) -> DataFrame:
    from ..operators import grading
    ev = table_stream(spark, d, "events", folder=folder)
    r = views.responses_of(ev).join(_batch().eligible_population(spark, d), "uid", "inner")   # stream-static join
    r = (r.select("netuid", "round", "ts", "event_id", "uid", "patch", *views.rubric_columns("k"))
          .withColumn("grade", grading.rubric_score("addresses", "logical", "brevity", "bugs", "checklist", "patch"))
          .withColumn("valid", F.col("patch").isNotNull() & (F.col("patch") != "")))
    s = st.trueskill_stream(r, "netuid", "round", "ts", "event_id", "uid", "grade", "valid")
    out = latest_by_batch(run_to_table(spark, s, "trueskill", "update"), ["netuid", "round", "uid"])
    return out.select("netuid", "round", "uid", F.round("mu", 9).alias("mu"), F.round("sigma", 9).alias("sigma"),
                      F.round("ts_score", 9).alias("ts_score"))


def stream_token_batches(spark: SparkSession, d: str, folder: str | None = None) -> DataFrame:
    """Tokens of whole conversations in threes, carried from turn to turn (STM2)."""
    ends = spark.read.parquet(table_path(d, "conversations")).groupBy("conv_id").agg(F.max("turn").alias("end"))
    c = table_stream(spark, d, "conversations", max_files=2, folder=folder or _mixed_turns(spark, d))
    c = c.join(ends, "conv_id").withColumn("last", F.col("turn") == F.col("end"))
    return run_to_table(spark, st.token_batch_stream(c, "conv_id", "turn", "text", "last"), "token_batches").drop("_batch")


def _heartbeat(spark: SparkSession, d: str, *types: str) -> DataFrame:
    """An event of each type two days behind the last one: the source is alive and has passed on all before."""
    ev = spark.read.parquet(table_path(d, "events"))
    end = ev.agg(F.max("ts").alias("end")).withColumn("event_type", F.explode(F.array(*[F.lit(t) for t in types])))
    values = {"event_id": F.lit(-1).cast("bigint"), "user_id": F.lit(-1).cast("bigint"), "event_type": F.col("event_type"),
              "ts": F.col("end") + F.expr("INTERVAL 2 DAYS")}
    return end.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ev.schema.fields])


def stream_deadline(spark: SparkSession, d: str, folder: str | None = None) -> DataFrame:
    """Every request with its first answer, or 408 where none came in time (STM6).

    The events arrive in several batches, up to ten minutes late; requests without an answer
    are closed by the watermark.
    """
    folder = folder or time_slices(spark, d, "events", "ts", "event_id", parts=4, disorder=600.0,
                                   closing=_heartbeat(spark, d, "view", "purchase"))
    ev = table_stream(spark, d, "events", max_files=2, folder=folder)
    req = ev.filter(F.col("event_type") == "view").select(F.col("event_id").alias("req_id"), "user_id", "ts")
    resp = ev.filter(F.col("event_type") == "purchase").select(F.col("event_id").alias("resp_id"), "user_id", "ts")
    out = run_to_table(spark, st.deadline_stream(req, resp, "user_id", "30 minutes", "10 minutes"), "deadline")
    return out.where(F.col("req_id") >= 0).select("req_id", "resp_id", "status_code")


#: A request is a duplicate within six hours of an accepted one.
DUPLICATE_SECONDS = 6 * 3_600


def distinct_requests(spark: SparkSession, d: str) -> DataFrame:
    """Each user's requests of a kind, and whether none was accepted in the hours before (STM10)."""
    ev = spark.read.parquet(table_path(d, "events"))
    return timing.recent_duplicates(ev, ["user_id", "event_type"], "ts", "event_id", DUPLICATE_SECONDS)


def stream_distinct_requests(spark: SparkSession, d: str, folder: str | None = None) -> DataFrame:
    """The same from a stream of several batches whose rows come up to an hour late (STM10)."""
    beat = _heartbeat(spark, d, "view")
    folder = folder or time_slices(spark, d, "events", "ts", "event_id", parts=4, disorder=3_600.0, closing=beat)
    ev = table_stream(spark, d, "events", max_files=2, folder=folder)
    rows = st.recent_duplicates_stream(ev.select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], "ts",
                                       "event_id", DUPLICATE_SECONDS, "1 hour")
    return run_to_table(spark, rows, "distinct_requests").where(F.col("event_id") >= 0).drop("_batch")


STREAM_QUERIES = {
    "stream_token_batches": stream_token_batches,
    "stream_deadline": stream_deadline,
    "distinct_requests": distinct_requests,
    "stream_distinct_requests": stream_distinct_requests,
    "stream_trueskill": stream_trueskill,
    "stream_population_resync": stream_population_resync,
    "stream_batch_tokens": stream_batch_tokens,
    "stream_epoch_due": stream_epoch_due,
    "stream_ema": stream_ema,
    "stream_scores": stream_scores,
    "stream_messages": stream_messages,
    "stream_chunks": stream_chunks,
    "stream_ttl_hold": stream_ttl_hold,
    "stream_log_lines": stream_log_lines,
    "stream_published": stream_published,
    "stream_gate_requests": stream_gate_requests,
    "stream_gate_live": stream_gate_live,
}
