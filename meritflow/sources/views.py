"""Domain tables derived from the driver's parquet tables.

The mapping (documented in FIXTURES.md section C) turns the generic tables into the
tables the scoring system works on: a population snapshot (``miners``), responses to
hourly tasks, rubric scores, test outcomes, hotkey snapshots, model completions and
token chunks.  Each function is a lazy projection/filter of a scan, so Catalyst prunes
columns and pushes predicates into parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.math import day_index, hour_index
from .tables import read_table


def miners(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer")
    return c.select(
        F.col("c_custkey").alias("uid"),
        F.col("c_name").alias("hotkey"),
        F.col("c_nationkey").alias("netuid"),
        F.col("c_acctbal").alias("stake"),
        (F.col("c_mktsegment") == "BUILDING").alias("validator_permit"),
        (F.pmod(F.col("c_custkey"), F.lit(7)) != 0).alias("is_serving"),
        (F.greatest(F.col("c_acctbal"), F.lit(0.0)) / 10000.0).alias("validator_trust"),
    )


def prop_k(props="props"):
    return F.get_json_object(F.col(props), "$.k").cast("int")


def responses(spark: SparkSession, d: str) -> DataFrame:
    """Every event is a miner's response to the task of its hour."""
    return responses_of(read_table(spark, d, "events"))


def responses_of(e: DataFrame, *carry: str) -> DataFrame:
    k = prop_k()
    return e.select(
        *carry, "event_id", "ts", "event_type",
        # round = hour index of the task; monotone in time, no global ranking needed
        hour_index("ts").alias("round"),
        day_index("ts").alias("day"),
        F.col("user_id").alias("uid"),
        k.alias("k"),
        (k / 100.0).alias("score"),
        (F.col("value") * 20.0).alias("process_time"),
        F.when(F.col("event_type") == "error", F.lit(None).cast("string"))
         .when(F.col("event_type") == "view", F.lit(""))
         .otherwise(F.col("event_type")).alias("patch"),
    )


def rubric_columns(k="k"):
    """Rubric fields of a response, derived from its k value."""
    k = F.col(k)
    return [
        (k / 100.0).alias("addresses"),
        (F.pmod(k, F.lit(50)) / 50.0).alias("logical"),
        (F.pmod(k, F.lit(10)) / 10.0).alias("brevity"),
        (F.pmod(k, F.lit(7)) / 7.0).alias("bugs"),
        F.when(F.pmod(k, F.lit(5)) == 0, F.array().cast("array<double>"))
         .otherwise(F.array(F.pmod(k, F.lit(3)) / 3.0, F.pmod(k, F.lit(4)) / 4.0)).alias("checklist"),
    ]


def test_results(spark: SparkSession, d: str) -> DataFrame:
    """Test outcomes: submission = user, test = k % 10, before/after by date."""
    e = read_table(spark, d, "events")
    k = prop_k()
    return e.select(
        F.col("user_id").alias("submission_id"),
        F.concat(F.col("user_id").cast("string"), F.lit(":"), F.pmod(k, F.lit(10)).cast("string")).alias("test_id"),
        F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), F.lit("before")).otherwise(F.lit("after")).alias("run"),
        F.when(F.col("event_type").isin("click", "purchase"), F.lit("passed"))
         .when(F.col("event_type") == "error", F.lit("failed")).otherwise(F.lit("other")).alias("status"),
        "ts", "event_id",
    )


def hotkey_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """One row per order: at that point uid is held by hotkey and earns reward."""
    o = read_table(spark, d, "orders")
    return o.select(
        F.pmod(F.col("o_custkey"), F.lit(64)).alias("uid"),
        F.col("o_orderdate").alias("snap_ts"),
        F.col("o_orderkey").alias("snap_seq"),
        F.col("o_orderpriority").alias("hotkey"),
        (F.col("o_totalprice") / 1e5).alias("reward"),
    )


def requests(spark: SparkSession, d: str) -> DataFrame:
    """Incoming requests: caller hotkey from the user; sign-ups carry no caller."""
    return requests_of(read_table(spark, d, "events"))


def requests_of(e: DataFrame) -> DataFrame:
    return e.select(
        "event_id", "ts", hour_index("ts").alias("round"),
        F.when(F.col("event_type") == "signup", F.lit(None).cast("string"))
         .otherwise(F.format_string("Customer#%09d", F.col("user_id"))).alias("caller_hotkey"),
    )


def registered_miners(spark: SparkSession, d: str) -> DataFrame:
    """Registered population: miners whose uid is not a multiple of 11."""
    return miners(spark, d).filter(F.pmod(F.col("uid"), F.lit(11)) != 0)
