"""STM7, TOP5: the request gate against a population that changes while the stream runs.

A streaming join fixes its static side when the stream starts.  Here every micro-batch reads
the population anew, judges its requests, and ranks the rounds it touched again, so that a
change of the population holds from the next batch on.  What a batch writes goes to a folder
of its own, overwritten on retry, and no batch reads more of the past than the days of the
rounds it touches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PopulationConfig
from ..operators import population as pop
from ..sources.sinks import path_exists


def publish_population(population: DataFrame, path: str, version: int) -> None:
    """The population from ``version`` on; a repeated version replaces itself."""
    population.write.mode("overwrite").parquet(f"{path}/v={version}")


def current_version(spark: SparkSession, path: str) -> DataFrame:
    """The population of the highest published version, listed anew at every call."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v=*/_SUCCESS")
    done = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    versions = [int(s.getPath().getParent().getName().removeprefix("v=")) for s in done]
    if not versions:
        raise FileNotFoundError(f"no population under {path}")
    return spark.read.parquet(f"{path}/v={max(versions)}")


def gate_batches(population: str, base: str, requests: Callable[[DataFrame], DataFrame], cfg: PopulationConfig = PopulationConfig(),
                 extra_rules: list[tuple[Column, str]] | None = None, priority: Column | None = None, rounds_a_day: int = 24):
    """A foreachBatch function that writes verdicts and serve ranks under ``base``.

    ``requests`` maps a batch to (event_id, round, caller_hotkey, ...); ``priority`` is the
    caller's hook over the gated columns, by default the stake.
    """
    day = F.floor(F.col("round") / rounds_a_day)

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        gated = pop.gate_requests(requests(batch), current_version(spark, population), cfg, extra_rules)
        gated = gated.withColumn("priority", F.coalesce(priority if priority is not None else F.col("caller_stake"), F.lit(0.0)))
        verdicts = f"{base}/verdicts/batch={batch_id}"
        (gated.select("event_id", "round", "blocked", "reason", "priority", day.alias("day"))
              .write.mode("overwrite").partitionBy("day").parquet(verdicts))
        if not path_exists(spark, f"{verdicts}/_SUCCESS"):
            return
        new = spark.read.parquet(verdicts) if _has_rows(spark, verdicts) else None
        if new is None:
            return
        open_ = new.where(~F.col("blocked")).select("round", "day").distinct()
        # a batch spans few days; only their partitions of earlier batches are read
        days = [r.day for r in open_.select("day").distinct().collect()]
        past = spark.read.parquet(f"{base}/verdicts").where(F.col("day").isin(days) & (F.col("batch") <= batch_id) & ~F.col("blocked"))
        rows = past.join(open_.select("round"), "round", "left_semi").select("event_id", "round", "priority")
        ranked = pop.serve_ranks(rows, "round", "event_id")
        ranked.write.mode("overwrite").parquet(f"{base}/ranks/batch={batch_id}")

    return run


def _has_rows(spark: SparkSession, path: str) -> bool:
    """Whether a partitioned folder holds any partition; an empty write leaves only its marker."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/day=*")
    return len(hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)) > 0


def verdicts(spark: SparkSession, base: str) -> DataFrame:
    """(event_id, round, blocked, reason, priority, serve_rank): each round as its last batch ranked it."""
    found = spark.read.parquet(f"{base}/verdicts").select("event_id", "round", "blocked", "reason", "priority")
    if not path_exists(spark, f"{base}/ranks"):
        return found.withColumn("serve_rank", F.lit(None).cast("bigint"))
    ranks = spark.read.parquet(f"{base}/ranks")
    last = ranks.groupBy("round").agg(F.max("batch").alias("batch"))
    ranks = ranks.join(last, ["round", "batch"]).select("event_id", "serve_rank")
    return found.join(ranks, "event_id", "left")
