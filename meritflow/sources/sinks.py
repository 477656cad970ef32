"""Sinks and state snapshots: SRC3, SRC4, SRC5, SRC6, SRC7."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def heuristics_key(**params) -> str:
    """Stable key of the parameters a cached result depends on."""
    return hashlib.sha1(json.dumps(params, sort_keys=True).encode()).hexdigest()[:16]


def fingerprint(df: DataFrame) -> str:
    """Digest of a table's rows and schema, the same in any order of rows (SRC3).

    One aggregate: the number of rows and two sums of independent row hashes.  Columns of map
    type cannot be hashed and raise.
    """
    row = [F.col(f"`{c}`") for c in df.columns]
    wide = lambda h: F.sum(h.cast("decimal(38,0)")).cast("string")
    n, a, b = df.agg(F.count(F.lit(1)), wide(F.xxhash64(*row)), wide(F.xxhash64(F.lit("second"), *row))).first()
    return heuristics_key(schema=df.schema.jsonValue(), rows=n, sums=[a, b])


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of ``path``, on whatever file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _versions(spark: SparkSession, folder: str) -> list[int]:
    fs, at = _hadoop(spark, f"{folder}/v=*")
    return sorted(int(s.getPath().getName().removeprefix("v=")) for s in fs.globStatus(at) or [])


def read_or_compute(spark: SparkSession, base: str, inputs: list[DataFrame], compute: Callable[[], DataFrame],
                    refresh: bool = False, **params) -> tuple[DataFrame, bool]:
    """A result by what it depends on, and whether it was cached (SRC3).

    The key is the ``params`` and the ``fingerprint`` of the ``inputs``, so any run on the same
    rows and parameters finds it and a changed row misses.  A result is written to a folder
    of its own and published by renaming it to the next version, which never replaces one, so
    readers see whole results only and the loser of a race publishes the version after.  An
    empty result is computed again next time.
    """
    key = heuristics_key(inputs=[fingerprint(df) for df in inputs], **params)
    folder = f"{base.rstrip('/')}/{key}"
    versions = [] if refresh else _versions(spark, folder)
    if versions:
        cached = spark.read.parquet(f"{folder}/v={versions[-1]}")
        if not cached.isEmpty():
            return cached, True
    staged = f"{base.rstrip('/')}/staged-{uuid.uuid4().hex}"
    compute().write.parquet(staged)
    fs, source = _hadoop(spark, staged)
    fs.mkdirs(_hadoop(spark, folder)[1])
    version = max(_versions(spark, folder), default=0) + 1
    for version in range(version, version + 100):
        to = _hadoop(spark, f"{folder}/v={version}")[1]
        if not fs.exists(to) and fs.rename(source, to):
            return spark.read.parquet(f"{folder}/v={version}"), False
    raise RuntimeError(f"no version of {folder} could be published")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists, on whatever file system; other errors are raised."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def publish_scored_rows(rows: DataFrame, path: str, run: str) -> None:
    """Scored submissions of one run, partitioned by repository (SRC4).

    A repeated run replaces its own rows and no others.
    """
    (rows.select("repo", "problem_statement", F.col("patch").alias("solution_patch"), "score",
                 F.col("hotkey").alias("miner_hotkey"))
         .write.mode("overwrite").partitionBy("repo").parquet(f"{path}/run={run}"))


def _steps(spark: SparkSession, path: str) -> list[int]:
    """Step numbers of the finished snapshots under ``path``."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return []
    done = (s.getPath() for s in fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/step=*/_SUCCESS")))
    return sorted(int(p.getParent().getName().removeprefix("step=")) for p in done)


def save_state(state: DataFrame, path: str, step: int | None = None) -> int:
    """Versioned snapshot of (uid, hotkey, score, pr_score) (SRC5); returns its step.

    Without ``step`` it follows the last finished one.  A step at or below that raises, so no
    later snapshot is ever shadowed by an earlier one.
    """
    last = max(_steps(state.sparkSession, path), default=0)
    step = last + 1 if step is None else step
    if step <= last:
        raise ValueError(f"step {step} is not above the last saved step, {last}")
    state.write.mode("overwrite").parquet(f"{path}/step={step}")
    return step


def load_state(spark: SparkSession, path: str) -> DataFrame:
    """The latest finished snapshot, with its step; without pr_score that reads as 0 (SRC5)."""
    steps = _steps(spark, path)
    if not steps:
        raise FileNotFoundError(f"no saved state under {path}")
    df = spark.read.parquet(f"{path}/step={steps[-1]}").withColumn("step", F.lit(steps[-1]).cast("bigint"))
    if "pr_score" not in df.columns:
        df = df.withColumn("pr_score", F.lit(0.0))
    return df.withColumn("pr_score", F.coalesce(F.col("pr_score"), F.lit(0.0)))


def resync_state(state: DataFrame, population: DataFrame) -> DataFrame:
    """The state of the present ``population`` (uid, hotkey): identity decides (SRC5, WIN2).

    A uid keeps its scores if its hotkey is the one they were saved with; a replaced uid and
    a new one start from 0, and one that is gone is dropped.
    """
    old = state.select("uid", F.col("hotkey").alias("_was"), "score", "pr_score")
    step = state.agg(F.max("step").alias("step"))
    kept = F.col("_was").isNotNull() & (F.col("_was") == F.col("hotkey"))
    both = population.select("uid", "hotkey").join(old, "uid", "left")
    scores = [F.when(kept, F.coalesce(F.col(c), F.lit(0.0))).otherwise(0.0).alias(c) for c in ("score", "pr_score")]
    return both.select("uid", "hotkey", *scores).withColumn("step", F.lit(step.first()[0]).cast("bigint"))


def as_of(snapshots: DataFrame, events: DataFrame, key: str, snap_ts: str, ev_ts: str,
          bucket_width: int = 86_400_000_000, rows: int = 1_000_000) -> DataFrame:
    """Each event with the latest snapshot row of its key taken at or before it (SRC6).

    Times are bucketed (``bucket_width`` in microseconds for timestamps, in the column's
    own units for numbers).  The answer is the last snapshot at or before the event in
    its own bucket (a window bounded to one bucket), else the last snapshot of the
    latest earlier non-empty bucket (a lag over one row per bucket).  A bucket of more than
    ``rows`` rows is cut into narrower ones, so no task sorts more than about that many of a
    key that are spread in time, and no event x snapshot pairs are formed.
    """
    from pyspark.sql.types import TimestampNTZType, TimestampType

    from ..functions.math import epoch_us, floor_div

    def num(df, c):
        t = df.schema[c].dataType
        return epoch_us(c) if isinstance(t, (TimestampNTZType, TimestampType)) else F.col(c).cast("bigint")

    snap_cols = [c for c in snapshots.columns if c != key]
    ev_cols = [c for c in events.columns if c != key]
    packed = F.struct(*[F.col(c) for c in snap_cols])
    snap_type = snapshots.select(packed.alias("x")).schema["x"].dataType
    ev_type = events.select(F.struct(*[F.col(c) for c in ev_cols]).alias("x")).schema["x"].dataType
    ev = events.select(F.col(key), num(events, ev_ts).alias("_t"), F.lit(1).alias("_side"),
                       F.struct(*[F.col(c) for c in ev_cols]).alias("_e"), F.lit(None).cast(snap_type).alias("_s"))
    sn = snapshots.select(F.col(key), num(snapshots, snap_ts).alias("_t"), F.lit(0).alias("_side"),
                          F.lit(None).cast(ev_type).alias("_e"), packed.alias("_s"))
    # buckets that hold too many rows, and into how many parts of equal width they are cut
    times = ev.select(key, "_t").unionByName(sn.select(key, "_t")).withColumn("_w", floor_div("_t", bucket_width))
    full = times.groupBy(F.col(key).alias("_fk"), F.col("_w").alias("_fw")).agg(F.ceil(F.count(F.lit(1)) / rows).alias("_cut")).where("_cut > 1")

    def bucketed(df):
        d = df.withColumn("_w", floor_div("_t", bucket_width))
        d = d.join(full, d[key].eqNullSafe(F.col("_fk")) & (F.col("_w") == F.col("_fw")), "left")
        part = F.floor((F.col("_t") - F.col("_w") * bucket_width) * F.coalesce("_cut", F.lit(1).cast("bigint")).cast("decimal(20,0)") / bucket_width)
        return d.withColumn("_b", F.struct(F.col("_w").alias("w"), part.cast("bigint").alias("p"))).drop("_w", "_fk", "_fw", "_cut")

    ev, sn = bucketed(ev), bucketed(sn)
    both = ev.unionByName(sn)
    # same bucket: last snapshot at or before the event (snapshots sort first on ties)
    w = (Window.partitionBy(key, "_b").orderBy("_t", "_side")
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    same = both.withColumn("_c1", F.last("_s", ignorenulls=True).over(w)).filter(F.col("_side") == 1)
    # earlier buckets: one row per (key, bucket) holding that bucket's last snapshot
    snap_b = (sn.groupBy(key, "_b").agg(F.max_by("_s", "_t").alias("_last"), F.lit(1).alias("_kind")))
    ev_b = same.select(key, "_b").distinct().withColumn("_last", F.lit(None).cast(snap_type)).withColumn("_kind", F.lit(0))
    wb = (Window.partitionBy(key).orderBy("_b", "_kind")
                .rowsBetween(Window.unboundedPreceding, -1))
    prev = (ev_b.unionByName(snap_b).withColumn("_c2", F.last("_last", ignorenulls=True).over(wb))
                .filter(F.col("_kind") == 0).select(key, "_b", "_c2"))
    m = same.join(prev, [key, "_b"], "left").withColumn("_snap", F.coalesce("_c1", "_c2"))
    return m.select(F.col(key), *[F.col("_e")[c].alias(c) for c in ev_cols],
                    *[F.col("_snap")[c].alias(c) for c in snap_cols if c not in ev_cols])


REPORT_SCHEMA = "tests array<struct<nodeid: string, outcome: string>>"


def test_report_outcomes(reports: DataFrame, run_cols: list[str], report: str = "report") -> DataFrame:
    """Pytest JSON reports -> (run..., test_id, status) for passed/failed tests; the last
    entry of a test id in a report wins (SRC7)."""
    parsed = reports.select(*run_cols, F.from_json(F.col(report), REPORT_SCHEMA).alias("_r"))
    ex = parsed.select(*run_cols, F.posexplode("_r.tests").alias("_pos", "_t"))
    ok = ex.select(*run_cols, "_pos", F.col("_t.nodeid").alias("test_id"), F.lower("_t.outcome").alias("status")) \
           .filter(F.col("status").isin("passed", "failed"))
    return (ok.groupBy(*run_cols, "test_id").agg(F.max_by("status", "_pos").alias("status")))
