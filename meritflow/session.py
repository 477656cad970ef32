"""Session helpers: one place for the configuration every job relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # map_concat / transform_keys keep the later key, as dict updates do.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "meritflow",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in _DEFAULTS.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    prepare(spark)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the session-level SQL settings to a session someone else built."""
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    return spark


_LOCAL_CKPT: dict[str, str] = {}
_SCRATCH: set[str] = set()


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables: ``spark.checkpoint.dir``.

    Where it is unset, a session on one machine gets one temporary folder, removed when its
    JVM ends; on a cluster this raises, since executors do not share the driver's folders.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if sc.applicationId not in _LOCAL_CKPT:
            d = _LOCAL_CKPT[sc.applicationId] = tempfile.mkdtemp(prefix="meritflow-ckpt-")
            remove_at_exit(spark, d)
        d = _LOCAL_CKPT[sc.applicationId]
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Remove ``path``, on whatever file system, when the driver's JVM ends."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for a written intermediate table.

    It belongs to this application and goes with it.
    """
    base = f"{checkpoint_dir(spark)}/meritflow/{spark.sparkContext.applicationId}"
    if base not in _SCRATCH:
        _SCRATCH.add(base)
        remove_at_exit(spark, base)
    return f"{base}/{name}"


def cache_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder for results that later applications may read again."""
    return f"{checkpoint_dir(spark)}/meritflow-cache/{name}"


def written(df, name: str):
    """``df`` written to the shared folder and read back: computed once, kept for retries."""
    path = scratch_path(df.sparkSession, f"tables/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_groups(df, *keys):
    """Hash-partition by ``keys`` into spark.sql.shuffle.partitions partitions.

    For CPU-heavy grouped-map stages (folds, matrix products): their input is small in
    bytes, so AQE would coalesce it into a handful of tasks and run the groups one after
    another; an explicit partition count is never coalesced.  The grouped stage that
    follows reuses this partitioning, so no extra shuffle is added.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)
