"""Stream sources and an idempotent sink for running streams to completion.

Sources read the table folders as file streams; ``run_to_table`` runs a streaming
DataFrame with ``availableNow`` into parquet under the shared checkpoint folder, one
sub-folder per micro-batch written with overwrite, so a retried batch replaces its own
output instead of duplicating it.
"""

from __future__ import annotations

import time
import uuid
from itertools import pairwise

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.math import epoch_us
from ..session import scratch_path
from ..sources.tables import table_path

#: Keys with little state are kept together in this many groups.
SLOTS = 1_024


def table_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int = 1,
                 folder: str | None = None) -> DataFrame:
    """A table as a file stream (schema taken from the table, never inferred per batch).

    The table may be one file or a folder of part files on any file system Spark reads;
    ``max_files`` of them make a micro-batch.  ``folder`` points at another folder of parts
    of the same table.
    """
    path = folder or table_path(sf_dir, name)
    stream = (spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", max_files))
    if is_folder(spark, path):
        return stream.parquet(path)
    # a single file: its folder, restricted to that file's name
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def time_slices(spark: SparkSession, sf_dir: str, name: str, ts: str, id_col: str, parts: int = 4,
                disorder: float = 0.0, closing: DataFrame | None = None, folder: str | None = None,
                only: range | None = None) -> str:
    """Folder of the table's rows in ``parts`` sets of files, in order of arrival, for a stream of several batches.

    A row arrives up to ``disorder`` seconds after its time, by a hash of its id, so rows of
    neighbouring slices mix.  ``closing`` rows come in a slice of their own behind all others:
    a heartbeat far ahead lets the watermark pass everything.  A row with a null time arrives
    first.  ``only`` these slices are added to ``folder``, so that others may follow later.
    """
    rows = spark.read.parquet(table_path(sf_dir, name))
    late = F.pmod(F.xxhash64(F.col(id_col)), F.lit(max(1, int(disorder * 1e6)))) if disorder else F.lit(0)
    rows = rows.withColumn("_at", F.coalesce(epoch_us(ts) + late, F.lit(-(1 << 62))))
    lo, hi = rows.where(F.col(ts).isNotNull()).agg(F.min("_at"), F.max("_at")).first()
    folder = folder or scratch_path(spark, f"streams/slices/{name}-{uuid.uuid4().hex}")
    cuts = [lo + (hi + 1 - lo) * i // parts for i in range(1, parts)] if lo is not None else []
    edges = list(pairwise([None, *cuts, None]))
    for a, b in [edges[i] for i in (only if only is not None else range(len(edges))) if i < len(edges)]:
        part = rows if a is None else rows.where(F.col("_at") >= a)
        part = part if b is None else part.where(F.col("_at") < b)
        part.drop("_at").coalesce(2).write.mode("append").parquet(folder)
        time.sleep(0.02)                  # the file source orders files by their time
    if closing is not None:
        closing.select(*spark.read.parquet(folder).columns).coalesce(1).write.mode("append").parquet(folder)
    return folder


def arrivals(spark: SparkSession, rows: DataFrame, turn, turns: int, name: str) -> str:
    """Folder of ``rows`` in ``turns`` sets of files, those with ``turn`` 0 first, for a stream of several batches."""
    folder = scratch_path(spark, f"streams/arrivals/{name}-{uuid.uuid4().hex}")
    for i in range(turns):
        rows.where(turn == i).coalesce(2).write.mode("append").parquet(folder)
        time.sleep(0.02)                  # the file source orders files by their time
    return folder


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether ``path``, on whatever file system, is a folder."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()


def event_time(ts) -> F.Column:
    """TIMESTAMP instant of a UTC wall-clock TIMESTAMP_NTZ; watermarks need TIMESTAMP."""
    return F.timestamp_micros(epoch_us(ts))


def slot(*keys: str) -> F.Column:
    """``_slot``: the group, of ``SLOTS``, whose state and calls a key shares."""
    return F.pmod(F.xxhash64(*keys), F.lit(SLOTS)).cast("int").alias("_slot")


def run_to_table(spark: SparkSession, sdf: DataFrame, name: str, output_mode: str = "append",
                 run_id: str | None = None) -> DataFrame:
    """Run ``sdf`` until the available input is consumed; return what it wrote, with ``_batch``.

    A failed stream raises; one without input gives no rows, since batch -1 is written empty
    before the stream starts.
    """
    base = scratch_path(spark, f"streams/{name}/{run_id or uuid.uuid4().hex}")
    out, ck = base + "/out", base + "/checkpoint"
    empty = spark.createDataFrame([], sdf.schema)
    empty.write.mode("overwrite").parquet(f"{out}/_batch=-1")

    def sink(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/_batch={batch_id}")

    q = (sdf.writeStream.outputMode(output_mode).foreachBatch(sink)
            .option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)


def latest_by_batch(df: DataFrame, keys: list[str]) -> DataFrame:
    """For update-mode outputs: the last emitted row per key."""
    w = Window.partitionBy(*keys).orderBy(F.col("_batch").desc())
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r", "_batch")
