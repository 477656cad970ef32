"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash within their source, and a row's fractional rank is its
place there divided by the source's row count.  Sorted by fractional rank, every stretch of
the table holds the sources in their overall proportions; it is cut into shards whose row
counts differ by at most one.

Neither order is made by one task: ranks are a bucket's offset (a running sum over counts)
plus the place in the bucket, and buckets are ranges of the hash and of the fractional rank,
so even a source with most of the rows is spread evenly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meritflow.llm.common import fresh, small, written

ROWS_PER_BUCKET = 4_096
RESULTS = ("law", "shard", "slot", "grown_shard")


def shuffle_key(seed: int, *parts: Column) -> Column:
    """A seeded hash in hexadecimal; null counts as 'null'."""
    text = [F.coalesce(p.cast("string"), F.lit("null")) for p in parts]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *text).cast("binary"))


def assign(docs: DataFrame, shards: int, seed: int = 17, ties: tuple[str, ...] = ("doc_id", "text_crc32")) -> DataFrame:
    """``docs`` with law ('rows'), shard, slot (from 0 without gaps) and grown_shard (null).

    ``ties`` names the columns that tell rows apart; rows that agree in all of them are
    interchangeable.  Null sources are a stratum of their own.  With fewer rows than shards
    some shards stay empty; an empty table gives an empty one.  Input columns named like the
    results are replaced.
    """
    n = fresh(docs, "key", "cell", "ahead", "size", "share", "bucket", "before", "pos", "c", "s")
    c = {k: F.col(v) for k, v in n.items()}
    total = docs.count()
    digits = 1
    while total >> (4 * digits) > ROWS_PER_BUCKET and digits < 7:
        digits += 1
    buckets = 16**digits
    order = [n["key"], *ties]
    rows = (docs.withColumn(n["key"], shuffle_key(seed, *[F.col(t) for t in ties]))
            .withColumn(n["cell"], F.conv(F.substring(n["key"], 1, digits), 16, 10).cast("long")))
    before = Window.partitionBy("source").orderBy(n["cell"]).rowsBetween(Window.unboundedPreceding, -1)
    cells = written(rows.groupBy("source", n["cell"]).agg(F.count("*").alias(n["size"]))
                    .withColumn(n["ahead"], F.coalesce(F.sum(n["size"]).over(before), F.lit(0)))
                    .withColumn(n["size"], F.sum(n["size"]).over(Window.partitionBy("source")))
                    .withColumnRenamed("source", n["s"]).withColumnRenamed(n["cell"], n["c"]), "cells")
    in_cell = F.row_number().over(Window.partitionBy("source", n["cell"]).orderBy(*order))
    ranked = (rows.join(small(cells), F.col("source").eqNullSafe(c["s"]) & (c["cell"] == c["c"])).drop(n["s"], n["c"])
              .withColumn(n["share"], (c["ahead"] + in_cell - 0.5) / c["size"])
              .withColumn(n["bucket"], F.floor(c["share"] * buckets).cast("long")))
    upto = Window.orderBy(n["c"]).rowsBetween(Window.unboundedPreceding, -1)
    starts = written(ranked.groupBy(c["bucket"].alias(n["c"])).agg(F.count("*").alias(n["size"]))
                     .select(n["c"], F.coalesce(F.sum(n["size"]).over(upto), F.lit(0)).alias(n["before"])), "starts")
    in_bucket = F.row_number().over(Window.partitionBy(n["bucket"]).orderBy(n["share"], "source", *order))
    placed = (ranked.join(small(starts), c["bucket"] == c["c"]).withColumn(n["pos"], c["before"] + in_bucket - 1)
              .withColumn(n["s"], F.floor(c["pos"] * shards / F.lit(max(total, 1))).cast("int")))
    carried = [F.col(f"`{x}`") for x in docs.columns if x.lower() not in RESULTS]
    return placed.select(*carried, F.lit("rows").alias("law"), c["s"].alias("shard"),
                         (c["pos"] - F.ceil(c["s"] * F.lit(total).cast("long") / F.lit(shards))).cast("long").alias("slot"),
                         F.lit(None).cast("int").alias("grown_shard"))
