"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source should be taken target / source_size times: a whole number of
copies plus one more with a fractional probability.  Two documents at a time exchange
probability mass, weighed by their sizes so that the words expected from the pair stay the
same, until one of the two probabilities is 0 or 1; which way the mass goes is drawn such
that neither document's expectation changes.  Tasks round the documents of one bucket and
leave at most one open document per source and bucket; these residuals are combined through
a reduction tree of fixed fan-in, until one per source is left and drawn by itself.  A
source's taken words so differ from its target by less than one document.

Draws come from hashes of the documents, so reruns agree whatever the partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meritflow.llm.common import fresh, mix64, small, small_batches, tidy, words, written

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
FAN_IN = 256


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size, n_rows, source_no, target from (source, source_size, n_rows).

    One row per source.  Sources by code point, null last, get the weights in turn.  With
    the sources ordered by the level at which they reach their limit, the level that
    exhausts the total is found with running sums: every source below it is at its limit,
    the others get the level times their weight.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_level = Window.orderBy("limit_level", "source_no")
    upto = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    most = (F.lit(max_repeats) * F.col("source_size")).cast("double")
    left = F.col("total") - F.coalesce(F.sum(most).over(upto), F.lit(0.0))
    weight_left = F.col("weights") - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    return (sizes.withColumn("source_no", (F.row_number().over(by_name) - 1).cast("long"))
            .withColumn("weight", w)
            .withColumn("limit_level", most / F.col("weight"))
            .withColumn("total", F.sum("source_size").over(everything).cast("double"))
            .withColumn("weights", F.sum("weight").over(everything))
            .withColumn("level", left / F.greatest(weight_left, F.col("weight")))
            .withColumn("level", F.max(F.when(F.col("level") <= F.col("limit_level"), F.col("level"))).over(everything))
            .withColumn("target", F.least(most, F.coalesce("level", "limit_level") * F.col("weight")))
            .select("source", "source_size", "n_rows", "source_no", "target"))


def _exchange(p: np.ndarray, size: np.ndarray, draw: np.ndarray) -> None:
    """Round probabilities in place by pairing neighbours until at most one is open.

    Each round pairs the open documents; one of each pair becomes 0 or 1.
    """
    open_ = np.flatnonzero((p > 0.0) & (p < 1.0))
    turn = 0
    while len(open_) > 1:
        k = len(open_) // 2
        a, b = open_[0:2 * k:2], open_[1:2 * k:2]
        pa, pb, sa, sb = p[a], p[b], size[a].astype(float), size[b].astype(float)
        # words that can move from b to a, and from a to b
        up, down = np.minimum((1 - pa) * sa, pb * sb), np.minimum(pa * sa, (1 - pb) * sb)
        u = (mix64(draw[a] ^ mix64(draw[b] + np.uint64(turn))) >> np.uint64(11)).astype(float) / 2.0**53
        gain = np.where(u * (up + down) < down, up, -down)
        na, nb = pa + gain / sa, pb - gain / sb
        # the bound that was reached is set exactly
        plus = gain == up
        na = np.where(plus & (up == (1 - pa) * sa), 1.0, np.where(~plus & (down == pa * sa), 0.0, na))
        nb = np.where(plus & (up == pb * sb), 0.0, np.where(~plus & (down == (1 - pb) * sb), 1.0, nb))
        p[a], p[b] = np.clip(na, 0.0, 1.0), np.clip(nb, 0.0, 1.0)
        rest = open_[2 * k:]
        both = np.stack([a, b], axis=1).ravel()
        open_ = np.concatenate([both[(p[both] > 0.0) & (p[both] < 1.0)], rest])
        turn += 1


def _level(rows: DataFrame, group: str, n: dict[str, str]) -> DataFrame:
    """Round the rows of each (group, source); at most one of them stays open.

    Rows are streamed in a fixed order, and one group of one source is held at a time, so
    that the outcome does not depend on how Spark cuts partitions and batches.
    """
    p_, keys = n["p"], [group, n["source_no"]]
    names = rows.columns

    def settle(t: pa.Table) -> Iterator[pa.RecordBatch]:
        p = t[p_].to_numpy().copy()
        size, draw = t[n["size"]].to_numpy(), t[n["draw"]].to_numpy().view(np.uint64)
        starts = _starts(t)
        for i, j in zip(starts, np.r_[starts[1:], len(p)], strict=True):
            _exchange(p[i:j], size[i:j], draw[i:j])
        yield from t.set_column(names.index(p_), p_, pa.array(p)).to_batches()

    def _starts(t: pa.Table) -> np.ndarray:
        code = np.stack([t[k].to_numpy() for k in keys], axis=1)
        return np.flatnonzero(np.r_[True, (code[1:] != code[:-1]).any(axis=1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([*held, b])
            last = int(_starts(t)[-1])
            if last:
                yield from settle(t.slice(0, last))
            held = t.slice(last).to_batches()
        if held:
            yield from settle(pa.Table.from_batches(held))
        tidy()

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, group).sortWithinPartitions(*keys, n["draw"], n["size"]).mapInArrow(run, rows.schema)


def _mixed(docs: DataFrame, size: Column | None, weights: tuple[int, ...], max_repeats: int,
           rows_per_bucket: int) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with working columns for size, source_size, target and copies."""
    n = fresh(docs, "source_no", "whole", "p", "draw", "bucket", "size", "source_size", "target", "src", "copies",
              "at", "of", "drawn")
    c = {k: F.col(v) for k, v in n.items()}
    small_batches(docs.sparkSession)
    sized = docs.withColumn(n["size"], words(F.col("text")) if size is None else size)
    goal = written(targets(sized.groupBy("source").agg(
        F.sum(n["size"]).alias("source_size"), F.count("*").alias("n_rows")), weights, max_repeats), "targets")
    buckets = max(1, -(-(goal.agg(F.sum("n_rows")).first()[0] or 0) // rows_per_bucket))
    ratio = F.when(c["size"] > 0, c["target"] / c["source_size"]).otherwise(0.0)
    known = [F.col(x) for x in docs.columns if x in ("doc_id", "text")]
    rows = (sized.join(small(goal.select(F.col("source").alias(n["src"]), F.col("source_size").alias(n["source_size"]),
                                         F.col("target").alias(n["target"]), F.col("source_no").alias(n["source_no"]))),
                       F.col("source").eqNullSafe(c["src"])).drop(n["src"])
            .withColumn(n["whole"], F.floor(ratio).cast("long"))
            .withColumn(n["p"], ratio - F.floor(ratio))
            .withColumn(n["draw"], F.xxhash64(F.lit(20260101), *known))
            .withColumn(n["bucket"], F.pmod(c["draw"], F.lit(buckets)).cast("long")))
    open_ = (c["p"] > 0) & (c["p"] < 1)
    # the tree works on the open documents, known by source and bucket, not on their texts
    tree = _level(rows.select(*[n[x] for x in ("bucket", "source_no", "p", "draw", "size")]), n["bucket"], n).where(open_)
    span = 1
    while span == 1 or span < buckets:
        span *= FAN_IN
        tree = _level(tree.withColumn("up", F.floor(c["bucket"] / span).cast("long")), "up", n).drop("up")
    chance = F.pmod(F.xxhash64(F.lit(7), c["draw"]), F.lit(1 << 40)) / float(1 << 40)
    settled = written(tree.select(c["bucket"].alias(n["at"]), c["source_no"].alias(n["of"]), F.when(
        open_, (chance < c["p"]).cast("long")).otherwise(c["p"].cast("long")).alias(n["drawn"])), "settled")
    out = _level(rows, n["bucket"], n).join(
        small(settled), (c["bucket"] == c["at"]) & (c["source_no"] == c["of"]) & open_, "left")
    return out.withColumn(n["copies"], c["whole"] + F.when(open_, c["drawn"]).otherwise(c["p"].cast("long"))), n


def mix(docs: DataFrame, size: Column | None = None, weights: tuple[int, ...] = WEIGHTS,
        max_repeats: int = MAX_REPEATS, rows_per_bucket: int = 4_000) -> DataFrame:
    """``docs`` with size, source_size, target (of its source) and copies, one row per row.

    Sizes count words unless ``size`` says otherwise; a document without any is never taken.
    A null source is a source of its own, after the others.  Fully tied rows are
    interchangeable.  An empty table gives an empty one; input columns named like the
    results are replaced.
    """
    rows, n = _mixed(docs, size, weights, max_repeats, rows_per_bucket)
    results = ("size", "source_size", "target", "copies")
    return rows.select(*[F.col(f"`{x}`") for x in docs.columns if x.lower() not in results],
                       *[F.col(n[x]).alias(x) for x in results])


def repeat(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS,
           rows_per_bucket: int = 4_000) -> DataFrame:
    """The mix itself: every row as often as it is taken, with the columns of ``docs``."""
    rows, n = _mixed(docs, None, weights, max_repeats, rows_per_bucket)
    times = F.sequence(F.lit(1).cast("long"), F.col(n["copies"]))
    return (rows.where(F.col(n["copies"]) > 0).withColumn(n["at"], F.explode(times))
            .select(*[F.col(f"`{x}`") for x in docs.columns]))
