"""Time-based operators: JOIN10 deadline join, DAT1/STM4 TTL hold, STM5 epoch trigger.

Interval conditions are turned into equi-joins on time buckets as wide as the interval,
so no key ever pairs all its rows: a request only meets responses of its own bucket
(via a bounded window) and the first response of the next bucket (via an aggregate).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.math import block_number, epoch_us, floor_div, ttl_bucket
from .summaries import attach


def deadline_join(req: DataFrame, resp: DataFrame, key: str, deadline_secs: float = 1800.0,
                  ok_code: int = 200, late_code: int = 408) -> DataFrame:
    """First response with ``req.ts <= resp.ts < req.ts + deadline`` per request (JOIN10).

    ``req``: (req_id, key, ts); ``resp``: (resp_id, key, ts).  Returns
    (req_id, resp_id, status_code): ``ok_code`` with the first in-time response,
    ``late_code`` and NULL when none arrived before the deadline (exactly at the
    deadline is late).
    """
    d_us = int(deadline_secs * 1_000_000)
    rq = req.select("req_id", key, epoch_us("ts").alias("_t")).withColumn("_b", floor_div("_t", d_us))
    rs = resp.select("resp_id", key, epoch_us("ts").alias("_t")).withColumn("_b", floor_div("_t", d_us))
    # same bucket: first response at or after the request, by a window bounded to one bucket
    both = (rq.select("req_id", key, "_t", "_b", F.lit(None).cast("bigint").alias("resp_id"), F.lit(0).alias("_side"))
              .unionByName(rs.select(F.lit(None).cast("bigint").alias("req_id"), key, "_t", "_b", "resp_id",
                                     F.lit(1).alias("_side"))))
    w = (Window.partitionBy(key, "_b").orderBy("_t", "_side", "resp_id")
               .rowsBetween(Window.currentRow, Window.unboundedFollowing))
    nxt = F.min(F.when(F.col("_side") == 1, F.struct(F.col("_t"), F.col("resp_id")))).over(w)
    same = (both.withColumn("_same", nxt).filter(F.col("_side") == 0)
                .select("req_id", key, "_t", "_b", "_same"))
    # next bucket: its first response
    first_next = (rs.groupBy(key, "_b").agg(F.min(F.struct(F.col("_t"), F.col("resp_id"))).alias("_next"))
                    .withColumn("_b", F.col("_b") - 1))
    j = same.join(first_next, [key, "_b"], "left")
    cand = F.coalesce(F.col("_same"), F.col("_next"))
    in_time = cand.isNotNull() & (cand["_t"] < F.col("_t") + F.lit(d_us))
    return j.select("req_id",
                    F.when(in_time, cand["resp_id"]).alias("resp_id"),
                    F.when(in_time, F.lit(ok_code)).otherwise(F.lit(late_code)).alias("status_code"))


def ttl_hold(df: DataFrame, key: str, ts: str, value: str, ttl_seconds: float = 12.0,
             order: list[str] | None = None) -> DataFrame:
    """Each row sees the value of the first row of its (key, TTL bucket) (STM4, DAT1).

    A non-positive TTL means 65536 s.  Adds ``bucket`` and ``held_value``.
    """
    b = ttl_bucket(ts, ttl_seconds)
    order = order or [ts]
    w = Window.partitionBy(key, "bucket").orderBy(*[F.col(o) for o in order])
    return (df.withColumn("bucket", b)
              .withColumn("held_value", F.first(F.col(value)).over(w.rowsBetween(Window.unboundedPreceding, 0))))


def epoch_triggers(df: DataFrame, key: str, ts: str, id_col: str, epoch_blocks: int = 100,
                   block_seconds: int = 12, slice_blocks: int = 65_536) -> DataFrame:
    """Greedy trigger per key: the first row sets the mark; a later row fires when more than
    ``epoch_blocks`` blocks passed since the mark, and moves the mark (STM5 batch twin).

    One algorithm for every key, null included, in tasks of bounded size.  Only the first
    row of a (key, block) can fire, so rows are first reduced to those.  Time is cut into
    slices of ``slice_blocks`` blocks.  What a slice does depends only on the least block
    that may fire in it, which before the key's first slice is one of ``epoch_blocks + 1``
    values: each slice is summed up as a step function from that block to the mark it leaves
    behind, a key's few functions are folded in order, and each slice then marks its rows
    from the mark it gets.  Returns (key, id_col, block, due).
    """
    gap = epoch_blocks + 1
    ev = df.select(F.col(key).alias("k"), F.col(id_col).alias("id"), epoch_us(ts).alias("t"),
                   block_number(ts, block_seconds).cast("bigint").alias("block"))
    first = (ev.groupBy("k", "block").agg(F.min(F.struct("t", "id"))["id"].alias("id"))
               .withColumn("slice", floor_div("block", slice_blocks)))
    # at most slice_blocks rows a group
    slices = first.groupBy("k", "slice").agg(F.sort_array(F.collect_list(F.struct("block", "id"))).alias("rows"))
    tables = slices.select("k", "slice", _slice_exits(gap, slice_blocks)("slice", "rows.block").alias("x"))
    # one small row a slice; a key has one for every slice of time that it was seen in
    folded = (tables.groupBy("k").agg(F.sort_array(F.collect_list(F.struct(
        "slice", F.col("x.own").alias("own"), F.arrays_zip("x.at", "x.exit").alias("steps")))).alias("xs")))
    start = F.struct(F.lit(None).cast("bigint").alias("mark"), F.array().cast("array<bigint>").alias("marks"))

    def step(acc, x):
        mark = acc["mark"]
        fires = F.get(F.filter(x["steps"], lambda s: s["at"] >= mark + gap), F.lit(0))
        left = F.coalesce(fires["exit"], mark)
        now = F.when(mark.isNull(), x["own"]).otherwise(left)
        return F.struct(now.alias("mark"), F.concat(acc["marks"], F.array(mark)).alias("marks"))

    marks = folded.select("k", F.inline(F.arrays_zip(
        F.transform("xs", lambda x: x["slice"]).alias("slice"), F.aggregate("xs", start, step)["marks"].alias("mark"))))
    here = slices.join(marks, slices["k"].eqNullSafe(marks["k"]) & (slices["slice"] == marks["slice"])).select(
        F.explode(_fired(gap)("rows.block", "rows.id", "mark")).alias("id"))
    return (ev.join(here.withColumn("due", F.lit(True)), "id", "left")
              .select(F.col("k").alias(key), F.col("id").alias(id_col), "block", F.coalesce("due", F.lit(False)).alias("due")))


def _next(blocks: np.ndarray, gap: int) -> np.ndarray:
    """Position of the first block at least ``gap`` after each, or the length."""
    return np.searchsorted(blocks, blocks + gap)


def _slice_exits(gap: int, width: int):
    """(slice, sorted blocks) -> own: the mark left if the slice is its key's first; at, exit:
    the mark left when the least block that may fire is at most ``at``, for ascending ``at``.
    No block from before can hold back more than ``gap`` blocks of the slice."""
    @F.pandas_udf("struct<own: bigint, at: array<bigint>, exit: array<bigint>>")
    def exits(no: pd.Series, blocks: pd.Series) -> pd.DataFrame:
        own, at, left = [], [], []
        for n, b in zip(no, blocks, strict=True):
            b = np.asarray(b, np.int64)
            last = np.arange(len(b))
            nxt = _next(b, gap)
            for i in np.flatnonzero(nxt < len(b))[::-1]:
                last[i] = last[nxt[i]]
            m = int(np.searchsorted(b, n * width + gap)) + 1
            own.append(b[last[0]])
            at.append(b[:m])
            left.append(b[last[:m]])
        return pd.DataFrame({"own": own, "at": at, "exit": left})

    return exits


def _fired(gap: int):
    """(sorted blocks, their ids, mark on entry) -> ids that fire."""
    @F.pandas_udf("array<bigint>")
    def fired(blocks: pd.Series, ids: pd.Series, mark: pd.Series) -> pd.Series:
        out = []
        for b, row, m in zip(blocks, ids, mark, strict=True):
            b = np.asarray(b, np.int64)
            nxt, at = _next(b, gap), []
            i = int(nxt[0]) if pd.isna(m) else int(np.searchsorted(b, int(m) + gap))
            while i < len(b):
                at.append(i)
                i = int(nxt[i])
            out.append(np.asarray(row)[at])
        return pd.Series(out)

    return fired


def recent_duplicates(df: DataFrame, keys: list[str], ts: str, id_col: str, window_seconds: int) -> DataFrame:
    """(keys..., id_col, accepted): a row is accepted unless its keys were accepted less than
    ``window_seconds`` before, in whole seconds; a rejected row does not extend the wait (STM10).

    The batch twin of ``stateful.recent_duplicates_stream``: accepted rows are a key's first
    and those that ``epoch_triggers`` fires.  Of rows in the same second the first by id counts.
    """
    packed = df.select(*keys, F.struct(*keys).alias("_key"), F.col(id_col), F.date_trunc("second", ts).alias("_ts"))
    due = epoch_triggers(packed, "_key", "_ts", id_col, window_seconds - 1, 1, 1 << 22)
    first = packed.groupBy("_key").agg(F.min(F.struct("_ts", id_col))[id_col].alias("_first"))
    both = attach(due, first, "_key")
    return both.select(*[F.col("_key")[k].alias(k) for k in keys], id_col,
                       (F.col("due") | (F.col(id_col) == F.col("_first"))).alias("accepted"))
