"""AGG3, AGG13, AGG15, WIN1, WIN2, JOIN9: rewards and moving averages.

The moving average s <- a*r + (1-a)*s over a uid's n rewards, starting from s0, equals
    sum_i a * r_i * (1-a)^(n-i)  +  (1-a)^n * s0
so the final score is an aggregation, not a sequential fold.  To keep one busy uid
from landing in one task, rows are first reduced per (uid, block) -- a block is a
time slice such as a day -- and only the small per-block partials are combined per uid.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ScoringConfig
from ..functions.math import exp_decay


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last write wins: one row per key, the one with the largest ``order`` (AGG13).

    A sort aggregate (the kept row is a struct) with map-side partial aggregation: a hot
    key is pre-reduced to one row in every map task before the shuffle.
    """
    others = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in order], F.struct(*[F.col(c) for c in others]).alias("_row"))
    return (df.groupBy(*keys).agg(F.max(packed).alias("_m"))
              .select(*keys, *[F.col("_m._row")[c].alias(c) for c in others]))


def reward(eval_score, process_time, cfg: ScoringConfig = ScoringConfig()) -> Column:
    """eval_mult * eval + time_mult * decay(timeout, process_time) (AGG3)."""
    return (F.lit(cfg.eval_mult) * eval_score
            + F.lit(cfg.time_mult) * exp_decay(cfg.timeout_secs, process_time))


def nan_to_zero(c) -> Column:
    """NaN rewards count as 0 (AGG15)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nanvl(c.cast("double"), F.lit(0.0))


def ema_final(df: DataFrame, key: str | list[str], order: str | list[str], value: str,
              block: Column | str, alpha: float = 0.1, out: str = "score",
              initial: str | None = None, start: DataFrame | None = None) -> DataFrame:
    """Final EMA per key of ``value`` taken in ``order`` (WIN1), starting at ``initial`` (0).

    ``block`` must be monotone in ``order`` (e.g. the day of a timestamp).  ``initial`` names
    a column of ``start``, a table with one row per key: the scores to resume from, of keys
    without new rows too.  Returns (key..., out, n_updates).
    """
    keys = [key] if isinstance(key, str) else list(key)
    order = [order] if isinstance(order, str) else list(order)
    blk = F.col(block) if isinstance(block, str) else block
    one_minus = 1.0 - alpha
    d = df.select(*[F.col(k) for k in keys], blk.alias("_blk"), *[F.col(o) for o in order],
                  nan_to_zero(value).alias("_r"))
    inner = Window.partitionBy(*keys, "_blk").orderBy(*[F.col(o).desc() for o in order])
    # position from the end of the block: 0 for the block's last row
    d = d.withColumn("_back", F.row_number().over(inner) - 1)
    per_block = (d.groupBy(*keys, "_blk")
                   .agg(F.sum(F.lit(alpha) * F.col("_r") * F.pow(F.lit(one_minus), F.col("_back"))).alias("_e"),
                        F.count(F.lit(1)).alias("_c")))
    later = Window.partitionBy(*keys).orderBy(F.col("_blk").asc()).rowsBetween(1, Window.unboundedFollowing)
    per_block = per_block.withColumn("_after", F.coalesce(F.sum("_c").over(later), F.lit(0)))
    res = (per_block.groupBy(*keys)
             .agg(F.sum(F.col("_e") * F.pow(F.lit(one_minus), F.col("_after"))).alias(out),
                  F.sum("_c").alias("n_updates")))
    if initial is None:
        return res
    before = start.select(*[F.col(k) for k in keys], nan_to_zero(initial).alias("_s0"))
    n = F.coalesce(F.col("n_updates"), F.lit(0).cast("bigint"))
    joined = before.join(res, keys, "full")
    return joined.select(*keys, (F.coalesce(F.col(out), F.lit(0.0)) + F.pow(F.lit(one_minus), n)
                                 * F.coalesce(F.col("_s0"), F.lit(0.0))).alias(out), n.alias("n_updates"))


def labelled_only(df: DataFrame, task_type: str = "task_type", labelled: str = "labelled_issue") -> DataFrame:
    """Rows that may move a score: those of labelled tasks (WIN1)."""
    return df.filter(F.col(task_type) == labelled)


# ------------------------------------------------------------------ resets
# A run of a uid's rows, in order, is summed up by its first and last hotkey, the number of
# changes in it, and the count and moving average of the rows since the last change.  Two
# neighbouring runs merge into the summary of both, whatever the grouping (an associative
# segmented scan), so a uid's history is folded where its rows lie and only summaries meet.
_SUMMARY = ("first", "last", "resets", "n", "e")


def _runs(uid: str, hotkey: str, order: list[str], alpha: float, rows: int = 200_000):
    """Summaries of the runs of equal ``uid`` in a task's sorted rows, with the key of their first row."""
    def fold(table: pa.Table) -> Iterator[pa.RecordBatch]:
        codes = [table.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy() for c in (uid, hotkey)]
        fresh = np.r_[True, codes[0][1:] != codes[0][:-1]]
        start = np.flatnonzero(fresh)
        end = np.append(start[1:], len(table))
        change = np.r_[False, codes[1][1:] != codes[1][:-1]] & ~fresh
        i = np.arange(len(table))
        since = np.maximum(np.maximum.reduceat(np.where(change, i, 0), start), start)
        run = np.cumsum(fresh) - 1
        r = table.column("_r").to_numpy()
        part = np.where(i >= since[run], alpha * r * (1.0 - alpha) ** np.minimum(end[run] - 1 - i, 1 << 20), 0.0)
        at, to = pa.array(start), pa.array(end - 1)
        yield pa.RecordBatch.from_arrays(
            [table.column(c).combine_chunks().take(at) for c in (uid, *order)]
            + [table.column(hotkey).combine_chunks().take(x) for x in (at, to)]
            + [pa.array(np.add.reduceat(change.astype(np.int64), start)), pa.array(end - since), pa.array(np.add.reduceat(part, start))],
            [uid, *order, *(f"_{c}" for c in _SUMMARY)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if len(batch):
                held.append(batch)
            if sum(map(len, held)) >= rows:
                yield from fold(pa.Table.from_batches(held))
                held = []
        if held:
            yield from fold(pa.Table.from_batches(held))
    return run


def _merge(alpha: float):
    def merge(a: Column, b: Column) -> Column:
        same = a["last"].eqNullSafe(b["first"])
        whole = same & (b["resets"] == 0)            # b goes on where a's last stretch ends
        return F.struct(
            a["first"].alias("first"), b["last"].alias("last"), (a["resets"] + b["resets"] + F.when(same, 0).otherwise(1)).alias("resets"),
            (b["n"] + F.when(whole, a["n"]).otherwise(F.lit(0))).alias("n"),
            (b["e"] + F.when(whole, a["e"] * F.pow(F.lit(1.0 - alpha), b["n"].cast("double"))).otherwise(0.0)).alias("e"))
    return merge


def ema_with_reset(df: DataFrame, uid: str, order: list[str], hotkey: str, value: str, alpha: float = 0.1,
                   out: str = "score", start: DataFrame | None = None) -> DataFrame:
    """EMA per uid that restarts from 0 whenever the uid's hotkey changes (WIN2, JOIN9).

    ``start`` is a saved state (uid, hotkey, score) to carry on from: a uid whose next row has
    another hotkey starts over, one without new rows keeps its score.  From or to a null
    hotkey is a change like any other.  Returns (uid, hotkey, n_resets, out): the current
    hotkey, how many times the uid changed hands, and the EMA over the current holder's rows.

    ``order`` must tell a uid's rows apart.  Rows are range-partitioned by (uid, order), so a
    busy uid spreads over many tasks; each folds its part to a summary, and a uid's
    summaries, at most a few a task, are merged in order.
    """
    rows = df.select(F.col(uid), *[F.col(c) for c in order], F.col(hotkey), nan_to_zero(value).alias("_r"))
    rows = rows.withColumn("_r", F.coalesce("_r", F.lit(0.0)))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    keys = ", ".join(f"`{c}` {kind[c]}" for c in (uid, *order))
    parts = (rows.repartitionByRange(uid, *order).sortWithinPartitions(uid, *order)
             .mapInArrow(_runs(uid, hotkey, order, alpha),
                         f"{keys}, _first {kind[hotkey]}, _last {kind[hotkey]}, _resets bigint, _n bigint, _e double"))
    parts = parts.select(F.col(uid), F.struct(F.lit(1).alias("new"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)]).alias("at"),
                         F.struct(*[F.col(f"_{c}").alias(c) for c in _SUMMARY]).alias("run"))
    if start is not None:
        at = F.struct(F.lit(0).alias("new"), *[F.lit(None).cast(kind[c]).alias(f"o{i}") for i, c in enumerate(order)])
        held = F.struct(F.col(hotkey).alias("first"), F.col(hotkey).alias("last"), F.lit(0).cast("long").alias("resets"),
                        F.lit(0).cast("long").alias("n"), F.coalesce(nan_to_zero(F.col(out)), F.lit(0.0)).alias("e"))
        parts = parts.unionByName(start.select(F.col(uid), at.alias("at"), held.alias("run")))
    runs = F.transform(F.sort_array(F.collect_list(F.struct("at", "run"))), lambda x: x["run"])
    got = parts.groupBy(uid).agg(runs.alias("_runs")).select(
        F.col(uid), F.aggregate(F.slice("_runs", F.lit(2), F.size("_runs")), F.get("_runs", F.lit(0)), _merge(alpha)).alias("_run"))
    return got.select(F.col(uid), F.col("_run.last").alias(hotkey), F.col("_run.resets").alias("n_resets"), F.col("_run.e").alias(out))
