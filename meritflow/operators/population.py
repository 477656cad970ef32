"""Population operators: eligibility, request gating, priority, stake sampling.

FLT1, FLT3, FLT4, FLT9-11, JOIN1-2, JOIN8, JOIN12, SET2-3, TOP2-5, AGG9, AGG16.
Population tables hold one row per uid (a dimension).  Joins of a fact table to the
population are left to AQE: it broadcasts the population when its runtime size is under
the broadcast threshold and falls back to a sort-merge join (with skew splitting) above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import PopulationConfig
from .summaries import attach, quantiles


def eligible(df: DataFrame, cfg: PopulationConfig = PopulationConfig()) -> DataFrame:
    """Serving, and not a validator holding more than the stake limit (FLT1)."""
    permit = F.coalesce(F.col("validator_permit"), F.lit(False))
    big = F.coalesce(F.col("stake"), F.lit(0.0)) > F.lit(float(cfg.vpermit_tao_limit))
    return df.filter(F.coalesce(F.col("is_serving"), F.lit(False)) & ~(permit & big))


# The reasons a request's caller is told, as the modelled gate words them.
REASON_MISSING = "Missing dendrite or hotkey"
REASON_UNKNOWN = "Unrecognized hotkey"
REASON_NO_PERMIT = "Non-validator hotkey"
REASON_ACCEPTED = "Hotkey recognized!"


def gate_requests(requests: DataFrame, registered: DataFrame,
                  cfg: PopulationConfig = PopulationConfig(),
                  extra_rules: list[tuple[Column, str]] | None = None) -> DataFrame:
    """Blacklist decision per request, rules in order (FLT3).

    missing caller -> blocked; caller not registered (unless allowed) -> blocked;
    permit required and absent -> blocked; then any ``extra_rules`` (condition, reason)
    supplied by the user (UDF3 hook); else accepted.  ``requests`` needs
    ``caller_hotkey``; ``registered`` needs (hotkey, uid, validator_permit).
    """
    first = F.min(F.struct("uid", "validator_permit", "stake"))       # a hotkey listed twice: its smallest uid
    reg = (registered.groupBy(F.col("hotkey").alias("_hk")).agg(first.alias("_m"))
           .select("_hk", F.col("_m.uid").alias("caller_uid"), F.col("_m.validator_permit").alias("validator_permit"),
                   F.col("_m.stake").alias("caller_stake")))
    d = requests.join(reg, requests["caller_hotkey"] == reg["_hk"], "left").drop("_hk")
    missing = F.col("caller_hotkey").isNull()
    unknown = F.col("caller_uid").isNull()
    verdict = (F.when(missing, F.struct(F.lit(True).alias("blocked"), F.lit(REASON_MISSING).alias("reason")))
                .when(unknown & F.lit(not cfg.allow_non_registered),
                      F.struct(F.lit(True).alias("blocked"), F.lit(REASON_UNKNOWN).alias("reason")))
                .when(F.lit(cfg.force_validator_permit) & ~F.coalesce(F.col("validator_permit"), F.lit(False)),
                      F.struct(F.lit(True).alias("blocked"), F.lit(REASON_NO_PERMIT).alias("reason"))))
    for cond, reason in extra_rules or []:
        verdict = verdict.when(cond, F.struct(F.lit(True).alias("blocked"), F.lit(reason).alias("reason")))
    verdict = verdict.otherwise(F.struct(F.lit(False).alias("blocked"), F.lit(REASON_ACCEPTED).alias("reason")))
    return d.withColumn("_v", verdict).select(*requests.columns, "caller_uid", "caller_stake",
                                              F.col("_v.blocked").alias("blocked"), F.col("_v.reason").alias("reason"))


def priority(gated: DataFrame, partition: str = "round", tiebreak: str = "event_id",
             block: int = 1 << 16, value: Column | None = None) -> DataFrame:
    """Priority of a request, served high first (TOP5): by default its caller's stake, 0.0
    when there is no known caller; ``value`` is the user's own (UDF3 hook)."""
    value = F.col("caller_stake") if value is None else value
    return serve_ranks(gated.withColumn("priority", F.coalesce(value, F.lit(0.0))), partition, tiebreak, block)


def serve_ranks(rows: DataFrame, partition: str, tiebreak: str, block: int = 1 << 16) -> DataFrame:
    """``rows`` with ``serve_rank``, the exact position in (priority desc, tiebreak asc) order
    within the partition, computed without sorting a whole partition in one task:
      rank = #rows with higher priority                 (window over distinct priorities,
                                                           at most one per caller)
           + #rows with equal priority in earlier blocks (window over tiebreak blocks)
           + position inside the block                   (at most ``block`` rows)
    ``tiebreak`` must be a unique integer id.  The rows are read twice.
    """
    d = rows.withColumn("_blk", F.floor(F.col(tiebreak) / F.lit(block)).cast("bigint"))
    counts = d.groupBy(partition, "priority", "_blk").agg(F.count(F.lit(1)).alias("_nb"))
    earlier = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per_p = counts.groupBy(partition, "priority").agg(F.sum("_nb").alias("_np"))
    per_p = per_p.withColumn("_above", earlier(Window.partitionBy(partition).orderBy(F.col("priority").desc()), "_np")).drop("_np")
    per_b = counts.withColumn("_same", earlier(Window.partitionBy(partition, "priority").orderBy("_blk"), "_nb")).drop("_nb")
    per_b = per_b.join(per_p, [partition, "priority"]).withColumn("_before", F.col("_above") + F.col("_same")).drop("_above", "_same")
    local = F.row_number().over(Window.partitionBy(partition, "priority", "_blk").orderBy(F.col(tiebreak)))
    return (d.withColumn("_local", local).join(per_b, [partition, "priority", "_blk"])
             .withColumn("serve_rank", (F.col("_before") + F.col("_local")).cast("bigint")).drop("_blk", "_before", "_local"))


def top_stake_sample(miners: DataFrame, group: str = "netuid", ok: Column | None = None,
                     cfg: PopulationConfig = PopulationConfig(), seed: str = "0") -> DataFrame:
    """API nodes per group: stake strictly above the (1-n) quantile (AGG9), positive
    validator trust (JOIN8, SET2), answered the ping (FLT4); at most ``max_api_nodes`` of
    them by a seeded hash order (TOP2).

    The quantile is selected without sorting a group; the last window is over the hash, and
    each task passes on ``max_api_nodes`` rows a group to it."""
    ok = ok if ok is not None else F.col("is_serving")
    d = attach(miners, quantiles(miners, group, "stake", lambda m: F.lit(1.0 - cfg.top_stake_fraction), "_q"), group)
    cand = d.filter((F.col("stake") > F.col("_q")) & (F.col("validator_trust") > 0) & ok)
    w = Window.partitionBy(group).orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col("uid").cast("string"))))
    return (cand.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= cfg.max_api_nodes)
                .select(group, "uid", "stake"))


def sample_with_topup(available: DataFrame, excluded: DataFrame, k: int, group: str = "netuid",
                      seed: str = "0") -> DataFrame:
    """k uids per group, non-excluded first, topped up from excluded ones (TOP3, JOIN12).

    The order is a seeded hash of the uid, so the sample is reproducible under task retry.
    k is capped at the number available.
    """
    ex = excluded.select("uid").distinct().withColumn("is_excluded", F.lit(True))
    d = available.join(ex, "uid", "left").withColumn("is_excluded", F.coalesce("is_excluded", F.lit(False)))
    w = Window.partitionBy(group).orderBy(F.col("is_excluded").asc(),
                                          F.md5(F.concat_ws(":", F.lit(seed), F.col("uid").cast("string"))))
    return d.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def status_split(df: DataFrame, group: str, ok: Column, call_failed: Column | None = None) -> DataFrame:
    """Count of successful and failed calls per group (FLT4).

    ``call_failed`` marks rows whose whole call raised (no per-uid status): they all
    count as failed, whatever their own status says.
    """
    if call_failed is not None:
        ok = ok & ~F.coalesce(call_failed, F.lit(False))
    ok = F.coalesce(ok, F.lit(False))
    return df.groupBy(group).agg(F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_failed"))


def status_lists(df: DataFrame, group: str, uid: str, ok: Column, call_failed: Column | None = None) -> DataFrame:
    """Distinct uids with and without a successful call per group, sorted (FLT4).

    A uid of a failed call is failed, whatever its own status.  The lists hold a group's
    callers once each: a population, not its calls.
    """
    good = F.coalesce(ok, F.lit(False)) & ~F.coalesce(call_failed if call_failed is not None else F.lit(False), F.lit(False))
    per = df.groupBy(group, uid).agg(F.max(good).alias("_ok"))
    return per.groupBy(group).agg(F.sort_array(F.collect_list(F.when(F.col("_ok"), F.col(uid)))).alias("ok_uids"),
                                  F.sort_array(F.collect_list(F.when(~F.col("_ok"), F.col(uid)))).alias("failed_uids"))


def semi(df: DataFrame, allowed: DataFrame, on) -> DataFrame:
    """Keep rows with a match (FLT10, FLT11, SET2)."""
    return df.join(allowed, on, "left_semi")


def anti(df: DataFrame, blocked: DataFrame, on) -> DataFrame:
    """Keep rows without a match (SET3)."""
    return df.join(blocked, on, "left_anti")


def total_stake(stake_map: Column, zero: Column | None = None) -> Column:
    """Sum of a coldkey -> stake map (AGG16); ``zero`` sets the type of the sum."""
    return F.aggregate(F.map_values(stake_map), F.lit(0.0) if zero is None else zero, lambda acc, x: acc + x)


def default_stake(stake_map: Column, coldkey: Column, amount: Column | float = 0.0) -> Column:
    """The map itself, or one entry for the coldkey where there is none (AGG16)."""
    return F.coalesce(stake_map, F.create_map(coldkey, amount if isinstance(amount, Column) else F.lit(amount)))


def epoch_due(block: Column, last_update: Column, step: Column,
              cfg: PopulationConfig = PopulationConfig(), disabled: bool = False,
              is_miner: Column | None = None) -> Column:
    """Whether weights are due: more than epoch_length blocks since the last update,
    not at step 0, not disabled, not for miners (FLT9)."""
    c = ((block - last_update) > F.lit(cfg.epoch_length)) & (step != 0) & F.lit(not disabled)
    if is_miner is not None:
        c = c & ~is_miner
    return c


def pick_per_step(steps: DataFrame, options: DataFrame, step: str, option_idx: str, n_options: int | None = None,
                  seed: str = "0", broadcast_rows: int = 100_000) -> DataFrame:
    """One option per step, chosen by a seeded hash of the step (TOP4).

    ``options`` is numbered 0..n_options-1 in ``option_idx``; without ``n_options`` they are
    counted.  They are broadcast if there are at most ``broadcast_rows``, else joined by a
    shuffle.  The hash is the first 32 bits of md5('<seed>:<step>'), so the choice is
    reproducible under task retry (unlike ``rand()``) and in other engines.
    """
    n = options.count() if n_options is None else n_options
    if n < 1:
        raise ValueError("no options to pick from")
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(step).cast("string"))), 1, 8), 16, 10)
    pick = F.pmod(h.cast("bigint"), F.lit(n)).cast(options.schema[option_idx].dataType)
    side = F.broadcast(options) if n <= broadcast_rows else options
    return steps.withColumn(option_idx, pick).join(side, option_idx, "left")


def zip_parallel(df: DataFrame, *arrays: str) -> DataFrame:
    """Parallel lists (uids, patches, times, ...) as one row per position (JOIN7)."""
    keep = [c for c in df.columns if c not in arrays]
    return (df.select(*keep, F.posexplode(F.arrays_zip(*[F.col(a) for a in arrays])).alias("pos", "_z"))
              .select(*keep, "pos", *[F.col("_z")[a].alias(a) for a in arrays]))


def within_tolerance(a, b, tol: float) -> Column:
    """|a - b| <= tol, symmetric (FLT13)."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.abs(a - b) <= F.lit(tol)


def require_nonempty(df: DataFrame, message: str) -> DataFrame:
    """Fail the job when ``df`` has no rows (FLT7); a cheap ``isEmpty`` probe, then the
    DataFrame itself is returned for further composition."""
    if df.isEmpty():
        raise ValueError(message)
    return df
