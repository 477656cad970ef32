"""AGG4-AGG9, FLT14-15, WIN4: from scores to normalised, capped, quantised weights.

A league (netuid) may hold any share of the rows, so none is sorted or windowed: its sums,
counts and largest values are merged from per-task summaries and joined back as one row per
league; see ``summaries``.  NaN weights count as 0 until they are emitted, where they raise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import WeightConfig
from .summaries import attach, largest_values, quantiles, with_totals

_U16 = 65535


def _number(value: str) -> Column:
    return F.nanvl(F.col(value).cast("double"), F.lit(0.0))


def l1_normalise(df: DataFrame, group: str, value: str, out: str = "weight",
                 p: int = 1, eps: float = 1e-12) -> DataFrame:
    """v / max(||v||_p, eps) within each group (AGG4)."""
    v = _number(value)
    power = {1: F.abs(v), 2: v * v}.get(p, F.pow(F.abs(v), float(p)))
    norm = {1: F.col("_norm"), 2: F.sqrt("_norm")}.get(p, F.pow(F.col("_norm"), 1.0 / p))
    d = with_totals(df, group, _norm=F.sum(power))
    return d.withColumn(out, v / F.greatest(norm, F.lit(eps))).drop("_norm")


def blend_scores(df: DataFrame, group: str, closed: str, open_: str, out: str = "raw_weight",
                 closed_pct: float = 1.0, open_pct: float = 0.0, eps: float = 1e-12) -> DataFrame:
    """closed_pct * L1(closed) + open_pct * L1(open) per group (AGG5), from one aggregate."""
    a, b = _number(closed), _number(open_)
    d = with_totals(df, group, _na=F.sum(F.abs(a)), _nb=F.sum(F.abs(b)))
    share = lambda v, n: v / F.greatest(F.col(n), F.lit(eps))
    return d.withColumn(out, share(a, "_na") * closed_pct + share(b, "_nb") * open_pct).drop("_na", "_nb")


def _cut(top: Column, n: Column, total: Column, limit: float, eps: float) -> Column:
    """The value that a group's weights are clipped at, from its largest values.

    With c the share a weight is cut to, c / sum(min(share, c)) grows with c; a weight that
    reaches ``limit`` there has at most 1 / limit others at or above it.  So the weights that
    must be cut are among the largest, and the rest enters by its sum alone.
    """
    # per rank j from the top: the share, how many are above, and what all up to it sum to
    shares = F.transform(top, lambda x: F.try_divide(x, total))
    start = F.struct(F.lit(1.0).alias("upto"), F.lit(0).cast("long").alias("above"), F.lit(False).alias("done"))

    def step(acc, share):
        fits = share / (acc["above"] * share + acc["upto"] + eps) < limit
        here = F.struct(acc["upto"].alias("upto"), acc["above"].alias("above"), F.lit(True).alias("done"))
        past = F.struct((acc["upto"] - share).alias("upto"), (acc["above"] + 1).alias("above"), F.lit(False).alias("done"))
        return F.when(acc["done"] | fits, here).otherwise(past)

    last = F.aggregate(shares, start, step)
    # nothing fits: every weight is cut, and the running sum starts over at the whole
    upto = F.when(last["above"] >= n, F.lit(1.0)).otherwise(last["upto"])
    den = F.lit(1.0) - F.lit(limit) * last["above"]
    return F.try_divide(F.lit(limit) * upto - F.lit(eps), den) * total


def cap_weights(df: DataFrame, group: str, value: str, out: str = "weight",
                limit: float = 0.1, eps: float = 1e-7, largest: str | None = None) -> DataFrame:
    """Normalise so the group sums to 1 and no weight exceeds ``limit`` (AGG6).

    Uniform when the group sums to 0 or n*limit <= 1; plain normalisation when the
    largest share is already within the limit; otherwise every weight is clipped at the
    cutoff that makes the largest weight the limit, then renormalised.  ``largest`` names a
    column for the group's largest weight.  The cutoff comes from each group's count, sum and
    ceil(1 / limit) + 1 largest values.
    """
    d = df.withColumn("_x", _number(value))
    per = largest_values(d, group, "_x", math.ceil(1.0 / limit) + 1)
    n, total, top = F.col("n"), F.col("total"), F.col("top")
    per = per.select(group, n.alias("_n"), total.alias("_S"), F.get(top, F.lit(0)).alias("_max"),
                     F.when((total == 0) | (n * F.lit(limit) <= 1), F.lit("uniform"))
                      .when(F.try_divide(F.get(top, F.lit(0)), total) <= F.lit(limit), F.lit("plain")).otherwise(F.lit("cut")).alias("_how"),
                     _cut(top, n, total, limit, eps).alias("_at"))
    d = attach(d, per, group).withColumn("_clip", F.when(F.col("_how") == "cut", F.least("_x", "_at")).otherwise(F.col("_x")))
    d = with_totals(d, group, _sum=F.sum("_clip"))
    weight = lambda x: (F.when(F.col("_how") == "uniform", F.lit(1.0) / F.col("_n"))
                         .otherwise(F.try_divide(x, F.col("_sum"))))
    most = F.when(F.col("_how") == "cut", F.least("_max", "_at")).otherwise(F.col("_max"))
    if largest:
        d = d.withColumn(largest, weight(most))
    return d.withColumn(out, weight(F.col("_clip"))).drop("_x", "_n", "_S", "_max", "_how", "_at", "_clip", "_sum")


def process_weights(df: DataFrame, group: str, uid: str, value: str, out: str = "weight",
                    cfg: WeightConfig = WeightConfig(), carry: tuple[str, ...] = (), largest: str | None = None) -> DataFrame:
    """Turn raw weights into the weights a validator may publish (AGG7).

    Per group with n uids and m positive weights (weights are first rounded to float32,
    as on chain; NaN is no positive weight):
      * m == 0 or n < min_allowed: uniform 1/n over all uids;
      * m < min_allowed: every uid gets 1e-5 + its positive weight, then capped;
      * otherwise positive weights below the exclusion quantile are dropped and the
        rest is capped.
    Returns (group, uid, out) for the uids that keep a weight, with the ``carry`` columns.
    """
    w32 = F.nanvl(F.col(value).cast("float").cast("double"), F.lit(0.0))
    d = df.select(F.col(group), F.col(uid), *carry, w32.alias("_w"))
    d = with_totals(d, group, _all=F.count(F.lit(1)), _m=F.count_if(F.col("_w") > 0))
    mn = cfg.min_allowed_weights
    few = (F.col("_m") == 0) | (F.col("_all") < mn)
    d = d.withColumn("_case", F.when(few, "a").when(F.col("_m") < mn, "b").otherwise("c"))
    keep = (F.col("_case") != "c") | (F.col("_w") > 0)
    q = float(cfg.exclude_quantile) / _U16
    if q > 0:
        low = quantiles(d.where((F.col("_case") == "c") & (F.col("_w") > 0)), group, "_w",
                        lambda m: F.least(F.lit(q), F.try_divide(F.greatest(m - mn, F.lit(0)), m)), "_low")
        d = attach(d, low, group, "left")
        keep = (F.col("_case") != "c") | ((F.col("_w") > 0) & (F.col("_low") <= F.col("_w")))
    x = (F.when(F.col("_case") == "a", F.lit(1.0)).when(F.col("_case") == "b", F.lit(1e-5) + F.greatest("_w", F.lit(0.0)))
          .otherwise(F.col("_w")))
    kept = d.where(keep).select(group, uid, *carry, x.alias("_raw"))
    capped = cap_weights(kept, group, "_raw", out, limit=cfg.max_weight_limit, eps=cfg.epsilon, largest=largest)
    return capped.select(group, uid, *carry, out, *([largest] if largest else []))


def emit_u16(df: DataFrame, group: str, uid: str, weight: str, out: str = "weight_u16",
             u16_max: int = _U16, largest: str | None = None) -> DataFrame:
    """Scale so the largest weight is ``u16_max``, round half to even, drop zeros (AGG8).

    ``largest`` names a column that holds the group's largest weight already, as
    ``cap_weights`` gives it; else it is aggregated.  A group whose weights are all zero
    emits nothing, as does an empty table.  Negative, missing or NaN weights and negative or
    missing uids cannot be emitted (FLT15) and raise.
    """
    w = F.col(weight).cast("double")
    checked = (F.when((w < 0) | (F.col(uid) < 0), F.raise_error(F.lit("negative weight or uid cannot be emitted")))
                .when(F.isnan(w), F.raise_error(F.lit("a NaN weight cannot be emitted")))
                .when(w.isNull() | F.col(uid).isNull(), F.raise_error(F.lit("every uid needs a weight and every weight a uid")))
                .otherwise(w))
    d = df.withColumn("_w", checked)
    d = d.withColumn("_wmax", F.col(largest)) if largest else with_totals(d, group, _wmax=F.max("_w"))
    value = F.rint(F.try_divide(F.col("_w"), F.col("_wmax")) * F.lit(float(u16_max))).cast("int")
    return d.withColumn(out, value).where((F.col("_wmax") > 0) & (F.col(out) != 0)).drop("_w", "_wmax")


def emit_lists(weights: DataFrame, group: str, uids: str, values: str) -> DataFrame:
    """(group, uid, weight) of parallel lists of uids and weights, one row per group (FLT15).

    Lists of different lengths raise, as does a list without its partner; empty lists give
    no rows.
    """
    n, m = F.size(F.col(uids)), F.size(F.col(values))
    same = F.when(n.eqNullSafe(m) & F.col(uids).isNotNull() & F.col(values).isNotNull(),
                  F.arrays_zip(F.col(uids).alias("uid"), F.col(values).alias("weight")))
    pairs = same.otherwise(F.raise_error(F.lit("weights and uids must have the same length")))
    return weights.select(group, F.inline(pairs)).toDF(group, "uid", "weight")
