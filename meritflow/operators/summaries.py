"""Per-group summaries that merge: counts, sums, bounded largest values, exact quantiles.

A group (a league) may hold any share of the rows.  Nothing here sorts or gathers one:
every task folds its rows into a bounded summary, summaries are merged, and one row per
group is joined back to the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written


def attach(rows: DataFrame, per_group: DataFrame, group: str, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of their group's row; a null group is a group."""
    key = "_group"
    other = per_group.withColumnRenamed(group, key)
    return rows.join(other, rows[group].eqNullSafe(other[key]), how).drop(key)


def with_totals(rows: DataFrame, group: str, **totals: Column) -> DataFrame:
    """``rows`` with aggregates over their group, as ``sum(...).over(group)`` would give."""
    per = rows.groupBy(group).agg(*[c.alias(n) for n, c in totals.items()])
    return attach(rows, per, group)


# ------------------------------------------------------------------ largest values
def _fold(group: str, value: str, k: int, flush: int = 100_000):
    """(group, n, total, top) of a task's rows: how many, their sum, the k largest."""
    def largest(parts: list[pd.DataFrame]) -> pd.DataFrame:
        every = pd.concat(parts, ignore_index=True).sort_values(value, ascending=False, kind="stable")
        return every.groupby(group, dropna=False, sort=False).head(k)

    def out(top: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        lists = top.groupby(group, dropna=False, sort=False)[value].apply(list).rename("top").reset_index()
        return sums.merge(lists, on=group)[[group, "n", "total", "top"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top = sums = None
        for pdf in batches:
            if not len(pdf):
                continue
            part = pdf.groupby(group, dropna=False, sort=False)[value].agg(n="size", total="sum").reset_index()
            top = largest([pdf] if top is None else [top, pdf])
            sums = part if sums is None else (pd.concat([sums, part]).groupby(group, dropna=False, sort=False)[["n", "total"]]
                                              .sum().reset_index())
            if len(sums) > flush:                    # many groups: pass on what was folded so far
                yield out(top, sums)
                top = sums = None
        if sums is not None:
            yield out(top, sums)
    return run


def largest_values(rows: DataFrame, group: str, value: str, k: int) -> DataFrame:
    """(group, n, total, top): count, sum and the ``k`` largest of a group's values, descending.

    Tasks pass on k values a group, so the merged row of a group is bounded by k times the
    number of tasks whatever the group's size.  Values must not be null.
    """
    two = rows.select(F.col(group), F.col(value).cast("double").alias(value))
    kind = two.schema[group].dataType.simpleString()
    parts = two.mapInPandas(_fold(group, value, k), f"`{group}` {kind}, n bigint, total double, top array<double>")
    top = F.sort_array(F.flatten(F.collect_list("top")), asc=False)
    return parts.groupBy(group).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.slice(top, 1, k).alias("top"))


# ------------------------------------------------------------------ exact quantiles
def _bin(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    # finite, and scaled down where the width would overflow: lo and hi never share a bin
    scale = F.when(F.greatest(F.abs(lo), F.abs(hi)) > 1e300, 0.25).otherwise(1.0)
    v, lo, hi = (F.greatest(F.least(x, F.lit(1.7e308)), F.lit(-1.7e308)) * scale for x in (v, lo, hi))
    part = (v - lo) / (hi - lo)
    return F.least(F.floor(part * bins), F.lit(bins - 1)).cast("int")


def quantiles(rows: DataFrame, group: str, value: str, fraction: Callable[[Column], Column], out: str, bins: int = 1_024,
              few: int = 4_096) -> DataFrame:
    """(group, out): the linearly interpolated quantile of each group, numpy's default.

    ``fraction`` gives a group's fraction from the number of its values, so it may differ from
    group to group.  Null and NaN values do not count; a group without others has no row.

    The value at a rank is found by refining histograms: the values between the bounds are
    counted into ``bins`` of equal width, the bin that holds the rank gives the next bounds,
    and what is left is sorted once it is one value or ``few`` values.  Each round is one
    aggregate that a task reduces to bins * groups rows, so no group is sorted or gathered.
    """
    v = F.col(value).cast("double")
    use = rows.select(F.col(group), (v + 0.0).alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    first = use.groupBy(group).agg(F.count(F.lit(1)).alias("m"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    at = (F.col("m") - 1) * fraction(F.col("m"))
    state = first.withColumns({"h": at, "rank": F.floor(at), "below": F.lit(0).cast("long"), "left": F.col("m")})
    state = written(state, "ranks")
    while True:
        wide = (F.col("left") > few) & (F.col("lo") < F.col("hi"))
        if state.where(wide).isEmpty():
            break
        inside = attach(use, state.where(wide), group).where(F.col("_v").between(F.col("lo"), F.col("hi")))
        histogram = inside.groupBy(group, _bin(F.col("_v"), F.col("lo"), F.col("hi"), bins).alias("bin")).agg(
            F.count(F.lit(1)).alias("c"), F.min("_v").alias("a"), F.max("_v").alias("b"))
        # a group's bins, at most ``bins`` of them, in order
        listed = histogram.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("bin", "c", "a", "b"))).alias("hist"))
        start = F.struct(F.col("below").alias("below"), F.lit(0).cast("long").alias("left"), F.col("lo").alias("lo"),
                         F.col("hi").alias("hi"))

        def walk(acc, x):
            # stay in the bin that holds the rank; until then its predecessors lie below it
            found = acc["left"] > F.lit(0)
            holds = acc["below"] + x["c"] > F.col("rank")
            here = F.struct(acc["below"].alias("below"), x["c"].alias("left"), x["a"].alias("lo"), x["b"].alias("hi"))
            past = F.struct((acc["below"] + x["c"]).alias("below"), acc["left"].alias("left"), acc["lo"].alias("lo"),
                            acc["hi"].alias("hi"))
            return F.when(found, acc).when(holds, here).otherwise(past)

        nxt = attach(state.where(wide), listed, group).withColumn("to", F.aggregate("hist", start, walk))
        nxt = nxt.select(group, "m", F.col("to.lo").alias("lo"), F.col("to.hi").alias("hi"), "h", "rank",
                         F.col("to.below").alias("below"), F.col("to.left").alias("left"))
        state = written(nxt.unionByName(state.where(~wide)), "ranks")
    rest = attach(use, state.where("lo < hi"), group).where(F.col("_v").between(F.col("lo"), F.col("hi")))
    one = F.element_at(F.sort_array(F.collect_list("_v")), (F.first("rank") - F.first("below") + 1).cast("int"))
    low = rest.groupBy(group).agg(one.alias("low")).unionByName(state.where("lo >= hi").select(group, F.col("lo").alias("low")))
    low = attach(state.select(group, "m", "h", "rank"), low, group)
    # the next value up: the same one if it fills the next rank too, else the least above it
    up = attach(use, low, group).groupBy(group).agg(
        F.count_if(F.col("_v") <= F.col("low")).alias("upto"), F.min(F.when(F.col("_v") > F.col("low"), F.col("_v"))).alias("over"),
        F.first("low").alias("low"), F.first("h").alias("h"), F.first("rank").alias("rank"), F.first("m").alias("m"))
    high = F.when((F.col("upto") > F.col("rank") + 1) | (F.col("rank") + 1 >= F.col("m")), F.col("low")).otherwise(F.col("over"))
    return up.select(group, (F.col("low") + (F.col("h") - F.col("rank")) * (high - F.col("low"))).alias(out))
