"""Submission grading: AGG1-2, FLT8, FLT12, JOIN3, SET1, SRC7 semantics, UDF1 registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeResult

from ..functions.nested import mean_array
from ..functions.text import strip_patch_comments
from .scoring import latest_per_key

# fixed values: rubric weights of the float grader
W_CHECKLIST, W_ADDRESSES, W_LOGICAL, W_BREVITY, W_BUGS = 0.2, 0.3, 0.25, 0.05, 0.2
EMPTY_PATCH_SCORE = W_BUGS / (1.0 - W_CHECKLIST)   # bugs=0 on an empty patch -> 0.25


def cleaned_patch(patch) -> Column:
    """NULL patch reads as '' (FLT8); comments of added lines are removed (STR1)."""
    patch = F.col(patch) if isinstance(patch, str) else patch
    raw = F.coalesce(patch, F.lit(""))
    return F.when(raw == "", F.lit("")).otherwise(strip_patch_comments(raw))


def rubric_score(addresses, logical, brevity, bugs, checklist, patch=None) -> Column:
    """Overall score of one rubric (AGG1); empty (cleaned) patches score 0.25 (AGG2).

    Without checklist items the static part is rescaled by 1/(1-0.2); otherwise the
    checklist mean adds 0.2 of weight.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    static = (F.lit(W_ADDRESSES) * col(addresses) + F.lit(W_LOGICAL) * col(logical)
              + F.lit(W_BREVITY) * col(brevity) + F.lit(W_BUGS) * (F.lit(1.0) - col(bugs)))
    cl = col(checklist)
    mean = mean_array(cl)                        # NULL without items
    score = F.when(mean.isNull(), static / F.lit(1.0 - W_CHECKLIST)).otherwise(static + F.lit(W_CHECKLIST) * mean)
    if patch is not None:
        score = F.when(cleaned_patch(patch) == "", F.lit(EMPTY_PATCH_SCORE)).otherwise(score)
    return score


def judgement_valid(a_wins, b_wins, draw) -> Column:
    """Exactly one of the three outcome flags is set (FLT12)."""
    s = sum(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False)).cast("int") for c in (a_wins, b_wins, draw))
    return s == 1


def test_outcomes(results: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep passed/failed outcomes; the last one per (keys, run, test) wins (SRC7)."""
    r = results.filter(F.lower(F.col("status")).isin("passed", "failed")).withColumn("status", F.lower("status"))
    return latest_per_key(r.select(*keys, "run", "test_id", "status", *order), keys + ["run", "test_id"], order)


BUCKETS = ("PASS_TO_PASS", "PASS_TO_FAIL", "FAIL_TO_PASS", "FAIL_TO_FAIL", "NEW_PASS", "NEW_FAIL")


def classify_tests(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Before/after buckets per test (JOIN3, SET1).

    ``after LEFT JOIN before``: tests that vanish after the patch are dropped; a test
    with no before-outcome is NEW_PASS / NEW_FAIL.
    """
    before = outcomes.filter(F.col("run") == "before").select(*keys, "test_id", F.col("status").alias("_b"))
    after = outcomes.filter(F.col("run") == "after").select(*keys, "test_id", F.col("status").alias("_a"))
    j = after.join(before, keys + ["test_id"], "left")
    a, b = F.col("_a"), F.col("_b")
    bucket = (F.when(b.isNull(), F.when(a == "passed", "NEW_PASS").otherwise("NEW_FAIL"))
               .otherwise(F.concat(F.when(b == "passed", "PASS").otherwise("FAIL"), F.lit("_TO_"),
                                   F.when(a == "passed", "PASS").otherwise("FAIL"))))
    return j.select(*keys, "test_id", bucket.alias("bucket"))


def classify_results(results: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Before/after buckets straight from test results (SRC7, JOIN3, SET1): one scan and one
    aggregate, which keeps the last passed/failed status of either run."""
    status = F.lower("status")
    last = lambda run: F.max_by(status, F.when((F.col("run") == run) & status.isin("passed", "failed"),
                                               F.struct(*[F.col(o) for o in order])))
    j = results.groupBy(*keys, "test_id").agg(last("before").alias("_b"), last("after").alias("_a"))
    name = lambda c: F.when(F.col(c) == "passed", "PASS").otherwise("FAIL")
    prefix = F.when(F.col("_b").isNull(), "NEW").otherwise(F.concat(name("_b"), F.lit("_TO")))
    return j.filter(F.col("_a").isNotNull()).select(*keys, "test_id", F.concat(prefix, F.lit("_"), name("_a")).alias("bucket"))


def bucket_counts(classified: DataFrame, keys: list[str]) -> DataFrame:
    return classified.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n_tests"))


# UDF1: graders are functions (submissions, extra) -> scores keyed like the submissions.
GRADERS: dict[str, Callable[..., DataFrame]] = {}


def register_grader(name: str):
    def deco(fn):
        GRADERS[name] = fn
        return fn
    return deco


@register_grader("float")
def float_grader(submissions: DataFrame, rubric: DataFrame, key: list[str]) -> DataFrame:
    """Rubric scores joined to submissions by key -> (key..., score)."""
    j = submissions.join(rubric, key, "inner")
    return j.select(*key, rubric_score("addresses", "logical", "brevity", "bugs", "checklist", "patch").alias("score"))


class RubricFold:
    """Grader as a table function: rubric rows of a submission in, its score out (UDF1).

    Call it on a table partitioned by the submission's key, its first column, and ordered as
    the criteria come: (key, criterion, value, ...).  The criteria are those of
    ``rubric_score``; ``checklist`` rows are averaged, and a row ``empty`` marks an empty patch.
    It is polymorphic: the key keeps the name and type that the argument has.
    """

    @staticmethod
    def analyze(rows):
        key = rows.dataType.fields[0]
        return AnalyzeResult(StructType([key, StructField("score", DoubleType()), StructField("n_rows", LongType())]))

    def __init__(self):
        self.key, self.n, self.items, self.empty = None, 0, [], False
        self.fixed = {"addresses": W_ADDRESSES, "logical": W_LOGICAL, "brevity": W_BREVITY, "bugs": -W_BUGS}
        self.static = W_BUGS

    def eval(self, row):
        self.key, self.n = row[0], self.n + 1
        if row["criterion"] == "checklist":
            self.items.append(row["value"])
        elif row["criterion"] == "empty":
            self.empty = True
        else:
            self.static += self.fixed[row["criterion"]] * row["value"]

    def terminate(self):
        if self.empty:
            score = EMPTY_PATCH_SCORE
        elif self.items:
            score = self.static + W_CHECKLIST * sum(self.items) / len(self.items)
        else:
            score = self.static / (1.0 - W_CHECKLIST)
        if self.n:
            yield self.key, score, self.n


def rubric_rows(rubric: DataFrame, key: str, patch: str = "patch") -> DataFrame:
    """(key, criterion, item, value): one row per criterion and checklist item of each submission."""
    one = [F.struct(F.lit(c).alias("criterion"), F.lit(0).alias("item"), F.col(c).cast("double").alias("value"))
           for c in ("addresses", "logical", "brevity", "bugs")]
    items = F.transform(F.coalesce("checklist", F.array().cast("array<double>")), lambda x, i: F.struct(
        F.lit("checklist").alias("criterion"), i.alias("item"), x.alias("value")))
    empty = F.when(cleaned_patch(patch) == "", F.array(F.struct(F.lit("empty").alias("criterion"), F.lit(0).alias("item"),
                                                               F.lit(0.0).alias("value"))))
    none = F.array().cast("array<struct<criterion: string, item: int, value: double>>")
    return rubric.select(key, F.inline(F.concat(F.array(*one), items, F.coalesce(empty, none))))


@register_grader("rows")
def row_grader(submissions: DataFrame, rubric: DataFrame, key: list[str]) -> DataFrame:
    """Rubric scores folded by ``RubricFold``, a task taking whole submissions -> (key, score)."""
    fold = F.udtf(RubricFold)
    rows = rubric_rows(submissions.join(rubric, key), key[0])
    return fold(rows.asTable().partitionBy(key[0]).orderBy("criterion", "item")).select(key[0], "score")


@register_grader("elo")
def elo_grader(submissions: DataFrame, rubric: DataFrame, key: list[str], problem: str = "round", player: str = "uid",
               order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Elo rating of every submission among those of its problem, the rubric score deciding
    each match -> (problem, player, score)."""
    from .ratings import elo_ratings
    scored = submissions.join(float_grader(submissions, rubric, key), key)
    return elo_ratings(scored, problem, list(order), player, "score").select(problem, player, F.col("rating").alias("score"))


@register_grader("trueskill")
def trueskill_grader(submissions: DataFrame, rubric: DataFrame, key: list[str], league: str = "netuid", rnd: str = "round",
                     player: str = "uid", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """League rating after each round, normalised -> (league, round, player, score)."""
    from .ratings import trueskill_scores
    scored = submissions.join(float_grader(submissions, rubric, key), key)
    return trueskill_scores(scored, league, rnd, list(order), player, "score").select(
        league, rnd, player, F.col("ts_score").alias("score"))
