"""Registered queries for guards, rejects, lookups and reports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PopulationConfig
from ..functions import math as fm
from ..functions import nested as nst
from ..operators import corpus, cost, grading
from ..operators import population as pop
from ..sources import sinks, views
from ..sources.tables import read_table

K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


def report_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """A JSON test report per event, written and parsed again with a declared schema (SRC7,
    NST1, NST2): statuses are lower-cased, others than passed and failed do not count, and
    the last entry of a test wins."""
    e = read_table(spark, d, "events").select("event_id", "event_type", F.col("user_id").cast("string").alias("u"),
                                              views.prop_k().alias("k"))
    entry = lambda mod, outcome: F.struct(
        F.concat("u", F.lit(":"), F.pmod("k", F.lit(mod)).cast("string")).alias("nodeid"), outcome.alias("outcome"))
    first = F.when(F.col("event_type").isin("click", "purchase"), "passed").when(F.col("event_type") == "error", "FAILED").otherwise("skipped")
    second = F.when(F.pmod("k", F.lit(2)) == 0, "Passed").otherwise("xfail")
    reports = e.select("event_id", F.to_json(F.struct(F.array(entry(10, first), entry(3, second)).alias("tests"))).alias("report"))
    return sinks.test_report_outcomes(reports, ["event_id"]).select("event_id", "test_id", "status")


REPORT_OUTCOMES = f"""
WITH t AS (
  SELECT event_id, 0 AS pos, CAST(user_id AS VARCHAR) || ':' || CAST({K} % 10 AS VARCHAR) AS test_id,
         CASE WHEN event_type IN ('click', 'purchase') THEN 'passed' WHEN event_type = 'error' THEN 'failed' END AS status FROM events
  UNION ALL
  SELECT event_id, 1, CAST(user_id AS VARCHAR) || ':' || CAST({K} % 3 AS VARCHAR),
         CASE WHEN {K} % 2 = 0 THEN 'passed' END FROM events)
SELECT event_id, test_id, arg_max(status, pos) AS status FROM t WHERE status IS NOT NULL GROUP BY event_id, test_id"""


def weights_due(spark: SparkSession, d: str) -> DataFrame:
    """For every order as a step of its customer's neuron: are weights due (FLT9)?"""
    o = read_table(spark, d, "orders")
    due = pop.epoch_due(fm.block_number("o_orderdate", 86_400), F.lit(8_000) + F.pmod("o_custkey", F.lit(1_000)),
                        F.pmod("o_orderkey", F.lit(5)), is_miner=F.col("o_orderpriority") == "1-URGENT")
    return o.select("o_orderkey", due.alias("due"))


WEIGHTS_DUE = """
SELECT o_orderkey, epoch_us(o_orderdate) // 86400000000 - (8000 + o_custkey % 1000) > 100 AND o_orderkey % 5 <> 0
       AND o_orderpriority <> '1-URGENT' AS due FROM orders"""


def _models(spark, d):
    names = cost.model_names()
    li = read_table(spark, d, "lineitem")
    model = F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod("l_partkey", F.lit(len(names))) + 1).cast("int"))
    return li.select("l_orderkey", "l_linenumber", model.alias("model")), names


def allowed_models(spark: SparkSession, d: str) -> DataFrame:
    """Completions per model, by whether the model is on the allow-list: a semi join keeps
    them, an anti join rejects them (FLT10, SET3, AGG over both)."""
    li, names = _models(spark, d)
    allowed = spark.createDataFrame([(n,) for n in names[::2]], "model string")
    kept = pop.semi(li, allowed, "model").withColumn("allowed", F.lit(True))
    out = pop.anti(li, allowed, "model").withColumn("allowed", F.lit(False))
    return kept.unionByName(out).groupBy("model", "allowed").agg(F.count("*").alias("n"))


def _allowed_sql() -> str:
    names = cost.model_names()
    listed = ", ".join(f"'{n}'" for n in names)
    kept = ", ".join(f"'{n}'" for n in names[::2])
    return f"""
WITH m AS (SELECT ([{listed}])[l_partkey % {len(names)} + 1] AS model FROM lineitem)
SELECT model, model IN ({kept}) AS allowed, count(*) AS n FROM m GROUP BY model"""


def judgement_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Judgements with other than one outcome flag set are rejected (FLT12)."""
    k = views.prop_k()
    j = read_table(spark, d, "events").select(
        "event_id", (F.pmod(k, F.lit(3)) == 0).alias("a_wins"), (F.pmod(k, F.lit(5)) == 0).alias("b_wins"),
        F.when(F.pmod(k, F.lit(11)) != 0, F.pmod(k, F.lit(7)) == 0).alias("draw"))
    return j.select("event_id", (~grading.judgement_valid("a_wins", "b_wins", "draw")).alias("rejected"))


JUDGEMENT_REJECTS = f"""
SELECT event_id, CAST({K} % 3 = 0 AS INT) + CAST({K} % 5 = 0 AS INT)
       + CAST(coalesce(CASE WHEN {K} % 11 <> 0 THEN {K} % 7 = 0 END, false) AS INT) <> 1 AS rejected FROM events"""


def close_values(spark: SparkSession, d: str) -> DataFrame:
    """Does an event's value, in seconds, agree with its k in minutes within 1000 s (FLT13, MTH5)?"""
    e = read_table(spark, d, "events")
    close = pop.within_tolerance(F.col("value") * 20.0, fm.minutes_to_seconds(views.prop_k()), 1000.0)
    return e.select("event_id", close.alias("close"))


CLOSE_VALUES = f"SELECT event_id, abs(value * 20.0::DOUBLE - {K} * 60.0::DOUBLE) <= 1000.0 AS close FROM events"


def zipped_responses(spark: SparkSession, d: str) -> DataFrame:
    """A uid's responses of an hour as parallel lists, and back to one row each (JOIN7)."""
    r = views.responses(spark, d)
    lists = r.groupBy("round", "uid").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "score"))).alias("x"))
    lists = lists.select("round", "uid", F.col("x.event_id").alias("event_id"), F.col("x.score").alias("score"))
    return pop.zip_parallel(lists, "event_id", "score").select("round", "uid", "pos", "event_id", "score")


ZIPPED = f"""
SELECT epoch_us(ts) // 3600000000 AS round, user_id AS uid, event_id, {K} / 100.0::DOUBLE AS score,
       CAST(row_number() OVER (PARTITION BY epoch_us(ts) // 3600000000, user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS pos
FROM events"""


def latest_versions(spark: SparkSession, d: str) -> DataFrame:
    """Per brand the part with the highest version, read as a number (AGG12)."""
    p = read_table(spark, d, "part").select(
        "p_brand", "p_name", "p_partkey",
        F.format_string("%d.%06d", F.col("p_size"), F.col("p_partkey")).alias("version"))
    return corpus.latest_version(p, ["p_brand"], "version").select("p_brand", "p_name", "p_partkey", "version")


LATEST_VERSIONS = """
SELECT p_brand, p_name, p_partkey, version FROM (
  SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY CAST(version AS DOUBLE) DESC) AS r FROM (
    SELECT p_brand, p_name, p_partkey, printf('%d.%06d', p_size, p_partkey) AS version FROM part))
WHERE r = 1"""


def graded_submissions(spark: SparkSession, d: str) -> DataFrame:
    """Submissions through the registry's rubric grader (UDF1)."""
    r = views.responses(spark, d)
    scores = grading.GRADERS["float"](r.select("event_id", "patch"), r.select("event_id", *views.rubric_columns("k")), ["event_id"])
    return scores.select("event_id", F.round("score", 9).alias("score"))


def graded_rows(spark: SparkSession, d: str) -> DataFrame:
    """Submissions through the registry's table function over rubric rows (UDF1)."""
    r = views.responses(spark, d)
    scores = grading.GRADERS["rows"](r.select("event_id", "patch"), r.select("event_id", *views.rubric_columns("k")), ["event_id"])
    return scores.select("event_id", F.round("score", 9).alias("score"))


def gate_custom_rules(spark: SparkSession, d: str) -> DataFrame:
    """The request gate with the permit required and a user's rule behind it (FLT3, UDF3)."""
    q = views.requests(spark, d)
    g = pop.gate_requests(q, views.registered_miners(spark, d), PopulationConfig(force_validator_permit=True),
                          extra_rules=[(F.col("caller_stake") < 0.0, "stake below zero")])
    return g.select("event_id", "blocked", F.when(F.col("reason") == "stake below zero", "rule").alias("by"))


GATE_CUSTOM = """
WITH m AS (SELECT c_name AS hotkey, c_mktsegment = 'BUILDING' AS permit, c_acctbal AS stake FROM customer WHERE c_custkey % 11 <> 0),
g AS (
  SELECT event_id, event_type = 'signup' AS anonymous, m.hotkey IS NULL AS unknown, coalesce(permit, false) AS permit, stake
  FROM events LEFT JOIN m ON m.hotkey = 'Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0') AND event_type <> 'signup')
SELECT event_id, anonymous OR unknown OR NOT permit OR stake < 0 AS blocked,
       CASE WHEN NOT anonymous AND NOT unknown AND permit AND stake < 0 THEN 'rule' END AS by FROM g"""


def status_lists(spark: SparkSession, d: str) -> DataFrame:
    """Per hour the uids that were answered and those that were not; a sign-up's call fails as
    a whole (FLT4)."""
    r = views.responses(spark, d)
    return pop.status_lists(r, "round", "uid", F.col("event_type") != "error", F.col("event_type") == "signup").select(
        "round", F.array_join(F.transform("ok_uids", lambda x: x.cast("string")), ",").alias("ok_uids"),
        F.array_join(F.transform("failed_uids", lambda x: x.cast("string")), ",").alias("failed_uids"))


STATUS_LISTS = """
WITH u AS (SELECT epoch_us(ts) // 3600000000 AS round, user_id AS uid, bool_or(event_type NOT IN ('error', 'signup')) AS ok
           FROM events GROUP BY 1, 2)
SELECT round, coalesce(string_agg(CAST(uid AS VARCHAR), ',' ORDER BY uid) FILTER (WHERE ok), '') AS ok_uids,
       coalesce(string_agg(CAST(uid AS VARCHAR), ',' ORDER BY uid) FILTER (WHERE NOT ok), '') AS failed_uids
FROM u GROUP BY round"""

GRADE_TEMPLATE = "Task:\n{task}\n\nPatch under review:\n{patch}\n\nRate it on the rubric."
DUEL_TEMPLATE = "Task:\n{task}\n\nFirst patch:\n{first}\n\nSecond patch:\n{second}\n\nWhich one is better?"


def grading_prompts(spark: SparkSession, d: str) -> DataFrame:
    """The rubric grader's prompt of every response, and the pair judge's against the caller's
    next response of the hour (STR4, UDF4)."""
    from pyspark.sql import Window
    r = views.responses(spark, d).select("event_id", "round", "uid", "ts", "patch")
    nxt = F.lead("patch").over(Window.partitionBy("round", "uid").orderBy("ts", "event_id"))
    task = F.concat(F.lit("task "), F.col("round").cast("string"))
    p = r.withColumn("next", nxt)
    return p.select("event_id", nst.fill_template(GRADE_TEMPLATE, task=task, patch=F.col("patch")).alias("grade"),
                    nst.fill_template(DUEL_TEMPLATE, task=task, first=F.col("patch"), second=F.col("next")).alias("duel"))


GRADING_PROMPTS = """
WITH r AS (
  SELECT event_id, 'task ' || CAST(epoch_us(ts) // 3600000000 AS VARCHAR) AS task, patch,
         lead(patch) OVER (PARTITION BY epoch_us(ts) // 3600000000, user_id ORDER BY ts, event_id) AS nxt
  FROM (SELECT *, CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN '' ELSE event_type END AS patch FROM events))
SELECT event_id,
       concat('Task:', chr(10), task, chr(10), chr(10), 'Patch under review:', chr(10), coalesce(patch, ''), chr(10), chr(10),
              'Rate it on the rubric.') AS grade,
       concat('Task:', chr(10), task, chr(10), chr(10), 'First patch:', chr(10), coalesce(patch, ''), chr(10), chr(10),
              'Second patch:', chr(10), coalesce(nxt, ''), chr(10), chr(10), 'Which one is better?') AS duel
FROM r"""

PROBLEM_TEMPLATE = "Write a problem that needs both files.\n{files}\nDirectory: {dir}"


def file_prompts(spark: SparkSession, d: str) -> DataFrame:
    """The problem prompt of each directory, on its most similar pair of files (STR3, STR4)."""
    pairs = corpus.most_similar_pairs(read_table(spark, d, "embeddings"), "label", "vec_id", "embedding", block_size=64, lsh_bits=3)
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    picked = pairs.select(F.col("dir").cast("string").alias("dir"), F.posexplode(F.array("path_a", "path_b")).alias("pos", "doc_id"))
    files = (picked.join(docs, "doc_id").groupBy("dir").agg(F.array_sort(F.collect_list(F.struct(
        "pos", F.col("doc_id").cast("string").alias("path"), F.col("text").alias("contents")))).alias("files")))
    listed = F.transform("files", lambda x: F.struct(x["path"].alias("path"), x["contents"].alias("contents")))
    return files.select("dir", nst.fill_template(PROBLEM_TEMPLATE, files=nst.render_files(listed), dir=F.col("dir")).alias("prompt"))


FILE_PROMPTS = """, picked AS (
  SELECT dir, 0 AS pos, path_a AS path FROM best UNION ALL SELECT dir, 1, path_b FROM best)
SELECT dir, 'Write a problem that needs both files.' || chr(10)
            || string_agg('Filename: ' || CAST(path AS VARCHAR) || chr(10) || '```python3' || chr(10) || text
                          || chr(10) || '```' || chr(10), '' ORDER BY pos)
            || chr(10) || 'Directory: ' || dir AS prompt
FROM picked JOIN documents ON doc_id = path GROUP BY dir"""

QUERIES = {
    "report_outcomes": report_outcomes, "weights_due": weights_due, "allowed_models": allowed_models,
    "judgement_rejects": judgement_rejects, "close_values": close_values, "zipped_responses": zipped_responses,
    "latest_versions": latest_versions, "graded_submissions": graded_submissions, "graded_rows": graded_rows, "gate_custom_rules": gate_custom_rules,
    "file_prompts": file_prompts, "status_lists": status_lists, "grading_prompts": grading_prompts,
}


def oracle_sql(pairs: str, rubric: str) -> dict[str, str]:
    """SQL of these queries; ``pairs`` finds the best file pairs, ``rubric`` scores the events."""
    return {
        "report_outcomes": REPORT_OUTCOMES, "weights_due": WEIGHTS_DUE, "allowed_models": _allowed_sql(),
        "judgement_rejects": JUDGEMENT_REJECTS, "close_values": CLOSE_VALUES, "zipped_responses": ZIPPED,
        "latest_versions": LATEST_VERSIONS, "graded_submissions": rubric, "graded_rows": rubric, "gate_custom_rules": GATE_CUSTOM,
        "file_prompts": pairs.rstrip() + FILE_PROMPTS, "status_lists": STATUS_LISTS, "grading_prompts": GRADING_PROMPTS,
    }
