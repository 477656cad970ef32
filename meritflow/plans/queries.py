"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Float outputs are rounded to 9 decimals so that the Spark result and the DuckDB oracle
agree despite different summation orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import PopulationConfig, ScoringConfig, WeightConfig
from ..functions import nested as nst
from ..functions import text as txt
from ..operators import corpus, cost, grading, patches, ratings, scoring, timing, weights
from ..operators import population as pop
from ..session import written
from ..sources import views
from ..sources.tables import read_table

R = 9  # decimals kept in float outputs


def _r(c, name=None):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, R).alias(name) if name else F.round(c, R)


# --------------------------------------------------------------------------- scoring
def eligible_population(spark: SparkSession, d: str) -> DataFrame:
    return pop.eligible(views.miners(spark, d)).select("uid", "hotkey", "netuid")


def valid_rewards(spark: SparkSession, d: str, cfg: ScoringConfig = ScoringConfig()) -> DataFrame:
    """Latest response per (round, uid) from an eligible miner with a non-empty patch,
    scored: reward = 9 * eval + decay(timeout, process_time)."""
    m = eligible_population(spark, d)
    # the responses are reduced to one row per (uid, round) before any shuffle
    r = scoring.latest_per_key(views.responses(spark, d), ["uid", "day", "round"], ["ts", "event_id"])
    r = r.filter(F.col("patch").isNotNull() & (F.col("patch") != ""))
    r = r.join(m, "uid", "inner")
    return r.withColumn("reward", scoring.reward(F.col("score"), F.col("process_time"), cfg))


def reward_to_weights(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: responses -> rewards -> EMA per uid -> blended shares of the whole league ->
    exclusion and cap -> u16.  Uids without a score take part with 0."""
    rw = valid_rewards(spark, d)
    ema = scoring.ema_final(rw, "uid", ["round"], "reward", block=F.col("day"), alpha=0.1).select("uid", "score")
    league = views.miners(spark, d).select("netuid", "uid").join(ema, "uid", "left")
    # closed-task scores weigh 1.0, open-task scores (none tracked here) 0.0; written once, since
    # every league aggregate reads it again
    league = written(league.withColumns({"score": F.coalesce("score", F.lit(0.0)), "pr_score": F.lit(0.0)}), "league")
    w = weights.blend_scores(league, "netuid", "score", "pr_score", "share", closed_pct=1.0, open_pct=0.0)
    p = weights.process_weights(w, "netuid", "uid", "share", "weight", WeightConfig(), carry=("score",), largest="most")
    u = weights.emit_u16(p, "netuid", "uid", "weight", largest="most")
    return u.select("netuid", "uid", _r("score", "score"), _r("weight", "weight"), "weight_u16")


def _holders(spark, d):
    """Rewarded snapshots of the uids' hotkeys; now and then a uid has none."""
    s = views.hotkey_snapshots(spark, d)
    return s.withColumn("hotkey", F.when(F.pmod("snap_seq", F.lit(11)) != 0, F.col("hotkey")))


def ema_resumed(spark: SparkSession, d: str) -> DataFrame:
    """The EMA with resets over all days, in three steps: each saves its state, hotkeys with
    scores, at the next step number, and the next loads the latest and carries on from it; a
    uid that changed hands in between starts over (SRC5, WIN1, WIN2)."""
    from ..sources import sinks
    s = _holders(spark, d)
    path = _run_path(spark, "resume")
    day = F.year("snap_ts")
    first, last = s.agg(F.min(day), F.max(day)).first()
    cuts = [first, first + (last - first) // 3, first + 2 * (last - first) // 3, last + 1] if first is not None else []
    state = None
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        part = s.where((day >= lo) & (day < hi))
        got = scoring.ema_with_reset(part, "uid", ["snap_ts", "snap_seq"], "hotkey", "reward", alpha=0.1, start=state)
        sinks.save_state(got.select("uid", "hotkey", "score"), path)
        state = sinks.load_state(spark, path)
    if state is None:
        return s.select("uid", "hotkey", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("step"))
    return state.select("uid", "hotkey", _r("score", "score"), "step")


def ema_final(spark: SparkSession, d: str) -> DataFrame:
    rw = valid_rewards(spark, d)
    ema = scoring.ema_final(rw, "uid", ["round"], "reward", block=F.col("day"), alpha=0.1)
    return ema.select("uid", _r("score", "score"), "n_updates")


def ema_reset(spark: SparkSession, d: str) -> DataFrame:
    res = scoring.ema_with_reset(_holders(spark, d), "uid", ["snap_ts", "snap_seq"], "hotkey", "reward", alpha=0.1)
    return res.select("uid", "hotkey", "n_resets", _r("score", "score"))


def reward_blend(spark: SparkSession, d: str) -> DataFrame:
    rw = valid_rewards(spark, d)
    return rw.select("event_id", "uid", _r("reward", "reward"))


# --------------------------------------------------------------------------- weights
def _acct_weights(spark, d):
    m = views.miners(spark, d)
    return m.select("netuid", "uid", F.greatest(F.col("stake") - 8000.0, F.lit(0.0)).alias("raw"))


def l1_normalise(spark: SparkSession, d: str) -> DataFrame:
    m = views.miners(spark, d)
    return weights.l1_normalise(m, "netuid", "stake", "weight").select("netuid", "uid", _r("weight", "weight"))


def cap_weights(spark: SparkSession, d: str) -> DataFrame:
    w = weights.cap_weights(_acct_weights(spark, d), "netuid", "raw", "weight", limit=0.1)
    return w.select("netuid", "uid", _r("weight", "weight"))


def process_weights(spark: SparkSession, d: str) -> DataFrame:
    w = weights.process_weights(_acct_weights(spark, d), "netuid", "uid", "raw", "weight", WeightConfig())
    return w.select("netuid", "uid", _r("weight", "weight"))


def emit_u16(spark: SparkSession, d: str) -> DataFrame:
    w = weights.process_weights(_acct_weights(spark, d), "netuid", "uid", "raw", "weight", WeightConfig(), largest="most")
    return weights.emit_u16(w, "netuid", "uid", "weight", largest="most").select("netuid", "uid", "weight_u16")


def _uneven_weights(spark, d):
    """Raw weights that reach every branch: leagues without any, leagues with few, NaN ones,
    and leagues of steep weights whose largest are cut."""
    m = views.miners(spark, d)
    steep = F.exp(F.greatest("stake", F.lit(0.0)) / 500.0)
    raw = (F.when(F.pmod("netuid", F.lit(6)) == 0, 0.0)
            .when((F.pmod("netuid", F.lit(6)) == 1) & (F.pmod("uid", F.lit(10)) != 0), 0.0)
            .when(F.pmod("uid", F.lit(17)) == 0, F.lit("NaN").cast("double")).otherwise(steep))
    return m.select("netuid", "uid", raw.alias("raw"))


def process_weights_quantile(spark: SparkSession, d: str) -> DataFrame:
    """Weights without the lowest third of each league's positive ones (AGG7), then their cap."""
    w = weights.process_weights(_uneven_weights(spark, d), "netuid", "uid", "raw", "weight",
                                WeightConfig(exclude_quantile=20_000))
    return w.select("netuid", "uid", _r("weight", "weight"))


def blended_weights(spark: SparkSession, d: str) -> DataFrame:
    """Shares of a league from two scores: 0.8 of the labelled tasks' (clicks here), which alone
    move the main score, and 0.2 of the open ones' (WIN1, AGG5)."""
    rw = valid_rewards(spark, d).withColumn("task_type", F.when(F.col("event_type") == "click", "labelled_issue").otherwise("open_issue"))
    rw = written(rw.select("uid", "round", "day", "reward", "task_type"), "rewards")
    ema = lambda rows, name: scoring.ema_final(rows, "uid", ["round"], "reward", block=F.col("day"), alpha=0.1, out=name).select("uid", name)
    league = (views.miners(spark, d).select("netuid", "uid").join(ema(scoring.labelled_only(rw), "score"), "uid", "left")
              .join(ema(rw.where("task_type = 'open_issue'"), "pr_score"), "uid", "left").na.fill(0.0, ["score", "pr_score"]))
    w = weights.blend_scores(league, "netuid", "score", "pr_score", "share", closed_pct=0.8, open_pct=0.2)
    return w.select("netuid", "uid", _r("share", "share"))


def emit_u16_quantile(spark: SparkSession, d: str) -> DataFrame:
    """The same weights as whole numbers, through the lists that a validator emits (AGG8, FLT15)."""
    w = weights.process_weights(_uneven_weights(spark, d), "netuid", "uid", "raw", "weight",
                                WeightConfig(exclude_quantile=20_000))
    lists = w.groupBy("netuid", F.pmod("uid", F.lit(8)).alias("part")).agg(F.collect_list("uid").alias("uids"), F.collect_list("weight").alias("ws"))
    flat = weights.emit_lists(lists, "netuid", "uids", "ws")
    return weights.emit_u16(flat, "netuid", "uid", "weight").select("netuid", "uid", "weight_u16")


# --------------------------------------------------------------------------- population
def eligible_miners(spark: SparkSession, d: str) -> DataFrame:
    return pop.eligible(views.miners(spark, d)).select("netuid", "uid", "hotkey")


def gate_of(events: DataFrame, registered: DataFrame) -> DataFrame:
    g = pop.gate_requests(views.requests_of(events), registered, PopulationConfig())
    return g.select("event_id", "blocked", "reason")


def gate_requests(spark: SparkSession, d: str) -> DataFrame:
    return gate_of(read_table(spark, d, "events"), views.registered_miners(spark, d))


def priority_order(spark: SparkSession, d: str) -> DataFrame:
    g = pop.gate_requests(views.requests(spark, d), views.registered_miners(spark, d), PopulationConfig())
    # judged once; the ranks read the accepted requests again
    g = written(g.filter(~F.col("blocked")).select("event_id", "round", "caller_stake"), "accepted")
    p = pop.priority(g, partition="round", tiebreak="event_id")
    return p.select("event_id", "round", _r("priority", "priority"), F.col("serve_rank").cast("bigint").alias("serve_rank"))


def top_stake_sample(spark: SparkSession, d: str) -> DataFrame:
    return pop.top_stake_sample(views.miners(spark, d), "netuid", seed="api").select("netuid", "uid")


def sample_with_topup(spark: SparkSession, d: str) -> DataFrame:
    avail = pop.eligible(views.miners(spark, d)).select("netuid", "uid")
    failed = views.responses(spark, d).filter(F.col("event_type") == "error").select("uid")
    s = pop.sample_with_topup(avail, failed, k=5, group="netuid", seed="round-0")
    return s.select("netuid", "uid", "is_excluded")


def status_split(spark: SparkSession, d: str) -> DataFrame:
    r = views.responses(spark, d)
    return pop.status_split(r, "round", F.col("event_type") != "error")


QUERIES = {
    "reward_to_weights": reward_to_weights,
    "ema_final": ema_final,
    "ema_reset": ema_reset,
    "reward_blend": reward_blend,
    "l1_normalise": l1_normalise,
    "cap_weights": cap_weights,
    "process_weights": process_weights,
    "emit_u16": emit_u16,
    "process_weights_quantile": process_weights_quantile,
    "emit_u16_quantile": emit_u16_quantile,
    "blended_weights": blended_weights,
    "eligible_miners": eligible_miners,
    "gate_requests": gate_requests,
    "priority_order": priority_order,
    "top_stake_sample": top_stake_sample,
    "sample_with_topup": sample_with_topup,
    "status_split": status_split,
}


# --------------------------------------------------------------------------- grading


def rubric_score(spark: SparkSession, d: str) -> DataFrame:
    r = views.responses(spark, d).select("event_id", "patch", *views.rubric_columns("k"))
    s = grading.rubric_score("addresses", "logical", "brevity", "bugs", "checklist", "patch")
    return r.select("event_id", _r(s, "score"))


def test_buckets(spark: SparkSession, d: str) -> DataFrame:
    t = views.test_results(spark, d)
    c = grading.classify_results(t, ["submission_id"], ["ts", "event_id"])
    return grading.bucket_counts(c, ["submission_id"])


def _completions(spark, d):
    li = read_table(spark, d, "lineitem")
    names = cost.model_names()
    arr = F.array(*[F.lit(n) for n in names])
    return li.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"),
        F.element_at(arr, (F.pmod(F.col("l_partkey"), F.lit(len(names))) + 1).cast("int")).alias("model"),
        (F.col("l_quantity") * 100).cast("bigint").alias("input_tokens"),
        (F.col("l_quantity") * 10).cast("bigint").alias("output_tokens"))


def token_cost(spark: SparkSession, d: str) -> DataFrame:
    priced = cost.price_completions(_completions(spark, d), cost.flat_prices(spark))
    t = cost.cost_by_model(priced)
    return t.select("model", "n_completions", "input_tokens", "output_tokens", "total_cost", "n_unpriced")


def _doc_patch(text_col="text"):
    """A document as a diff body: even lines added ('+'), odd lines context (' ')."""
    lines = F.split(F.col(text_col), "\n", -1)
    return F.array_join(F.transform(lines, lambda l, i: F.concat(F.when(i % 2 == 0, F.lit("+")).otherwise(F.lit(" ")), l)), "\n")


def strip_patch_comments(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    p = docs.select("doc_id", _doc_patch().alias("patch"))
    return p.select("doc_id", txt.strip_patch_comments(F.col("patch")).alias("cleaned"))


# --------------------------------------------------------------------------- corpus
def corpus_filter(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").select(F.col("source").alias("dir"), F.col("doc_id").alias("path"), "text")
    f = corpus.corpus_filter(docs, "dir", "text")
    return f.select("dir", "path", F.char_length("text").cast("bigint").alias("n_chars"))


def _file_pairs(spark, d):
    e = read_table(spark, d, "embeddings")
    return corpus.most_similar_pairs(e, "label", "vec_id", "embedding", block_size=64, lsh_bits=3)


def file_pair_top1(spark: SparkSession, d: str) -> DataFrame:
    p = _file_pairs(spark, d)
    return p.select("dir", "path_a", "path_b", _r("cosine", "cosine"))


def best_file_pair(spark: SparkSession, d: str) -> DataFrame:
    p = corpus.best_overall(_file_pairs(spark, d), F.round("cosine", corpus.TIE_DECIMALS))
    return p.select("dir", "path_a", "path_b", _r("cosine", "cosine"))


# --------------------------------------------------------------------------- ratings
def elo_rank(spark: SparkSession, d: str) -> DataFrame:
    """Elo tournament of every hour's submissions, the higher k winning a match (JOIN5, WIN5, WIN6)."""
    s = valid_rewards(spark, d).select("round", "ts", "event_id", "uid", "k")
    e = ratings.elo_ratings(s, "round", ["ts", "event_id"], "uid", "k")
    return e.select("round", "uid", "idx", F.round("rating", 6).alias("rating"), "rank")


def elo_judged(spark: SparkSession, d: str) -> DataFrame:
    """Elo ratings from a table of judgements as they come in (WIN5, FLT12): every event of an
    hour judges two of its submissions; judgements without exactly one outcome are counted."""
    s = written(valid_rewards(spark, d).select("round", "ts", "event_id", "uid"), "players")
    order = Window.partitionBy("round").orderBy("ts", "event_id")
    players = s.select("round", "uid", (F.row_number().over(order) - 1).cast("bigint").alias("idx"))
    sizes = s.groupBy("round").agg(F.count(F.lit(1)).alias("n"))
    k = F.col("k").cast("bigint")
    a, b = F.pmod(k, F.col("n")), F.pmod(k * 7 + F.col("event_id"), F.col("n"))
    j = views.responses(spark, d).select("round", "event_id", "k").join(sizes, "round").where(a != b)
    j = j.select("round", F.lit(0).alias("rr"), F.format_string("%020d", "event_id").alias("at"), F.least(a, b).alias("i"), F.greatest(a, b).alias("j"),
                 (k % 3 == 0).alias("a_wins"), (k % 5 == 0).alias("b_wins"), (k % 7 == 0).alias("draw"))
    e = ratings.elo_from_judgements(players, j, "round", "uid")
    return e.select("round", "uid", "idx", F.round("rating", 6).alias("rating"), "rank", "n_rejected")


def trueskill_rank(spark: SparkSession, d: str) -> DataFrame:
    s = valid_rewards(spark, d).select("netuid", "round", "ts", "event_id", "uid", "patch", *views.rubric_columns("k"))
    s = s.withColumn("grade", grading.rubric_score("addresses", "logical", "brevity", "bugs", "checklist", "patch"))
    t = ratings.trueskill_scores(s, "netuid", "round", ["ts", "event_id"], "uid", "grade")
    return t.select("netuid", "round", "uid", _r("mu", "mu"), _r("sigma", "sigma"), _r("ts_score", "ts_score"))


# --------------------------------------------------------------------------- timing
def deadline_join(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events")
    req = e.filter(F.col("event_type") == "view").select(F.col("event_id").alias("req_id"), "user_id", "ts")
    resp = e.filter(F.col("event_type") == "purchase").select(F.col("event_id").alias("resp_id"), "user_id", "ts")
    return timing.deadline_join(req, resp, "user_id", 1800.0)


def ttl_hold(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events")
    h = timing.ttl_hold(e, "event_type", "ts", "value", 12.0, order=["ts", "event_id"])
    return h.select("event_id", "bucket", "held_value")


def epoch_due(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events")
    return timing.epoch_triggers(e, "user_id", "ts", "event_id", 100, 12)


# --------------------------------------------------------------------------- text & nested
def stream_join_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "conversations")
    pieces = c.select("conv_id", "turn", nst.chunk_text("text").alias("piece"))
    g = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "piece"))).alias("_p"),
                                      F.count(F.lit(1)).alias("n_chunks"))
    return g.select("conv_id", F.array_join(F.transform("_p", lambda x: x["piece"]), "").alias("completion"), "n_chunks")


def batch_tokens(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "conversations")
    # tokens are materialised once; the batching lambda then only indexes into them
    t = c.select("conv_id", "turn", nst.tokens("text").alias("toks"))
    b = t.select("conv_id", "turn", F.inline(nst.token_batches(F.col("toks"), 3)))
    return b.select("conv_id", "turn", F.col("idx").cast("bigint").alias("idx"), "batch", "is_last")


def _headers(e):
    k = views.prop_k().cast("string")
    return F.create_map(
        F.lit("name"), F.col("event_type"),
        F.lit("timeout"), k,
        F.lit("total_size"), F.col("event_id").cast("string"),
        F.lit("bt_header_dendrite_uuid"), F.col("user_id").cast("string"),
        F.lit("bt_header_dendrite_hotkey"), F.format_string("Customer#%09d", F.col("user_id")),
        F.lit("bt_header_axon_status_code"), F.when(F.col("event_type") == "error", "408").otherwise("200"),
        F.lit("bt_header_axon_process_code"), k,
    )


def header_extract(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events")
    h = e.select("event_id", _headers(e).alias("h"))
    den = nst.headers_with_prefix(F.col("h"), "bt_header_dendrite")
    axon = nst.headers_with_prefix(F.col("h"), "bt_header_axon")
    return h.select(
        "event_id",
        nst.header_scalar("h", "name", "string", "").alias("name"),
        nst.header_scalar("h", "timeout", "double", 0.0).alias("timeout"),
        nst.header_scalar("h", "total_size", "bigint", 0).alias("total_size"),
        nst.header_scalar("h", "header_size", "bigint", 0).alias("header_size"),
        F.element_at(den, F.lit("hotkey")).alias("dendrite_hotkey"),
        F.element_at(den, F.lit("uuid")).alias("dendrite_uuid"),
        F.element_at(axon, F.lit("code")).alias("axon_code"),
        F.size(axon).cast("bigint").alias("n_axon"))


def log_lines(spark: SparkSession, d: str) -> DataFrame:
    return log_lines_of(read_table(spark, d, "events"))


def log_lines_of(e: DataFrame) -> DataFrame:
    """Log events enriched for the event sink (STR9, MAP1, SRC9/STM9)."""
    k = views.prop_k()
    msg = F.concat(F.col("event_type"), F.lit(" by user "), F.col("user_id").cast("string"))
    desc = nst.log_description("ts", F.upper("event_type"), F.lit("events.py"), k, msg)
    extra = F.when(F.col("event_type") == "error",
                   F.create_map(F.lit("description"), F.concat(F.lit("error code "), k.cast("string"))))\
             .otherwise(F.create_map(F.lit("k"), k.cast("string")))
    props = nst.override(F.create_map(F.lit("description"), desc), extra)
    explicit_id = F.when(F.col("event_type") == "purchase", F.concat(F.lit("purchase-"), F.col("event_id").cast("string")))
    return e.select(
        "event_id",
        F.coalesce(explicit_id, msg).alias("event"),
        F.when(F.col("event_type") == "signup", F.lit("anonymous"))
         .otherwise(F.format_string("Customer#%09d", F.col("user_id"))).alias("distinct_id"),
        F.element_at(props, F.lit("description")).alias("description"),
        F.size(props).cast("bigint").alias("n_properties"))


def prompt_table(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "conversations")
    g = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    rest = F.slice(F.col("t"), 2, F.greatest(F.size("t") - 1, F.lit(0)))
    p = nst.detailed_problem(F.col("t")[0]["text"], F.transform(rest, lambda x: x["role"]),
                             F.transform(rest, lambda x: x["text"]))
    return g.select("conv_id", p.alias("prompt"))


def scored_rows_json(spark: SparkSession, d: str) -> DataFrame:
    """A round's scored responses as JSON payloads of bounded size (NST3): pages of about 2,000
    characters, a response going to the page that its hotkey hashes to."""
    rw = valid_rewards(spark, d)
    row = F.struct(F.concat(F.lit("task "), F.col("round").cast("string")).alias("problem_statement"),
                   F.col("patch").alias("solution_patch"),
                   F.round(F.col("reward") * 1e6).cast("bigint").alias("score_micros"),
                   F.col("hotkey").alias("miner_hotkey"))
    rows = written(rw.select("round", row.alias("row")), "payload-rows")
    return nst.payload_pages(rows, "round", "row", F.col("row.miner_hotkey"), 2_000)


def task_labels(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    repo = F.concat(F.lit("org-"), F.col("lang"), F.lit("/"), F.col("source"))
    parts = txt.split_repo(repo)
    return docs.select("doc_id", parts["author"].alias("author"), parts["name"].alias("name"),
                       txt.task_id(repo, F.col("text")).alias("task_id"), txt.preview(F.col("text"), 100).alias("preview"))


QUERIES.update({
    "rubric_score": rubric_score,
    "test_buckets": test_buckets,
    "token_cost": token_cost,
    "strip_patch_comments": strip_patch_comments,
    "corpus_filter": corpus_filter,
    "file_pair_top1": file_pair_top1,
    "best_file_pair": best_file_pair,
    "elo_rank": elo_rank,
    "elo_judged": elo_judged,
    "trueskill_rank": trueskill_rank,
    "deadline_join": deadline_join,
    "ttl_hold": ttl_hold,
    "epoch_due": epoch_due,
    "stream_join_chunks": stream_join_chunks,
    "batch_tokens": batch_tokens,
    "header_extract": header_extract,
    "log_lines": log_lines,
    "prompt_table": prompt_table,
    "scored_rows_json": scored_rows_json,
    "task_labels": task_labels,
})


def _doc_patches(spark, d):
    """A patch per document over its whole text.  Its first file is the document itself
    (doc_id % 3 = 0) or the next one: a hunk for every tenth line, with up to three lines of
    context and an added line that looks like a file header.  Every other patch also deletes
    the document's own file."""
    docs = read_table(spark, d, "documents").select("doc_id", F.split("text", "\n", -1).alias("ls"))
    own = F.col("doc_id").cast("string")
    target = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.col("doc_id")).otherwise(F.col("doc_id") + 1).cast("string")
    n = F.size("ls")

    def hunk(s):
        c = F.least(F.lit(3), n - s + 1)
        kept = F.transform(F.slice("ls", s, c), lambda x: F.concat(F.lit(" "), x))
        head = F.format_string("@@ -%d,%d +%d,%d @@", s, c, s, c + 1)
        return F.concat_ws("\n", head, F.get(kept, F.lit(0)), F.lit("+++ added"), F.slice(kept, F.lit(2), F.lit(2)))

    edits = F.concat_ws("\n", F.concat(F.lit("--- a/"), target), F.concat(F.lit("+++ b/"), target),
                        F.transform(F.sequence(F.lit(1), n, F.lit(10)), hunk))
    drop = F.concat_ws("\n", F.concat(F.lit("--- a/"), own), F.lit("+++ /dev/null"), F.format_string("@@ -1,%d +0,0 @@", n),
                       F.transform("ls", lambda x: F.concat(F.lit("-"), x)))
    whole = F.concat(edits, F.when(F.pmod("doc_id", F.lit(2)) == 0, F.concat(F.lit("\n"), drop)).otherwise(""), F.lit("\n"))
    # some patches are missing, empty, or say that they change a file without a hunk
    none = lambda k: F.pmod("doc_id", F.lit(k)) == 0
    return docs.select(F.col("doc_id").alias("patch_id"), F.when(none(37), F.lit(None)).when(none(41), "")
                       .when(none(43), F.concat(F.lit("--- a/"), own, F.lit("\n+++ b/"), own, F.lit("\n"))).otherwise(whole).alias("patch"))


def patch_applies(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    a = patches.patch_applies(patches.hunks(_doc_patches(spark, d)), docs, "doc_id", "text")
    return a.select("patch_id", "applies", F.col("offset").alias("line_offset"), "n_hunks")


QUERIES["patch_applies"] = patch_applies


# --------------------------------------------------------------------------- sinks
def _run_path(spark, name):
    import uuid
    from ..session import scratch_path
    return scratch_path(spark, f"tables/{name}/{uuid.uuid4().hex}")


def state_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """EMA scores saved with their hotkeys as versioned snapshots and restored, against a
    population in which every ninth uid has a new hotkey and every fourth is new (SRC5): a
    replaced or new uid restarts from 0, one that left is dropped; the snapshot holds no
    pr_score column, so it is read as 0."""
    from ..sources import sinks
    path = _run_path(spark, "state")
    miners = views.miners(spark, d).select("uid", "hotkey")
    ema = scoring.ema_final(valid_rewards(spark, d), "uid", ["round"], "reward", block=F.col("day"), alpha=0.1)
    held = ema.join(miners, "uid").where(F.pmod("uid", F.lit(4)) != 0).select("uid", "hotkey", "score")
    for _ in range(2):                                   # the later step is the one restored
        sinks.save_state(held, path)
    now = miners.where(F.pmod("uid", F.lit(5)) != 0).withColumn(
        "hotkey", F.when(F.pmod("uid", F.lit(9)) == 0, F.concat(F.lit("new-"), "hotkey")).otherwise(F.col("hotkey")))
    st = sinks.resync_state(sinks.load_state(spark, path), now)
    return st.select("uid", "hotkey", _r("score", "score"), "pr_score", "step")


def cached_file_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Best file pairs through the result cache, keyed by the table's rows and the search
    parameters (SRC3): whatever the first call does, the second is served from the cache."""
    from ..session import cache_path
    from ..sources import sinks
    table, path = read_table(spark, d, "embeddings"), cache_path(spark, "file_pairs")
    params = {"block_size": 64, "lsh_bits": 3}
    sinks.read_or_compute(spark, path, [table], lambda: _file_pairs(spark, d), **params)
    again, hit = sinks.read_or_compute(spark, path, [table], lambda: _file_pairs(spark, d), **params)
    pop.require_nonempty(again, "no directory has a valid pair of files")          # FLT7
    return again.select("dir", "path_a", "path_b", _r("cosine", "cosine"), F.lit(hit).alias("hit"))


def source_walk(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a file of a source tree, walked and read again (SRC1, SRC2, FLT5, FLT6):
    hidden files and folders are left out, one underscore is an ordinary name, files that are
    no UTF-8 are dropped, and folders need five file names."""
    from ..sources import trees
    docs = read_table(spark, d, "documents").select("doc_id", "lang", "source", "text")
    k = lambda n: F.pmod("doc_id", F.lit(n))
    name = F.concat(F.when(k(7) == 0, ".x").when(k(5) == 0, "__x").when(k(3) == 0, "_x").otherwise("x"), F.col("doc_id").cast("string"),
                    F.when(k(11) == 0, ".pyc").when(k(13) == 0, ".txt").otherwise(".py"))
    folder = F.concat(F.col("source"), F.lit("/"), F.when(k(17) == 0, "__cache__/").when(k(19) == 0, ".git/").otherwise(""), F.col("lang"))
    body = F.when(k(23) == 0, F.concat(F.unhex(F.lit("FF")), F.encode("text", "utf-8"))).otherwise(F.encode("text", "utf-8"))
    root = _run_path(spark, "tree")
    trees.write_files(docs.select(F.concat(folder, F.lit("/"), name).alias("path"), body.alias("body")), root, "path", "body")
    found = trees.candidate_files(spark, root, 5, 50)
    return found.select("dir", "name", "size", F.char_length("contents").cast("bigint").alias("n_chars"), F.md5("contents").alias("md5"))


def published_rows(spark: SparkSession, d: str) -> DataFrame:
    """Scored responses published to a table partitioned by repository (SRC4)."""
    from ..sources import sinks
    path = _run_path(spark, "published")
    rw = valid_rewards(spark, d).select(
        F.concat(F.lit("league-"), F.col("netuid").cast("string")).alias("repo"),
        F.concat(F.lit("task "), F.col("round").cast("string")).alias("problem_statement"),
        "patch", F.round("reward", 6).alias("score"), "hotkey")
    sinks.publish_scored_rows(rw, path, "first")
    sinks.publish_scored_rows(rw, path, "first")          # a retried job publishes once
    return spark.read.parquet(path).select("repo", "problem_statement", "solution_patch", "score", "miner_hotkey")


def hotkey_as_of(spark: SparkSession, d: str) -> DataFrame:
    """Each shipped line item with the hotkey its uid (supplier % 64) held on the ship date
    (SRC6): the last snapshot of the day counts when a uid changed hands several times."""
    from ..sources import sinks
    snaps = scoring.latest_per_key(views.hotkey_snapshots(spark, d).select("uid", "snap_ts", "snap_seq", "hotkey"),
                                   ["uid", "snap_ts"], ["snap_seq"]).select("uid", "snap_ts", "hotkey")
    li = read_table(spark, d, "lineitem").select(
        F.pmod(F.col("l_suppkey"), F.lit(64)).alias("uid"), "l_orderkey", "l_linenumber", F.col("l_shipdate").alias("ts"))
    j = sinks.as_of(snaps, li, "uid", "snap_ts", "ts", bucket_width=30 * 86_400_000_000)
    return j.select("l_orderkey", "l_linenumber", "uid", "hotkey")


def league_per_round(spark: SparkSession, d: str) -> DataFrame:
    """The league each hourly task goes to, picked by a seeded hash of the round (TOP4)."""
    nations = read_table(spark, d, "nation").select(F.col("n_nationkey").alias("opt"), F.col("n_name").alias("league"))
    rounds = views.responses(spark, d).select("round").distinct()
    repos = cost.repositories(spark)
    picked = pop.pick_per_step(rounds, nations, "round", "opt", seed="task").select("round", "league")
    return pop.pick_per_step(picked, repos, "round", "idx", seed="repo").select("round", "league", "repo")


def model_credentials(spark: SparkSession, d: str) -> DataFrame:
    """Completions per model and the name of the key they need (SRC8)."""
    c = _completions(spark, d)
    return c.groupBy("model", cost.credential_name("model").alias("credential")).agg(F.count(F.lit(1)).alias("n"))


def stake_maps(spark: SparkSession, d: str) -> DataFrame:
    """Per uid a coldkey -> stake map (order priority -> total price) and its total (AGG16, MAP1)."""
    o = read_table(spark, d, "orders")
    # money in exact integer cents, so the total does not depend on summation order
    per = o.groupBy(F.col("o_custkey").alias("uid"), F.col("o_orderpriority").alias("coldkey")) \
           .agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("stake"))
    m = per.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("coldkey", "stake"))).alias("stake_map"))
    # a customer without orders has the default map: its segment with its balance
    c = read_table(spark, d, "customer").select(F.col("c_custkey").alias("uid"), "c_mktsegment", F.round(F.col("c_acctbal") * 100).cast("bigint").alias("cents"))
    held = pop.default_stake(F.col("stake_map"), F.col("c_mktsegment"), F.col("cents"))
    full = c.join(m, "uid", "left").select("uid", held.alias("stake_map"))
    total = pop.total_stake(F.col("stake_map"), F.lit(0).cast("bigint"))
    return full.select("uid", F.size("stake_map").cast("bigint").alias("n_coldkeys"),
                       (total / F.lit(100.0)).alias("total_stake"))


def run_labels(spark: SparkSession, d: str) -> DataFrame:
    """Run names and release codes for model completions (STR8, STR11)."""
    li = read_table(spark, d, "lineitem")
    names = cost.model_names()
    model = F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod(F.col("l_partkey"), F.lit(len(names))) + 1).cast("int"))
    version = F.date_format(F.col("l_shipdate"), "yyyy.M.d")
    return li.select(
        "l_orderkey", "l_linenumber",
        txt.run_name(model, F.lit("lineitem"), F.col("l_returnflag"), F.col("l_discount"), F.col("l_tax"),
                     F.col("l_quantity"), F.col("l_linenumber"), F.col("l_linestatus")).alias("run"),
        txt.release_code(version).alias("release"))


QUERIES.update({"ema_resumed": ema_resumed, "run_labels": run_labels, "model_credentials": model_credentials, "league_per_round": league_per_round, "stake_maps": stake_maps, "hotkey_as_of": hotkey_as_of, "state_roundtrip": state_roundtrip, "cached_file_pairs": cached_file_pairs, "source_walk": source_walk,
                "published_rows": published_rows})


def _register_others():
    from . import guard_queries, stream_queries
    QUERIES.update(guard_queries.QUERIES)
    QUERIES.update(stream_queries.STREAM_QUERIES)


_register_others()
