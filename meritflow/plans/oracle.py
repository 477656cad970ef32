"""DuckDB SQL for each registered query: an independent statement of the same result.

Written with plain windows and aggregates (no block decomposition), so it checks the
distributed forms in ``queries.py``.  Float outputs are rounded like the Spark side.
"""

from __future__ import annotations

from ..functions.text import LINE_BREAK_RE2, PY_SPACE_RE2

MINERS = """miners AS (
  SELECT c_custkey AS uid, c_name AS hotkey, c_nationkey AS netuid, c_acctbal AS stake,
         c_mktsegment = 'BUILDING' AS validator_permit, c_custkey % 7 <> 0 AS is_serving,
         greatest(c_acctbal, 0.0) / 10000.0 AS validator_trust
  FROM customer)"""

ELIGIBLE = """eligible AS (
  SELECT * FROM miners
  WHERE coalesce(is_serving, false) AND NOT (coalesce(validator_permit, false) AND coalesce(stake, 0.0) > 4096.0))"""

RESPONSES = """responses AS (
  SELECT event_id, ts, event_type, epoch_us(ts) // 3600000000 AS round, epoch_us(ts) // 86400000000 AS day,
         user_id AS uid, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CAST(json_extract_string(props, '$.k') AS INTEGER) / 100.0::DOUBLE AS score,
         value * 20.0::DOUBLE AS process_time,
         CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN '' ELSE event_type END AS patch
  FROM events)"""

VALID_REWARDS = """latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY round, uid ORDER BY ts DESC, event_id DESC) AS _rn
                 FROM responses) WHERE _rn = 1),
valid AS (
  SELECT l.*, e.hotkey, e.netuid,
         9.0 * l.score + CASE WHEN l.process_time >= 1800.0 THEN 0.0
                              ELSE exp(-l.process_time / (1800.0 - l.process_time)) END AS reward
  FROM latest l JOIN eligible e ON l.uid = e.uid
  WHERE l.patch IS NOT NULL AND l.patch <> '')"""

EMA = """ema AS (
  SELECT netuid, uid, sum(0.1 * reward * pow(0.9, n - rn)) AS score, count(*) AS n_updates
  FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY round) AS rn,
               count(*) OVER (PARTITION BY uid) AS n FROM valid)
  GROUP BY netuid, uid)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


ACCT_WEIGHTS = """acct AS (SELECT netuid, uid, greatest(stake - 8000.0, 0.0) AS raw FROM miners)"""


def _cap_sql(src: str, x: str, limit: float = 0.1, eps: float = 1e-7) -> str:
    """SQL of the max-weight cap over table ``src`` with value column ``x`` per netuid."""
    return f"""(SELECT netuid, uid,
    CASE WHEN S = 0 OR n * {limit} <= 1 THEN 1.0 / n
         WHEN emax <= {limit} THEN x / S
         ELSE clip / sum(clip) OVER (PARTITION BY netuid) END AS weight
  FROM (SELECT *, least(x, (({limit} * csk - {eps}) / (1 - {limit} * (n - k))) * S) AS clip
        FROM (SELECT *, max(CASE WHEN rn = (CASE WHEN k = 0 THEN n ELSE k END) THEN cs END)
                          OVER (PARTITION BY netuid) AS csk
              FROM (SELECT *, sum(CASE WHEN est / ((n - rn) * est + cs + {eps}) < {limit} THEN 1 ELSE 0 END)
                                OVER (PARTITION BY netuid) AS k
                    FROM (SELECT *, x / S AS est, max(x / S) OVER (PARTITION BY netuid) AS emax,
                                 row_number() OVER (PARTITION BY netuid ORDER BY x) AS rn,
                                 sum(x / S) OVER (PARTITION BY netuid ORDER BY x
                                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cs
                          FROM (SELECT netuid, uid, {x} AS x, sum({x}) OVER (PARTITION BY netuid) AS S,
                                       count(*) OVER (PARTITION BY netuid) AS n FROM {src}))))))"""


def _process_sql(quantile: float = 0.0) -> str:
    """SQL of the published weights pw over table acct; ``quantile`` is the fraction left out."""
    return f"""pw_in AS (
  SELECT netuid, uid, w, count(*) OVER (PARTITION BY netuid) AS n,
         sum(CASE WHEN w > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY netuid) AS m
  FROM (SELECT netuid, uid, CASE WHEN isnan(raw) THEN 0.0 ELSE CAST(CAST(raw AS FLOAT) AS DOUBLE) END AS w FROM acct)),
pw_case AS (SELECT *, CASE WHEN m = 0 OR n < 10 THEN 'a' WHEN m < 10 THEN 'b' ELSE 'c' END AS c FROM pw_in),
pw_c AS (
  SELECT *, least({quantile}, greatest(m - 10, 0) / m) AS frac,
         row_number() OVER (PARTITION BY netuid ORDER BY w) - 1 AS qr, count(*) OVER (PARTITION BY netuid) AS qm
  FROM pw_case WHERE c = 'c' AND w > 0),
pw_q AS (SELECT *, (qm - 1) * frac AS qh, floor((qm - 1) * frac) AS ql FROM pw_c),
pw_q2 AS (
  SELECT *, max(CASE WHEN qr = ql THEN w END) OVER (PARTITION BY netuid) AS qlo,
         max(CASE WHEN qr = least(ql + 1, qm - 1) THEN w END) OVER (PARTITION BY netuid) AS qhi FROM pw_q),
pw_cq AS (SELECT netuid, uid, w FROM pw_q2 WHERE qlo + (qh - ql) * (qhi - qlo) <= w),
pw_x AS (
  SELECT netuid, uid, CASE WHEN c = 'a' THEN 1.0 ELSE 1e-5 + CASE WHEN w > 0 THEN w ELSE 0.0 END END AS x
  FROM pw_case WHERE c <> 'c'
  UNION ALL SELECT netuid, uid, w AS x FROM pw_cq),
pw AS """ + _cap_sql("pw_x", "x")


PROCESS_WEIGHTS = _process_sql()
UNEVEN_WEIGHTS = """acct AS (
  SELECT netuid, uid, CASE WHEN netuid % 6 = 0 OR (netuid % 6 = 1 AND uid % 10 <> 0) THEN 0.0 WHEN uid % 17 = 0 THEN 'nan'::DOUBLE
                           ELSE exp(greatest(stake, 0.0) / 500.0) END AS raw FROM miners)"""


def _token_pattern() -> str:
    from ..functions.nested import TOKEN_PATTERN
    return TOKEN_PATTERN


# plays steps (round, step, i, j, sa, sb) of submissions subs (round, idx) in order
ELO_WALK = """walk(round, step, rt) AS (
  SELECT round, 0, list(1200.0::DOUBLE ORDER BY idx) FROM subs GROUP BY round
  UNION ALL
  SELECT round, step, list_concat(rt[1:i], [na], rt[i + 2:j], [nb], rt[j + 2:len(rt)]) FROM (
    SELECT *, CASE WHEN sa > sb THEN ra + cw WHEN sa < sb THEN ra - cl ELSE ra1 - c2 END AS na,
              CASE WHEN sa > sb THEN rb - cw WHEN sa < sb THEN rb + cl ELSE rb1 + c2 END AS nb FROM (
      SELECT *, 32.0 * (1.0 - 1.0 / (1.0 + pow(10.0, (ra1 - rb1) / 400.0))) AS c2 FROM (
        SELECT *, ra + c1 AS ra1, rb - c1 AS rb1 FROM (
          SELECT w.round, w.step + 1 AS step, w.rt, o.i, o.j, o.sa, o.sb,
                 w.rt[o.i + 1] AS ra, w.rt[o.j + 1] AS rb,
                 32.0 * (1.0 - 1.0 / (1.0 + pow(10.0, (w.rt[o.j + 1] - w.rt[o.i + 1]) / 400.0))) AS cw,
                 32.0 * (1.0 - 1.0 / (1.0 + pow(10.0, (w.rt[o.i + 1] - w.rt[o.j + 1]) / 400.0))) AS cl,
                 32.0 * (0.5 - 1.0 / (1.0 + pow(10.0, (w.rt[o.j + 1] - w.rt[o.i + 1]) / 400.0))) AS c1
          FROM walk w JOIN steps o ON o.round = w.round AND o.step = w.step + 1))))),
final AS (SELECT round, rt FROM walk QUALIFY step = max(step) OVER (PARTITION BY round)),
flat AS (SELECT round, unnest(rt) AS rating, unnest(range(len(rt))) AS idx FROM final)
"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    base = [MINERS, ELIGIBLE, RESPONSES, VALID_REWARDS]
    q["reward_to_weights"] = _with(*base, EMA, """scored AS (
  SELECT m.netuid, m.uid, coalesce(e.score, 0.0) AS score FROM miners m LEFT JOIN ema e ON m.uid = e.uid)""", """acct AS (
  SELECT netuid, uid, score / greatest(sum(abs(score)) OVER (PARTITION BY netuid), 1e-12) AS raw FROM scored)""",
                                   PROCESS_WEIGHTS) + """
SELECT netuid, uid, round(score, 9) AS score, round(weight, 9) AS weight, weight_u16 FROM (
  SELECT pw.netuid, pw.uid, score, weight, max(weight) OVER (PARTITION BY pw.netuid) AS wmax,
         CAST(round_even(weight / max(weight) OVER (PARTITION BY pw.netuid) * 65535.0, 0) AS INTEGER) AS weight_u16
  FROM pw JOIN scored s ON pw.netuid = s.netuid AND pw.uid = s.uid)
WHERE wmax > 0 AND weight_u16 <> 0"""
    q["ema_final"] = _with(*base, EMA) + "SELECT uid, round(score, 9) AS score, n_updates FROM ema"
    q["reward_blend"] = _with(*base) + "SELECT event_id, uid, round(reward, 9) AS reward FROM valid"
    holders = _with("""snap AS (
  SELECT o_custkey % 64 AS uid, o_orderdate AS snap_ts, o_orderkey AS snap_seq,
         CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS hotkey, o_totalprice / 1e5 AS reward FROM orders)""", """flagged AS (
  SELECT *, row_number() OVER (PARTITION BY uid ORDER BY snap_ts, snap_seq) AS pos,
         lag(hotkey) OVER (PARTITION BY uid ORDER BY snap_ts, snap_seq) IS DISTINCT FROM hotkey
           AND row_number() OVER (PARTITION BY uid ORDER BY snap_ts, snap_seq) > 1 AS reset FROM snap)""", """epochs AS (
  SELECT *, sum(CASE WHEN reset THEN 1 ELSE 0 END) OVER (PARTITION BY uid ORDER BY pos) AS epoch,
         sum(CASE WHEN reset THEN 1 ELSE 0 END) OVER (PARTITION BY uid) AS n_resets FROM flagged)""", """cur AS (
  SELECT *, row_number() OVER (PARTITION BY uid ORDER BY pos) AS rn, count(*) OVER (PARTITION BY uid) AS n
  FROM epochs WHERE epoch = n_resets)""")
    # one hotkey holds a uid's rows since the last reset, so any of them names it
    q["ema_reset"] = holders + """
SELECT uid, max(hotkey) AS hotkey, CAST(max(n_resets) AS BIGINT) AS n_resets,
       round(sum(0.1 * reward * pow(0.9, n - rn)), 9) AS score
FROM cur GROUP BY uid"""
    q["ema_resumed"] = holders + """
SELECT uid, max(hotkey) AS hotkey, round(sum(0.1 * reward * pow(0.9, n - rn)), 9) AS score, 3::BIGINT AS step
FROM cur GROUP BY uid"""

    q["l1_normalise"] = _with(MINERS) + """
SELECT netuid, uid, round(stake / greatest(sum(abs(stake)) OVER (PARTITION BY netuid), 1e-12), 9) AS weight FROM miners"""
    q["cap_weights"] = _with(MINERS, ACCT_WEIGHTS) + "SELECT netuid, uid, round(weight, 9) AS weight FROM " + _cap_sql("acct", "raw")
    q["process_weights"] = _with(MINERS, ACCT_WEIGHTS, PROCESS_WEIGHTS) + "SELECT netuid, uid, round(weight, 9) AS weight FROM pw"
    q["blended_weights"] = _with(*base, """typed AS (
  SELECT uid, labelled, sum(0.1 * reward * pow(0.9, n - rn)) AS score
  FROM (SELECT uid, reward, event_type = 'click' AS labelled, row_number() OVER (PARTITION BY uid, event_type = 'click' ORDER BY round) AS rn,
               count(*) OVER (PARTITION BY uid, event_type = 'click') AS n FROM valid) GROUP BY 1, 2)""", """league AS (
  SELECT netuid, m.uid, coalesce(c.score, 0.0) AS a, coalesce(o.score, 0.0) AS b
  FROM miners m LEFT JOIN typed c ON c.uid = m.uid AND c.labelled LEFT JOIN typed o ON o.uid = m.uid AND NOT o.labelled)""") + """
SELECT netuid, uid, round(0.8 * a / greatest(sum(abs(a)) OVER (PARTITION BY netuid), 1e-12)
                          + 0.2 * b / greatest(sum(abs(b)) OVER (PARTITION BY netuid), 1e-12), 9) AS share FROM league"""
    uneven = [MINERS, UNEVEN_WEIGHTS, _process_sql(20_000 / 65_535)]
    q["process_weights_quantile"] = _with(*uneven) + "SELECT netuid, uid, round(weight, 9) AS weight FROM pw"
    emitted = """
SELECT netuid, uid, weight_u16 FROM (
  SELECT netuid, uid, CAST(round_even(weight / max(weight) OVER (PARTITION BY netuid) * 65535.0, 0) AS INTEGER) AS weight_u16,
         max(weight) OVER (PARTITION BY netuid) AS wmax FROM pw)
WHERE wmax > 0 AND weight_u16 <> 0"""
    q["emit_u16"] = _with(MINERS, ACCT_WEIGHTS, PROCESS_WEIGHTS) + emitted
    q["emit_u16_quantile"] = _with(*uneven) + emitted

    q["eligible_miners"] = _with(MINERS, ELIGIBLE) + "SELECT netuid, uid, hotkey FROM eligible"
    gate = _with(MINERS, """reg AS (SELECT hotkey, min(uid) AS uid FROM miners WHERE uid % 11 <> 0 GROUP BY hotkey)""",
                 """reqs AS (
  SELECT event_id, epoch_us(ts) // 3600000000 AS round,
         CASE WHEN event_type = 'signup' THEN NULL ELSE 'Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0') END AS caller_hotkey
  FROM events)""", """gated AS (
  SELECT r.event_id, r.round, m.stake AS caller_stake,
         CASE WHEN r.caller_hotkey IS NULL THEN true WHEN g.uid IS NULL THEN true ELSE false END AS blocked,
         CASE WHEN r.caller_hotkey IS NULL THEN 'Missing dendrite or hotkey'
              WHEN g.uid IS NULL THEN 'Unrecognized hotkey' ELSE 'Hotkey recognized!' END AS reason
  FROM reqs r LEFT JOIN reg g ON r.caller_hotkey = g.hotkey LEFT JOIN miners m ON g.uid = m.uid)""")
    q["gate_requests"] = gate + "SELECT event_id, blocked, reason FROM gated"
    q["priority_order"] = gate + """
SELECT event_id, round, round(coalesce(caller_stake, 0.0), 9) AS priority,
       row_number() OVER (PARTITION BY round ORDER BY coalesce(caller_stake, 0.0) DESC, event_id) AS serve_rank
FROM gated WHERE NOT blocked"""
    q["top_stake_sample"] = _with(MINERS) + """
SELECT netuid, uid FROM (
  SELECT *, row_number() OVER (PARTITION BY netuid ORDER BY md5('api:' || CAST(uid AS VARCHAR))) AS r
  FROM (SELECT *, quantile_cont(stake, 0.9) OVER (PARTITION BY netuid) AS q FROM miners)
  WHERE stake > q AND validator_trust > 0 AND is_serving)
WHERE r <= 3"""
    q["sample_with_topup"] = _with(MINERS, ELIGIBLE, RESPONSES) + """
SELECT netuid, uid, is_excluded FROM (
  SELECT e.netuid, e.uid, x.uid IS NOT NULL AS is_excluded,
         row_number() OVER (PARTITION BY e.netuid ORDER BY x.uid IS NOT NULL, md5('round-0:' || CAST(e.uid AS VARCHAR))) AS r
  FROM eligible e LEFT JOIN (SELECT DISTINCT uid FROM responses WHERE event_type = 'error') x ON e.uid = x.uid)
WHERE r <= 5"""
    q["status_split"] = _with(RESPONSES) + """
SELECT round, count(*) FILTER (WHERE event_type <> 'error') AS n_ok,
       count(*) FILTER (WHERE event_type = 'error') AS n_failed FROM responses GROUP BY round"""
    q.update(oracle_sql_more())
    q["patch_applies"] = """
WITH docs AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
hunks AS (
  SELECT doc_id AS patch_id, CASE WHEN doc_id % 3 = 0 THEN doc_id ELSE doc_id + 1 END AS path, s AS start,
         (s - 1) // 10 + 1 AS hunk_no, ls[s:s + 2] AS old
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1, 10)) AS s FROM docs)
  UNION ALL
  SELECT doc_id, doc_id, 1, (len(ls) - 1) // 10 + 2, ls FROM docs WHERE doc_id % 2 = 0),
spots AS (SELECT doc_id AS path, ls, generate_subscripts(ls, 1) AS p, unnest(ls) AS line FROM docs),
hits AS (
  SELECT patch_id, hunk_no, arg_min(p - start, (abs(p - start), p - start)) AS delta
  FROM hunks h JOIN spots f ON h.path = f.path AND h.old[1] = f.line AND f.ls[f.p:f.p + len(h.old) - 1] = h.old
  GROUP BY 1, 2)
SELECT h.patch_id, bool_and(hits.patch_id IS NOT NULL) AS applies,
       CAST(max(hits.delta) FILTER (WHERE h.hunk_no = 1) AS BIGINT) AS line_offset,
       count(*) AS n_hunks
FROM hunks h LEFT JOIN hits ON h.patch_id = hits.patch_id AND h.hunk_no = hits.hunk_no
WHERE h.patch_id % 37 <> 0 AND h.patch_id % 41 <> 0 AND h.patch_id % 43 <> 0 GROUP BY 1
UNION ALL
SELECT doc_id, false, NULL, 0 FROM documents WHERE doc_id % 37 = 0 OR doc_id % 41 = 0 OR doc_id % 43 = 0"""
    elo_body = _with(MINERS, ELIGIBLE, RESPONSES, VALID_REWARDS, "x AS (SELECT 1)")
    q["elo_rank"] = elo_body.replace("WITH ", "WITH RECURSIVE ", 1).replace("x AS (SELECT 1)\n", """subs AS (
  SELECT round, uid, CAST(k AS DOUBLE) AS s, row_number() OVER (PARTITION BY round ORDER BY ts, event_id) - 1 AS idx
  FROM valid),
pairs AS (
  SELECT a.round, 0 AS rr, a.idx AS i, b.idx AS j, a.s AS sa, b.s AS sb FROM subs a JOIN subs b
    ON a.round = b.round AND a.idx < b.idx
  UNION ALL
  SELECT a.round, 1 AS rr, a.idx AS i, b.idx AS j, a.s AS sa, b.s AS sb FROM subs a JOIN subs b
    ON a.round = b.round AND a.idx < b.idx),
steps AS (
  SELECT *, row_number() OVER (PARTITION BY round ORDER BY rr,
           md5('elo:' || CAST(round AS VARCHAR) || ':' || CAST(rr AS VARCHAR) || ':' || CAST(i AS VARCHAR)
               || ':' || CAST(j AS VARCHAR))) AS step
  FROM pairs),
""" + ELO_WALK) + """
SELECT f.round, s.uid, CAST(f.idx AS BIGINT) AS idx, round(f.rating, 6) AS rating,
       row_number() OVER (PARTITION BY f.round ORDER BY f.rating DESC, f.idx) AS rank
FROM flat f JOIN subs s ON s.round = f.round AND s.idx = f.idx"""
    q["elo_judged"] = elo_body.replace("WITH ", "WITH RECURSIVE ", 1).replace("x AS (SELECT 1)\n", """subs AS (
  SELECT round, uid, row_number() OVER (PARTITION BY round ORDER BY ts, event_id) - 1 AS idx FROM valid),
sizes AS (SELECT round, count(*) AS n FROM subs GROUP BY round),
judged AS (
  SELECT r.round, event_id, least(k % n, (k * 7 + event_id) % n) AS i, greatest(k % n, (k * 7 + event_id) % n) AS j,
         k % 3 = 0 AS a, k % 5 = 0 AS b, k % 7 = 0 AS draw
  FROM responses r JOIN sizes USING (round) WHERE k % n <> (k * 7 + event_id) % n),
steps AS (
  SELECT round, i, j, a::INT AS sa, b::INT AS sb, row_number() OVER (PARTITION BY round ORDER BY event_id) AS step
  FROM judged WHERE a::INT + b::INT + draw::INT = 1),
rejects AS (SELECT round, count(*) AS n_rejected FROM judged WHERE a::INT + b::INT + draw::INT <> 1 GROUP BY round),
""" + ELO_WALK) + """
SELECT f.round, s.uid, CAST(f.idx AS BIGINT) AS idx, round(f.rating, 6) AS rating,
       row_number() OVER (PARTITION BY f.round ORDER BY f.rating DESC, f.idx) AS rank, coalesce(n_rejected, 0) AS n_rejected
FROM flat f JOIN subs s ON s.round = f.round AND s.idx = f.idx LEFT JOIN rejects ON rejects.round = f.round"""
    from ..operators.cost import model_names
    n_models = len(model_names())
    q["run_labels"] = f"""
SELECT l_orderkey, l_linenumber,
       replace(printf('%s__%s__%s__t-%.2f__p-%.2f__c-%.2f__install-%d', {_names_list()}[l_partkey % {n_models} + 1],
                      'lineitem', l_returnflag, l_discount, l_tax, l_quantity, l_linenumber)
               || CASE WHEN l_linestatus IS NULL OR l_linestatus = '' THEN '' ELSE '__' || l_linestatus END,
               ':', '-') AS run,
       CAST(1000 * year(l_shipdate) + 10 * month(l_shipdate) + day(l_shipdate) AS INTEGER) AS release
FROM lineitem"""
    q["league_per_round"] = _with(RESPONSES) + """
SELECT r.round, n.n_name AS league,
       (['mwaskom/seaborn', 'pytest-dev/pytest'])[('0x' || substring(md5('repo:' || CAST(r.round AS VARCHAR)), 1, 8))::BIGINT % 2 + 1] AS repo
FROM (SELECT DISTINCT round FROM responses) r
LEFT JOIN nation n ON n.n_nationkey =
  (('0x' || substring(md5('task:' || CAST(r.round AS VARCHAR)), 1, 8))::BIGINT % (SELECT count(*) FROM nation))"""
    q["model_credentials"] = f"""
WITH m AS (SELECT {_names_list()}[l_partkey % {n_models} + 1] AS model FROM lineitem)
SELECT model, CASE WHEN starts_with(model, 'claude') THEN 'ANTHROPIC_API_KEY' ELSE 'OPENAI_API_KEY' END AS credential, count(*) AS n
FROM m GROUP BY ALL"""
    q["stake_maps"] = """
WITH m AS (
  SELECT uid, count(*) AS n, CAST(sum(stake) AS BIGINT) AS total FROM (
    SELECT o_custkey AS uid, o_orderpriority AS coldkey, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS stake
    FROM orders GROUP BY 1, 2) GROUP BY uid)
SELECT c_custkey AS uid, coalesce(n, 1) AS n_coldkeys, coalesce(total, CAST(round(c_acctbal * 100) AS BIGINT)) / 100.0 AS total_stake
FROM customer LEFT JOIN m ON m.uid = c_custkey"""
    q["hotkey_as_of"] = """
WITH snaps AS (
  SELECT uid, snap_ts, arg_max(hotkey, snap_seq) AS hotkey FROM (
    SELECT o_custkey % 64 AS uid, o_orderdate AS snap_ts, o_orderkey AS snap_seq, o_orderpriority AS hotkey FROM orders)
  GROUP BY uid, snap_ts),
li AS (SELECT l_suppkey % 64 AS uid, l_orderkey, l_linenumber, l_shipdate AS ts FROM lineitem)
SELECT li.l_orderkey, li.l_linenumber, li.uid, s.hotkey
FROM li ASOF LEFT JOIN snaps s ON li.uid = s.uid AND li.ts >= s.snap_ts"""
    q["state_roundtrip"] = _with(*base, EMA) + """
SELECT m.uid, CASE WHEN m.uid % 9 = 0 THEN 'new-' ELSE '' END || m.hotkey AS hotkey,
       CASE WHEN m.uid % 9 <> 0 AND m.uid % 4 <> 0 THEN round(coalesce(ema.score, 0.0), 9) ELSE 0.0 END AS score,
       0.0::DOUBLE AS pr_score, 2::BIGINT AS step
FROM miners m LEFT JOIN ema ON m.uid = ema.uid WHERE m.uid % 5 <> 0"""
    q["cached_file_pairs"] = f"SELECT *, true AS hit FROM ({q['file_pair_top1']})"
    q["source_walk"] = r"""
WITH f AS (
  SELECT source || '/' || CASE WHEN doc_id % 17 = 0 THEN '__cache__/' WHEN doc_id % 19 = 0 THEN '.git/' ELSE '' END || lang AS dir,
         CASE WHEN doc_id % 7 = 0 THEN '.x' WHEN doc_id % 5 = 0 THEN '__x' WHEN doc_id % 3 = 0 THEN '_x' ELSE 'x' END || doc_id::VARCHAR
           || CASE WHEN doc_id % 11 = 0 THEN '.pyc' WHEN doc_id % 13 = 0 THEN '.txt' ELSE '.py' END AS name,
         doc_id % 23 <> 0 AS readable, strlen(text) AS size, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS contents
  FROM documents WHERE doc_id % 17 <> 0 AND doc_id % 19 <> 0),
kept AS (SELECT *, count(*) OVER (PARTITION BY dir) AS n FROM f
         WHERE name LIKE '%.py' AND NOT starts_with(name, '.') AND NOT starts_with(name, '__'))
SELECT dir, name, size, length(contents) AS n_chars, md5(contents) AS md5 FROM kept WHERE n >= 5 AND readable AND length(contents) > 50"""
    q["published_rows"] = _with(*base) + """
SELECT 'league-' || CAST(netuid AS VARCHAR) AS repo, 'task ' || CAST(round AS VARCHAR) AS problem_statement,
       patch AS solution_patch, round(reward, 6) AS score, hotkey AS miner_hotkey FROM valid"""
    # streamed twins: same result as the batch query
    q["stream_epoch_due"] = q["epoch_due"]
    q["stream_token_batches"] = f"""
WITH t AS (
  SELECT conv_id, turn, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i
  FROM (SELECT conv_id, turn, regexp_extract_all(text, '{_token_pattern()}') AS toks FROM conversations)),
n AS (SELECT conv_id, tok, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS pos,
             count(*) OVER (PARTITION BY conv_id) AS total FROM t)
SELECT conv_id, pos // 3 AS idx, string_agg(tok, '' ORDER BY pos) AS batch, max(pos) = max(total) - 1 AS is_last
FROM n GROUP BY conv_id, pos // 3"""
    q["stream_deadline"] = q["deadline_join"]
    q["distinct_requests"] = """
WITH RECURSIVE ev AS (
  SELECT user_id, event_type, event_id, epoch_us(ts) // 1000000 AS s,
         row_number() OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts) // 1000000, event_id) AS rn FROM events),
walk(user_id, event_type, rn, event_id, last, accepted) AS (
  SELECT user_id, event_type, rn, event_id, s, true FROM ev WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.event_type, e.rn, e.event_id, CASE WHEN e.s - w.last >= 21600 THEN e.s ELSE w.last END, e.s - w.last >= 21600
  FROM walk w JOIN ev e ON e.user_id = w.user_id AND e.event_type = w.event_type AND e.rn = w.rn + 1)
SELECT user_id, event_type, event_id, accepted FROM walk"""
    q["stream_distinct_requests"] = q["distinct_requests"]
    q["stream_ema"] = q["ema_final"]
    q["stream_scores"] = q["ema_final"]
    q["stream_messages"] = q["stream_chunks"] = q["stream_join_chunks"]
    q["stream_log_lines"] = q["log_lines"]
    q["stream_published"] = q["log_lines"]
    q["stream_gate_requests"] = q["gate_requests"]
    q["stream_gate_live"] = """
WITH span AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events),
r AS (
  SELECT event_id, epoch_us(ts) // 3600000000 AS round,
         CASE WHEN epoch_us(ts) < lo + (hi + 1 - lo) * 2 // 4 THEN 0 ELSE 1 END AS era,
         CASE WHEN event_type <> 'signup' THEN user_id END AS caller
  FROM events, span),
m AS (
  SELECT 0 AS era, c_custkey AS uid, c_acctbal AS stake FROM customer WHERE c_custkey % 11 <> 0
  UNION ALL SELECT 1, c_custkey, c_acctbal - 1000.0 FROM customer WHERE c_custkey % 7 <> 0),
g AS (
  SELECT event_id, round,
         CASE WHEN caller IS NULL THEN 'Missing dendrite or hotkey' WHEN m.uid IS NULL THEN 'Unrecognized hotkey'
              WHEN stake < 0.0 THEN 'stake below zero' ELSE 'Hotkey recognized!' END AS reason,
         coalesce(-abs((floor(stake)::BIGINT % 1000 + 1000) % 1000 - 500)::DOUBLE, 0.0) AS priority
  FROM r LEFT JOIN m ON m.era = r.era AND m.uid = r.caller)
SELECT event_id, round, reason <> 'Hotkey recognized!' AS blocked, reason, priority,
       CASE WHEN reason = 'Hotkey recognized!' THEN row_number() OVER (
         PARTITION BY round, reason = 'Hotkey recognized!' ORDER BY priority DESC, event_id) END AS serve_rank
FROM g"""
    q["stream_batch_tokens"] = q["batch_tokens"]
    q["stream_population_resync"] = holders + """
SELECT uid, max(hotkey) AS hotkey, CAST(max(n_resets) AS BIGINT) AS n_resets FROM cur GROUP BY uid"""
    q["stream_ttl_hold"] = """
SELECT event_type, epoch_us(ts) // 12000000 AS bucket, arg_min(value, (ts, event_id)) AS held_value,
       count(*) AS n_calls
FROM events GROUP BY event_type, epoch_us(ts) // 12000000"""
    return q


K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
HOTKEY = "'Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0')"


def _names_list() -> str:
    from ..operators.cost import model_names
    return "[" + ", ".join(f"'{n}'" for n in model_names()) + "]"


def _flat_prices_values() -> str:
    from ..operators.cost import NESTED_MODELS, PRICES
    rows = [f"('{m}', {round(i * 1000)}::BIGINT, {round(o * 1000)}::BIGINT)" for m, _, i, o in PRICES
            if m not in NESTED_MODELS]
    return "prices(model, p_in, p_out) AS (VALUES " + ", ".join(rows) + ")"


def oracle_sql_more() -> dict[str, str]:
    q: dict[str, str] = {}
    q["rubric_score"] = f"""
WITH f AS (
  SELECT event_id, CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN '' ELSE event_type END AS patch,
         {K} / 100.0::DOUBLE AS a, CAST({K} % 50 AS DOUBLE) / 50.0 AS l, CAST({K} % 10 AS DOUBLE) / 10.0 AS b,
         CAST({K} % 7 AS DOUBLE) / 7.0 AS bugs,
         CASE WHEN {K} % 5 = 0 THEN []::DOUBLE[] ELSE [CAST({K} % 3 AS DOUBLE) / 3.0, CAST({K} % 4 AS DOUBLE) / 4.0] END AS cl
  FROM events),
s AS (SELECT *, 0.3 * a + 0.25 * l + 0.05 * b + 0.2 * (1.0 - bugs) AS static FROM f)
SELECT event_id, round(CASE WHEN coalesce(patch, '') = '' THEN 0.25 WHEN len(cl) = 0 THEN static / 0.8
                            ELSE static + 0.2 * (list_sum(cl) / len(cl)) END, 9) AS score FROM s"""
    q["test_buckets"] = f"""
WITH t AS (
  SELECT user_id AS submission_id, CAST(user_id AS VARCHAR) || ':' || CAST({K} % 10 AS VARCHAR) AS test_id,
         CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 'before' ELSE 'after' END AS run,
         CASE WHEN event_type IN ('click', 'purchase') THEN 'passed' WHEN event_type = 'error' THEN 'failed' ELSE 'other' END AS status,
         ts, event_id FROM events),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY submission_id, run, test_id ORDER BY ts DESC, event_id DESC) AS rn
                     FROM t WHERE status IN ('passed', 'failed')) WHERE rn = 1),
c AS (
  SELECT a.submission_id,
         CASE WHEN b.status IS NULL THEN CASE WHEN a.status = 'passed' THEN 'NEW_PASS' ELSE 'NEW_FAIL' END
              ELSE (CASE WHEN b.status = 'passed' THEN 'PASS' ELSE 'FAIL' END) || '_TO_' ||
                   (CASE WHEN a.status = 'passed' THEN 'PASS' ELSE 'FAIL' END) END AS bucket
  FROM o a LEFT JOIN o b ON b.run = 'before' AND a.submission_id = b.submission_id AND a.test_id = b.test_id
  WHERE a.run = 'after')
SELECT submission_id, bucket, count(*) AS n_tests FROM c GROUP BY submission_id, bucket"""
    n = len(eval(_names_list()))
    q["token_cost"] = f"""
WITH {_flat_prices_values()},
comp AS (
  SELECT CASE m WHEN 'gpt4omini' THEN 'gpt-4o-mini' WHEN 'gpt4o' THEN 'gpt-4o' ELSE m END AS model,
         input_tokens, output_tokens
  FROM (SELECT {_names_list()}[l_partkey % {n} + 1] AS m, CAST(l_quantity * 100 AS BIGINT) AS input_tokens,
               CAST(l_quantity * 10 AS BIGINT) AS output_tokens FROM lineitem)),
priced AS (SELECT c.*, input_tokens * p.p_in + output_tokens * p.p_out AS cost_nano
           FROM comp c LEFT JOIN prices p ON c.model = p.model)
SELECT model, count(*) AS n_completions, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
       CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cost_nano) AS BIGINT) / 1e9 AS total_cost,
       count(*) FILTER (WHERE cost_nano IS NULL) AS n_unpriced
FROM priced GROUP BY model"""
    q["strip_patch_comments"] = f"""
WITH p AS (
  SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)),
                 lambda x, i: CASE WHEN (i - 1) % 2 = 0 THEN '+' ELSE ' ' END || x), chr(10)) AS patch
  FROM documents),
l AS (SELECT doc_id, patch, regexp_split_to_array(patch, '{LINE_BREAK_RE2}') AS parts FROM p),
s AS (SELECT doc_id, CASE WHEN patch = '' THEN []::VARCHAR[]
                          WHEN regexp_matches(patch, '({LINE_BREAK_RE2})\\z') THEN parts[1:len(parts) - 1]
                          ELSE parts END AS lines FROM l)
SELECT doc_id, array_to_string(list_transform(
         list_filter(lines, lambda x: NOT regexp_matches(x, '^\\+{PY_SPACE_RE2}*#')),
         lambda x: CASE WHEN starts_with(x, '+')
                        THEN regexp_replace(regexp_replace(x, '(?s)#.*', ''), '{PY_SPACE_RE2}+\\z', '')
                        ELSE x END), chr(10)) AS cleaned
FROM s"""
    q["corpus_filter"] = """
SELECT dir, path, CAST(length(text) AS BIGINT) AS n_chars FROM (
  SELECT source AS dir, doc_id AS path, text, count(*) OVER (PARTITION BY source) AS n FROM documents)
WHERE n >= 3 AND length(text) > 50"""
    pairs = """
WITH e AS (SELECT CAST(label AS VARCHAR) AS dir, vec_id AS path, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.dir, a.path AS path_a, b.path AS path_b,
             list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS cosine
      FROM e a JOIN e b ON a.dir = b.dir AND a.path < b.path),
best AS (
  SELECT dir, path_a, path_b, cosine FROM (
    SELECT *, row_number() OVER (PARTITION BY dir ORDER BY round(cosine, 12) DESC, path_a, path_b) AS rn
    FROM p WHERE cosine > -1 AND NOT isnan(cosine)) WHERE rn = 1)
"""
    q["file_pair_top1"] = pairs + "SELECT dir, path_a, path_b, round(cosine, 9) AS cosine FROM best"
    q["best_file_pair"] = pairs + """SELECT dir, path_a, path_b, round(cosine, 9) AS cosine FROM best
ORDER BY round(cosine, 12) DESC, dir LIMIT 1"""
    from . import guard_queries
    q.update(guard_queries.oracle_sql(pairs, q["rubric_score"]))
    q["deadline_join"] = """
WITH req AS (SELECT event_id AS req_id, user_id, ts FROM events WHERE event_type = 'view'),
resp AS (SELECT event_id AS resp_id, user_id, ts FROM events WHERE event_type = 'purchase')
SELECT req_id, resp_id, CASE WHEN resp_id IS NULL THEN 408 ELSE 200 END AS status_code FROM (
  SELECT r.req_id, p.resp_id, row_number() OVER (PARTITION BY r.req_id ORDER BY p.ts, p.resp_id) AS rn
  FROM req r LEFT JOIN resp p ON p.user_id = r.user_id AND p.ts >= r.ts AND p.ts < r.ts + INTERVAL 30 MINUTE)
WHERE rn = 1"""
    q["ttl_hold"] = """
SELECT event_id, epoch_us(ts) // 12000000 AS bucket,
       first_value(value) OVER (PARTITION BY event_type, epoch_us(ts) // 12000000 ORDER BY ts, event_id) AS held_value
FROM events"""
    q["epoch_due"] = """
WITH RECURSIVE ev AS (
  SELECT user_id, event_id, epoch_us(ts) // 12000000 AS block,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
walk(user_id, rn, event_id, block, mark, due) AS (
  SELECT user_id, rn, event_id, block, block, false FROM ev WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.rn, e.event_id, e.block,
         CASE WHEN e.block - w.mark > 100 THEN e.block ELSE w.mark END, e.block - w.mark > 100
  FROM walk w JOIN ev e ON e.user_id = w.user_id AND e.rn = w.rn + 1)
SELECT user_id, event_id, block, due FROM walk"""
    q["stream_join_chunks"] = """
SELECT conv_id, string_agg(piece, '' ORDER BY turn) AS completion, count(*) AS n_chunks FROM (
  SELECT conv_id, turn, array_to_string(list_filter(string_split(text, chr(10)), lambda t: t <> ''), '') AS piece
  FROM conversations) GROUP BY conv_id"""
    from ..functions.nested import TOKEN_PATTERN
    q["batch_tokens"] = f"""
WITH t AS (SELECT conv_id, turn, regexp_extract_all(text, '{TOKEN_PATTERN}') AS toks FROM conversations),
b AS (SELECT conv_id, turn, toks, CAST(ceil(len(toks) / 3.0) AS BIGINT) AS nb FROM t),
u AS (SELECT conv_id, turn, toks, nb, unnest(range(nb)) AS i FROM b)
SELECT conv_id, turn, CAST(i AS BIGINT) AS idx, array_to_string(toks[3 * i + 1:3 * i + 3], '') AS batch,
       i = nb - 1 AS is_last FROM u"""
    q["header_extract"] = f"""
SELECT event_id, event_type AS name, CAST({K} AS DOUBLE) AS timeout, event_id AS total_size,
       CAST(0 AS BIGINT) AS header_size, {HOTKEY} AS dendrite_hotkey, CAST(user_id AS VARCHAR) AS dendrite_uuid,
       CAST({K} AS VARCHAR) AS axon_code, CAST(1 AS BIGINT) AS n_axon
FROM events"""
    q["log_lines"] = f"""
WITH d AS (SELECT *, {K} AS k, event_type || ' by user ' || CAST(user_id AS VARCHAR) AS msg, upper(event_type) AS lvl
           FROM events)
SELECT event_id,
       CASE WHEN event_type = 'purchase' THEN 'purchase-' || CAST(event_id AS VARCHAR) ELSE msg END AS event,
       CASE WHEN event_type = 'signup' THEN 'anonymous' ELSE {HOTKEY} END AS distinct_id,
       CASE WHEN event_type = 'error' THEN 'error code ' || CAST(k AS VARCHAR)
            ELSE strftime(timezone('America/New_York', timezone('UTC', ts)), '%Y-%m-%d %H:%M:%S') || ' - events.py:'
                 || CAST(k AS VARCHAR) || ' [' || CASE WHEN length(lvl) < 5 THEN rpad(lvl, 5, ' ') ELSE lvl END
                 || '] ' || msg END AS description,
       CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 2 END AS BIGINT) AS n_properties
FROM d"""
    q["prompt_table"] = """
WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations)
SELECT conv_id,
       chr(10) || 'Problem Statement: ' || max(CASE WHEN rn = 1 THEN text END) || chr(10)
       || 'Checklist of items to consider: ['
       || coalesce(string_agg('''' || role || '''', ', ' ORDER BY turn) FILTER (WHERE rn > 1), '') || ']' || chr(10)
       || coalesce(string_agg('# File ' || CAST(rn - 2 AS VARCHAR) || ' used to solve the problem: ' || text, ''
                              ORDER BY turn) FILTER (WHERE rn > 1), '') || chr(10) AS prompt
FROM c GROUP BY conv_id"""
    q["scored_rows_json"] = _with(MINERS, ELIGIBLE, RESPONSES, VALID_REWARDS, """one AS (
  SELECT round, hotkey, {'problem_statement': 'task ' || CAST(round AS VARCHAR), 'solution_patch': patch,
                         'score_micros': CAST(round(reward * 1e6) AS BIGINT), 'miner_hotkey': hotkey} AS r FROM valid)""", """pages AS (
  SELECT round, 1 + sum(length(to_json(r)) + 1)::BIGINT // 2000 AS pages FROM one GROUP BY round)""") + """
SELECT round, ('0x' || substring(md5(hotkey), 1, 8))::BIGINT % pages AS page, to_json(list(r ORDER BY r)) AS payload
FROM one JOIN pages USING (round) GROUP BY ALL"""
    q["task_labels"] = """
SELECT doc_id, 'org-' || lang AS author, source AS name,
       'org-' || lang || '/' || source || '-' || substring(text, 1, 10) || '-'
         || substring(md5('org-' || lang || '/' || source || chr(1) || text), 1, 12) AS task_id,
       substring(text, 1, 100) || '...' AS preview
FROM documents"""
    return q
