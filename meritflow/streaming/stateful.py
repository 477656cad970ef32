"""Stateful streaming operators.

STM1 token-stream accumulation, STM2 token batches, STM3 moving-average score loop, STM4 TTL hold,
STM5 epoch trigger, STM6 request/response deadline join, STM7 live gate,
STM9 log-event enrichment, STM10 recent-duplicate rejection.

Keyed state lives in the state store.  Arrival order decides nothing: rows are compared by
event time and id, and what may still change stays in the state, within the lateness that
each operator states.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType

from ..functions.math import block_number, epoch_us
from ..functions.nested import chunk_text, tokens
from .runner import event_time, slot


def _numbered(keys: list, named: list[pd.Series], rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The rows and the number of each one's key in ``keys``, to which new keys are appended."""
    no = {k: i for i, k in enumerate(keys)}
    own = [np.zeros(0, np.int64)]
    for names in named:
        code, found = pd.factorize(names, use_na_sentinel=False)
        for k in found:
            k = None if pd.isna(k) else k
            if k not in no:
                no[k] = len(keys)
                keys.append(k)
        own.append(np.array([no[None if pd.isna(k) else k] for k in found], np.int64)[code])
    return np.concatenate(rows) if rows else np.zeros((0, 0), np.int64), np.concatenate(own)


def _split(own: np.ndarray, rows: np.ndarray):
    """(number, its rows) of every number, rows in their order."""
    order = np.argsort(own, kind="stable")
    own, rows = own[order], rows[order]
    cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(own)], strict=len(cuts) > 0):
        yield int(own[i]), rows[i:j]


# ----------------------------------------------------------------------------- STM5
def epoch_trigger_stream(events: DataFrame, key: str, ts: str, id_col: str, epoch_blocks: int = 100,
                         block_seconds: int = 12, lateness: str = "1 hour") -> DataFrame:
    """Per key, fire when more than ``epoch_blocks`` blocks passed since the last firing;
    the first row of a key only sets the mark (update mode: the last report of a row stands).

    Rows may arrive up to ``lateness`` out of order.  Only the earliest row of a block can
    fire, so a key's state is the mark at the watermark and the earliest row of each block
    after it; every batch replays those few from the mark and reports them again.  A row
    from before the watermark can no longer move the mark and is reported with due NULL.
    The keys of a slot share one state and one call a batch.
    """
    gap = epoch_blocks + 1
    d = (events.withColumn("_et", event_time(ts)).withWatermark("_et", lateness)
               .select(F.col(key).cast("string").alias("_key"), F.col(id_col), "_et", epoch_us(ts).alias("_t"),
                       block_number(ts, block_seconds).cast("bigint").alias("block"), slot(key)))
    out_schema = f"_key string, {id_col} bigint, block bigint, due boolean"
    state_schema = ("keys array<string>, marks array<bigint>, uptos array<bigint>, own array<bigint>, blocks array<bigint>, "
                    "ts array<bigint>, ids array<bigint>")

    def replay(new, mark, upto, watermark):
        """A key's rows from its mark: what is reported, and its mark, edge and open rows behind it."""
        stale = np.zeros(len(new), bool) if upto is None else new[:, 0] <= upto
        late, new = new[stale], new[~stale]
        new = new[np.lexsort((new[:, 2], new[:, 1], new[:, 0]))]
        first = np.r_[True, new[1:, 0] != new[:-1, 0]] if len(new) else np.zeros(0, bool)
        blocks, rows = new[first, 0], np.flatnonzero(first)
        due, at = np.zeros(len(new), bool), []
        nxt = np.searchsorted(blocks, blocks + gap)
        i = 0 if mark is None else int(np.searchsorted(blocks, mark + gap))
        while i < len(blocks):
            at.append(i)
            due[rows[i]] = mark is not None or i > 0
            i = int(nxt[i])
        # blocks that end before the watermark are settled
        edge = max(upto if upto is not None else -(1 << 62), watermark // (1000 * block_seconds) - 1)
        settled = [int(blocks[i]) for i in at if blocks[i] <= edge]
        keep = new[first][blocks > edge]
        return (np.concatenate([new, late]), [*due.tolist(), *[None] * len(late)], settled[-1] if settled else mark,
                edge if len(new) or upto is not None else upto, keep)

    def fn(_, pdfs, state):
        keys, marks, uptos, *held = state.get if state.exists else ([], [], [], [], [], [], [])
        keys, marks, uptos = list(keys), list(marks), list(uptos)
        parts = [*pdfs]
        rows, own = _numbered(keys, [p["_key"] for p in parts], [p[["block", "_t", id_col]].to_numpy(np.int64) for p in parts])
        marks += [None] * (len(keys) - len(marks))
        uptos += [None] * (len(keys) - len(uptos))
        open_no, *open_rows = (np.asarray(h, np.int64) for h in held)
        waiting = dict(_split(open_no, np.stack(open_rows, axis=1).reshape(-1, 3)))
        told, due, who = [], [], []
        for k, new in _split(own, rows):
            every, fired, marks[k], uptos[k], keep = replay(
                np.concatenate([waiting[k], new]) if k in waiting else new, marks[k], uptos[k], state.getCurrentWatermarkMs())
            waiting[k] = keep
            told.append(every)
            due += fired
            who += [keys[k]] * len(every)
        left = np.concatenate([np.zeros((0, 3), np.int64), *waiting.values()])
        own = np.repeat(np.array([*waiting], np.int64), [len(x) for x in waiting.values()])
        state.update((keys, marks, uptos, own.tolist(), *(left[:, c].tolist() for c in range(3))))
        every = np.concatenate([np.zeros((0, 3), np.int64), *told])
        yield pd.DataFrame({"_key": pd.Series(who, dtype=object), id_col: every[:, 2], "block": every[:, 0],
                            "due": pd.array(due, "boolean")})

    out = d.groupBy("_slot").applyInPandasWithState(fn, out_schema, state_schema, "update", GroupStateTimeout.NoTimeout)
    return out.select(F.col("_key").cast("bigint").alias(key), id_col, "block", "due")


# ----------------------------------------------------------------------------- STM3
def ema_stream(responses: DataFrame, key: str, rnd: str, ts: str, id_col: str, reward: str, valid: str,
               alpha: float = 0.1, extra: list[str] | None = None, open_rounds: int = 24 * 366) -> DataFrame:
    """Moving-average score per key over rounds, the last response of a round counting.

    State per key: the score and count of the closed rounds, and the latest response, by
    (time, id), of each open one.  A round closes ``open_rounds`` rounds after it; until
    then responses may arrive in any order.  Every batch emits the score with the open
    rounds applied in order (update mode), and how many responses came too late to count.
    """
    extra = extra or []
    d = responses.select(F.col(key), *[F.col(c) for c in extra], F.col(rnd).cast("bigint").alias("rnd"),
                         epoch_us(ts).alias("t_us"), F.col(id_col).cast("bigint").alias("eid"),
                         F.nanvl(F.coalesce(F.col(reward).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("rw"),
                         F.coalesce(F.col(valid), F.lit(False)).alias("ok"))
    extra_schema = "".join(f", {c} bigint" for c in extra)
    out_schema = f"{key} bigint{extra_schema}, score double, n_updates bigint, n_late bigint"
    state_schema = ("score double, n bigint, closed bigint, late bigint, p_rnd array<bigint>, p_t array<bigint>, "
                    "p_id array<bigint>, p_r array<double>, p_v array<boolean>")
    names = ["rnd", "t_us", "eid", "rw", "ok"]

    def ahead(score, n, rewards):
        m = len(rewards)
        keep = (1 - alpha) ** np.arange(m - 1, -1, -1)
        return float(alpha * (rewards * keep).sum() + (1 - alpha) ** m * score), n + m

    def fn(k, pdfs, state):
        score, n, closed, late, *held = state.get if state.exists else (0.0, 0, None, 0, [], [], [], [], [])
        kept = pd.DataFrame(dict(zip(names, held, strict=True))).astype(
            {"rnd": "int64", "t_us": "int64", "eid": "int64", "rw": "float64", "ok": "bool"})
        first = None
        for pdf in pdfs:                       # one Arrow batch at a time: only a row per open round is held
            first = pdf.iloc[0] if first is None else first
            rows = pdf[names]
            if closed is not None:
                late += int((rows["rnd"] <= closed).sum())
                rows = rows[rows["rnd"] > closed]
            kept = pd.concat([kept, rows]).sort_values(["rnd", "t_us", "eid"], kind="stable").drop_duplicates("rnd", keep="last")
        if len(kept):
            edge = int(kept["rnd"].iloc[-1]) - open_rounds
            done = kept["rnd"] <= edge
            if done.any():
                part = kept[done]
                score, n = ahead(score, n, part.loc[part["ok"], "rw"].to_numpy())
                closed, kept = int(part["rnd"].iloc[-1]), kept[~done]
        state.update((score, n, closed, late, *(kept[c].tolist() for c in names)))
        out_score, out_n = ahead(score, n, kept.loc[kept["ok"], "rw"].to_numpy())
        if out_n > 0:
            yield pd.DataFrame([{key: k[0], **{c: first[c] for c in extra}, "score": out_score, "n_updates": out_n,
                                 "n_late": late}])

    return d.groupBy(key).applyInPandasWithState(fn, out_schema, state_schema, "update",
                                                 GroupStateTimeout.NoTimeout)


# ----------------------------------------------------------------------------- STM1
def chunk_accumulator(chunks: DataFrame, key: str, seq: str, text: str, last: str | None = None,
                      first_seq: int = 0, timeout_ms: int | None = None) -> DataFrame:
    """A request's chunks (each split on LF, empties dropped) in sequence order, whatever
    order they arrive in (update mode).

    ``last`` names a boolean column that marks a request's final chunk.  A request is
    complete, is reported once more and leaves the state when its final chunk and all
    sequence numbers from ``first_seq`` on are there; with ``timeout_ms`` it also leaves, as it
    is, after so long without a chunk.  The state of a request is its text so far, so
    requests are taken to be messages, not streams without end.
    """
    end = F.coalesce(F.col(last), F.lit(False)) if last else F.lit(False)
    d = chunks.select(F.col(key), F.col(seq).cast("bigint").alias("_seq"), chunk_text(text).alias("_piece"), end.alias("_end"))
    wait = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout

    def fn(k, pdfs, state):
        seqs, pieces, final = state.get if state.exists else ([], [], None)
        have = dict(zip(seqs, pieces, strict=True))
        if not state.hasTimedOut:
            for pdf in pdfs:
                have.update(zip(pdf["_seq"].tolist(), pdf["_piece"].tolist(), strict=True))
                ends = pdf.loc[pdf["_end"], "_seq"]
                final = int(ends.max()) if len(ends) else final
        order = sorted(have)
        complete = final is not None and order[-1] == final and len(order) == final - first_seq + 1
        yield pd.DataFrame([{key: k[0], "completion": "".join(have[s] or "" for s in order), "n_chunks": len(order),
                             "complete": complete}])
        if complete or state.hasTimedOut:
            state.remove()
        else:
            state.update((order, [have[s] for s in order], final))
            if timeout_ms:
                state.setTimeoutDuration(timeout_ms)

    return d.groupBy(key).applyInPandasWithState(
        fn, f"{key} bigint, completion string, n_chunks bigint, complete boolean",
        "seqs array<bigint>, pieces array<string>, final bigint", "update", wait)


# ----------------------------------------------------------------------------- STM2
def token_batch_stream(chunks: DataFrame, key: str, seq: str, text: str, last: str, n: int = 3,
                       first_seq: int = 0) -> DataFrame:
    """A request's tokens in batches of ``n``, carried over from chunk to chunk (STM2).

    ``last`` names a boolean column that marks a request's final chunk.  Chunks are taken in
    sequence order; those that come early wait.  The state is the tokens of less than two
    batches, so that the final batch is known as such, and the chunks that wait.  A request
    without a single token gives no batch.
    """
    d = chunks.select(F.col(key), F.col(seq).cast("bigint").alias("_seq"), tokens(text).alias("_toks"),
                      F.coalesce(F.col(last), F.lit(False)).alias("_end"))
    state_schema = "nxt bigint, idx bigint, carry array<string>, seqs array<bigint>, toks array<array<string>>, final bigint"

    def fn(k, pdfs, state):
        nxt, idx, carry, seqs, toks, final = state.get if state.exists else (first_seq, 0, [], [], [], None)
        wait = dict(zip(seqs, toks, strict=True))
        for pdf in pdfs:
            wait.update(zip(pdf["_seq"].tolist(), pdf["_toks"].tolist(), strict=True))
            ends = pdf.loc[pdf["_end"], "_seq"]
            final = int(ends.max()) if len(ends) else final
        carry, out = list(carry), []
        while nxt in wait:
            got = wait.pop(nxt)
            carry.extend([] if got is None else list(got))
            nxt += 1
            while len(carry) > n:                      # something follows, so this is not the last
                out.append((idx, "".join(carry[:n]), False))
                carry, idx = carry[n:], idx + 1
        if final is not None and nxt > final:
            if carry:
                out.append((idx, "".join(carry), True))
            state.remove()
        else:
            state.update((nxt, idx, carry, list(wait), [list(t) for t in wait.values()], final))
        if out:
            rows = pd.DataFrame(out, columns=["idx", "batch", "is_last"])
            rows.insert(0, key, k[0])
            yield rows

    return d.groupBy(key).applyInPandasWithState(fn, f"{key} bigint, idx bigint, batch string, is_last boolean", state_schema,
                                                 "append", GroupStateTimeout.NoTimeout)


# ----------------------------------------------------------------------------- STM4
def ttl_hold_stream(events: DataFrame, key: str, ts: str, id_col: str, value: str, ttl_seconds: int = 12,
                    lateness: str = "1 minute") -> DataFrame:
    """First value per (key, TTL bucket) and the number of calls it served (update mode)."""
    et = event_time(ts)
    d = events.withColumn("_et", et).withWatermark("_et", lateness)
    bucket = F.floor(epoch_us(ts) / F.lit(ttl_seconds * 1_000_000)).cast("bigint")
    return (d.withColumn("bucket", bucket)
             .groupBy(F.col(key), F.col("bucket"))
             .agg(F.min(F.struct(F.col("_et"), F.col(id_col), F.col(value))).alias("_m"),
                  F.count(F.lit(1)).alias("n_calls"))
             .select(key, "bucket", F.col("_m")[value].alias("held_value"), "n_calls"))


# ----------------------------------------------------------------------------- STM6
def deadline_join_stream(requests: DataFrame, responses: DataFrame, key: str, deadline: str = "30 minutes",
                         lateness: str = "10 minutes") -> DataFrame:
    """Stream-stream left outer interval join: every response within the deadline of a
    request, and a NULL row for requests that saw none once the watermark passes.

    ``requests``: (req_id, key, ts); ``responses``: (resp_id, key, ts).  The first
    response per request is a downstream ``min`` per req_id (see operators.timing).
    """
    rq = (requests.select("req_id", F.col(key).alias("_rk"), event_time("ts").alias("req_time"))
                  .withWatermark("req_time", lateness))
    rs = (responses.select("resp_id", F.col(key).alias("_sk"), event_time("ts").alias("resp_time"))
                   .withWatermark("resp_time", lateness))
    cond = ((F.col("_rk") == F.col("_sk")) & (F.col("resp_time") >= F.col("req_time"))
            & (F.col("resp_time") < F.col("req_time") + F.expr(f"INTERVAL {deadline}")))
    return rq.join(rs, cond, "leftOuter").select("req_id", "resp_id", "req_time", "resp_time")


def deadline_stream(requests: DataFrame, responses: DataFrame, key: str, deadline: str = "30 minutes",
                    lateness: str = "10 minutes", ok_code: int = 200, late_code: int = 408) -> DataFrame:
    """(req_id, resp_id, status_code) of every request, as soon as its verdict is final (append mode).

    The first response within the deadline counts.  The watermark, not a response, closes a
    request: once no response within its deadline can still come, its row is emitted, with
    ``late_code`` and no response if there was none.  Rows may be up to ``lateness`` late.
    """
    pairs = deadline_join_stream(requests, responses, key, deadline, lateness)
    answer = F.struct(F.unix_micros("resp_time").alias("t"), F.col("resp_id"))
    pairs = pairs.select("req_id", "req_time", F.when(F.col("resp_id").isNotNull(), answer).alias("answer"))
    first = pairs.groupBy("req_id", "req_time").agg(F.min("answer").alias("answer"))
    return first.select("req_id", F.col("answer.resp_id").alias("resp_id"),
                        F.when(F.col("answer").isNull(), late_code).otherwise(ok_code).alias("status_code"))


# ----------------------------------------------------------------------------- STM10
def recent_duplicates_stream(requests: DataFrame, keys: list[str], ts: str, id_col: str, window_seconds: int,
                             lateness: str = "10 minutes") -> DataFrame:
    """(keys..., id_col, accepted) of every request: accepted unless its keys were accepted less
    than ``window_seconds`` before, in whole seconds (STM10, append mode).

    Rows may come up to ``lateness`` out of order, so a request waits in its key's state until
    the watermark passes it.  The state is the second last accepted and the waiting requests;
    a timer closes them, and the state goes once it can reject nothing more.  Later rows are
    dropped.  The keys of a slot share one state, one timer and one call a batch.
    """
    fields = StructType([f for k in keys for f in requests.schema.fields if f.name == k])
    d = (requests.withColumn("_et", event_time(ts)).withWatermark("_et", lateness)
                 .select(F.to_json(F.struct(*keys)).alias("_key"), F.col(id_col).cast("bigint").alias("_id"),
                         F.floor(epoch_us(ts) / 1_000_000).alias("_s"), "_et", slot(*keys)))

    def close(rows, last, mark):
        """A key's final requests, whether accepted, the last accepted, those that wait, and until when."""
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        final = rows[:, 0] < mark // 1000             # no row of these seconds can still come
        done, rows = rows[final], rows[~final]
        accepted = np.zeros(len(done), bool)
        i = 0 if last is None else int(np.searchsorted(done[:, 0], last + window_seconds))
        while i < len(done):
            accepted[i], last = True, int(done[i, 0])
            i = int(np.searchsorted(done[:, 0], last + window_seconds))
        until = int(rows[0, 0]) + 1 if len(rows) else -1 if last is None else last + window_seconds
        return done, accepted, last, rows, until

    def fn(_, pdfs, state):
        keys, lasts, *held = state.get if state.exists else ([], [], [], [], [])
        keys, lasts = list(keys), list(lasts)
        parts = [] if state.hasTimedOut else [*pdfs]
        rows, own = _numbered(keys, [p["_key"] for p in parts], [p[["_s", "_id"]].to_numpy(np.int64) for p in parts])
        lasts += [None] * (len(keys) - len(lasts))
        held_no, *held_rows = (np.asarray(h, np.int64) for h in held)
        every = dict(_split(np.concatenate([held_no, own]), np.concatenate([np.stack(held_rows, axis=1).reshape(-1, 2), rows.reshape(-1, 2)])))
        mark = state.getCurrentWatermarkMs()
        none, kept, waits, untils, told, verdict, who = np.zeros((0, 2), np.int64), [], [], [], [], [], []
        for k, name in enumerate(keys):
            if k not in every:                        # nothing waits: the last accepted holds until its window ends
                if lasts[k] is not None and 1000 * (lasts[k] + window_seconds) > mark:
                    kept.append((name, lasts[k]))
                    waits.append(none)
                    untils.append(lasts[k] + window_seconds)
                continue
            done, accepted, last, wait, until = close(every[k], lasts[k], mark)
            if 1000 * until > mark:
                kept.append((name, last))
                waits.append(wait)
                untils.append(until)
            if len(done):
                told.append(done[:, 1])
                verdict.append(accepted)
                who += [name] * len(done)
        if kept:
            left = np.concatenate(waits)
            state.update(([k for k, _ in kept], [x for _, x in kept], np.repeat(np.arange(len(kept)), [len(w) for w in waits]).tolist(),
                          *(left[:, j].tolist() for j in range(2))))
            state.setTimeoutTimestamp(1000 * min(untils))
        else:
            state.remove()
        if told:
            yield pd.DataFrame({"_key": pd.Series(who, dtype=object), id_col: np.concatenate(told), "accepted": np.concatenate(verdict)})

    out = d.groupBy("_slot").applyInPandasWithState(
        fn, f"_key string, `{id_col}` bigint, accepted boolean", "keys array<string>, lasts array<bigint>, own array<bigint>, "
        "s array<bigint>, ids array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
    key = F.from_json("_key", fields)
    return out.select(*[key[k].alias(k) for k in keys], id_col, "accepted")


# ----------------------------------------------------------------------------- STM8
def population_resync(snapshots: DataFrame, base: str, uid: str, hotkey: str, order: list[str]):
    """Land a stream of (uid, hotkey, order...) snapshot rows under ``base``, a folder per
    micro-batch, overwritten on retry (STM8).  Returns the streaming writer, not started.

    Nothing is read back or merged while streaming, so rows may come in any order.
    """
    def land(batch: DataFrame, batch_id: int) -> None:
        batch.select(uid, hotkey, *order).write.mode("overwrite").parquet(f"{base}/v={batch_id}")

    return snapshots.writeStream.foreachBatch(land)


def current_population(landed: DataFrame, uid: str, hotkey: str, order: list[str]) -> DataFrame:
    """uid, its current hotkey by ``order``, and how often it changed hands (WIN2 on read)."""
    from ..operators.scoring import ema_with_reset
    return ema_with_reset(landed.withColumn("_none", F.lit(0.0)), uid, order, hotkey, "_none").select(uid, hotkey, "n_resets")


# ----------------------------------------------------------------------------- STM3 (ratings)
def trueskill_stream(subs: DataFrame, league: str, rnd: str, ts: str, id_col: str, player: str, score: str,
                     valid: str, cfg=None, open_rounds: int = 24 * 366) -> DataFrame:
    """TrueSkill league state across micro-batches (STM3).

    State per league: the ratings after the closed rounds, and each player's latest response,
    by (time, id), of the open ones.  A round closes ``open_rounds`` rounds after it; until
    then responses may come in any order, and later ones do not count.  Every batch replays
    the open rounds from the closed ratings and reports them (update mode; the last report
    per (league, round, player) stands).
    """
    from ..config import RatingConfig
    from ..operators.ratings import trueskill_round
    cfg = cfg or RatingConfig()
    d = subs.select(F.col(league).cast("bigint").alias("lg"), F.col(rnd).cast("bigint").alias("rnd"),
                    epoch_us(ts).alias("t_us"), F.col(id_col).cast("bigint").alias("eid"),
                    F.col(player).cast("bigint").alias("pl"), F.col(score).cast("double").alias("sc"),
                    F.coalesce(F.col(valid), F.lit(False)).alias("ok"))
    out_schema = f"{league} bigint, {rnd} bigint, {player} bigint, mu double, sigma double, ts_score double"
    state_schema = ("players array<bigint>, mus array<double>, sigmas array<double>, closed bigint, p_rnd array<bigint>, "
                    "p_t array<bigint>, p_id array<bigint>, p_pl array<bigint>, p_sc array<double>, p_ok array<boolean>")
    names = ["rnd", "t_us", "eid", "pl", "sc", "ok"]

    def play(ratings: dict, rows: pd.DataFrame, lg, out: list) -> None:
        for r, part in rows[rows["ok"]].groupby("rnd", sort=True):
            pairs = [(int(p), float(x)) for p, x in zip(part["pl"], part["sc"], strict=True)]
            out.extend((lg, int(r), *x) for x in trueskill_round(ratings, pairs, cfg))

    def fn(k, pdfs, state):
        players, mus, sigmas, closed, *held = state.get if state.exists else ([], [], [], None, *[[]] * 6)
        ratings = {int(p): (float(m), float(s)) for p, m, s in zip(players, mus, sigmas, strict=True)}
        rows = pd.concat([pd.DataFrame(dict(zip(names, held, strict=True))), *(p[names] for p in pdfs)])
        rows = rows.astype({"rnd": "int64", "t_us": "int64", "eid": "int64", "pl": "int64", "sc": "float64", "ok": "bool"})
        if closed is not None:
            rows = rows[rows["rnd"] > closed]
        rows = rows.sort_values(["rnd", "t_us", "eid"], kind="stable").drop_duplicates(["rnd", "pl"], keep="last")
        out: list = []
        if len(rows):
            done = rows["rnd"] <= int(rows["rnd"].iloc[-1]) - open_rounds
            play(ratings, rows[done], k[0], out)
            closed = int(rows.loc[done, "rnd"].iloc[-1]) if done.any() else closed
            rows = rows[~done]
        order = list(ratings)
        state.update((order, [ratings[p][0] for p in order], [ratings[p][1] for p in order], closed,
                      *(rows[c].tolist() for c in names)))
        play(dict(ratings), rows, k[0], out)
        if out:
            yield pd.DataFrame(out, columns=[league, rnd, player, "mu", "sigma", "ts_score"])

    return d.groupBy("lg").applyInPandasWithState(fn, out_schema, state_schema, "update",
                                                  GroupStateTimeout.NoTimeout)
