"""STM1, STM3: keyed state as lists and maps with timers, through ``transformWithState``.

A batch writes to the state what it brings, instead of one value that is read and written
whole; timers, not the next row, close what is finished; and state that nobody finishes
expires.  These processors need the RocksDB state store, which ``run_processor`` chooses for
its query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.math import epoch_us
from ..functions.nested import chunk_text
from .runner import event_time, run_to_table, slot

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def run_processor(spark: SparkSession, stream: Callable[[], DataFrame], name: str, idle_batches: bool = True) -> DataFrame:
    """Run ``stream`` until the available input is consumed; see ``runner.run_to_table``.

    Batches without rows let the watermark close what is open; a stream whose state expires by
    the clock would run them without end, so it needs ``idle_batches`` off.
    """
    with _settings(spark, {_PROVIDER: _ROCKS, _IDLE: str(idle_batches).lower()}):
        return run_to_table(spark, stream(), name)


# ----------------------------------------------------------------------------- STM3
class _RoundScores(StatefulProcessor):
    """The scores over closed rounds of a slot's keys, and the responses of their open rounds as they came."""

    def __init__(self, key: str, round_ms: int, alpha: float) -> None:
        self.key, self.round_ms, self.alpha = key, round_ms, alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.scores = handle.getListState("scores", "key bigint, score double, n bigint")
        self.open = handle.getListState("open", "rnd bigint, key bigint, t bigint, id bigint, reward double, ok boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first, names = None, ["rnd", self.key, "t", "id", "reward", "ok"]
        for pdf in rows:
            part = pdf[names].sort_values(names[:4]).drop_duplicates(names[:2], keep="last")
            self.open.appendList([*zip(*(part[c].tolist() for c in names), strict=True)])
            first = int(part["rnd"].iloc[0]) if first is None else min(first, int(part["rnd"].iloc[0]))
        if first is not None:
            self.handle.registerTimer(max((first + 1) * self.round_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame({self.key: [], "rnd": [], "score": [], "n_updates": []})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        upto = timerValues.getCurrentWatermarkInMs()
        held = sorted(self.open.get()) if self.open.exists() else []
        rounds = {r[:2]: r for r in held}                    # the last response of a key's round counts
        done = [r for r in rounds.values() if (r[0] + 1) * self.round_ms <= upto]
        rest = [r for r in rounds.values() if (r[0] + 1) * self.round_ms > upto]
        out = []
        if done:
            scores = {k: (score, n) for k, score, n in self.scores.get()} if self.scores.exists() else {}
            for rnd, k, _, _, reward, ok in done:
                score, n = scores.get(k, (0.0, 0))
                if ok:
                    score, n = self.alpha * reward + (1 - self.alpha) * score, n + 1
                scores[k] = score, n
                out.append((k, rnd, score, n))
            self.scores.put([(k, *x) for k, x in scores.items()])
            if rest:
                self.open.put(rest)
            else:
                self.open.clear()
        if rest:
            self.handle.registerTimer((rest[0][0] + 1) * self.round_ms)
        yield pd.DataFrame(out, columns=[self.key, "rnd", "score", "n_updates"])

    def close(self) -> None:
        pass


def round_scores(responses: DataFrame, key: str, ts: str, id_col: str, reward: str, valid: str, round_seconds: int = 3_600,
                 alpha: float = 0.1) -> DataFrame:
    """(key, rnd, score, n_updates) of every round of a key as it closes (STM3, append mode).

    ``responses`` has a watermark on ``_et``.  The last response of a round by (time, id)
    counts, and only if it is ``valid``.  A timer closes a round when the watermark passes its
    end; what comes later is dropped.  The state of a key is its score and the responses of
    its open rounds: a batch appends its own and a closing round rewrites the few left open.
    The keys of a slot share their lists and timers.
    """
    d = responses.select(slot(key), F.col(key).cast("bigint").alias(key), "_et", F.floor(epoch_us(ts) / (round_seconds * 1_000_000)).alias("rnd"), epoch_us(ts).alias("t"),
                         F.col(id_col).cast("bigint").alias("id"),
                         F.nanvl(F.coalesce(F.col(reward).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("reward"),
                         F.coalesce(F.col(valid), F.lit(False)).alias("ok"))
    return d.groupBy("_slot").transformWithStateInPandas(
        _RoundScores(key, 1_000 * round_seconds, alpha), f"{key} bigint, rnd bigint, score double, n_updates bigint", "append", "EventTime")


def watermarked(events: DataFrame, ts: str, lateness: str) -> DataFrame:
    """``events`` with their event time ``_et`` and its watermark."""
    return events.withColumn("_et", event_time(ts)).withWatermark("_et", lateness)


# ----------------------------------------------------------------------------- STM1
class _Messages(StatefulProcessor):
    """The pieces of a message by their number, and how many there are once its end is known."""

    def __init__(self, key: str, first_seq: int, ttl_ms: int) -> None:
        self.key, self.first_seq, self.ttl_ms = key, first_seq, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pieces = handle.getMapState("pieces", "seq bigint", "piece string", ttlDurationMs=self.ttl_ms)
        self.seen = handle.getValueState("seen", "have bigint, last bigint", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        have, last = self.seen.get() if self.seen.exists() else (0, None)
        for pdf in rows:
            for seq, piece, end in zip(pdf["seq"].tolist(), pdf["piece"].tolist(), pdf["end"].tolist(), strict=True):
                if end:
                    last = int(seq)
                elif not self.pieces.containsKey((int(seq),)):           # a chunk sent again changes nothing
                    self.pieces.updateValue((int(seq),), (piece,))
                    have += 1
        if last is not None and have == last - self.first_seq:
            text = "".join(v[0] or "" for _, v in sorted((k[0], v) for k, v in self.pieces.iterator())) if have else ""
            self.pieces.clear()
            self.seen.clear()
            yield pd.DataFrame({self.key: [key[0]], "completion": [text], "n_chunks": [have]})
        else:
            self.seen.update((have, last))

    def close(self) -> None:
        pass


def messages(chunks: DataFrame, key: str, seq: str, text: str, end: str, first_seq: int = 0, ttl_hours: float = 24.0) -> DataFrame:
    """(key, completion, n_chunks) of every message once its end and all its chunks are there (STM1).

    ``end`` marks the end message, which holds no text and whose number follows the last
    chunk's.  Chunks may come in any order and more than once.  A chunk is written to the
    state once, and read when its message is complete; messages that are not completed within
    ``ttl_hours`` of their last chunk expire.
    """
    d = chunks.select(F.col(key), F.col(seq).cast("bigint").alias("seq"), chunk_text(text).alias("piece"),
                      F.coalesce(F.col(end), F.lit(False)).alias("end"))
    return d.groupBy(key).transformWithStateInPandas(
        _Messages(key, first_seq, int(3.6e6 * ttl_hours)), f"{key} bigint, completion string, n_chunks bigint", "append", "ProcessingTime")
