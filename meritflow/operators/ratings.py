"""Ratings: JOIN5, WIN3, WIN5-8, MTH3-4, AGG14.

Elo tournaments are independent per problem and TrueSkill leagues are independent
per league, so both run as grouped-map folds (``applyInPandas``) with one group per
problem / league.  Everything upstream (grading, cleaning, ranking) is plain Spark; the
fold receives only (group, round, player, score, order) rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import RatingConfig
from ..session import spread_groups

_N = NormalDist()


# ----------------------------------------------------------------------------- Elo
_MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_MD5_ADD = [int(abs(math.sin(t + 1)) * 2 ** 32) for t in range(64)]
_MD5_TURN = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_MD5_WORD = [(1, 0), (5, 1), (3, 5), (7, 0)]
_U32 = 0xFFFFFFFF
#: A tournament of fewer submissions is folded match by match.
FOLD_TOGETHER = 640
#: Pairs of a tournament whose places are held at once, two bytes each.
HELD = 300_000_000
#: Matches handed on together.
_STEP = 1 << 18


def _md5_start_of(words: list, size: int) -> np.ndarray:
    """The first 64 bits of ``size`` md5 digests; a block's word is one int for all or a uint32 array."""
    a, b, c, d = _MD5_START
    t = 0
    while t < 15 and isinstance(words[t], int):          # alike in all texts
        f = ((d ^ (b & (c ^ d))) + a + words[t] + _MD5_ADD[t]) & _U32
        turn = _MD5_TURN[0][t % 4]
        a, d, c, b = d, c, b, (b + (f << turn | f >> (32 - turn))) & _U32
        t += 1
    a, b, c, d, f = (np.full(size, x, np.uint32) for x in (a, b, c, d, 0))
    for t in range(t, 64):
        kind = t // 16
        if kind == 0:                                     # d ^ (b & (c ^ d))
            np.bitwise_xor(c, d, f)
            np.bitwise_and(f, b, f)
            np.bitwise_xor(f, d, f)
        elif kind == 1:                                   # c ^ (d & (b ^ c))
            np.bitwise_xor(b, c, f)
            np.bitwise_and(f, d, f)
            np.bitwise_xor(f, c, f)
        elif kind == 2:                                   # b ^ c ^ d
            np.bitwise_xor(b, c, f)
            np.bitwise_xor(f, d, f)
        else:                                             # c ^ (b | ~d)
            np.invert(d, f)
            np.bitwise_or(f, b, f)
            np.bitwise_xor(f, c, f)
        step, first = _MD5_WORD[kind]
        word = words[(step * t + first) % 16]
        np.add(a, f, a)
        if isinstance(word, int):
            np.add(a, np.uint32((word + _MD5_ADD[t]) & _U32), a)
        else:
            np.add(a, word, a)
            np.add(a, np.uint32(_MD5_ADD[t]), a)
        turn = _MD5_TURN[kind][t % 4]
        np.left_shift(a, np.uint32(turn), f)
        np.right_shift(a, np.uint32(32 - turn), a)
        np.bitwise_or(a, f, a)
        np.add(a, b, a)
        a, d, c, b = d, c, b, a
    a, b = ((x + np.uint32(y)).byteswap().astype(np.uint64) for x, y in zip((a, b), _MD5_START, strict=False))
    return (a << np.uint64(32)) | b


def _decimal_words(lo: int, hi: int, digits: int, at: int) -> dict[int, np.ndarray]:
    """Words of md5 blocks that have only the ``digits`` digits of lo .. hi - 1, from byte ``at`` on."""
    values, text = np.arange(lo, hi), np.zeros((hi - lo, 64), np.uint8)
    for place in range(at + digits - 1, at - 1, -1):
        text[:, place] = 48 + values % 10
        values //= 10
    words = text.view("<u4")
    return {k: words[:, k].astype(np.uint32) for k in range(at // 4, (at + digits - 1) // 4 + 1)}


class _Pairs:
    """All pairs i < j of n submissions in blocks of at most 2^16, and the start of
    md5('<prefix><i>:<j>') of any of them.

    All i, and all j, of a block have as many digits; ``blocks`` has (lot, first i, end of i), and
    a lot's pairs have j from ``lo`` to ``hi`` - 1.
    """

    def __init__(self, n: int, most: int = 1 << 16):
        self.lots, self.blocks = [], []
        edges = [0] + [10 ** k for k in range(1, 19)]
        of = lambda k, end: range(edges[k - 1], min(edges[k], end))
        for di in range(1, len(str(n)) + 1):
            for dj in range(di, len(str(n)) + 1):
                rows, columns = of(di, n - 1), of(dj, n)
                for lo in range(columns.start, columns.stop, most // 2):
                    hi = min(columns.stop, lo + most // 2)
                    i, end = rows.start, min(rows.stop, hi - 1)
                    self.lots.append((di, dj, rows.start, rows.stop, lo, hi))
                    while i < end:
                        after = min(end, i + max(1, most // (hi - max(lo, i + 1))))
                        self.blocks.append((len(self.lots) - 1, i, after))
                        i = after

    def of(self, block: tuple[int, int, int], at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The block's pairs, or those at its ascending places ``at``."""
        lot, i0, i1 = block
        *_, lo, hi = self.lots[lot]
        rows = np.arange(i0, i1)
        counts = hi - np.maximum(lo, rows + 1)
        ends = np.cumsum(counts)
        if at is None:
            at = np.arange(ends[-1])
        else:
            counts = np.diff(np.searchsorted(at, ends), prepend=0)
        return np.repeat(rows, counts), at + np.repeat(hi - ends, counts)

    def digests(self, prefix: bytes):
        """(lot, i, j) -> first 64 bits of the digests, for pairs of one lot."""
        tables: dict = {}

        def start_of(lot: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
            di, dj, i0, i1, lo, hi = self.lots[lot]
            text = prefix + b"\0" * di + b":" + b"\0" * dj
            if len(text) > 55:                            # more than one block
                both = [hashlib.md5(prefix + b"%d:%d" % x).digest()[:8] for x in zip(i.tolist(), j.tolist(), strict=True)]
                return np.frombuffer(b"".join(both), ">u8").astype(np.uint64)
            if lot not in tables:
                tables.clear()
                tables[lot] = (_decimal_words(i0, i1, di, len(prefix)), _decimal_words(lo, hi, dj, len(text) - dj))
            words: list = np.frombuffer((text + b"\x80").ljust(56, b"\0") + (8 * len(text)).to_bytes(8, "little"), "<u4").tolist()
            for table, at in zip(tables[lot], (i - i0, j - lo), strict=True):
                for k, column in table.items():
                    words[k] = column.take(at) + (np.uint32(words[k]) if isinstance(words[k], int) else words[k])
            return _md5_start_of(words, len(i))
        return start_of


def match_blocks(n: int, rounds: int, seed: str, at_once: int = 10_000_000,
                 held: int = HELD) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(round, i, j) arrays whose matches follow one another as in ``match_schedule``.

    Beyond ``at_once`` pairs they are sorted by parts of the hash. The places of up to ``held`` pairs
    are first dealt to their parts, so a digest is computed twice, however many parts there are, and
    once more for every further ``held`` pairs.
    """
    total = n * (n - 1) // 2
    if not total:
        return
    passes = -(-total // held)
    each = -(-total // (passes * max(at_once, total // 60_000)))      # parts of a pass
    parts = passes * each
    pairs = _Pairs(n)
    for r in range(rounds):
        prefix = f"{seed}:{r}:".encode()
        start_of = pairs.digests(prefix)
        if parts == 1:
            keys, end = np.empty(total, np.uint64), 0
            for block in pairs.blocks:
                i, j = pairs.of(block)
                keys[end:end + len(i)] = _keyed(n, start_of(block[0], i, j), i, j)
                end += len(i)
            yield from ((r, i, j) for i, j in _in_order(n, keys, prefix))
            continue
        for first in range(0, parts, each):
            places, cuts = [], np.zeros((len(pairs.blocks), each + 1), np.int64)
            for at, block in enumerate(pairs.blocks):
                i, j = pairs.of(block)
                part = ((start_of(block[0], i, j) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64) - first
                here = np.flatnonzero((part >= 0) & (part < each)) if passes > 1 else np.arange(len(part))
                dealt = np.sort((part[here].astype(np.uint32) << np.uint32(16)) | here.astype(np.uint32))
                cuts[at] = np.searchsorted(dealt, np.arange(each + 1, dtype=np.uint32) << np.uint32(16))
                places.append(dealt.astype(np.uint16))
            for k in range(each):
                low = -(-((first + k) << 32) // parts) << 32            # the least hash of the part
                keys, end = np.empty(int((cuts[:, k + 1] - cuts[:, k]).sum()), np.uint64), 0
                for lot, i, j in _gathered(pairs, places, cuts[:, k], cuts[:, k + 1]):
                    start = (start_of(lot, i, j) - np.uint64(low)) << np.uint64(parts.bit_length() - 1)
                    keys[end:end + len(i)] = _keyed(n, start, i, j)
                    end += len(i)
                yield from ((r, i, j) for i, j in _in_order(n, keys, prefix))


def _gathered(pairs: _Pairs, places: list[np.ndarray], begins: np.ndarray, ends: np.ndarray,
              most: int = 1 << 16) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(lot, i, j) of the pairs at places[b][begins[b]:ends[b]], about ``most`` at a time."""
    some, held, lot = [], 0, None
    for block, place, begin, end in zip(pairs.blocks, places, begins.tolist(), ends.tolist(), strict=True):
        if some and (lot != block[0] or held >= most):
            yield lot, *(np.concatenate(x) for x in zip(*some, strict=True))
            some, held = [], 0
        lot = block[0]
        if end > begin:
            some.append(pairs.of(block, place[begin:end].astype(np.int64)))
            held += end - begin
    if some:
        yield lot, *(np.concatenate(x) for x in zip(*some, strict=True))


def _keyed(n: int, start: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """One number of the digest's first bits and the pair."""
    bits = np.uint64((n - 1).bit_length())
    pair = (i.astype(np.uint64) << bits) | j.astype(np.uint64)
    return (start >> (bits + bits) << (bits + bits)) | pair


def _in_order(n: int, keys: np.ndarray, prefix: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) arrays of the pairs in ``keys`` by their digests; sorts ``keys``."""
    keys.sort()
    bits = (n - 1).bit_length()
    start_of = lambda x: x >> np.uint64(2 * bits)
    at = 0
    while at < len(keys):
        end = min(len(keys), at + _STEP)
        while end < len(keys) and start_of(keys[end]) == start_of(keys[end - 1]):
            end += 1
        some = keys[at:end]
        i = ((some >> np.uint64(bits)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        j = (some & np.uint64((1 << bits) - 1)).astype(np.int64)
        same = np.zeros(len(some) + 1, bool)
        same[1:-1] = start_of(some[1:]) == start_of(some[:-1])
        tied = np.flatnonzero(same[1:] | same[:-1])
        if len(tied):                             # alike in the bits kept: by the whole digest
            found = zip(start_of(some[tied]).tolist(), i[tied].tolist(), j[tied].tolist(), strict=True)
            ranked = sorted((s, hashlib.md5(prefix + b"%d:%d" % (a, b)).digest(), a, b) for s, a, b in found)
            i[tied], j[tied] = [x[2] for x in ranked], [x[3] for x in ranked]
        yield i, j
        at = end


def match_schedule(n: int, rounds: int, seed: str, at_once: int = 10_000_000) -> Iterator[tuple[int, int, int]]:
    """All pairs i<j of n submissions, ``rounds`` times; inside a round the pairs are
    ordered by md5('<seed>:<round>:<i>:<j>') -- a seeded, portable shuffle (JOIN5, TOP6).

    A large tournament is played by ranges of the hash, so about ``at_once`` pairs are held.
    """
    for r, i, j in match_blocks(n, rounds, seed, at_once):
        yield from ((r, a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True))


def elo_fold(scores: list[float], cfg: RatingConfig = RatingConfig(), seed: str = "0") -> list[float]:
    """Ratings after the tournament; a judge prefers the higher score, equal is a draw.

    draw_mode 'reference' applies the 0.5 update and then a win for the second player;
    'standard' applies only the 0.5 update.
    """
    if len(scores) >= FOLD_TOGETHER:
        return _elo_fold_together(scores, cfg, seed)
    r = [cfg.elo_default] * len(scores)
    k_factor = cfg.elo_k
    reference = cfg.draw_mode == "reference"
    for _, a, b in match_schedule(len(scores), cfg.elo_rounds, seed):
        sa, sb = scores[a], scores[b]
        if sa == sb:
            ch = k_factor * (0.5 - 1.0 / (1.0 + 10.0 ** ((r[b] - r[a]) / 400.0)))
            r[a] += ch
            r[b] -= ch
            if not reference:
                continue
            a, b = b, a                       # then the second player is credited with a win
        elif sa < sb:
            a, b = b, a
        ch = k_factor * (1.0 - 1.0 / (1.0 + 10.0 ** ((r[b] - r[a]) / 400.0)))
        r[a] += ch
        r[b] -= ch
    return r


def _elo_fold_together(scores: list[float], cfg: RatingConfig, seed: str) -> list[float]:
    """``elo_fold`` by a window over the next matches: those with no earlier match of either player in
    the window are played together and the window is filled up, so each player's matches keep their order."""
    n = len(scores)
    score, r = np.array(scores, np.float64), np.full(n, cfg.elo_default)
    size = max(16, n // (6 if n < 10_000 else 10))
    place = np.repeat(np.arange(size), 2)
    earliest = np.empty(n, np.int64)              # a player's first place in the window
    waiting, result = np.empty((0, 2), np.int64), np.empty(0)

    def play(more: np.ndarray, won: np.ndarray, until: int) -> None:
        nonlocal waiting, result
        at = 0
        while at < len(more) or len(waiting) > until:
            end = min(len(more), at + size - len(waiting))
            waiting, result = np.concatenate((waiting, more[at:end])), np.concatenate((result, won[at:end]))
            at, players = end, waiting.ravel()
            earliest[players[::-1]] = place[:len(players)][::-1]          # the last one written stays
            free = earliest.take(players) == place[:len(players)]
            ready = free[0::2] & free[1::2]
            now = np.flatnonzero(ready)
            both = waiting.take(now, axis=0)
            rated = r.take(both)
            change = cfg.elo_k * (result.take(now) - 1.0 / (1.0 + 10.0 ** ((rated[:, 1] - rated[:, 0]) / 400.0)))
            rated[:, 0] += change
            rated[:, 1] -= change
            r[both] = rated
            later = np.flatnonzero(~ready)
            waiting, result = waiting.take(later, axis=0), result.take(later)

    for _, i, j in match_blocks(n, cfg.elo_rounds, seed):
        first, second = score.take(i), score.take(j)
        drawn, swap = first == second, first < second
        more = np.empty((len(i), 2), np.int64)
        more[:, 0], more[:, 1] = np.where(swap, j, i), np.where(swap, i, j)
        won = np.where(drawn, 0.5, 1.0)
        if cfg.draw_mode == "reference":                  # then the second player is credited with a win
            at = np.flatnonzero(drawn)
            more, won = np.insert(more, at + 1, more[at, ::-1], axis=0), np.insert(won, at + 1, 1.0)
        play(more, won, size - 1)
    play(np.empty((0, 2), np.int64), np.empty(0), 0)
    return r.tolist()


def elo_ratings(subs: DataFrame, problem: str, order: list[str], player: str, score: str,
                cfg: RatingConfig = RatingConfig(), seed: str = "elo") -> DataFrame:
    """Per problem: Elo rating and rank of each submission (WIN5, WIN6).

    ``order`` columns give the submission order inside a problem (idx = position).
    Returns (problem, player, idx, rating, rank).  The grouped fold sorts its rows
    itself, so the only shuffle is the spread by problem.
    """
    schema = f"{problem} bigint, {player} bigint, idx bigint, rating double, rank bigint"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        prob = int(pdf[problem].iat[0])
        rat = elo_fold(pdf[score].astype(float).tolist(), cfg, seed=f"{seed}:{prob}")
        out = pd.DataFrame({problem: prob, player: pdf[player].astype("int64"),
                            "idx": np.arange(len(pdf), dtype=np.int64), "rating": rat})
        ranked = out.sort_values(["rating", "idx"], ascending=[False, True], kind="stable").index
        rank = np.empty(len(out), dtype=np.int64)
        rank[ranked] = np.arange(1, len(out) + 1)
        out["rank"] = rank
        return out

    d = subs.select(F.col(problem).cast("bigint"), F.col(player).cast("bigint"), *order, F.col(score).cast("double"))
    return spread_groups(d, problem).groupBy(problem).applyInPandas(fold, schema)


def elo_from_judgements(players: DataFrame, judgements: DataFrame, problem: str, player: str,
                        cfg: RatingConfig = RatingConfig()) -> DataFrame:
    """Per problem: Elo rating and rank of each submission (WIN5, WIN6) from judged matches.

    ``judgements``: (problem, rr, i, j, at, a_wins, b_wins, draw).  Judgements without
    exactly one flag are rejected (FLT12) and counted per problem in ``n_rejected``.  The
    matches of a problem are folded in (rr, at) order, problems in parallel; draw_mode
    'reference' applies the 0.5 update and then a win for the second player.
    """
    from .grading import judgement_valid
    flat = judgements.select(F.col(problem).cast("bigint").alias(problem), F.col("rr").cast("bigint").alias("rr"), "at",
                             "i", "j", judgement_valid("a_wins", "b_wins", "draw").alias("ok"),
                             F.when(F.col("a_wins"), 1.0).when(F.col("b_wins"), 0.0).otherwise(0.5).alias("won"))
    games = flat.groupBy(problem).agg(
        F.sort_array(F.collect_list(F.when(F.col("ok"), F.struct("rr", "at", "i", "j", "won")))).alias("games"),
        F.sum((~F.col("ok")).cast("bigint")).alias("n_rejected"))
    sizes = players.groupBy(problem).agg(F.count("*").alias("n"))

    @F.pandas_udf("array<double>")
    def fold(n: pd.Series, games: pd.Series) -> pd.Series:
        out = []
        for size, played in zip(n, games, strict=True):
            r = [cfg.elo_default] * int(size)
            for g in [] if played is None else played:
                # a draw counts 0.5 and, in the modelled judge, then as a win of the second player
                for won in ([0.5, 0.0] if g["won"] == 0.5 and cfg.draw_mode == "reference" else [g["won"]]):
                    change = cfg.elo_k * (won - 1.0 / (1.0 + 10.0 ** ((r[g["j"]] - r[g["i"]]) / 400.0)))
                    r[g["i"]] += change
                    r[g["j"]] -= change
            out.append(r)
        return pd.Series(out)

    rated = (sizes.join(games, problem, "left").select(problem, F.coalesce("n_rejected", F.lit(0).cast("bigint")).alias("n_rejected"),
                                                       F.posexplode(fold("n", "games")).alias("pos", "rating"))
             .withColumn("idx", F.col("pos").cast("bigint")).drop("pos"))
    best = Window.partitionBy(problem).orderBy(F.desc("rating"), "idx")
    return (players.join(rated, [problem, "idx"]).withColumn("rank", F.row_number().over(best).cast("bigint"))
                   .select(problem, player, "idx", "rating", "rank", "n_rejected"))


# ----------------------------------------------------------------------------- TrueSkill
_ROOT_HALF, _DENSITY = math.sqrt(0.5), 1.0 / math.sqrt(2.0 * math.pi)
#: From here down, the moments come from the tail's continued fraction of this many levels.
TAIL, TAIL_LEVELS = -5.0, 40


def _won(x: float) -> tuple[float, float]:
    """v(x) = pdf / cdf and 1 - v * (v + x): shift and remaining variance of a unit normal cut at -x.

    Both keep their digits far down the tail, where 1 + erf(x) and v + x would lose them.
    """
    if x > TAIL:
        v = _DENSITY * math.exp(-0.5 * x * x) / (0.5 * math.erfc(-x * _ROOT_HALF))
        return v, 1.0 - v * (v + x)
    # v = y + d and d = 1 / (y + e) with e = 2 / (y + 3 / (y + ...)), so 1 - v * d = d * (e - d)
    y, e = -x, 0.0
    for k in range(TAIL_LEVELS, 1, -1):
        e = k / (y + e)
    d = 1.0 / (y + e)
    return y + d, d * (e - d)


def draw_margin(p_draw: float, beta: float, n_players: int = 2) -> float:
    return _N.inv_cdf((p_draw + 1.0) / 2.0) * math.sqrt(n_players) * beta


def rate_ffa(ratings: list[tuple[float, float]], cfg: RatingConfig = RatingConfig(),
             tol: float = 1e-10, max_iter: int = 200) -> list[tuple[float, float]]:
    """Free-for-all update of single-player teams given in finishing order (best first).

    Expectation propagation on the chain of performance differences: each difference
    of neighbours in the order is observed to exceed the draw margin.  Works in natural
    parameters (precision, precision * mean); returns new (mu, sigma) in input order.
    Plain floats: the chains are short and numpy scalars would only add overhead.
    """
    n = len(ratings)
    if n < 2:
        return list(ratings)
    b2, t2 = cfg.ts_beta ** 2, cfg.ts_tau ** 2
    eps = draw_margin(cfg.ts_draw_probability, cfg.ts_beta)
    sqrt = math.sqrt
    # prior message on each performance: N(mu, sigma^2 + tau^2 + beta^2)
    p_pi = [1.0 / (sg * sg + t2 + b2) for _, sg in ratings]
    p_tau = [m * pp for (m, _), pp in zip(ratings, p_pi)]
    m1 = n - 1
    l_pi, l_tau = [0.0] * m1, [0.0] * m1       # factor k -> t_k
    r_pi, r_tau = [0.0] * m1, [0.0] * m1       # factor k -> t_{k+1}
    tr_pi, tr_tau = [0.0] * m1, [0.0] * m1     # truncation messages on d_k

    def update(k):
        # cavities of t_k and t_{k+1}: prior times the message of the other neighbour
        api, atau = p_pi[k], p_tau[k]
        if k > 0:
            api += r_pi[k - 1]
            atau += r_tau[k - 1]
        bpi, btau = p_pi[k + 1], p_tau[k + 1]
        if k + 1 < m1:
            bpi += l_pi[k + 1]
            btau += l_tau[k + 1]
        am, av = atau / api, 1.0 / api
        bm, bv = btau / bpi, 1.0 / bpi
        dm, dv = am - bm, av + bv            # message down to d_k = t_k - t_{k+1}
        sd = sqrt(dv)
        v, left = _won((dm - eps) / sd)
        nm, nv = dm + sd * v, dv * left       # moment-matched truncated d_k
        new_pi = 1.0 / nv - 1.0 / dv
        new_tau = nm / nv - dm / dv
        # where a message is large its last digits are rounding, so its change counts relative to it
        delta = max(abs(new_pi - tr_pi[k]) / max(1.0, new_pi), abs(new_tau - tr_tau[k]) / max(1.0, abs(new_tau)))
        tr_pi[k], tr_tau[k] = new_pi, new_tau
        if new_pi > 0:                        # t_k = d_k + t_{k+1};  t_{k+1} = t_k - d_k
            tm, tv = new_tau / new_pi, 1.0 / new_pi
            l_pi[k] = 1.0 / (tv + bv)
            l_tau[k] = (tm + bm) * l_pi[k]
            r_pi[k] = 1.0 / (tv + av)
            r_tau[k] = (am - tm) * r_pi[k]
        return delta

    for _ in range(max_iter):
        delta = 0.0
        for k in range(m1):
            delta = max(delta, update(k))
        if m1 == 1:
            break                             # a single factor is exact after one update
        for k in range(m1 - 2, -1, -1):
            delta = max(delta, update(k))
        if delta < tol:
            break
    out = []
    for i, (mu, sigma) in enumerate(ratings):
        mpi = (r_pi[i - 1] if i > 0 else 0.0) + (l_pi[i] if i < m1 else 0.0)
        mtau = (r_tau[i - 1] if i > 0 else 0.0) + (l_tau[i] if i < m1 else 0.0)
        prior_pi = 1.0 / (sigma * sigma + t2)
        prior_tau = mu * prior_pi
        if mpi > 0:
            msg_v = 1.0 / mpi + b2            # what the game says, through the performance noise
            msg_pi, msg_tau = 1.0 / msg_v, (mtau / mpi) / msg_v
        else:
            msg_pi = msg_tau = 0.0
        post_pi, post_tau = prior_pi + msg_pi, prior_tau + msg_tau
        out.append((post_tau / post_pi, sqrt(1.0 / post_pi)))
    return out


def trueskill_round(ratings: dict[int, tuple[float, float]], subs: list[tuple[int, float]],
                    cfg: RatingConfig = RatingConfig()) -> list[tuple[int, float, float, float]]:
    """One round: update ``ratings`` in place from (player, score) in submission order and
    return (player, mu, sigma, normalised score) per submission (WIN3, WIN7, WIN8, AGG14).

    Players are ranked by score, ties by submission order (never shared).  A round with
    a single participant updates nothing but still reports a score.
    """
    if not subs:
        return []
    slope = math.log(4.0) / cfg.ts_beta
    latest: dict[int, float] = {}
    for p, s in subs:
        if p not in ratings:
            ratings[p] = (cfg.ts_mu, cfg.ts_sigma)
        latest[p] = s
    order = sorted(latest.items(), key=lambda kv: kv[1], reverse=True)
    players = [p for p, _ in order]
    if len(players) >= 2:
        for _ in range(cfg.ts_passes):
            new = rate_ffa([ratings[p] for p in players], cfg)
            for p, r in zip(players, new):
                ratings[p] = r
    mean_cr = float(np.mean([m - 3 * s for m, s in ratings.values()]))
    out = []
    for p, _ in subs:
        m, s = ratings[p]
        out.append((p, m, s, 1.0 / (1.0 + math.exp(-slope * ((m - 3 * s) - mean_cr)))))
    return out


def trueskill_fold(rounds: list[list[tuple[int, float]]], cfg: RatingConfig = RatingConfig()):
    """Replay rounds of (player, score) in submission order; yields per round and player
    (round_no, player, mu, sigma, normalised score)."""
    ratings: dict[int, tuple[float, float]] = {}
    for rno, subs in enumerate(rounds):
        for p, m, s, sc in trueskill_round(ratings, subs, cfg):
            yield rno, p, m, s, sc


def trueskill_scores(subs: DataFrame, league: str, rnd: str, order: list[str], player: str, score: str,
                     cfg: RatingConfig = RatingConfig()) -> DataFrame:
    """Per league, replay rounds in order; one row per submission with the rating after
    its round and the normalised score.  ``order`` gives the submission order inside a
    round.  Returns (league, round, player, mu, sigma, ts_score)."""
    schema = f"{league} bigint, {rnd} bigint, {player} bigint, mu double, sigma double, ts_score double"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([rnd, *order], kind="stable")
        lg = int(pdf[league].iat[0])
        ratings: dict[int, tuple[float, float]] = {}
        rows, cur, subs = [], None, []
        for r, p, s in zip(pdf[rnd].tolist(), pdf[player].tolist(), pdf[score].tolist()):
            if cur is not None and r != cur:
                rows.extend((lg, cur, *x) for x in trueskill_round(ratings, subs, cfg))
                subs = []
            cur = r
            subs.append((int(p), float(s)))
        if subs:
            rows.extend((lg, cur, *x) for x in trueskill_round(ratings, subs, cfg))
        return pd.DataFrame(rows, columns=[league, rnd, player, "mu", "sigma", "ts_score"])

    d = subs.select(F.col(league).cast("bigint"), F.col(rnd).cast("bigint"), *order,
                    F.col(player).cast("bigint"), F.col(score).cast("double"))
    return spread_groups(d, league).groupBy(league).applyInPandas(fold, schema)
