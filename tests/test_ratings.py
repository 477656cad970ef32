"""Elo and TrueSkill folds."""

import math

import pytest

from meritflow.config import RatingConfig
from meritflow.operators import ratings


def test_trueskill_published_values():
    (m1, s1), (m2, s2) = ratings.rate_ffa([(25.0, 25 / 3), (25.0, 25 / 3)])
    assert round(m1, 3) == 29.396 and round(s1, 3) == 7.171
    assert round(m2, 3) == 20.604 and round(s2, 3) == 7.171


def test_trueskill_three_way_symmetry():
    r = ratings.rate_ffa([(25.0, 25 / 3)] * 3)
    assert abs(r[1][0] - 25.0) < 1e-9
    assert abs((r[0][0] - 25.0) - (25.0 - r[2][0])) < 1e-9
    assert r[0][0] > r[1][0] > r[2][0]


@pytest.mark.parametrize("n", [20, 60, 200])
def test_trueskill_large_rounds_settle(n):
    """Far upsets keep their digits, so a long chain settles within a few sweeps."""
    spread = [(25.0 + 9.0 * math.sin(7 * i), 1.0 + i % 7) for i in range(n)]
    few, many = ratings.rate_ffa(spread, max_iter=40), ratings.rate_ffa(spread, max_iter=400)
    assert few == many
    alike = ratings.rate_ffa([(25.0, 25 / 3)] * n)
    assert [m for m, _ in alike] == sorted((m for m, _ in alike), reverse=True)
    for (m, s), (m2, s2) in zip(alike, reversed(alike)):
        assert m - 25.0 == pytest.approx(25.0 - m2, abs=1e-6) and s == pytest.approx(s2, abs=1e-6)


def test_trueskill_moments_keep_their_digits_down_the_tail():
    from fractions import Fraction
    for x in (-4.0, -4.999, -5.0, -6.5, -12.0, -40.0, -500.0):
        y = e = Fraction(-x)
        for k in range(200, 1, -1):
            e = (k / (y + e)).limit_denominator(10 ** 40)
        d = 1 / (y + e)
        v, left = ratings._won(x)
        assert v == pytest.approx(float(y + d), rel=1e-13) and left == pytest.approx(float(d * (e - d)), rel=1e-11)


def test_trueskill_fold_single_participant_and_ranks():
    rounds = [[(7, 0.5)], [(1, 0.9), (2, 0.1), (3, 0.5)], [(2, 0.4), (1, 0.4)]]
    out = list(ratings.trueskill_fold(rounds))
    assert out[0][2] == 25.0 and out[0][3] == pytest.approx(25 / 3)
    by = {(r, p): (m, s) for r, p, m, s, _ in out}
    assert by[(1, 1)][0] > by[(1, 3)][0] > by[(1, 2)][0]
    # equal scores: submission order decides (player 2 submitted first)
    assert by[(2, 2)][0] > by[(1, 2)][0]
    for *_, sc in out:
        assert 0.0 < sc < 1.0


def test_elo_zero_sum_and_draw_modes():
    scores = [0.5, 0.2, 0.9, 0.5, 0.5]
    for mode in ("reference", "standard"):
        r = ratings.elo_fold(scores, RatingConfig(draw_mode=mode), seed="3")
        assert abs(sum(r) - 1200.0 * len(scores)) < 1e-9
    # two equal players: standard mode keeps them at 1200, reference mode does not
    std = ratings.elo_fold([1.0, 1.0], RatingConfig(draw_mode="standard"))
    ref = ratings.elo_fold([1.0, 1.0], RatingConfig(draw_mode="reference"))
    assert std == [1200.0, 1200.0]
    assert ref[1] > ref[0]


def test_match_schedule_is_all_pairs_twice():
    s = list(ratings.match_schedule(5, 2, seed="1"))
    assert len(s) == 20
    for r in range(2):
        assert sorted((a, b) for rr, a, b in s if rr == r) == [(a, b) for a in range(5) for b in range(a + 1, 5)]


def test_elo_ratings_dataframe(spark):
    rows = [(1, 10, 0, 3.0), (1, 11, 1, 1.0), (1, 12, 2, 2.0), (2, 10, 0, 1.0)]
    df = spark.createDataFrame(rows, "p long, u long, i long, s double")
    out = {(r.p, r.u): r for r in ratings.elo_ratings(df, "p", ["i"], "u", "s").collect()}
    assert out[(1, 10)].rank == 1 and out[(1, 11)].rank == 3
    assert out[(2, 10)].rating == 1200.0
    exp = ratings.elo_fold([3.0, 1.0, 2.0], seed="elo:1")
    assert abs(out[(1, 12)].rating - exp[2]) < 1e-9


def test_elo_from_judgements_counts_rejects(spark):
    players = spark.createDataFrame([(1, 0, 10), (1, 1, 11), (2, 0, 20)], "p long, idx long, player long")
    judged = spark.createDataFrame(
        [(1, 0, 0, 1, "a", True, False, False), (1, 1, 0, 1, "a", True, True, False), (1, 1, 0, 1, "b", None, None, None)],
        "p long, rr int, i long, j long, at string, a_wins boolean, b_wins boolean, draw boolean")
    got = {r.player: r for r in ratings.elo_from_judgements(players, judged, "p", "player").collect()}
    assert (got[10].rating, got[11].rating, got[20].rating) == (1216.0, 1184.0, 1200.0)
    assert got[10].n_rejected == 2 and got[20].n_rejected == 0 and got[10].rank == 1


@pytest.mark.parametrize("at_once", [1, 7, 50])
def test_large_tournaments_keep_their_order(at_once):
    assert list(ratings.match_schedule(12, 2, "x", at_once)) == list(ratings.match_schedule(12, 2, "x"))


def test_large_tournament_is_folded_in_turns_like_match_by_match(monkeypatch):
    scores = [float(x * x % 41) for x in range(130)]
    for mode in ("reference", "standard"):
        cfg = RatingConfig(draw_mode=mode)
        one_by_one = ratings.elo_fold(scores, cfg, seed="s")
        monkeypatch.setattr(ratings, "FOLD_TOGETHER", 2)
        assert ratings.elo_fold(scores, cfg, seed="s") == pytest.approx(one_by_one, abs=1e-9)
        monkeypatch.undo()


def test_match_order_is_the_md5_order_in_ranges_too():
    import hashlib
    key = lambda r, i, j: hashlib.md5(f"elo:7:{r}:{i}:{j}".encode()).digest()
    every = [(r, i, j) for r in range(2) for i in range(112) for j in range(i + 1, 112)]
    exp = sorted(every, key=lambda x: (x[0], key(*x)))
    assert list(ratings.match_schedule(112, 2, seed="elo:7")) == exp
    assert list(ratings.match_schedule(112, 2, seed="elo:7", at_once=1_000)) == exp


def _in_md5_order(n, rounds, seed):
    import hashlib
    key = lambda r, i, j: hashlib.md5(f"{seed}:{r}:{i}:{j}".encode()).digest()
    return sorted(((r, i, j) for r in range(rounds) for i in range(n) for j in range(i + 1, n)), key=lambda x: (x[0], key(*x)))


def _played(blocks):
    return [(r, a, b) for r, i, j in blocks for a, b in zip(i.tolist(), j.tolist(), strict=True)]


@pytest.mark.parametrize(("held", "times"), [(10 ** 6, 2), (3_000, 4)])
def test_digests_are_not_computed_again_for_every_part(monkeypatch, held, times):
    """6,105 pairs in parts of about 200 (31 or 48): twice, and once more for every further ``held`` pairs."""
    computed, start_of = [], ratings._md5_start_of
    monkeypatch.setattr(ratings, "_md5_start_of", lambda words, size: computed.append(size) or start_of(words, size))
    assert _played(ratings.match_blocks(111, 1, "elo:7", 200, held)) == _in_md5_order(111, 1, "elo:7")
    assert sum(computed) == times * 111 * 110 // 2


def test_pairs_alike_in_the_bits_kept_follow_the_whole_digest(monkeypatch):
    keyed = ratings._keyed
    monkeypatch.setattr(ratings, "_keyed", lambda n, start, i, j: keyed(n, start * 0, i, j))
    assert _played(ratings.match_blocks(40, 2, "elo:7")) == _in_md5_order(40, 2, "elo:7")


@pytest.mark.parametrize("mode", ["reference", "standard"])
def test_window_of_a_large_tournament_keeps_every_match(monkeypatch, mode):
    cfg = RatingConfig(draw_mode=mode)
    scores = [float("nan") if x % 50 == 3 else float(x * x % 23) for x in range(300)]
    monkeypatch.setattr(ratings, "FOLD_TOGETHER", 2)
    together = ratings.elo_fold(scores, cfg, seed="s")
    monkeypatch.undo()
    assert together == pytest.approx(ratings.elo_fold(scores, cfg, seed="s"), abs=1e-9)
