"""Patch parsing/applicability and the exact most-similar-pair search vs brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meritflow.operators import corpus, patches


def test_hunk_parse_and_apply(spark):
    base = "a\nb\nc\nd\ne\nf\ng\n"
    p_ok = ("--- a/f.py\n+++ b/f.py\n@@ -1,2 +1,3 @@\n b\n+new\n c\n@@ -5,2 +6,1 @@\n f\n-g\n")
    p_bad = "--- a/f.py\n+++ b/f.py\n@@ -1,2 +1,2 @@\n x\n-y\n"
    p_add = "--- /dev/null\n+++ b/f.py\n@@ -0,0 +1,1 @@\n+only added\n"
    p_other = "--- a/g.py\n+++ b/g.py\n@@ -1,1 +1,1 @@\n-a\n+z\n"
    pt = spark.createDataFrame([(1, p_ok), (2, p_bad), (3, p_add), (4, p_other)], "patch_id int, patch string")
    h = patches.hunk_lines(pt)
    rows = h.filter("patch_id = 1").orderBy("hunk_no", "k").collect()
    assert [(r.hunk_no, r.kind, r.k, r.text) for r in rows if r.k is not None] == \
        [(1, " ", 0, "b"), (1, " ", 1, "c"), (2, " ", 0, "f"), (2, "-", 1, "g")]
    files = spark.createDataFrame([("f.py", base)], "path string, contents string")
    out = {r.patch_id: r for r in patches.patch_applies(patches.hunks(pt), files).collect()}
    assert out[1].applies and out[1].offset == 1 and out[1].n_hunks == 2
    assert not out[2].applies
    assert not out[3].applies            # a created file must not exist yet
    assert not out[4].applies            # target file absent


def applies(spark, patch, **files):
    h = patches.hunks(spark.createDataFrame([(1, patch)], "patch_id int, patch string"))
    f = spark.createDataFrame([(k, v) for k, v in files.items()], "path string, contents string")
    return patches.patch_applies(h, f).first()


def test_patch_over_several_files(spark):
    two = ("diff --git a/f1 b/f1\n--- a/f1\n+++ b/f1\n@@ -1,2 +1,2 @@\n a\n-b\n+B\n@@ -4 +4,2 @@\n d\n+dd\n"
           "diff --git a/f2 b/f2\n--- a/f2\t2024-01-01\n+++ b/f2\t2024-01-02\n@@ -2,1 +2,1 @@\n-y\n+Y\n\\ No newline at end of file\n")
    r = applies(spark, two, f1="a\nb\nc\nd\n", f2="x\ny")
    assert r.applies and r.n_hunks == 3
    assert not applies(spark, two, f1="a\nb\nc\nd\n", f2="x\nz").applies
    assert not applies(spark, two, f1="a\nb\nc\nd\n").applies


def test_patch_deletes_and_creates(spark):
    gone = "--- a/f\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-a\n-b\n"
    new = "--- /dev/null\n+++ b/n\n@@ -0,0 +1,2 @@\n+x\n+y\n"
    assert applies(spark, gone, f="a\nb").applies and not applies(spark, gone, f="a\nc").applies
    assert applies(spark, gone + new, f="a\nb").applies and not applies(spark, gone + new, f="a\nb", n="").applies


def test_lines_that_look_like_headers(spark):
    # removed '-- a', added '++ b/other': the hunk goes on behind them
    p = "--- a/f\n+++ b/f\n@@ -1,3 +1,3 @@\n x\n--- a\n+++ b/other\n z\n"
    assert applies(spark, p, f="x\n-- a\nz").applies
    assert not applies(spark, p, f="x\n-- a\nq").applies


def test_patch_nearest_offset(spark):
    base = "x\ny\nq\nx\ny\n"
    p = "--- a/f\n+++ b/f\n@@ -3,2 +3,2 @@\n x\n-y\n"
    r = applies(spark, p, f=base)
    assert r.applies and r.offset == 1   # matches at line 1 (offset -2) and line 4 (offset +1)
    tie = "--- a/f\n+++ b/f\n@@ -3,1 +3,1 @@\n-\n+z\n"
    assert applies(spark, tie, f="a\n\nb\n\nc").offset == -1       # as near above as below: the earlier line
    assert applies(spark, tie, f="\n" * 5000).offset == 0


def test_every_patch_has_a_verdict(spark):
    """Missing, empty and hunk-less patches do not apply."""
    rows = [(1, None), (2, ""), (3, "no diff"), (4, "--- a/f\n+++ b/f\n"), (5, "--- a/f\n+++ b/f\n@@ -1,1 +1,1 @@"),
            (6, "@@ -1,1 +1,1 @@\n-a\n+b\n"), (7, "--- a/f\n+++ b/f\n@@ -99999999999999999999,1 +1,1 @@\n-a\n+b\n"), (None, "--- a/f\n+++ b/f\n@@ -1 +1 @@\n-a\n+b\n")]
    f = spark.createDataFrame([("f", "a\n"), ("g", None)], "path string, contents string")
    got = {r.patch_id: (r.applies, r.offset, r.n_hunks) for r in patches.patch_applies(
        patches.hunks(spark.createDataFrame(rows, "patch_id int, patch string")), f).collect()}
    assert got.pop(7)[0] and got.pop(None) == (True, 0, 1)
    assert got == {i: (False, None, 0) for i in range(1, 6)} | {6: (False, None, 1)}


def brute_best(vecs):
    best = None
    for i in range(len(vecs)):
        for j in range(i + 1, len(vecs)):
            a, b = vecs[i][1], vecs[j][1]
            na, nb = np.linalg.norm(a), np.linalg.norm(b)
            if na == 0 or nb == 0:
                continue
            c = float(a @ b / (na * nb))
            if c > -1 and (best is None or round(c, 12) > round(best[0], 12)):
                best = (c, vecs[i][0], vecs[j][0])
    return best


@pytest.mark.parametrize("block_size,bits,fan", [(4, 2, 1), (4, 5, 2), (16, 3, 8), (1000, 1, 1)])
def test_most_similar_pairs_matches_brute_force(spark, block_size, bits, fan):
    rng = np.random.default_rng(block_size)
    rows = []
    for d in range(4):
        n = [1, 7, 40, 90][d]
        base = rng.standard_normal((n, 8))
        if n > 10:
            base[5] = base[3] * 2.0          # an exact duplicate direction
            base[6] = 0.0                    # a zero vector
        for i, v in enumerate(base):
            rows.append((d, d * 1000 + i, [float(x) for x in v]))
    df = spark.createDataFrame(rows, "label int, vec_id long, embedding array<double>")
    got = {r.dir: r for r in corpus.most_similar_pairs(df, "label", "vec_id", "embedding",
                                                         block_size=block_size, lsh_bits=bits, fan_bits=fan).collect()}
    for d in range(4):
        vecs = [(vid, np.array(e)) for lab, vid, e in rows if lab == d]
        exp = brute_best(vecs)
        if exp is None:
            assert str(d) not in got
            continue
        g = got[str(d)]
        assert (g.path_a, g.path_b) == (exp[1], exp[2])
        assert abs(g.cosine - exp[0]) < 1e-9


def test_distant_balls_are_never_paired(spark):
    """Tight clusters far from each other: the walk forms few of the block pairs, and none is lost."""
    rng = np.random.default_rng(3)
    centres = np.linalg.qr(rng.standard_normal((16, 16)))[0]
    near = [centres[i % 16] + 1e-2 * rng.standard_normal(16) for i in range(640)]
    rows = [("d", i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(near)]
    df = spark.createDataFrame(rows, "dir string, path long, v array<double>")
    blocks = (df.withColumn("blk", F.col("path") % 16 * 4 + F.floor(F.col("path") / 160)).withColumn("u", F.col("v"))
              .groupBy("dir", "blk").applyInPandas(corpus._block_summary, corpus._BEST_SCHEMA).persist())
    pairs, tree = corpus._close_blocks(blocks, 6, 2)
    formed = {(r.blk_a, r.blk_b) for r in pairs.collect()}
    assert len(tree) == 2 and 0 < len(formed) <= 16 * 6                      # of 64 * 63 / 2
    assert all(a // 4 == b // 4 for a, b in formed)
    got = corpus.most_similar_pairs(df, "dir", "path", "v", block_size=8, lsh_bits=6, fan_bits=2).first()
    best = brute_best([(i, np.array(v)) for _, i, v in rows])
    assert (got.path_a, got.path_b) == best[1:]


def test_corpus_filter_counts_names_before_length(spark):
    rows = [("d1", 1, "x" * 60), ("d1", 2, "short"), ("d1", 3, "y" * 51), ("d2", 4, "z" * 80), ("d2", 5, "w" * 80)]
    df = spark.createDataFrame(rows, "dir string, path int, text string")
    got = sorted(r.path for r in corpus.corpus_filter(df, "dir", "text").collect())
    assert got == [1, 3]


def test_latest_version_numeric_order(spark):
    df = spark.createDataFrame([("r", "3.9", "a"), ("r", "3.10", "b")], "repo string, python string, inst string")
    assert corpus.latest_version(df, ["repo"], "python").first().python == "3.9"


def test_unit_vector_and_cosine_helpers(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0])],
                               "a array<double>, b array<double>")
    rows = df.select(corpus.unit_vector("a").alias("u"), corpus.cosine("a", "b").alias("c")).collect()
    assert rows[0].u == [0.6, 0.8] and abs(rows[0].c - 0.96) < 1e-12
    assert rows[1].u is None and rows[1].c is None
    assert rows[2].c == -1.0


def test_vectors_are_shuffled_by_tile_not_by_block_pair(spark):
    """Vectors without any structure: all blocks are close, but a task gets whole tiles."""
    import numpy as np
    rng = np.random.default_rng(3)
    n = 1_200
    m = rng.standard_normal((n, 12))
    m[700] = m[3] * 2.0
    df = spark.createDataFrame([("d", i, [float(x) for x in v]) for i, v in enumerate(m)], "dir string, path long, v array<double>")
    sent = []
    real = corpus.spread_groups
    corpus.spread_groups = lambda d, *keys: sent.append(d.count()) or real(d, *keys)
    try:
        got = corpus.most_similar_pairs(df, "dir", "path", "v", block_size=8, lsh_bits=2).first()
    finally:
        corpus.spread_groups = real
    assert (got.path_a, got.path_b) == (3, 700)
    assert sum(sent) <= n * (2 + 2 * corpus.MOST_TILES)


def test_block_with_an_undirected_vector_is_still_compared():
    import numpy as np
    import pandas as pd
    u = [np.array([np.nan, 1.0]), np.array([0.0, 1.0]), np.array([1.0, 0.0]), np.array([0.0, 1.0])]
    rows = pd.DataFrame({"dir": "d", "_lb": 0.5, "side": 0, "blk": [0, 0, 1, 1], "path": [1, 2, 3, 4], "u": u})
    got = corpus._cross_best(rows)
    assert got[["cos", "a", "b"]].values.tolist() == [[1.0, 2, 4]]
