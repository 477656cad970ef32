"""Corpus ingestion: FLT5-7, JOIN4, MTH2, AGG10-12, UDF2.

Most-similar file pair per directory, exactly, without emitting all file pairs:

1. vectors are normalised once and grouped into blocks of similar vectors (sign bits
   against a few fixed hyperplanes, then split by hash to at most ``block_size`` rows);
2. one grouped-map task per block finds the block's best internal pair with a numpy
   matrix product and reports the block's centroid and angular radius;
3. the best internal pair of a directory is a lower bound; a pair of blocks is only
   compared when the triangle bound  cos(max(0, angle(cA, cB) - rA - rB))  can reach it;
4. blocks that follow one another make a tile, and tiles are paired by the same bound:
   a task gets the vectors of two tiles once, not once for each pair of their blocks, and
   compares the surviving block pairs with one matrix product each; the best of all
   candidates per directory wins, first pair in (path_a, path_b) order on ties.

Only summaries are paired, never rows, and every task holds at most two tiles.  A directory
has about ``MOST_TILES`` tiles, so a vector is shuffled about as often at any size; beyond
``TILE_BLOCKS[1]`` blocks in a tile their number grows instead of their size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import IngestConfig
from ..session import checkpoint_dir, spread_groups

TIE_DECIMALS = 12   # cosine values equal to 12 decimals count as a tie
MOST_TILES = 16
TILE_BLOCKS = (6, 10)   # a tile has 2^6 to 2^10 blocks


def dir_threshold(files: DataFrame, dir_col: str, min_files: int) -> DataFrame:
    """Keep directories with at least ``min_files`` file names (FLT5).

    Counted on names, before any read or length filter.  The count is an aggregate
    joined back, so a huge directory is pre-counted in every map task.
    """
    counts = files.groupBy(dir_col).agg(F.count(F.lit(1)).alias("_nfiles"))
    return files.join(counts.filter(F.col("_nfiles") >= min_files), dir_col, "left_semi")


def length_filter(files: DataFrame, contents: str, min_len: int) -> DataFrame:
    """Strictly longer than ``min_len`` characters (FLT6)."""
    return files.filter(F.char_length(F.col(contents)) > F.lit(min_len))


def corpus_filter(files: DataFrame, dir_col: str, contents: str, cfg: IngestConfig = IngestConfig()) -> DataFrame:
    return length_filter(dir_threshold(files, dir_col, cfg.min_files), contents, cfg.min_len)


def unit_vector(v) -> Column:
    """v / |v| in double; a zero vector gives NULL and never takes part in a pair (MTH2)."""
    v = F.col(v) if isinstance(v, str) else v
    d = F.transform(v, lambda x: x.cast("double"))
    # the squared norm is accumulated once; the finish step divides by its root, so the
    # norm is not recomputed for every element
    return F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x,
                       lambda ss: F.when(ss > 0, F.transform(d, lambda x: x / F.sqrt(ss))))


def cosine(a, b) -> Column:
    """Cosine of two double arrays; NULL when either is a zero vector (MTH2)."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda s, x: s + x * x))
    # a zero vector has no direction: NULL (never wins), not a division error under ANSI
    return F.when(na * nb > 0, dot / (na * nb))


def _hyperplanes(dim: int, bits: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((bits, dim))


def _unit_and_code(bits: int):
    """mapInPandas body: normalise each vector (dropping zero vectors) and give it the
    sign bits of its projections on fixed hyperplanes, one numpy pass per Arrow batch."""
    def run(batches):
        planes = None
        weights = (1 << np.arange(bits)).astype(np.int64)
        for pdf in batches:
            if pdf.empty:
                yield pd.DataFrame({"dir": [], "path": [], "u": [], "code": []})
                continue
            m = np.vstack(pdf["v"].to_numpy()).astype(np.float64)
            norm = np.linalg.norm(m, axis=1)
            ok = norm > 0
            m = m[ok] / norm[ok, None]
            if planes is None or planes.shape[1] != m.shape[1]:
                planes = _hyperplanes(m.shape[1], bits)
            code = ((m @ planes.T) >= 0).astype(np.int64) @ weights
            yield pd.DataFrame({"dir": pdf["dir"].to_numpy()[ok], "path": pdf["path"].to_numpy()[ok],
                                "u": list(m), "code": code})
    return run


_BEST_SCHEMA = "dir string, blk bigint, n bigint, centroid array<double>, radius double, cos double, a bigint, b bigint"
_CROSS_SCHEMA = "dir string, cos double, a bigint, b bigint"


def _best_pair(sim: np.ndarray, ia: np.ndarray, ib: np.ndarray, same: bool):
    """Best (cos, a, b) in a similarity block; ties -> smallest (a, b) in path order."""
    if same:
        mask = ia[:, None] < ib[None, :]
    else:
        mask = np.ones(sim.shape, dtype=bool)
    valid = mask & np.isfinite(sim) & (sim > -1.0)
    if not valid.any():
        return None
    s = np.where(valid, np.round(sim, TIE_DECIMALS), -np.inf)
    top = s.max()
    rr, cc = np.nonzero(s == top)
    lo = np.minimum(ia[rr], ib[cc])
    hi = np.maximum(ia[rr], ib[cc])
    k = np.lexsort((hi, lo))[0]
    return float(sim[rr[k], cc[k]]), int(lo[k]), int(hi[k])


def _centre(m: np.ndarray) -> tuple[np.ndarray, float]:
    """The direction of the vectors' sum and the widest angle to it."""
    c = m.sum(axis=0)
    cn = np.linalg.norm(c)
    if cn > 0:
        c = c / cn
        return c, float(np.arccos(np.clip(m @ c, -1.0, 1.0)).max())
    return c, math.pi


def _block_summary(pdf: pd.DataFrame) -> pd.DataFrame:
    ids = pdf["path"].to_numpy(dtype=np.int64)
    m = np.vstack(pdf["u"].to_numpy())
    c, radius = _centre(m)
    best = _best_pair(m @ m.T, ids, ids, same=True) if len(ids) > 1 else None
    cos, a, b = best if best else (None, None, None)
    return pd.DataFrame([{"dir": pdf["dir"].iat[0], "blk": int(pdf["blk"].iat[0]), "n": len(ids),
                          "centroid": c.tolist(), "radius": radius, "cos": cos, "a": a, "b": b}])


def _cross_best(pdf: pd.DataFrame) -> pd.DataFrame:
    """Best pair between different blocks of two tiles, or of one (rows of side 0 alone)."""
    none = pd.DataFrame(columns=["dir", "cos", "a", "b"])
    pdf = pdf.sort_values(["side", "blk", "path"], kind="stable")
    ids, m = pdf["path"].to_numpy(dtype=np.int64), np.vstack(pdf["u"].to_numpy())
    side, blk = pdf["side"].to_numpy(), pdf["blk"].to_numpy()
    starts = np.flatnonzero(np.r_[True, (side[1:] != side[:-1]) | (blk[1:] != blk[:-1])])
    ends = np.r_[starts[1:], len(ids)]
    balls = [_centre(m[i:j]) for i, j in zip(starts, ends, strict=True)]
    centre, radius = np.vstack([c for c, _ in balls]), np.array([r for _, r in balls])
    lower = pdf["_lb"].iat[0]
    lower = -math.inf if lower is None or math.isnan(lower) else float(lower)
    crossing = side[-1] != side[0]
    best = None
    for x in range(len(starts)):
        if crossing and side[starts[x]]:
            break
        others = side[starts] == 1 if crossing else np.arange(len(starts)) > x
        theta = np.arccos(np.clip(centre @ centre[x], -1.0, 1.0))
        # a block without a direction bounds nothing and is compared
        near = others & ~(np.cos(np.maximum(0.0, theta - radius[x] - radius)) + 1e-9 < lower)
        if not near.any():
            continue
        right = np.flatnonzero(np.repeat(near, ends - starts))
        sim = m[starts[x]:ends[x]] @ m[right].T
        if sim.max() < lower - 1e-11:
            continue
        got = _best_pair(sim, ids[starts[x]:ends[x]], ids[right], False)
        rank = lambda g: (-round(g[0], TIE_DECIMALS), g[1], g[2])
        if got is not None and (best is None or rank(got) < rank(best)):
            best, lower = got, max(lower, round(got[0], TIE_DECIMALS))
    if best is None:
        return none
    return pd.DataFrame([{"dir": pdf["dir"].iat[0], "cos": best[0], "a": best[1], "b": best[2]}])


def _ball(pdf: pd.DataFrame) -> pd.DataFrame:
    """The ball around the balls of one parent: their weighted centre, and how far they reach from it."""
    centres = np.vstack(pdf["centroid"].to_numpy())
    c = (centres * pdf["n"].to_numpy()[:, None]).sum(axis=0)
    norm = np.linalg.norm(c)
    if norm > 0:
        c = c / norm
        far = np.arccos(np.clip(centres @ c, -1.0, 1.0)) + pdf["radius"].to_numpy()
        radius = float(min(math.pi, far.max()))
    else:
        radius = math.pi
    return pd.DataFrame([{"dir": pdf["dir"].iat[0], "node": int(pdf["parent"].iat[0]), "n": int(pdf["n"].sum()),
                          "centroid": c.tolist(), "radius": radius}])


def _close_blocks(summ: DataFrame, key_bits: int, fan_bits: int) -> tuple[DataFrame, list[DataFrame]]:
    """(dir, blk_a, blk_b) of the blocks that may hold a better pair than any block does inside,
    and the cached levels of the tree.

    Blocks are the leaves of a tree of balls: a block's ancestors are the prefixes of its
    number.  The walk goes down level by level with the pairs of balls whose bound still
    beats the directory's best inner pair, and a ball with itself, so the blocks of two
    distant balls are never paired.
    """
    lower = (summ.filter(F.col("cos").isNotNull()).groupBy("dir").agg(F.max(F.round("cos", TIE_DECIMALS)).alias("_lb")))
    levels = [summ.select("dir", F.col("blk").alias("node"), "n", "centroid", "radius")]
    for _ in range(1, -(-key_bits // fan_bits)):
        below = levels[-1].withColumn("parent", F.shiftright("node", fan_bits))
        levels.append(below.groupBy("dir", "parent").applyInPandas(
            _ball, "dir string, node bigint, n bigint, centroid array<double>, radius double").persist())
    pairs = levels[-1].select("dir", F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b")).distinct()
    for nodes in reversed(levels):
        child = nodes.withColumn("parent", F.shiftright("node", fan_bits))
        side = lambda x, child=child: child.select("dir", F.col("parent").alias(x), F.col("node").alias(f"n{x}"),
                                                   F.col("centroid").alias(f"c{x}"), F.col("radius").alias(f"r{x}"))
        dot = F.aggregate(F.zip_with("ca", "cb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        theta = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot)))
        bound = F.cos(F.greatest(F.lit(0.0), theta - F.col("ra") - F.col("rb"))) + F.lit(1e-9)
        pairs = (pairs.join(side("a"), ["dir", "a"]).join(side("b"), ["dir", "b"]).where("na <= nb").join(lower, "dir", "left")
                 .where((F.col("na") == F.col("nb")) | F.col("_lb").isNull() | (bound >= F.col("_lb")))
                 .select("dir", F.col("na").alias("a"), F.col("nb").alias("b")))
    return pairs.where("a < b").select("dir", F.col("a").alias("blk_a"), F.col("b").alias("blk_b")), levels[1:]


def _close_tiles(summ: DataFrame, key_bits: int, tile_bits: int, fan_bits: int) -> tuple[DataFrame, list[DataFrame]]:
    """(dir, tile_a, tile_b, _lb) of the tiles, each with itself too, whose blocks may hold a better
    pair than any block does inside, the best of which is _lb, and the cached balls.

    A block's tile is the prefix of its number; the balls of tiles are the leaves of the tree.
    """
    lower = summ.groupBy("dir").agg(F.max(F.round("cos", TIE_DECIMALS)).alias("_lb")).persist()
    balls = (summ.select("dir", F.shiftright("blk", tile_bits).alias("parent"), "n", "centroid", "radius").groupBy("dir", "parent")
             .applyInPandas(_ball, "dir string, node bigint, n bigint, centroid array<double>, radius double"))
    tiles = balls.withColumnRenamed("node", "blk").join(lower.withColumnRenamed("_lb", "cos"), "dir").persist()
    pairs, tree = _close_blocks(tiles, max(1, key_bits - tile_bits), fan_bits)
    pairs = pairs.unionByName(tiles.select("dir", F.col("blk").alias("blk_a"), F.col("blk").alias("blk_b")))
    return (pairs.join(lower, "dir").select("dir", F.col("blk_a").alias("tile_a"), F.col("blk_b").alias("tile_b"), "_lb"),
            [*tree, tiles, lower])


def most_similar_pairs(vectors: DataFrame, dir_col: str, path_col: str, vec_col: str,
                       block_size: int = 256, lsh_bits: int = 4, fan_bits: int = 8) -> DataFrame:
    """Best file pair per directory by cosine similarity (JOIN4 + AGG10, exact).

    Runs eagerly: the small result is checkpointed and the cached intermediates freed.  The
    blocks of a directory are compared through a tree of balls with 2^fan_bits children each.

    ``path_col`` must be an integer ordinal giving the file order inside a directory.
    Returns (dir, path_a, path_b, cosine) with path_a < path_b; directories without a
    valid pair (fewer than two usable vectors, or every similarity <= -1) give no row.
    """
    v = (vectors.select(F.col(dir_col).cast("string").alias("dir"), F.col(path_col).cast("bigint").alias("path"),
                        F.col(vec_col).alias("v"))
                .filter(F.col("v").isNotNull())
                .mapInPandas(_unit_and_code(lsh_bits), "dir string, path bigint, u array<double>, code bigint"))
    vb = v = v.persist()
    sizes = v.groupBy("dir", "code").agg(F.count(F.lit(1)).alias("_cnt"))
    chunks = F.greatest(F.lit(1), F.ceil(F.col("_cnt") / F.lit(block_size)))
    most = sizes.agg(F.max(chunks)).first()[0] or 1
    chunk_bits = int(most - 1).bit_length()
    v = (v.join(sizes, ["dir", "code"])
          .withColumn("blk", (F.shiftleft("code", chunk_bits) + F.pmod(F.xxhash64(F.col("path")), chunks)).cast("bigint"))
          .select("dir", "blk", "path", "u")).persist()
    # vectors and block summaries each feed several branches: computed once per run
    summ = spread_groups(v, "dir", "blk").groupBy("dir", "blk").applyInPandas(_block_summary, _BEST_SCHEMA).persist()
    key_bits = lsh_bits + chunk_bits
    tile_bits = min(TILE_BLOCKS[1], max(TILE_BLOCKS[0], key_bits - int(MOST_TILES).bit_length() + 1))
    pairs, tree = _close_tiles(summ, key_bits, tile_bits, fan_bits)
    tiled = v.withColumn("tile", F.shiftright("blk", tile_bits))
    side_a = pairs.join(tiled.withColumnRenamed("tile", "tile_a"), ["dir", "tile_a"]).withColumn("side", F.lit(0))
    side_b = (pairs.where("tile_a < tile_b").join(tiled.withColumnRenamed("tile", "tile_b"), ["dir", "tile_b"])
              .withColumn("side", F.lit(1)))
    cols = ["dir", "tile_a", "tile_b", "_lb", "side", "blk", "path", "u"]
    cross = (spread_groups(side_a.select(*cols).unionByName(side_b.select(*cols)), "dir", "tile_a", "tile_b")
             .groupBy("dir", "tile_a", "tile_b").applyInPandas(_cross_best, _CROSS_SCHEMA))
    cands = summ.filter(F.col("cos").isNotNull()).select("dir", "cos", "a", "b").unionByName(cross)
    best = (cands.groupBy("dir")
                 .agg(F.max(F.struct(F.round("cos", TIE_DECIMALS).alias("k"), (-F.col("a")).alias("na"),
                                     (-F.col("b")).alias("nb"), F.col("cos").alias("cos"),
                                     F.col("a").alias("a"), F.col("b").alias("b"))).alias("m")))
    res = best.select(F.col("dir"), F.col("m.a").alias("path_a"), F.col("m.b").alias("path_b"),
                      F.col("m.cos").alias("cosine"))
    # one row per directory: written to the shared checkpoint folder, then the cached
    # intermediates are released (a lost executor only costs a recomputation)
    checkpoint_dir(res.sparkSession)
    res = res.checkpoint(eager=True)
    for held in (*tree, summ, v, vb):
        held.unpersist()
    return res


def best_overall(pairs: DataFrame, key: Column | None = None) -> DataFrame:
    """Top-1 pair across directories (AGG11 / TOP1 / UDF2); ties go to the smallest dir.

    ``key`` is the selection expression (default: the cosine).  A global aggregate with
    partial aggregation: each map task reduces its rows to one candidate first.  No pair at
    all is an error (FLT7).
    """
    key = key if key is not None else F.col("cosine")
    best = F.min(F.struct(F.col("_nk"), *[F.col(c) for c in pairs.columns]))
    none = F.raise_error(F.lit("no valid pair to select from"))
    return (pairs.withColumn("_nk", -key).groupBy().agg(best.alias("m"))
                 .withColumn("m", F.when(F.col("m").isNull(), none).otherwise(F.col("m")))
                 .select(*[F.col("m")[c].alias(c) for c in pairs.columns]))


def latest_version(df: DataFrame, group: list[str], version: str) -> DataFrame:
    """Row with the highest version read as a number ('3.10' < '3.9', as the source does) (AGG12)."""
    others = [c for c in df.columns if c not in group]
    return (df.groupBy(*group)
              .agg(F.max_by(F.struct(*[F.col(c) for c in others]), F.col(version).cast("double")).alias("m"))
              .select(*group, *[F.col("m")[c].alias(c) for c in others]))
