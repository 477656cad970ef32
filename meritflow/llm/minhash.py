"""Near-duplicate search by circulant MinHash, bands, and exact Jaccard verification.

A document is its set of word shingles.  Documents with equal sets form one class, and only
classes are compared.  Two permutations give the whole signature: the first (a hash) places
each shingle on a ring, the second orders the ring's places, and coordinate k is the minimum
after shifting the second by k.  Classes that agree on all rows of a band fall into one
bucket; buckets that touch form candidate groups.

Within a group pairs are not listed.  First, a few pivots of each group are compared on full
sets with all its classes, in streams that are salted for large groups.  In a group with
more classes than pivots, most attach to one pivot; every class that does not becomes a
pivot itself, in blocks that stream the group's classes past them.  So a link is left
uncompared only between two classes that are known to hang together through the first
pivot, and no component is missed, whatever the group's size.  What leaves a task is one
link for each class and block, and the links that join pivots, which is enough for the
components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meritflow.llm.common import (BLANK, BROADCAST_ROWS, fresh, mix64, pieces, small, small_batches, stream_values, tidy,
                                  utf8, word_starts, written)

RING = 1 << 20
PIVOTS = 256
SALT_ROWS = 512
#: Rows that a broadcast of classes may hold: their tables grow with the input, and the driver
#: collects, hashes and serves what is broadcast.  Beside whole texts only row keys are
#: broadcast, up to BROADCAST_ROWS.
BROADCAST = 20_000

_LETTERS = stream_values(11, 256)
for _a in range(65, 91):                       # A-Z hash as a-z
    _LETTERS[_a] = _LETTERS[_a + 32]
_POWERS = np.cumprod(np.full(1 << 12, 0x9E3779B97F4A7C15 | 1, np.uint64))


def word_hashes(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row number of each word in the bytes of texts that begin at ``rows``.

    A word's hash is the sum of its letters' random values times powers of an odd base.
    """
    starts = word_starts(data, rows)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    blank = BLANK[data]
    row = np.searchsorted(rows, starts, side="right") - 1
    # the position inside a word decides the power, so equal words hash alike anywhere
    where = np.zeros(len(data), np.int64)
    where[starts] = starts
    where = np.arange(len(data)) - np.maximum.accumulate(where)
    value = _LETTERS[data] * _POWERS[where & (len(_POWERS) - 1)] + (where >> 12).astype(np.uint64)
    value[blank] = 0
    return mix64(np.add.reduceat(value, starts)), row


def shingle_sets(data: np.ndarray, rows: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, row = word_hashes(data, rows)
    at = np.searchsorted(row, np.arange(len(rows) + 1))
    if len(h) >= size:
        s = h[:len(h) - size + 1].copy()
        for k in range(1, size):
            s = mix64(s + np.uint64(k)) + h[k:len(h) - size + 1 + k]
        s = mix64(s)
    else:
        s = np.zeros(0, np.uint64)
    out = []
    for i, j in zip(at[:-1], at[1:], strict=True):
        if j - i >= size:
            out.append(np.unique(s[i:j - size + 1]))
        elif j > i:
            x = np.array([len(_LETTERS)], np.uint64) + np.uint64(j - i)
            for w in h[i:j]:
                x = mix64(x + w)
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Signer:
    """Band keys of shingle sets."""

    def __init__(self, bands: int, rows: int, seed: int = 5):
        self.bands, self.rows = bands, rows
        self.n = bands * rows
        order = np.argsort(stream_values(seed, RING), kind="stable").astype(np.uint32)
        ring = np.concatenate([order, order[:self.n]])
        self.windows = np.lib.stride_tricks.sliding_window_view(ring, self.n)

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        low = np.full(self.n, RING, np.uint32)
        place = np.unique((mix64(shingles + np.uint64(77)) & np.uint64(RING - 1)).astype(np.int64))
        for i in range(0, len(place), 4096):
            np.minimum(low, self.windows[place[i:i + 4096]].min(axis=0), out=low)
        key = np.arange(1, self.bands + 1, dtype=np.uint64)
        for part in low.reshape(self.bands, self.rows).T:
            key = mix64(key + part)
        return key.view(np.int64)


def features(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, row_key, n_shingles, set_id (binary) and band keys, one row per input row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands, rows)
        for b in batches:
            data, at = utf8(b.column("text"))
            n, ids, keys = [], [], []
            for i, j in pieces(at, 1 << 19):
                for s in shingle_sets(data[at[i]:at[j]], at[i:j] - at[i], size):
                    n.append(len(s))
                    ids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    keys.append(signer.keys(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("row_key"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "row_key", "n_shingles", "set_id", "bands"])
        tidy()

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_key(), "text")
            .mapInArrow(run, "doc_id long, row_key long, n_shingles long, set_id binary, bands array<long>"))


def _row_key():
    return F.xxhash64("doc_id", "text").alias("row_key")


def _few(df: DataFrame, most: int = BROADCAST) -> DataFrame:
    """Hint a broadcast of the written table ``df`` up to ``most`` rows, beyond it a shuffle.

    Left without a hint, Spark goes by the size of its files, and a file of keys takes many
    times its size once it is hashed in the driver.
    """
    few = small(df, most)
    return few if few is not df else df.hint("merge")


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is the least node.

    Alternates large and small stars: every node links its larger neighbours, then its
    smaller ones, to the least of them.  Each step is written to the shared folder.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    before = None
    for _ in range(most):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        big = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        joined = big.join(low, "u")
        e = written(joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                    .unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct(), "stars")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
    raise RuntimeError("components did not settle")


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """set_id, set (sorted 64-bit hashes as bytes) of the rows whose row_key is wanted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = utf8(b.column("text"))
            for i, j in pieces(at, 1 << 19):
                s = [x.tobytes() for x in shingle_sets(data[at[i]:at[j]], at[i:j] - at[i], size)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in s], pa.binary()),
                     pa.array(s, pa.binary())], ["set_id", "set"])
        tidy()

    rows = docs.select(_row_key(), "text").join(wanted, "row_key", "left_semi").select("text")
    return rows.mapInArrow(run, "set_id binary, set binary")


def _compare(who: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (grp, a, b, no) found between members and pivots of the same (grp, block, salt).

    ``who`` has the pivots, numbered by ``no`` from 0, and the members, with no = -1.  A
    member's link goes to its first pivot; links between pivots have no = -1.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pivots, names, parent = None, [], [], []
        table: tuple[np.ndarray, ...] | None = None

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for batch in batches:
            places = list(zip(*(batch.column(x).to_pylist() for x in ("grp", "block", "salt")), strict=True))
            pivot, ids = batch.column("no").to_numpy() >= 0, batch.column("set_id").to_pylist()
            data, off = utf8(batch.column("set"))
            out: list[tuple] = []
            for i, place in enumerate(places):
                if place != at:
                    at, pivots, names, table = place, [], [], None
                x = data[off[i]:off[i + 1]].view(np.uint64)
                if pivot[i]:
                    pivots.append(x.copy())
                    names.append(ids[i])
                    continue
                if table is None:
                    every, owner = np.concatenate(pivots), np.repeat(np.arange(len(pivots)), [len(p) for p in pivots])
                    order = np.argsort(every, kind="stable")
                    table = every[order], owner[order], np.array([len(p) for p in pivots])
                    parent[:] = range(len(pivots))
                every, owner, sizes = table
                lo, hi = np.searchsorted(every, x), np.searchsorted(every, x, side="right")
                n = hi - lo
                hit = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                both = np.bincount(owner[hit], minlength=len(sizes))
                linked = np.flatnonzero(100 * both >= percent * (sizes + len(x) - both)).tolist()
                if linked:
                    out.append((at[0], ids[i], names[linked[0]], linked[0]))
                    for k in linked[1:]:
                        a, b = root(linked[0]), root(k)
                        if a != b:
                            parent[max(a, b)] = min(a, b)
                            out.append((at[0], names[linked[0]], names[k], -1))
            g, a, b, no = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.binary()), pa.array(a, pa.binary()), pa.array(b, pa.binary()),
                                              pa.array(no, pa.int32())], ["grp", "a", "b", "no"])
        tidy()

    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (sets.join(written(who, "compared").hint("merge"), "set_id").select("grp", "block", "salt", "no", "set_id", "set")
            .repartition(parts, "grp", "block", "salt").sortWithinPartitions("grp", "block", "salt", F.col("no") < 0, "no")
            .mapInArrow(run, "grp binary, a binary, b binary, no int"))


def _streams(members: DataFrame, pivots: DataFrame) -> DataFrame:
    """Members (grp, n, blocks, set_id) dealt to every block and one salt, pivots (grp, n, block,
    no, set_id) to every salt of their block."""
    salts = F.ceil(F.col("n") / SALT_ROWS).cast("long")
    upto = lambda x: F.explode(F.sequence(F.lit(0).cast("long"), x - 1))
    return (members.select("grp", upto(F.col("blocks")).alias("block"), F.pmod(F.xxhash64(F.lit(3), "set_id"), salts)
                           .alias("salt"), F.lit(-1).cast("long").alias("no"), "set_id")
            .unionByName(pivots.select("grp", "block", upto(salts).alias("salt"), "no", "set_id")))


def _resolve(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(set_id, label) of the linked classes, from candidate groups (set_id, grp)."""
    one = F.lit(1).cast("long")
    sized = nodes.join(nodes.groupBy("grp").agg(F.count("*").alias("n")), "grp").withColumn("blocks", one)
    first = F.row_number().over(Window.partitionBy("grp").orderBy(F.xxhash64("set_id"), "set_id")) - 1
    pivots = written(sized.withColumn("no", first.cast("long")).where(F.col("no") < PIVOTS)
                     .select("grp", "n", F.lit(0).cast("long").alias("block"), "no", "set_id"), "pivots")
    links = written(_compare(_streams(sized, pivots), sets, percent), "links")
    # larger groups: whoever is not attached to the group's most common pivot is compared too
    large = sized.where(F.col("n") > PIVOTS).join(pivots.select("set_id"), "set_id", "left_anti")
    best = (links.where("no >= 0").groupBy("grp", "no").agg(F.count("*").alias("held")).groupBy("grp")
            .agg(F.max_by("no", F.struct("held", -F.col("no"))).alias("no")))
    attached = links.join(best, ["grp", "no"]).select(F.col("a").alias("set_id")).distinct()
    rest = written(large.join(attached, "set_id", "left_anti"), "rest")
    if not rest.isEmpty():
        per = rest.groupBy("grp").agg(F.ceil(F.count("*") / PIVOTS).cast("long").alias("blocks"))
        more = rest.drop("blocks").join(per, "grp").withColumn("block", F.pmod(F.xxhash64(F.lit(9), "set_id"), "blocks"))
        late = Window.partitionBy("grp", "block").orderBy("set_id")
        more = more.withColumn("no", (F.row_number().over(late) - 1).cast("long")).select("grp", "n", "block", "no", "set_id")
        again = _compare(_streams(large.drop("blocks").join(per, "grp"), more), sets, percent)
        links = written(links.unionByName(again).select("a", "b"), "links")
    return components(links.select("a", "b")).select(F.col("node").alias("set_id"), F.col("root").alias("label"))


def link(docs: DataFrame, size: int = 3, percent: int = 85, bands: int = 20, rows: int = 4) -> DataFrame:
    """doc_id, row_key, n_shingles, set_id, root, component_id: one row per row of ``docs``.

    Two rows are linked when 100 * intersection >= ``percent`` * union of their shingle sets;
    a component's id is its smallest doc_id (null if all of its ids are null).  A text with
    fewer words than a shingle is one shingle; null texts and texts without words have none,
    are linked with nothing and are their own component.  Of two texts at the threshold the
    bands miss fewer than one in a million, and no link inside a candidate group is missed.
    """
    small_batches(docs.sparkSession)
    seen = written(features(docs, size, bands, rows), "features")
    classes = seen.where("set_id is not null").select("set_id", "bands").dropDuplicates(["set_id"])
    member = classes.select("set_id", F.explode("bands").alias("bucket"))
    full = member.groupBy("bucket").agg(F.min("set_id").alias("a"), F.count("*").alias("n")).where("n > 1")
    touching = written(member.join(full.select("bucket", "a"), "bucket").select("a", F.col("set_id").alias("b"))
                       .where("a != b").distinct(), "touching")
    if touching.isEmpty():
        label = touching.select(F.col("a").alias("set_id"), F.col("b").alias("label"))
    else:
        groups = written(components(touching).select(F.col("node").alias("set_id"), F.col("root").alias("grp")), "groups")
        # copies of one text meet in partial minima, so the join has one row of a class
        firsts = seen.where("set_id is not null").groupBy("set_id").agg(F.min("row_key").alias("row_key"))
        reps = written(firsts.join(_few(groups), "set_id").select("row_key"), "reps")
        # another row may share a key with a representative: the join by set_id sorts it out
        sets = written(_sets(docs, _few(reps, BROADCAST_ROWS), size).dropDuplicates(["set_id"]), "sets")
        label = written(_resolve(groups, sets, percent), "labels")
    # the smallest doc_id of every class, then of every component
    ids = seen.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    root = F.coalesce("label", "set_id")
    by_set = ids.join(_few(label), "set_id", "left").select("set_id", "least", root.alias("root"))
    by_root = by_set.groupBy("root").agg(F.min("least").alias("component_id"))
    found = by_set.join(by_root, "root").select("set_id", "root", "component_id")
    out = seen.select("doc_id", "row_key", "n_shingles", "set_id").join(found, "set_id", "left")
    return out.withColumn("component_id", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))


def dedup(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = 28, rows: int = 4) -> DataFrame:
    """The rows of ``docs`` without all but one of each near-duplicate group.

    The row with the smallest doc_id stays; among rows that tie in it one stays, as it does
    in a group whose doc_ids are all null.  Rows without words stay.
    """
    linked = written(link(docs, size, percent, bands, rows).where("set_id is not null"), "linked")
    first = F.min(F.when(F.col("doc_id").eqNullSafe(F.col("component_id")), F.col("row_key")))
    several = linked.groupBy("root").agg(F.count("*").alias("n"), first.alias("stays")).where("n > 1")
    verdict = written(linked.join(several, "root").groupBy("row_key", (F.col("row_key") == F.col("stays")).alias("stays"))
                      .agg(F.count("*").alias("n")).where("not stays or n > 1"), "verdict")
    n = fresh(docs, "row_key", "stays", "rank")
    keyed = docs.withColumn(n["row_key"], F.xxhash64("doc_id", "text")).join(_few(verdict.select(
        F.col("row_key").alias(n["row_key"]), F.col("stays").alias(n["stays"])), BROADCAST_ROWS), n["row_key"], "left")
    out = keyed.where(F.col(n["stays"]).isNull())
    if not verdict.where("stays").isEmpty():      # the row that stays occurs several times
        out = out.unionByName(keyed.where(F.col(n["stays"])).dropDuplicates([n["row_key"]]))
    return out.select(*[F.col(f"`{x}`") for x in docs.columns])
