"""Source divergence audit: how the sources of a language differ, and by which terms.

Term counts per (lang, source) give smoothed shares in parts of 10^9; the distance of two
shares p and q is floor((p - q)^2 / (p + q)).  A source is compared with every other source
of its language over all kept terms, and its most unusual terms are ranked.

For a group, the distance of a term grows with its count in the group and falls with its
count in the language.  So a term that k others dominate (count in the group as high or
higher, count in the language as low or lower, earlier in UTF-8) is behind these k in any
ranking.  Each partition keeps its k-skyband, the terms that fewer than k others dominate;
skybands are merged in two rounds, and only the merged skyband is ranked exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meritflow.llm.common import Numbers, byte_chunks, runs, small, small_batches, tidy, utf8, written

#: Shares are counted in parts of this.
UNIT = 1_000_000_000
#: Bytes of a term, lower-cased; all others become blanks.  Bytes of other scripts stay.
_TERM = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Terms of texts that a task holds before it passes their counts on.
_HELD = 3_000_000
#: Bytes of a text whose set of terms is held at once; longer texts take several passes.
_SET_BYTES = 32 << 20
#: Terms to a bucket and sources to a tile of the pairwise sums.
_TERMS, _SOURCES = 1_024, 256
#: Rows held against a skyband at once.
_BLOCK = 256


class _Counts:
    """Occurrences and documents of terms by group, held as the numbers of terms and documents."""

    def __init__(self) -> None:
        self.ids = Numbers()
        self.groups: dict[tuple[str, str], int] = {}
        self.terms: list[np.ndarray] = []
        self.docs: list[tuple[int, int, bool]] = []         # group, number of terms, whether they stand for documents
        self.more: list[tuple[int, np.ndarray]] = []        # group, terms of one more document each
        self.size = 0

    def add(self, group: tuple[str, str], terms: list[bytes], whole: bool) -> None:
        """Take the terms of a document, or of a part of one that is counted by ``add_document``."""
        self.docs.append((self.groups.setdefault(group, len(self.groups)), len(terms), whole))
        self.terms.append(self.ids.of(terms))
        self.size += len(terms)

    def add_document(self, group: tuple[str, str], terms: set[bytes]) -> None:
        self.more.append((self.groups.setdefault(group, len(self.groups)), self.ids.of(terms)))
        self.size += len(terms)

    def rows(self) -> pa.RecordBatch:
        kinds = max(1, len(self.ids))
        none = np.zeros(0, np.int64)
        group, size, whole = np.array(self.docs, np.int64).reshape(-1, 3).T
        terms = np.concatenate([none, *self.terms])
        doc = np.repeat(np.arange(len(size)), size)
        more = np.concatenate([none, *(g * kinds + t for g, t in self.more)])
        # a row for each (group, term), whether seen as occurrence or as document, and for each group
        key, n = runs(np.concatenate([group[doc] * kinds + terms, more]))
        again, m = runs(more)
        n[np.searchsorted(key, again)] -= m
        pair, _ = runs((doc * kinds + terms)[whole[doc] > 0])
        held, k = runs(np.concatenate([group[pair // kinds] * kinds + pair % kinds, more]))
        d = np.zeros(len(key), np.int64)
        d[np.searchsorted(key, held)] = k
        pick = pa.array(np.concatenate([key // kinds, np.arange(len(self.groups))]))
        lang, source = (pa.array([g[i] for g in self.groups], pa.string()) for i in (0, 1))
        word = pa.concat_arrays([pa.array(list(self.ids), pa.binary()).take(pa.array(key % kinds)),
                                 pa.array([b""] * len(self.groups), pa.binary())])
        nil = np.zeros(len(self.groups), np.int64)
        return pa.RecordBatch.from_arrays([lang.take(pick), source.take(pick), word.cast(pa.string()),
                                           pa.array(np.append(n, nil)), pa.array(np.append(d, nil))],
                                          ["lang", "source", "term", "n", "d"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, d) of the rows: occurrences and documents, combined per task.

    Every group also gives a row with the empty term.
    """
    held = _Counts()
    for batch in batches:
        data, at = utf8(batch.column("text"))
        for i, group in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)):
            row = data[at[i]:at[i + 1]]
            passes = 1 + len(row) // _SET_BYTES
            if passes == 1:
                held.add(group, [t for chunk in byte_chunks(row, _TERM) for t in chunk.split()], True)
            for p in range(passes if passes > 1 else 0):
                seen: set[bytes] = set()
                for chunk in byte_chunks(row, _TERM):
                    if p == 0:
                        held.add(group, chunk.split(), False)
                    seen.update(t for t in set(chunk.split()) if crc32(t) % passes == p)
                    if held.size > _HELD:
                        yield held.rows()
                        held = _Counts()
                held.add_document(group, seen)
            if held.size > _HELD:
                yield held.rows()
                held = _Counts()
    if held.groups:
        yield held.rows()
    tidy()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d) of ``docs``, and a row with the empty term for every group."""
    small_batches(docs.sparkSession)
    empty = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")]
    rows = docs.select(*empty).mapInArrow(_count, "lang string, source string, term string, n bigint, d bigint")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def share(count: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 kinds)), exact for any counts."""
    part = (count + 2).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    whole = (total + 2 * kinds).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.floor(_div(part, whole))


def _div(a: Column, b: Column) -> Column:
    # the integer part of a division of decimals; Column has no operator for it
    return F.call_function("div", a, b).cast("long")


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of two shares: below 2^63 at every step."""
    return F.call_function("div", (p - q) * (p - q), p + q)


# ------------------------------------------------------------------ unusual terms
def skyband(n: np.ndarray, total: np.ndarray, name: np.ndarray, k: int) -> np.ndarray:
    """Which rows of one group fewer than ``k`` others dominate; ``name`` is the rank of the term.

    The rows come with ``n`` descending, then ``total`` and ``name`` ascending.  A row dominates
    another if its n is not lower, its total not higher and its name earlier.  Dominators come
    before, and k of them that are in the skyband exist wherever k exist, so a row is held
    against the kept ones only.
    """
    kept = np.zeros(0, np.int64)
    for s in range(0, len(n), _BLOCK):
        # a block against what is kept, then what is left of it in its own order
        i = np.arange(s, min(len(n), s + _BLOCK))
        over = ((total[kept] <= total[i][:, None]) & (name[kept] < name[i][:, None])).sum(axis=1)
        i, over = i[over < k], over[over < k]
        own = np.tril((total[i] <= total[i][:, None]) & (name[i] < name[i][:, None]), -1)
        keep = np.zeros(len(i), bool)
        for j in range(len(i)):
            keep[j] = over[j] + np.count_nonzero(own[j, :j] & keep[:j]) < k
        kept = np.append(kept, i[keep])
    return kept


def _thin(rows: pa.Table, k: int) -> pa.Table:
    """The skybands of all groups of ``rows``."""
    group = np.zeros(len(rows), np.int64)
    for c in ("lang", "source"):
        codes = rows.column(c).combine_chunks().dictionary_encode()
        group = group * max(1, len(codes.dictionary)) + codes.indices.to_numpy()
    n, total = (rows.column(c).to_numpy() for c in ("n", "total"))
    name = np.empty(len(rows), np.int64)
    name[pc.sort_indices(rows.column("term")).to_numpy()] = np.arange(len(rows))        # Arrow sorts by UTF-8 bytes
    order = np.lexsort((name, total, -n, group))
    n, total, name, group = n[order], total[order], name[order], group[order]
    edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
    kept = [s + skyband(n[s:e], total[s:e], name[s:e], k) for s, e in pairwise(edges)]
    return rows.take(pa.array(order[np.concatenate([np.zeros(0, np.int64), *kept])]))


def _skybands(k: int, batch_rows: int = 400_000):
    """A partition's rows without those that ``k`` others of their group in it dominate."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= batch_rows:
                held = _thin(pa.Table.from_batches(held), k).combine_chunks().to_batches()
                size = sum(map(len, held))
                if 2 * size > batch_rows:         # many groups: pass on what is left of them
                    yield from held
                    held, size = [], 0
        if held:
            yield from _thin(pa.Table.from_batches(held), k).to_batches()
        tidy()
    return run


def unusual_terms(cells: DataFrame, k: int) -> DataFrame:
    """(lang, source, item, value, rank): the first ``k`` terms of every group by distance from the language.

    ``cells``: lang, source, term, n, total, p, q.  Only terms with n > 0 and p > q count.
    """
    rows = cells.where((F.col("n") > 0) & (F.col("p") > F.col("q")))
    for keys in ([], ["lang", "source", F.pmod(F.xxhash64("term"), F.lit(16))], ["lang", "source"]):
        rows = (rows.repartition(*keys) if keys else rows).mapInArrow(_skybands(k), rows.schema)
    rows = rows.select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


# ------------------------------------------------------------------ pairs of sources
def _tile(pdf: pd.DataFrame) -> pd.DataFrame:
    """Summed distances of all pairs of sources of two tiles over the terms of one bucket."""
    lang, ta, tb = pdf["lang"].iloc[0], pdf["ta"].iloc[0], pdf["tb"].iloc[0]
    absent = pdf["term"].isna().to_numpy()
    codes, terms = pd.factorize(pdf["term"][~absent])
    idx, p, side = pdf["idx"].to_numpy(np.int64), pdf["p"].to_numpy(np.int64), pdf["tile"].to_numpy() == tb

    def matrix(pick):
        base = absent & pick
        ids = np.sort(idx[base])
        m = np.repeat(p[base][np.argsort(idx[base])][None, :], len(terms), axis=0)
        use = pick[~absent]
        m[codes[use], np.searchsorted(ids, idx[~absent][use])] = p[~absent][use]
        return ids, m

    ib, b = matrix(side)
    ia, a = (ib, b) if ta == tb else matrix(~side)
    firsts = [i + 1 if ta == tb else 0 for i in range(len(ia))]
    sums = [np.zeros(0, np.int64)]
    for i, first in enumerate(firsts):
        x, y = a[:, i:i + 1], b[:, first:]
        sums.append(((x - y) ** 2 // (x + y)).sum(axis=0))
    value = np.concatenate(sums)
    return pd.DataFrame({"lang": np.full(len(value), lang, object), "a": np.repeat(ia, [len(ib) - f for f in firsts]),
                         "b": np.concatenate([ib[:0], *(ib[f:] for f in firsts)]), "value": value, "seen": len(terms)})


def source_pairs(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): every other source of the language by summed distance.

    ``cells``: lang, source, term, p of terms that occur; ``groups``: lang, source, kinds (number
    of kept terms), base (share of a term that does not occur).  Sums run over buckets of terms
    for tiles of sources, so no task holds more than one dense block; terms that occur in
    neither tile add one distance of the bases each.
    """
    order = Window.partitionBy("lang").orderBy("source")
    g = groups.withColumn("idx", F.row_number().over(order).cast("long") - 1)
    g = g.withColumn("tile", F.floor(F.col("idx") / _SOURCES)).withColumn("tiles", F.max("tile").over(
        Window.partitionBy("lang")) + 1)
    g = written(g.withColumn("buckets", 1 + F.floor(F.col("kinds") / _TERMS)), "groups")
    dim = small(g.select("lang", "source", "idx", "tile", "tiles", "buckets"))
    present = cells.join(dim, ["lang", "source"]).select(
        "lang", "idx", "tile", "tiles", "term", "p", F.pmod(F.xxhash64("term"), F.col("buckets")).alias("bucket"))
    absent = g.select("lang", "idx", "tile", "tiles", F.lit(None).cast("string").alias("term"), F.col("base").alias("p"),
                      F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1)).alias("bucket"))
    rows = present.unionByName(absent).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    rows = rows.select("lang", "idx", "tile", "term", "p", "bucket", F.least("tile", "other").alias("ta"),
                       F.greatest("tile", "other").alias("tb"))
    sums = (rows.groupBy("lang", "ta", "tb", "bucket")
            .applyInPandas(_tile, "lang string, a bigint, b bigint, value bigint, seen bigint")
            .groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen")))
    both = sums.withColumn("way", F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")),
                                                    F.struct(F.col("b").alias("x"), F.col("a").alias("y")))))
    both = both.select("lang", F.col("way.x").alias("x"), F.col("way.y").alias("y"), "value", "seen")
    one = small(g.select("lang", F.col("idx").alias("x"), "source", F.col("base").alias("p0"), "kinds"))
    two = small(g.select("lang", F.col("idx").alias("y"), F.col("source").alias("item"), F.col("base").alias("q0")))
    rest = F.when(F.col("kinds") > 0, (F.col("kinds") - F.col("seen")) * distance(F.col("p0"), F.col("q0"))).otherwise(F.lit(0))
    named = both.join(one, ["lang", "x"]).join(two, ["lang", "y"]).select(
        "lang", "source", "item", (F.col("value") + rest).alias("value"))
    return named.withColumn("rank", F.row_number().over(
        Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))))


def audit(docs: DataFrame, min_docs: int = 10, k: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank of every (lang, source) group of ``docs``.

    Part ``pair`` ranks the other sources of the language, part ``term`` the group's first
    ``k`` unusual terms.  A term is kept by a language that has it in at least ``min_docs``
    documents; equal rows are documents of their own.  Null text, lang or source counts as
    empty.  A group without terms has pairs but no terms, a language without kept terms has
    pairs of value 0, a language with one source has no pairs, and an empty table gives no
    rows.  Ties go by UTF-8.  Other columns are not read.  Memory: a task holds three million
    terms of texts and the set of terms of 32 MB of a text, however long the text is.
    """
    counts = written(term_counts(docs), "terms")
    terms = counts.where(F.col("term") != "")
    kept = written(terms.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("d").alias("docs"))
                   .where(F.col("docs") >= min_docs).select("lang", "term", "total"), "kept")
    found = written(terms.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "total"), "cells")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kinds"), F.sum("total").alias("all_"))
    sizes = found.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    zero = F.lit(0).cast("long")
    groups = (counts.where(F.col("term") == "").select("lang", "source")
              .join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
              .select("lang", "source", *[F.coalesce(F.col(c), zero).alias(c) for c in ("size", "kinds", "all_")]))
    groups = written(groups.withColumn("base", F.when(F.col("kinds") > 0, share(
        zero, F.col("size"), F.col("kinds"))).otherwise(zero + 1)), "sources")
    cells = found.join(small(groups), ["lang", "source"]).select(
        "lang", "source", "term", "n", "total", share(F.col("n"), F.col("size"), F.col("kinds")).alias("p"),
        share(F.col("total"), F.col("all_"), F.col("kinds")).alias("q"))
    pairs = source_pairs(cells.select("lang", "source", "term", "p"), groups.select("lang", "source", "kinds", "base"))
    best = unusual_terms(cells, k)
    out = pairs.withColumn("part", F.lit("pair")).unionByName(best.withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", "rank")
