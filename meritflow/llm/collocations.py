"""Phrase collocation mining: one count of the longest windows, summed to all shorter phrases.

Every word opens one window: itself and the words that follow it in its piece, padded
where the piece ends.  Only these longest windows are counted.  A ROLLUP over their columns
sums them to every shorter phrase, since a phrase occurs where a window begins with it; its
top level is the number of words.  Phrases are then scored against their two parts.

A phrase that occurs ``min_count`` times has parts that do, so everything behind the ROLLUP
reads phrases of that frequency only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meritflow.llm.common import Numbers, byte_chunks, small, small_batches, tidy, utf8, written

#: Piece ends become line feeds, tabs blanks, and A-Z is lower-cased; other bytes stay.
_MAP = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b | 32 if 65 <= b <= 90 else b for b in range(256))
#: Words that a task counts windows over at once.
_HELD = 3_000_000
#: Buckets that the windows with the same first word are in.
_SPLITS = 16


class _Windows:
    """Windows of one language, held as the numbers of the words in text order."""

    def __init__(self, words: list[bytes] = ()) -> None:
        self.ids = Numbers({b"\n": 0})
        self.parts = [self.ids.of(words)]

    def add(self, chunk: bytes) -> int:
        """Take the words of a mapped chunk of text, with a 0 where a piece ends."""
        got = self.ids.of(filter(None, chunk.replace(b"\n", b" \n ").split(b" ")))
        self.parts.append(got)
        return len(got)

    def end(self) -> None:
        """A text ends: no window goes on behind it."""
        self.parts.append(np.zeros(1, np.int64))

    def counts(self, length: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """The different windows as columns of numbers, their bucket, their words, how often each
        occurs, and the last words, whose windows are still open.  Windows come by bucket and size."""
        text = np.concatenate(self.parts)
        m = max(0, len(text) - length + 1)
        names = list(self.ids)
        leads = [text[:m]]
        for k in range(1, length):
            leads.append(np.where(leads[-1] == 0, 0, text[k:m + k]))      # nothing follows a piece's end
        leads = np.stack(leads)[:, leads[0] != 0]
        hashes = np.array([crc32(x) for x in names], np.int64)
        bucket = (hashes[leads[0]] * 31 + hashes[leads[1]] % _SPLITS) % buckets
        size = np.count_nonzero(leads, axis=0)
        code, kinds = bucket * (length + 1) + size, buckets * (length + 1)
        for x in leads:
            if kinds * len(names) >= 1 << 63:
                seen, code = np.unique(code, return_inverse=True)
                kinds = len(seen)
            code, kinds = code * len(names) + x, kinds * len(names)
        order = np.argsort(code)
        code = code[order]
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]][:len(code)])
        at = order[first]
        return leads[:, at], bucket[at], size[at], np.diff(np.append(first, len(code))), [names[i] for i in text[m:]]


def _window_rows(length: int, buckets: int):
    """(lang, bucket, size, lines) of the rows: the different windows, combined per task.

    A line is a window without its padding, a tab, and how often it occurs.  The bucket follows
    from the first word and a split of the second, so windows with one beginning of two
    words share a bucket and a frequent first word has several.
    """
    def out(held: dict[str, _Windows], last: bool):
        """Windows whose words are all there; with ``last`` those that the end of the text pads too."""
        for lang, one in held.items():
            for _ in range(length if last else 0):
                one.end()
            columns, bucket, size, n, tail = one.counts(length, buckets)
            words = pa.array([b"", *list(one.ids)[1:]], pa.binary()).cast(pa.string())
            held[lang] = _Windows(tail)
            for k in range(1, length + 1):
                pick = size == k
                if not pick.any():
                    continue
                window = pc.binary_join_element_wise(*(words.take(pa.array(x[pick])) for x in columns[:k]), " ")
                lines = pc.binary_join_element_wise(window, pa.array(n[pick]).cast(pa.string()), "\t")
                b = bucket[pick]
                edges = np.flatnonzero(np.r_[True, b[1:] != b[:-1], True])
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), lines)
                same = pa.array(np.zeros(len(lists), np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang], pa.string()).take(same), pa.array(b[edges[:-1]]), pa.array([k], pa.int32()).take(same),
                     pc.binary_join(lists, "\n")], ["lang", "bucket", "size", "lines"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Windows] = {}
        size = 0
        for batch in batches:
            data, at = utf8(batch.column("text"))
            for lang, (s, e) in zip(batch.column("lang").to_pylist(), pairwise(at), strict=True):
                one = held.setdefault(lang, _Windows())
                for chunk in byte_chunks(data[s:e], _MAP):
                    size += one.add(chunk)
                    if size > _HELD:
                        yield from out(held, False)
                        one, size = held[lang], 0
                one.end()
        yield from out(held, True)
        tidy()
    return run


def windows(docs: DataFrame, length: int) -> DataFrame:
    """(lang, bucket, phrase, size, n): every different longest window and how often it occurs.

    Windows are shuffled as sorted lists, a bucket to a row, which keeps the shuffle near the
    size of the texts.
    """
    small_batches(docs.sparkSession)
    buckets = max(1_024, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    lists = rows.mapInArrow(_window_rows(length, buckets), "lang string, bucket bigint, size int, lines string")
    one = lists.repartition("bucket").select("lang", "bucket", "size", F.explode(F.split("lines", "\n")).alias("line"))
    one = one.select("lang", "bucket", "size", F.substring_index("line", "\t", 1).alias("phrase"),
                     F.substring_index("line", "\t", -1).cast("long").alias("n"))
    return one.groupBy("lang", "bucket", "phrase", "size").agg(F.sum("n").alias("n"))


def forget_rare(counted: DataFrame, length: int, min_count: int) -> DataFrame:
    """``counted`` with the last words of windows below ``min_count`` forgotten, as far as two words.

    No phrase that rare is a candidate or part of one, so only its prefixes need its count.  A
    prefix with a frequent longer window is marked and kept.  All windows with a prefix of two
    words are in one bucket, so this needs no shuffle.
    """
    rows = counted.withColumn("mark", F.lit(False))
    for size in range(length, 1, -1):
        here = F.col("size") == size
        rare = here & (F.col("n") < min_count) & ~F.col("mark")
        prefix = F.substring_index("phrase", " ", size - 1)
        less = F.struct(prefix.alias("phrase"), F.lit(size - 1).alias("size"), F.col("n").alias("n"), F.lit(False).alias("mark"))
        same = F.struct("phrase", "size", "n", "mark")
        above = F.struct(prefix.alias("phrase"), F.lit(size - 1).alias("size"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("mark"))
        rows = rows.select("lang", "bucket", F.inline(F.when(rare, F.array(less)).when(here, F.array(same, above)).otherwise(F.array(same))))
        rows = rows.groupBy("lang", "bucket", "phrase", "size").agg(F.sum("n").alias("n"), F.max("mark").alias("mark"))
    return rows.drop("mark")


def phrases(docs: DataFrame, length: int, min_count: int) -> tuple[DataFrame, DataFrame]:
    """(lang, size, w1 .. wn, f) of phrases with f >= min_count, and (lang, n) of all words.

    The ROLLUP sums the longest windows to their prefixes.
    """
    w = [f"w{i}" for i in range(1, length + 1)]
    counted = forget_rare(windows(docs, length), length, min_count)
    words = F.split("phrase", " ")
    padded = counted.select("lang", *[F.coalesce(F.get(words, F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(w)], "n")
    sums = padded.rollup("lang", *w).agg(F.sum("n").alias("f"), F.grouping_id().alias("level")).where("lang IS NOT NULL")
    # the level has a set bit for each column summed over; a prefix that ends in padding is a
    # shorter phrase's row over again, except that of all words
    known = F.lit(length) - F.bit_count("level")
    last = F.element_at(F.array(*[F.col(c) for c in w]), F.greatest(known, F.lit(1)).cast("int"))
    sums = sums.withColumn("size", known.cast("int")).where((F.col("size") == 0) | ((last != "") & (F.col("f") >= min_count)))
    sums = written(sums.select("lang", "size", *w, "f"), "phrases")
    return sums.where(F.col("size") > 0), sums.where(F.col("size") == 0).select("lang", F.col("f").alias("n"))


def _exact(c: Column) -> Column:
    return c.cast("decimal(18,0)")


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(10^6 a^2 / (left right)), exact for counts below 10^16."""
    top = (_exact(a) * _exact(a)).cast("decimal(32,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", top.cast("decimal(38,0)"), _exact(left) * _exact(right)).cast("long")


def collocations(docs: DataFrame, length: int = 3, min_count: int = 10, top: int = 2_000, inside: int = 50) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of ``docs``.

    Phrases of 2 to ``length`` words that occur ``min_count`` times are scored by their worst
    cut.  A phrase goes if a longer one that holds it occurs at least ``inside`` percent as
    often.  A null lang is ``und``, a null text is empty; texts without words give nothing, and
    an empty table no rows.  Equal rows count each; ties go by a, then UTF-8.  Other columns
    are not read.  Memory: a task holds three million words, however long a text is.
    """
    found, totals = phrases(docs, length, min_count)
    w = [f"w{i}" for i in range(1, length + 1)]
    sized = {k: found.where(F.col("size") == k).select("lang", *w[:k], "f") for k in range(1, length + 1)}
    scored, holders = [], []
    for size in range(2, length + 1):
        rows = sized[size].withColumnRenamed("f", "a")
        cuts = []
        for k in range(1, size):
            left = sized[k].select("lang", *w[:k], F.col("f").alias(f"l{k}"))
            right = sized[size - k].select("lang", *[F.col(w[i]).alias(w[k + i]) for i in range(size - k)],
                                           F.col("f").alias(f"r{k}"))
            rows = rows.join(small(left), ["lang", *w[:k]]).join(small(right), ["lang", *w[k:size]])
            cuts.append(F.struct(score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"),
                                 F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
        worst = cuts[0] if len(cuts) == 1 else F.least(*cuts)
        scored.append(rows.select("lang", F.concat_ws(" ", *w[:size]).alias("phrase"), "a", worst.alias("cut")))
        # the phrases inside these, with their frequency
        parts = [F.concat_ws(" ", *w[s:s + m]) for m in range(2, size) for s in range(size - m + 1)]
        if parts:
            holders.append(rows.select("lang", F.explode(F.array(*parts)).alias("phrase"), F.col("a").alias("longer")))
    every = scored[0]
    for more in scored[1:]:
        every = every.unionByName(more)
    if holders:
        held = holders[0]
        for more in holders[1:]:
            held = held.unionByName(more)
        held = held.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        every = every.join(held, ["lang", "phrase"], "left").where(
            F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    best = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), F.asc("phrase"))
    ranked = every.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top)
    return ranked.join(small(totals), "lang").select("lang", "rank", "phrase", "a", F.col("cut.l").alias("l"),
                                                     F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
