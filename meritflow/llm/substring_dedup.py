"""Substring dedup by content-defined chunking with a gear rolling hash.

A text is cut wherever the rolling hash of the last 16 bytes is the least within some bytes
to either side, so cuts depend on nothing but the bytes around them: an insertion moves the
cuts behind it without changing them, and the same passage is cut alike in any document.
Where a text repeats itself within that reach the least hash comes back every period: such a
run is cut where it begins and ends and after every so many periods, whatever its length.
No chunk is shorter than that reach, so few repeat by chance.  Chunks are identified by
digest.  A Bloom filter of the digests met twice lets only possibly repeated chunks shuffle;
those are grouped by digest, which tells the first document of each.  Adjacent repeated
chunks of a text form spans, and spans of enough words are reported; all but the first
occurrence are to be removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meritflow.llm.common import BLANK, mix64, pieces, small, stream_values, utf8, word_starts, written
from meritflow.llm.exact_dedup import _has, _probes, repeated_filter

WINDOW = 16
REACH = 15               # a cut is the least hash of this many bytes to either side
RUN_STEP = 32            # a run that repeats itself is cut every so many bytes, in whole periods
MAX_CHUNK = 512
HOT_PLACES = 10_000      # a digest of more places is joined by broadcast

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[BLANK] = 32
_GEAR = stream_values(3, 256).astype(np.uint32)
_NONE = np.uint32(0xFFFFFFFF)
_VALUE = stream_values(4, 256)
_POWER = np.cumprod(np.full(MAX_CHUNK, 0x9E3779B97F4A7C15, np.uint64))


def _least(h: np.ndarray) -> np.ndarray:
    """Where a hash is not above any of the REACH before it and after it, thinned in runs.

    Two such places within REACH of each other have the same hash: there the text repeats
    itself.  Of such a run the first place stays, then one every RUN_STEP bytes in whole
    periods, so that any two of its chunks are equal, and the last.
    """
    edge = np.full(REACH, _NONE, np.uint32)
    m = np.concatenate([edge, h, edge])
    for step in (1, 2, 4):                     # the least of 8 from each place on
        m = np.minimum(m[:-step], m[step:])
    n, r = len(h), REACH
    before = np.minimum(m[0:n], m[r - 8:n + r - 8])
    after = np.minimum(m[r + 1:n + r + 1], m[2 * r - 7:n + 2 * r - 7])
    at = np.flatnonzero((h <= before) & (h <= after) & (h != _NONE))
    if len(at) < 2:
        return at
    near = np.diff(at) <= REACH
    k = np.arange(len(at))
    first = np.maximum.accumulate(np.where(np.r_[True, ~near], k, 0))
    period = at[np.minimum(first + 1, len(at) - 1)] - at[first]
    every = -(-RUN_STEP // np.maximum(period, 1))
    over = (k - first) % every
    return at[(over == 0) | (np.r_[~near, True] & (at - at[k - over] > REACH))]


def chunks(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, digest and words of each chunk of the texts that begin at ``rows``."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    b = _FOLD[data]
    h, width = _GEAR[b], 1
    while width < WINDOW:                      # the hash of 2w bytes from two of w bytes
        h[width:] = h[width:] + (h[:-width].copy() << np.uint32(width))
        width *= 2
    begins = rows[rows < n]
    for k in range(WINDOW - 1):                # the window must lie inside the text, and as it
        h[np.minimum(begins + k, n - 1)] = _NONE   # is longer than the reach, so do the neighbours
    cut = np.zeros(n + 1, bool)
    cut[_least(h) + 1] = True
    cut[begins] = True
    start = np.flatnonzero(cut[:n])
    size = np.diff(np.r_[start, n])
    if (size > MAX_CHUNK).any():
        extra = [np.arange(s + MAX_CHUNK, s + k, MAX_CHUNK) for s, k in zip(start[size > MAX_CHUNK], size[size > MAX_CHUNK], strict=True)]
        start = np.sort(np.concatenate([start, *extra]))
        size = np.diff(np.r_[start, n])
    place = np.arange(n) - np.repeat(start, size)
    digest = mix64(np.add.reduceat(_VALUE[b] * _POWER[place], start) + size.astype(np.uint64))
    words = np.diff(np.searchsorted(word_starts(data, rows), np.r_[start, n]))
    return start, digest, words


def _digests(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = utf8(b.column(0))
            for i, j in pieces(at, 1 << 20):
                _, digest, _ = chunks(data[at[i]:at[j]], at[i:j] - at[i])
                yield pa.RecordBatch.from_arrays([pa.array(digest.view(np.int64))], ["key"])

    return docs.select("text").mapInArrow(run, "key long")


def _suspects(docs: DataFrame, max_bits: int) -> DataFrame:
    """key, doc_id, place, digest of the chunks that may be repeated.

    ``place`` is start * 2^20 + size * 2^10 + words, which keeps the rows narrow.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, bits = repeated_filter(_digests(docs), size // (2 * REACH), max_bits)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            data, at = utf8(b.column("text"))
            doc, key = b.column("doc_id"), b.column("key")
            for i, j in pieces(at, 1 << 20):
                start, digest, words = chunks(data[at[i]:at[j]], at[i:j] - at[i])
                size = np.diff(np.r_[start, at[j] - at[i]])
                row = np.searchsorted(at[i:j] - at[i], start, side="right") - 1
                place = (start - (at[i:j] - at[i])[row] << 20) + (size << 10) + words
                keep = np.flatnonzero(_has(table, _probes(digest, blocks)))
                who = pa.array(row[keep] + i)
                yield pa.RecordBatch.from_arrays([key.take(who), doc.take(who), pa.array(place[keep]),
                                                  pa.array(digest[keep].view(np.int64))], ["key", "doc_id", "place", "digest"])

    return docs.select("key", "doc_id", "text").mapInArrow(run, "key long, doc_id long, place long, digest long")


def find(docs: DataFrame, min_words: int = 16, max_bits: int = 1 << 28) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, repeated_bytes, removed_bytes, spans, other_doc_ids.

    ``spans`` lists (start, length, removed, doc_ids) in bytes of the UTF-8 text, in order;
    ``removed`` is false where the passage first occurs.  ``doc_ids`` holds, for a removed
    span, the first documents of most of its chunks, and for a first occurrence the last
    documents that repeat them.  The first document is the one with the smallest doc_id (null last),
    and within a document the first place counts.  Rows with the same doc_id and text count
    as one document.  Null and empty texts have no spans.

    A passage loses at most a few words at either end to chunks that reach beyond it, also
    where it holds or touches repeated words.  A run of those is no repeat of itself: its
    chunks count as one place.
    ``min_words`` allows for that and finds passages of 50 words.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("key"))
    seen = written(_suspects(keyed, max_bits), "chunks")
    mine = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    repeated = (seen.groupBy("digest").agg(F.count("*").alias("n"), F.min(mine).alias("first"), F.max(mine).alias("last"),
                                             (F.min("key") == F.max("key")).alias("alone"))
                .where("n > 1"))
    # a digest of very many places would be one task of the join: such ones, at most one in
    # HOT_PLACES places, are joined by broadcast
    repeated = written(repeated, "repeated")
    hot = small(written(repeated.where(F.col("n") > HOT_PLACES), "hot"))
    usual = seen.join(hot.select("digest"), "digest", "left_anti").join(repeated.where(F.col("n") <= HOT_PLACES), "digest")
    hits = usual.unionByName(seen.join(hot, "digest")).select(
        "key", "place", "digest", "alone", (mine != F.col("first")).alias("later"),
        F.when(mine != F.col("first"), F.col("first")).otherwise(F.col("last")).alias("other"))
    # from here on a document's chunks stay together; rows with the same doc_id and text give
    # the same chunks twice
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = hits.repartition(parts, "key").dropDuplicates(["key", "place"])
    here = Window.partitionBy("key").orderBy("place")
    same = Window.partitionBy("key", "digest")
    start, size = F.shiftright("place", 20), F.shiftright("place", 10).bitwiseAND(F.lit(1023))
    # equal chunks that follow each other are a run, which begins at one place
    follows = (F.lag("digest").over(here) == F.col("digest")) & (F.lag(start + size).over(here) == start)
    told = (own.withColumn("begins", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1))
            .withColumn("places", F.sum("begins").over(same))
            .withColumn("removed", F.col("later") | (F.sum("begins").over(same.orderBy("place")) > 1))
            .where("places > 1 OR NOT alone")
            .select("key", "other", "removed", start.alias("start"), size.alias("size"),
                    F.col("place").bitwiseAND(F.lit(1023)).alias("words"), "place")
            .withColumn("new", F.coalesce((F.lag(F.col("start") + F.col("size")).over(here) != F.col("start"))
                                          | (F.lag("removed").over(here) != F.col("removed")), F.lit(True)))
            .withColumn("span", F.sum(F.col("new").cast("long")).over(here)))
    # a stray chunk next to a passage may come from elsewhere: name the documents of its bulk
    parts = told.groupBy("key", "span", "removed", "other").agg(
        F.min("start").alias("start"), F.sum("size").alias("length"), F.sum("words").alias("words"))
    most = F.least(F.lit(min_words // 2), F.array_max(F.transform("others", lambda x: x["words"])))
    spans = (parts.groupBy("key", "span", "removed").agg(
        F.min("start").alias("start"), F.sum("length").alias("length"), F.sum("words").alias("words"),
        F.collect_list(F.struct("words", "other")).alias("others")).where(F.col("words") >= min_words)
        .withColumn("doc_ids", F.transform(F.filter("others", lambda x: x["words"] >= most), lambda x: x["other"])))
    per = spans.groupBy("key").agg(
        F.sum("length").alias("repeated_bytes"),
        F.sum(F.when(F.col("removed"), F.col("length")).otherwise(0)).alias("removed_bytes"),
        F.sort_array(F.collect_list(F.struct("start", "length", "removed", F.sort_array("doc_ids").alias("doc_ids")))).alias("spans"))
    rows = keyed.select("doc_id", "key", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    out = rows.join(per, "key", "left")
    others = F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: s["doc_ids"]))))
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_bytes", F.coalesce("repeated_bytes", zero).alias("repeated_bytes"),
                      F.coalesce("removed_bytes", zero).alias("removed_bytes"), "spans",
                      F.filter(others, lambda x: ~x.eqNullSafe(F.col("doc_id"))).alias("other_doc_ids"))


def _cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
    def one(text: str | None, cuts) -> str | None:
        if text is None or cuts is None:
            return text
        raw, out, at = text.encode(), [], 0
        for x in cuts:
            if x["removed"]:
                # whole characters only: what a passage holds of one in part stays
                start, end = x["start"], x["start"] + x["length"]
                while start < end and raw[start] & 0xC0 == 0x80:
                    start += 1
                while start < end < len(raw) and raw[end] & 0xC0 == 0x80:
                    end -= 1
                if start < end:
                    out.append(raw[at:start])
                    at = end
        return b"".join([*out, raw[at:]]).decode()
    return pd.Series([one(t, s) for t, s in zip(texts, spans, strict=True)])


def strip(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` without the removed spans of ``find``, joined by doc_id, which must be unique."""
    cut = F.pandas_udf(_cut, "string")
    found = spans.where("removed_bytes > 0").select(F.col("doc_id").alias("id_"), F.col("spans").alias("spans_"))
    out = docs.join(found, docs["doc_id"] == F.col("id_"), "left")
    return out.select(*[F.when(F.col("spans_").isNull(), docs["text"]).otherwise(cut(docs["text"], F.col("spans_"))).alias("text")
                        if c == "text" else docs[c] for c in docs.columns])
