"""Exact dedup: two Bloom passes find the possibly repeated texts; only those shuffle.

Texts are equal when they agree after deleting blanks, tabs and line breaks.  Of equal
texts the row with the most code points stays, then the smallest doc_id (null last), then
any one of fully tied rows.  The first pass runs the 64-bit keys of all texts past a Bloom
filter, split by key over the cluster, and enters each key met again in a second filter.
The second pass asks that filter: a miss is proof that a text is unique, so its row goes
straight through; the others are grouped by their full SHA-256 digest, which removes the
filter's false alarms.  The filter's size follows the row count up to ``max_bits``; beyond
that more rows are grouped, with the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meritflow.llm.common import SPACE, fresh, mix64, small_batches, tidy, utf8

BLOCK_BITS = 15          # a block is 4 KB; all probes of a key fall into one block
PROBES = 4
RESULTS = ("keep_id", "group_size", "kept", "text_sha256")


def _digests(text: pa.Array) -> pa.Array:
    """SHA-256 of the UTF-8 texts without white space; null counts as empty."""
    data, at = utf8(text)
    view, blank = memoryview(data), SPACE.encode()
    out = [hashlib.sha256(bytes(view[a:b]).translate(None, blank)).digest() for a, b in zip(at[:-1], at[1:], strict=True)]
    tidy()
    return pa.array(out, pa.binary())


def _keys(digests: pa.Array) -> np.ndarray:
    """The first eight bytes of each digest as a number."""
    return np.frombuffer(b"".join(x[:8] for x in digests.to_pylist()), "<i8")


def _probes(keys: np.ndarray, blocks: int) -> np.ndarray:
    """Bit numbers of each key, one column a probe."""
    block = (keys >> np.uint64(40)) % np.uint64(blocks)
    rest = mix64(keys)
    bits = [(rest >> np.uint64(16 * i)) & np.uint64((1 << BLOCK_BITS) - 1) for i in range(PROBES)]
    return (block[:, None] << np.uint64(BLOCK_BITS)) + np.stack(bits, axis=1)


def _has(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool).all(axis=1)


def _enter(table: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(table, (at >> np.uint64(3)).ravel(), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)).ravel())


def repeated_filter(keys: DataFrame, rows: int, max_bits: int = 1 << 28,
                    of: Callable[[pa.Array], np.ndarray] = pa.Array.to_numpy) -> tuple[int, bytes]:
    """Blocks and bits of a Bloom filter that holds every key occurring twice in ``keys``.

    ``of`` gives the 64-bit keys of the frame's only column.  Each batch first drops its own repeats, so a hot key reaches the shuffle twice a batch.
    """
    blocks = 1
    while blocks < (1 << 22) and blocks << BLOCK_BITS < min(max_bits, 16 * max(rows, 1)):
        blocks *= 2

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, n = np.unique(of(b.column(0)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(k, np.minimum(n, 2)))], ["key"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = blocks << (BLOCK_BITS - 3)
        once, twice = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
        for b in batches:
            k, n = np.unique(b.column(0).to_numpy().view(np.uint64), return_counts=True)
            at = _probes(k, blocks)
            _enter(twice, at[(n > 1) | _has(once, at)])
            _enter(once, at)
        table = twice.reshape(blocks, -1)
        full = np.flatnonzero(table.any(axis=1))
        del once
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int64)),
                                          pa.array([table[i].tobytes() for i in full], pa.binary())], ["block", "bits"])

    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = F.pmod(F.shiftrightunsigned("key", 40), F.lit(blocks))
    found = (keys.mapInArrow(thin, "key long").repartition(parts, block).mapInArrow(build, "block long, bits binary"))
    table = bytearray(blocks << (BLOCK_BITS - 3))
    for r in found.toLocalIterator():
        table[r.block << (BLOCK_BITS - 3):(r.block + 1) << (BLOCK_BITS - 3)] = r.bits
    return blocks, bytes(table)


def _digest_and_repeated(docs: DataFrame, max_bits: int) -> Column:
    """The text's digest and whether it may occur again, by one Python worker for each task."""
    blocks, bits = repeated_filter(docs.select("text"), docs.count(), max_bits, lambda text: _keys(_digests(text)))
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf("digest binary, maybe boolean")
    def known(text: pa.Array) -> pa.Array:
        digests = _digests(text)
        maybe = _has(np.frombuffer(shared.value, np.uint8), _probes(_keys(digests).view(np.uint64), blocks))
        return pa.StructArray.from_arrays([digests, pa.array(maybe)], ["digest", "maybe"])

    # a filter on a deterministic function would be pushed down and so compute it twice
    return known.asNondeterministic()(F.col("text"))


def _marked(docs: DataFrame, max_bits: int) -> tuple[DataFrame, dict[str, str]]:
    """Rows that pass straight and rows that were grouped, with the working columns."""
    n = fresh(docs, "digest", "size", "rank", "best", "count", "kept", "keep_id", "sure", "known")
    c = {k: F.col(v) for k, v in n.items()}
    doc_id = F.col("doc_id").cast("long")
    small_batches(docs.sparkSession)
    keyed = docs.withColumn(n["known"], _digest_and_repeated(docs, max_bits)).withColumns({
        n["digest"]: c["known"]["digest"], n["sure"]: ~c["known"]["maybe"],
        n["size"]: F.coalesce(F.length("text"), F.lit(0))}).drop(n["known"])
    straight = keyed.where(c["sure"]).withColumns({
        n["keep_id"]: doc_id, n["count"]: F.lit(1).cast("long"), n["kept"]: F.lit(True)})
    # ~id falls as the id grows, and null is the least of all in a struct
    mine = F.struct(c["size"].alias("size"), F.bitwise_not(doc_id).alias("id"))
    ties = Window.partitionBy(n["digest"], "doc_id", n["size"]).orderBy(F.xxhash64(*[
        F.col(f"`{x}`") for x, t in docs.dtypes if not t.startswith("map")]))
    suspects = keyed.where(~c["sure"])
    best = suspects.groupBy(n["digest"]).agg(F.max(mine).alias(n["best"]), F.count("*").alias(n["count"]))
    grouped = (suspects.withColumn(n["rank"], F.row_number().over(ties)).join(best, n["digest"])
               .withColumn(n["keep_id"], F.bitwise_not(c["best"]["id"]))
               .withColumn(n["kept"], mine.eqNullSafe(c["best"]) & (c["rank"] == 1)))
    return straight.unionByName(grouped, allowMissingColumns=True), n


def mark(docs: DataFrame, max_bits: int = 1 << 28) -> DataFrame:
    """One row per input row: its other columns, keep_id, group_size, kept, text_sha256.

    Null text equals empty text.  A null doc_id loses against any other; keep_id is null
    only if the whole group's ids are.  Of rows that tie in text length and doc_id exactly
    one is kept.  An empty table gives an empty one; an input column named like a result
    column is replaced by it.
    """
    rows, n = _marked(docs, max_bits)
    carried = [F.col(f"`{x}`") for x in docs.columns if x.lower() not in RESULTS]
    return rows.select(*carried, F.col(n["keep_id"]).alias("keep_id"), F.col(n["count"]).alias("group_size"),
                       F.col(n["kept"]).alias("kept"), F.lower(F.hex(n["digest"])).alias("text_sha256"))


def dedup(docs: DataFrame, max_bits: int = 1 << 28) -> DataFrame:
    """The rows that stay, with exactly the columns of ``docs``."""
    rows, n = _marked(docs, max_bits)
    return rows.where(F.col(n["kept"])).select(*[F.col(f"`{x}`") for x in docs.columns])
