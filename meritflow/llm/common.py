"""Helpers shared by the operators: written intermediates, size-checked broadcasts, text buffers."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from meritflow.session import scratch_path

#: The word characters' complement: a word is a maximal run of anything else.
SPACE = " \t\n\u000b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a broadcast may hold; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, kept for retries.

    The application's scratch folder goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"llm/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if ``df``, a written table, has at most ``max_rows`` rows."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


BLANK = np.zeros(256, bool)
BLANK[[*SPACE.encode()]] = True


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Let Python workers get at most ``rows`` rows at a time: texts can be long.

    This sets the session's Arrow batch size, which is read when a query starts.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def tidy() -> None:
    """Give memory that Arrow and numpy have freed back to the system.

    Python workers are kept for the next task, several to an executor, and would otherwise
    each hold on to the most they ever used.
    """
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def _trimmer():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):       # another C library
        return None


_TRIM = _trimmer()


def fresh(df: DataFrame, *names: str) -> dict[str, str]:
    """Names for working columns that clash with none of ``df``'s."""
    have = {c.lower() for c in df.columns}
    out = {}
    for n in names:
        x = f"_{n}"
        while x.lower() in have:
            x = f"_{x}"
        out[n] = x
        have.add(x.lower())
    return out


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets.astype(np.int64)


def pieces(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j
        i = j


def byte_chunks(row: np.ndarray, table: bytes, most: int = 1 << 20, blank: int = 32) -> Iterator[bytes]:
    """The bytes of a text mapped through ``table``, in chunks of about ``most`` bytes.

    A chunk ends behind a ``blank`` of the mapped text, so no word is cut; a longer word makes
    a longer chunk.
    """
    s, n = 0, len(row)
    while s < n:
        size = most
        while True:
            chunk = row[s:s + size].tobytes().translate(table)
            end = len(chunk) if s + size >= n else chunk.rfind(blank) + 1
            if end:
                break
            size *= 2
        yield chunk[:end]
        s += end


class Numbers(dict):
    """Numbers of words in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n

    def of(self, words: Iterable[bytes]) -> np.ndarray:
        return np.array(list(map(self.__getitem__, words)), np.int64)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values, ascending, and how often each occurs."""
    values = np.sort(values)
    first = np.ones(len(values), bool)
    first[1:] = values[1:] != values[:-1]
    at = np.flatnonzero(first)
    return values[at], np.diff(np.append(at, len(values)))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values (splitmix64's finish)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream_values(seed: int, n: int) -> np.ndarray:
    """``n`` pseudo-random unsigned 64-bit values, the same on every machine."""
    steps = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix64(steps + mix64(np.array([seed], np.uint64)))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from meritflow.sources.tables import read_table
    return read_table(spark, sf_dir, name)


def word_starts(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where words start in the bytes of texts that begin at ``rows``."""
    letter = ~BLANK[data]
    start = letter.copy()
    start[1:] &= ~letter[:-1]
    first = rows[rows < len(data)]
    start[first] = letter[first]
    return np.flatnonzero(start)


@F.arrow_udf(LongType())
def words(text: pa.Array) -> pa.Array:
    """Number of words of each text; null counts as empty."""
    data, at = utf8(text)
    out = np.zeros(len(at) - 1, np.int64)
    for i, j in pieces(at, 1 << 20):
        starts = word_starts(data[at[i]:at[j]], at[i:j] - at[i])
        out[i:j] = np.diff(np.searchsorted(starts, at[i:j + 1] - at[i]))
    tidy()
    return pa.array(out)
