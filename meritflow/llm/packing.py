"""Hierarchical multi-length packing of tokenised documents.

Documents become token ids with an end id.  Whole windows of the longest tier are cut off
first; what is left of a document is routed to the smallest context tier that holds it.
Tiers are packed from the longest down: the longest remainder opens a window of its tier,
gaps take the longest remainders of shorter tiers that fit, and a last gap is closed by
cutting the longest remainder at hand.  So every window is full but for the last of a batch,
which is itself cut into tier lengths and one padded rest.  Finished sequences are dealt to
step groups by falling length, so that the groups of a batch differ by at most one window.

Packing needs no shuffle: each task packs its own rows, batch by batch, in a fixed order.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meritflow.llm.common import small_batches, tidy, utf8

TIERS = (64, 128, 256, 512, 1024)
STEP_TOKENS = 16 * 1024
#: Rows of one packing batch at most; a batch also ends at this many bytes of text.
BATCH_BYTES = 1 << 22

#: The ranked encoder's pattern fails on runs of about a million blanks; from here on it is not asked.
LONG_BLANK = 500_000
#: The pattern of byte-level vocabularies of this kind (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Token ids of texts, by the vocabulary file's own encoder.

    Where the file's merges are in the order of their ids, texts go through those ranks,
    which gives the same ids several times sooner; texts that hold a special token's string
    always take the file's own way, and so do texts that the ranked encoder cannot read.
    """

    def __init__(self, path: str):
        self.path = path
        self.ranked, self.special = _by_rank(path)

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer
        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> list[int]:
        if self.ranked and not any(s in text for s in self.special) and not _long_blank(text):
            try:
                return self.ranked.encode_ordinary(text)
            except (KeyboardInterrupt, SystemExit, MemoryError):
                raise
            except BaseException as e:       # a panic of native code is no Exception
                if not isinstance(e, Exception) and type(e).__name__ != "PanicException":
                    raise
        return self.tokenizer.encode(text, add_special_tokens=False).ids


def _long_blank(text: str) -> bool:
    return len(text) >= LONG_BLANK and any(m.end() - m.start() >= LONG_BLANK for m in re.finditer(r"\s+", text))


def _by_rank(path: str):
    """An encoder by merge ranks, or None if the file is no byte-level vocabulary in rank
    order, and the special tokens' strings."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec.get("added_tokens", ())}
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or spec.get("normalizer"):
        return None, special
    joined = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    order = [model["vocab"][a + b] for a, b in joined]
    if order != sorted(order):
        return None, special
    import tiktoken
    # the byte-level alphabet: printable Latin-1 stands for itself, the rest from U+0100 on
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), special


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, loaded once in each Python worker."""
    out = Encoder(path)
    tidy()                                   # the parsed file is several times its size
    return out


def token_bytes(texts: list[str | None], path: str, end_id: int) -> list[bytes]:
    """Ids of every text and the end id, as little-endian 32-bit values."""
    known = encoder(path)
    return [array("I", [*(known.ids(t) if t else ()), end_id]).tobytes() for t in texts]


def plan(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences as (window, [(row, start, length), ...]) for rows of the given lengths."""
    longest = tiers[-1]
    done: list[tuple[int, list[tuple[int, int, int]]]] = []
    pool: list[tuple[int, int, int]] = []           # length, row, start: ascending
    for row, n in enumerate(lengths):
        whole = n - n % longest
        done.extend((longest, [(row, s, longest)]) for s in range(0, whole, longest))
        if n > whole:
            pool.append((n - whole, row, whole))
    pool.sort()
    while pool:
        n, row, start = pool.pop()
        window = next(t for t in tiers if t >= n)
        held, gap = [(row, start, n)], window - n
        while gap and pool:
            k = bisect_right(pool, (gap + 1,)) - 1
            if k >= 0:
                n, row, start = pool.pop(k)
                held.append((row, start, n))
                gap -= n
            else:
                n, row, start = pool.pop()
                held.append((row, start, gap))
                insort(pool, (n - gap, row, start + gap))
                gap = 0
        if gap:
            done.extend(_last(held, tiers))
        else:
            done.append((window, held))
    return done


def _last(held: list[tuple[int, int, int]], tiers: tuple[int, ...]) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """The unfinished window of a batch: tier lengths as long as they fill, then the rest."""
    left = sum(n for *_, n in held)
    while left:
        window = next((t for t in reversed(tiers) if t <= left), 0)
        room, now = window or left, []
        while room:
            row, start, n = held.pop(0)
            now.append((row, start, min(n, room)))
            if n > room:
                held.insert(0, (row, start + room, n - room))
            room -= min(n, room)
        size = sum(n for *_, n in now)
        left -= size
        yield (size if size & (size - 1) == 0 else tiers[-1]), now


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, tiers: tuple[int, ...] = TIERS,
         step_tokens: int = STEP_TOKENS, with_ids: bool = True) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, window (the padded length), step_group and, on request, the ids
    as little-endian unsigned 32-bit values.

    ``tokenizer`` is the path of a vocabulary file, the same on all executors.  Null and
    empty texts are one end id.  Repeated rows are packed each; a null doc_id stays null.
    An empty table gives no rows; other columns of ``docs`` are not read.
    """
    cut = tuple(sorted(tiers))
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        sequence = step = 0
        for b in batches:
            _, sizes = utf8(b.column("text"))
            at = 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + BATCH_BYTES, side="right")) - 1)
                ids = token_bytes(b.column("text").slice(at, to - at).to_pylist(), tokenizer, end_id)
                doc = b.column("doc_id").slice(at, to - at)
                at = to
                done = plan([len(x) // 4 for x in ids], cut)
                done.sort(key=lambda s: -s[0])
                groups = max(1, -(-sum(w for w, _ in done) // step_tokens))
                rows: list[tuple] = []
                for k, (window, held) in enumerate(done):
                    offset = 0
                    for row, start, n in held:
                        rows.append((row, start, n, len(ids[row]) // 4, base + sequence + k, offset, window, base + step + k % groups))
                        offset += n
                sequence, step = sequence + len(done), step + groups
                for i in range(0, len(rows), 8192):
                    part = rows[i:i + 8192]
                    row, start, n, *rest = (pa.array(x, pa.int64()) for x in zip(*part, strict=True))
                    raw = [ids[r][4 * s:4 * (s + m)] for r, s, m, *_ in part]
                    crc = pa.array([zlib.crc32(x) for x in raw], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [doc.take(row), start, n, crc, *rest] + ([pa.array(raw, pa.binary())] if with_ids else []), names)
            tidy()

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_group"]
    names += ["ids"] if with_ids else []
    schema = ", ".join(f"`{n}` {'binary' if n == 'ids' else 'long'}" for n in names)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.sortWithinPartitions("doc_id", F.xxhash64("text")).mapInArrow(run, schema)
