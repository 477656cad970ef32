"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, everything but letters becomes a blank, and the grams of one to three
characters are hashed into a fixed number of bins.  Training counts bins per language over a
bounded sample; the matrix of log-probabilities is broadcast, and each batch of texts is
scored sparsely: the rows of its grams are gathered and summed by text.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritflow.llm.common import fresh, small_batches

BINS = 1 << 15
ORDERS = (1, 2, 3)
MAX_CELLS = 1 << 24          # of the broadcast matrix
_STEP = 1 << 19              # characters read at a time


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    weights: np.ndarray          # bins x languages, float32
    prior: np.ndarray


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(sys.maxunicode + 1)])


def _characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of the texts one after another, and where each begins."""
    low = [t.lower() if t else "" for t in texts]
    at = np.r_[0, np.cumsum([len(t) for t in low])].astype(np.int64)
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_letters()[points], points, np.uint32(32)), at


def _grams(points: np.ndarray, at: np.ndarray, bins: int, own: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: bin of the gram at every place, and whether it lies in one text and
    begins among the ``own`` first characters of its slice."""
    ends = np.repeat(at[1:], np.diff(at)) - np.arange(len(points))
    if own is not None:
        ends[np.arange(len(points)) - np.repeat(at[:-1], np.diff(at)) >= np.repeat(own, np.diff(at))] = 0
    h = np.zeros(len(points), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        shifted = np.zeros(len(points), np.uint32)
        shifted[:len(points) - n + 1] = points[n - 1:]
        h = (h ^ shifted) * np.uint32(0x9E3779B1) + np.uint32(n)
        if n in ORDERS:
            yield ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - bins.bit_length() + 1)).astype(np.int64), ends >= n


def _chunks(texts: list[str | None], step: int) -> Iterator[tuple[list[int], list[str], np.ndarray]]:
    """Row numbers, texts and own lengths of about ``step`` characters in all.

    A longer text comes in slices; each goes on for the longest gram less one behind its own
    characters, and a gram counts where it begins, so every gram of a text counts once.
    """
    rows, held, own, size = [], [], [], 0
    for i, t in enumerate(texts):
        t = t.lower() if t else ""
        for s in range(0, len(t) or 1, step):
            rows.append(i)
            held.append(t[s:s + step + max(ORDERS) - 1])
            own.append(min(step, len(t) - s))
            size += own[-1]
            if size >= step:
                yield rows, held, np.array(own)
                rows, held, own, size = [], [], [], 0
    if rows:
        yield rows, held, np.array(own)


def _score_step(languages: int) -> int:
    """Characters scored at a time: their gathered rows have at most 2^24 cells."""
    return max(1 << 12, min(_STEP, (1 << 24) // max(1, languages)))


def fit(docs: DataFrame, max_fit_rows: int = 3_000, smoothing: float = 0.2) -> LanguageModel:
    """Learn from the rows of ``docs`` with a text and a lang.

    ``max_fit_rows`` bounds the rows used of each language (a hash sample of about that
    many); the matrix has at most ``MAX_CELLS`` cells: with very many languages the number
    of bins falls, and beyond 4,096 languages this raises.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = docs.where("lang is not null and text is not null")
    per = {r.lang: r["count"] for r in known.groupBy("lang").count().orderBy("lang").limit(4_097).collect()}
    if len(per) > 4_096:
        raise ValueError("more than 4096 languages")
    languages, bins = tuple(sorted(per)), BINS
    if not languages:
        return LanguageModel((), np.zeros((bins, 0), np.float32), np.zeros(0))
    while bins * len(languages) > MAX_CELLS:
        bins //= 2
    shares = spark.createDataFrame([(k, i, min(1.0, max_fit_rows / per[k])) for i, k in enumerate(languages)],
                                   "lang string, no int, share double")
    draw = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1_000_000)) < F.col("share") * 1_000_000
    sample = known.join(F.broadcast(shares), "lang").where(draw).select("no", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(bins * len(languages), np.int64)
        for b in batches:
            no = b.column("no").to_numpy()
            for rows, texts, own in _chunks(b.column("text").to_pylist(), _STEP):
                points, at = _characters(texts)
                lang = np.repeat(no[rows], np.diff(at)).astype(np.int64) * bins
                for h, inside in _grams(points, at, bins, own):
                    table += np.bincount((lang + h)[inside], minlength=len(table))
        cells = np.flatnonzero(table)
        for i in range(0, len(cells), 1 << 16):
            part = cells[i:i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(table[part])], ["cell", "n"])

    counted = sample.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(bins * len(languages))
    table[counted["cell"].to_numpy()] = counted["n"].to_numpy()
    table = table.reshape(len(languages), bins) + smoothing
    weights = np.log(table / table.sum(axis=1, keepdims=True)).T.astype(np.float32)
    prior = np.log(np.array([per[k] for k in languages]) / sum(per.values()))
    return LanguageModel(languages, np.ascontiguousarray(weights), prior)


def predict(docs: DataFrame, model: LanguageModel, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the likeliest language of each whole text and its probability.

    A null text, or one without a letter, is 'und' with score 0, as is every text when the
    model knows no language.  The probability is tempered by the root of the number of
    grams, as grams of running text are far from independent.  Ties go to the language
    that sorts first; input columns named like the results are replaced.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang: string, score: double>")
    def best(column: pa.Array) -> pa.Array:
        m = shared.value
        texts = column.to_pylist()
        total, grams = np.zeros((len(texts), len(m.languages))), np.zeros(len(texts))
        for rows, part, own in _chunks(texts, _score_step(len(m.languages))):
            points, at = _characters(part)
            full = np.flatnonzero(np.diff(at))
            if not len(full):
                continue
            for h, inside in _grams(points, at, len(m.weights), own):
                gathered = m.weights[h]
                gathered[~inside] = 0
                np.add.at(total, np.array(rows)[full], np.add.reduceat(gathered, at[full], axis=0, dtype=np.float64))
                np.add.at(grams, np.array(rows)[full], np.add.reduceat(inside.astype(np.int64), at[full]))
        z = (total + m.prior) / np.sqrt(np.maximum(grams, 1))[:, None]
        e = np.exp(z - z.max(axis=1, keepdims=True, initial=-np.inf))
        top = e.argmax(axis=1)
        names = pa.array([m.languages[k] for k in top], pa.string())
        return pa.StructArray.from_arrays([names, pa.array(1.0 / e.sum(axis=1))], ["lang", "score"])

    n = fresh(docs, "best")["best"]
    known: Column = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)) & F.lit(bool(model.languages))
    carried = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in (lang.lower(), score.lower())]
    out = docs.withColumn(n, best(F.col("text"))) if model.languages else docs.withColumn(
        n, F.lit(None).cast("struct<lang: string, score: double>"))
    return out.select(*carried, F.when(known, F.col(n)["lang"]).otherwise("und").alias(lang),
                      F.when(known, F.col(n)["score"]).otherwise(0.0).alias(score))
