"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

``fit`` learns the lexicon (word beginnings with their log-odds) and a calibration from
labelled documents; ``score`` applies them to every whole text.  Folding lowers case,
undoes look-alike letters and digit substitutions and turns everything that is not a
letter into blanks.  A match starts at a word and counts once, with its heaviest entry;
matches inside an exception phrase do not count.  The sum of weights is normalised by
the text's length and mapped to a probability.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meritflow.llm.common import fresh, remainder, small, small_batches, tidy, written

# Letters that look like Latin ones, and digits or signs written for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "з": "e", "і": "i", "ї": "i", "к": "k", "м": "m", "н": "h", "о": "o",
    "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ј": "j", "ԁ": "d", "ո": "n", "ѵ": "v",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p",
    "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g", "ℓ": "l",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
#: Harmless phrases around words that the lexicon may hold.
EXCEPTIONS = ("idiot proof", "trash can", "trash bin", "class clown", "pond scum")

STEMS = (4, 5, 6, 7, 8)
#: Terms that a task counts before it passes the counts on.
COUNTED_TERMS = 50_000


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: dict[str, float]
    coefficients: tuple[float, ...]
    exceptions: tuple[str, ...] = field(default=EXCEPTIONS)


def _table() -> dict[int, str | None]:
    table: dict[int, str | None] = {i: " " for i in range(128) if not chr(i).isalpha()}
    table |= {ord(k): v for k, v in SUBSTITUTES.items()}
    table |= {ord(k): v for k, v in LOOKALIKES.items()}
    table |= {0xFF41 + i: chr(97 + i) for i in range(26)}
    table |= dict.fromkeys((0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF))
    return table


_FOLD = _table()
_FOLD_ASCII = {k: v for k, v in _FOLD.items() if k < 128}


def fold(text: str | None) -> str:
    """Folded text with a blank at either end."""
    if not text:
        return "  "
    low = text.lower()
    return f" {low.translate(_FOLD_ASCII if low.isascii() else _FOLD)} "


def _terms(text: str | None) -> set[str]:
    words = set(fold(text).split())
    return {w[:n] for w in words for n in STEMS if len(w) > n} | {w for w in words if 3 <= len(w) <= 20}


class Matcher:
    """The automaton of one model, built once in each Python worker."""

    def __init__(self, model: ToxicityModel):
        import ahocorasick
        self.automaton = ahocorasick.Automaton()
        for term, weight in model.lexicon.items():
            self.automaton.add_word(f" {term}", (len(term), weight))
        for phrase in model.exceptions:
            self.automaton.add_word(f" {fold(phrase).strip()} ", (len(fold(phrase).strip()), None))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.coefficients = np.array(model.coefficients)

    def features(self, text: str | None) -> tuple[float, ...]:
        folded = fold(text)
        hits: dict[int, float] = {}
        spans: list[tuple[int, int]] = []
        if len(self.automaton):
            for end, (length, weight) in self.automaton.iter(folded):
                if weight is None:
                    spans.append((end - length, end - 1))
                else:
                    start = end - length + 1
                    hits[start] = max(weight, hits.get(start, 0.0))
        if spans:
            # where an exception reaches up to, by where it begins: the furthest so far
            begins, reach = zip(*sorted(spans), strict=True)
            reach = list(accumulate(reach, max))
            covered = lambda s: (k := bisect_right(begins, s)) > 0 and reach[k - 1] >= s
            hits = {s: w for s, w in hits.items() if not covered(s)}
        total = sum(hits.values())
        length = max(1, len(folded)) / 6.0
        return 1.0, math.log1p(total), math.log1p(1000.0 * total / (length + 50.0)), max(hits.values(), default=0.0)

    def scores(self, texts: pd.Series) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        x = np.array([self.features(t) for t in texts])
        return 1.0 / (1.0 + np.exp(-np.clip(x @ self.coefficients, -30.0, 30.0)))


def _calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Logistic regression by Newton steps, slightly shrunk."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30.0, 30.0)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, max_fit_rows: int = 20_000, max_terms: int = 5_000,
        min_docs: int = 5, min_log_odds: float = 2.5, exceptions: tuple[str, ...] = EXCEPTIONS,
        holdout: int = 5) -> ToxicityModel:
    """Learn lexicon and calibration from the labelled rows outside the held-out fold.

    ``max_fit_rows`` bounds the labelled rows used (a hash sample of about that many);
    ``max_terms`` bounds the lexicon.  Rows with a null label or id teach nothing.  With no
    positive or no negative row the lexicon is empty and every score is the prior.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = (labels.select("doc_id", "toxic").where("doc_id is not null and toxic is not null")
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .where(remainder(F.col("doc_id"), holdout) != 0))
    n = known.count()
    share = min(1.0, max_fit_rows / n) if n else 0.0
    sampled = written(known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)), "labels")
    sample = docs.select("doc_id", "text").join(small(sampled, 4 * max_fit_rows), "doc_id")
    # ids that stand on many rows: a hash sample of the rows, so that what is calibrated on stays bounded
    held = sample.count()
    if held > 4 * max_fit_rows:
        sample = sample.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < int(4e6 * max_fit_rows / held))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bad, good = Counter(), Counter()

        def counted() -> pd.DataFrame:
            terms = [*bad, *(t for t in good if t not in bad)]
            return pd.DataFrame({"term": terms, "bad": [bad[t] for t in terms], "good": [good[t] for t in terms]})

        for b in batches:
            for text, toxic in zip(b["text"], b["toxic"], strict=True):
                (bad if toxic else good).update(_terms(text))
                if len(bad) + len(good) >= COUNTED_TERMS:
                    yield counted()
                    bad.clear()
                    good.clear()
        if bad or good:
            yield counted()
        tidy()

    rows = sample.select("text", "toxic").where("text is not null")
    sizes = {bool(r.toxic): r["count"] for r in sampled.groupBy((F.col("toxic") != 0).alias("toxic")).count().collect()}
    n_bad, n_good = sizes.get(True, 0), sizes.get(False, 0)
    if not n_bad or not n_good:
        prior = math.log((n_bad + 0.5) / (n_good + 0.5))
        return ToxicityModel({}, (prior, 0.0, 0.0, 0.0), exceptions)
    odds = (F.log((F.col("bad") + 0.5) / (n_bad + 1.0)) - F.log((F.col("good") + 0.5) / (n_good + 1.0)))
    found = (rows.mapInPandas(count, "term string, bad long, good long")
             .groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
             .where(F.col("bad") >= min_docs).withColumn("odds", odds).where(F.col("odds") >= min_log_odds)
             .orderBy(F.desc("odds"), F.desc("bad"), "term").limit(max_terms).collect())
    weights = {r.term: float(r.odds) for r in found}
    # a beginning that weighs about as much already stands for its longer forms
    lexicon = {t: w for t, w in weights.items()
               if not any(t[:k] in weights and weights[t[:k]] >= w - 1.0 for k in STEMS if k < len(t))}
    shared = spark.sparkContext.broadcast(ToxicityModel(lexicon, (0.0, 0.0, 0.0, 0.0), exceptions))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(shared.value)
        for b in batches:
            x = np.array([matcher.features(t) for t in b["text"]]).reshape(-1, 4)
            yield pd.DataFrame({"f1": x[:, 1], "f2": x[:, 2], "f3": x[:, 3], "toxic": b["toxic"].astype(float)})
        tidy()

    seen = rows.mapInPandas(measure, "f1 double, f2 double, f3 double, toxic double").toPandas()
    x = np.column_stack([np.ones(len(seen)), seen[["f1", "f2", "f3"]].to_numpy()])
    return ToxicityModel(lexicon, tuple(_calibrate(x, (seen["toxic"].to_numpy() != 0).astype(float))), exceptions)


def score(docs: DataFrame, model: ToxicityModel, column: str = "score") -> DataFrame:
    """``docs`` with a toxicity score from 0 to 1 for every row's whole text.

    Null and empty texts get the score of a text without matches.  Repeated rows score
    alike; every column of ``docs`` stays as it is.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cache: list[Matcher] = []

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if not cache:
            cache.append(Matcher(shared.value))
        for texts in batches:
            yield pd.Series(cache[0].scores(texts))
        tidy()

    return docs.withColumn(column, scored(F.col("text")))


def reject(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The rows whose score is below ``threshold``, with the columns of ``docs``."""
    name = fresh(docs, "score")["score"]
    return score(docs, model, name).where(F.col(name) < threshold).drop(name)
