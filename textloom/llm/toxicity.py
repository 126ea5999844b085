"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A document is the set of its distinct words (white-space separated, lower-cased, with word-edge marks); a feature is a
character n-gram of 3 to 6 characters and counts the distinct words that hold it, up to 1.  Each feature is scaled by
its log-count ratio between labels, and a logistic regression over the scaled features gives the score.  Only n-grams
whose log odds stand out from chance are kept, so the model is small enough to travel with the function.

The classifier is fitted on the driver from at most `max_rows` labelled documents (a bounded sample by hash of doc_id);
every document is scored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, lean

N_MIN, N_MAX = 3, 6
#: Labelled documents that are fitted at most, and characters of them that the driver takes at most.
MAX_ROWS, MAX_CHARS = 8_000, 30_000_000
FEATURES = 20_000


def held_out(doc_id):
    """Column: rows that are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def words_of(text: str) -> set[str]:
    return set(text.lower().split())


def grams_of(word: str) -> set[str]:
    w = f"\x02{word}\x03"
    return {w[i : i + n] for n in range(N_MIN, N_MAX + 1) for i in range(len(w) - n + 1)}


@dataclass
class Model:
    bias: float
    weights: dict[str, float]
    seen: dict[str, frozenset] = field(default_factory=dict, repr=False)

    def score(self, text: str) -> float:
        seen, weights = self.seen, self.weights
        held: set[str] = set()
        for w in words_of(text):
            g = seen.get(w)
            if g is None:
                if len(seen) > 150_000:
                    seen.clear()
                g = seen[w] = frozenset(x for x in grams_of(w) if x in weights)
            if g:
                held |= g
        z = self.bias + sum(weights[g] for g in sorted(held))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def fit(rows: Iterable[tuple[str, int]], alpha: float = 1.0, least: int = 3, z_least: float = 3.5, penalty: float = 0.02, rounds: int = 300) -> Model:
    """Train on (text, label) rows; without both labels the score is the share of label 1 (0 without rows)."""
    vocabulary: dict[str, int] = {}
    held: list[np.ndarray] = []
    labels: list[int] = []
    for text, y in rows:
        held.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)), np.int32))
        labels.append(y)
    n, n1 = len(labels), sum(labels)
    if not n1 or n1 == n:
        share = min(max(n1 / n if n else 0.0, 1e-4), 1 - 1e-4)
        return Model(math.log(share / (1 - share)), {})
    of = [np.bincount(np.concatenate([h for h, y in zip(held, labels, strict=True) if y == k]), minlength=len(vocabulary)) for k in (0, 1)]
    # n-grams that may stand out: those of words that several documents of label 1, or many at all, hold
    often = max(20, n // 500)
    near = (of[1] >= 2) | (of[0] >= often)
    index: dict[str, int] = {}
    for w, i in vocabulary.items():
        if near[i]:
            for g in grams_of(w):
                index.setdefault(g, len(index))
    count = np.zeros((2, len(index)))
    for w, i in vocabulary.items():
        at = [index[g] for g in grams_of(w) if g in index]
        count[0, at] += of[0][i]
        count[1, at] += of[1][i]
    q, p = count.sum(axis=1) + alpha * len(index)
    ratio = np.log((count[1] + alpha) / p) - np.log((count[0] + alpha) / q)
    z = np.abs(ratio) / np.sqrt(1 / (count[1] + alpha) + 1 / (count[0] + alpha))
    grams = list(index)
    good = [i for i in range(len(grams)) if count[0, i] + count[1, i] >= least and z[i] >= z_least]
    good = sorted(good, key=lambda i: (-round(z[i], 9), grams[i]))[:FEATURES]
    chosen, scale = [grams[i] for i in good], ratio[good]
    index = {g: i for i, g in enumerate(chosen)}
    by_word = {i: f for w, i in vocabulary.items() if (f := [index[g] for g in grams_of(w) if g in index])}
    cols, bounds = [], [0]
    for h in held:
        cols += sorted({f for w in h.tolist() for f in by_word.get(w, ())})
        bounds.append(len(cols))
    col, row = np.array(cols, np.int64), np.repeat(np.arange(n), np.diff(bounds))
    y = np.array(labels, float)
    value = scale[col] / max(1.0, math.sqrt(len(cols) / n))
    w, b, g2, gb2 = np.zeros(len(chosen)), math.log(n1 / (n - n1)), np.zeros(len(chosen)), 0.0
    for _ in range(rounds):  # adaptive gradient descent on the regularised mean loss
        z = b + np.bincount(row, weights=value * w[col], minlength=n)
        err = 1 / (1 + np.exp(-np.clip(z, -60, 60))) - y
        grad = np.bincount(col, weights=value * err[row], minlength=len(chosen)) / n + penalty / n * w
        g2 += grad**2
        gb2 += err.mean() ** 2
        w -= 0.5 * grad / np.sqrt(g2 + 1e-12)
        b -= 0.5 * err.mean() / math.sqrt(gb2 + 1e-12)
    per = scale / max(1.0, math.sqrt(len(cols) / n))
    return Model(float(b), {g: float(per[i] * w[i]) for g, i in index.items() if abs(per[i] * w[i]) > 1e-6})


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> Model:
    """Fit on labelled rows outside the held-out part; about max_rows documents and max_chars characters at most.

    The sample follows a hash of doc_id; documents over max_chars / 100 characters are not learnt from.
    Null labels, ids and repeated rows beyond the first are left out.
    """
    marked = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    base = id_text(docs)
    base = base.filter(~held_out(F.col("doc_id")) & (F.length("text") <= max_chars // 100))
    # Lengths alone are joined to find the share; then only the sample's texts move.
    n, chars = base.select("doc_id", F.length("text").alias("len")).join(marked, "doc_id").agg(F.count("*"), F.sum("len")).first()
    parts = 1_000_000
    share = min(1.0, max_rows / max(n, 1), max_chars / max(chars or 0, 1))
    if share < 1:
        base = base.filter(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < int(share * parts))
    rows = base.join(marked, "doc_id").select("text", "y")
    taken = sorted((text, int(y)) for text, y in rows.toLocalIterator())

    def drained() -> Iterator[tuple[str, int]]:  # texts go as soon as their words are taken
        while taken:
            yield taken.pop()

    return fit(drained())


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [model.score(t.as_py()) for t in batch.column(1)]
            ids = batch.column(0)
            out = [d is not None and zlib.crc32(str(d).encode()) % 4 == 2 for d in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.bool_()), pa.array(score, pa.float64())], ["doc_id", "held_out", "score"])

    return lean(run)


def scores(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs(doc_id, text).

    Null and empty texts get the score of a text without features.  Repeated rows are scored each; null doc_ids are
    not held out.  Extra columns are ignored.
    """
    found = id_text(docs).mapInArrow(_scored(Model(model.bias, model.weights)), "doc_id long, held_out boolean, score double")
    return found.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int"))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """docs without rows that score at least the threshold; columns unchanged, nothing is shuffled.

    Each row is judged by its own text: repeated rows and null doc_ids alike.
    """
    plain = Model(model.bias, model.weights)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([plain.score(t) for t in texts])

    return docs.filter(score(F.coalesce(docs["text"].cast("string"), F.lit(""))) < threshold)
