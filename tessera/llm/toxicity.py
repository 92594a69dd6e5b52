"""Toxicity severity by a cumulative-link (proportional odds) ordinal regression.

Sparse features of a text (its words and their beginnings) share one weight vector across the
ordered thresholds; the output is the expected severity grade. The labels only say toxic or not;
toxic training rows are graded 1 to 3 by how many indicative words they hold, in thirds. Those words
are among the model's features too, so the grades above 0 are the model's own scale and not a
judgement of its own; the labels alone decide between grade 0 and the others.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import labelled_sample, map_texts, small_batches, table

WORDS = re.compile(r"[^\W\d_]+")
GRADES = 4
PER_CLASS = 3000
MAX_CHARS = 40_000
FEATURES = 4000
#: A document is rejected from this probability of a grade above 0 on.
REJECT = 0.4
CACHE = 150_000


def word_features(word: str) -> tuple[str, ...]:
    """A word itself and its first four and five characters."""
    return (word, *(f"{word[:n]}*" for n in (4, 5) if len(word) > n))


def _count(text: str) -> Counter:
    found: Counter = Counter()
    for word, n in Counter(WORDS.findall(text.lower())).items():
        for f in word_features(word):
            found[f] += n
    return found


def fit(rows: list[tuple[str, int]], steps: int = 300) -> dict:
    """The model of (text, toxic) rows; without both labels it finds nothing toxic."""
    empty = {"weights": {}, "cuts": [30.0 + k for k in range(GRADES - 1)]}
    n1 = sum(y for _, y in rows)
    n0 = len(rows) - n1
    if not n1 or not n0:
        return empty
    counts = [_count(t) for t, _ in rows]
    y = np.array([y for _, y in rows])
    df = [Counter(), Counter()]
    for c, label in zip(counts, y, strict=True):
        df[label].update(c.keys())
    odds = {}
    for f, a in df[1].items():
        b = df[0][f]
        share = n1 / (n1 + n0)
        gain = math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))
        z = (a - share * (a + b)) / math.sqrt((a + b) * share * (1 - share))
        if gain > 2.0 and z > min(5, 0.3 * math.sqrt(n1)):
            odds[f] = z
    names = sorted(odds, key=lambda f: (-odds[f], f))[:FEATURES]
    if not names:
        return empty
    index = {f: i for i, f in enumerate(names)}
    row, col, val, hits = [], [], [], np.zeros(len(rows))
    for i, c in enumerate(counts):
        for f, n in c.items():
            if (j := index.get(f)) is not None:
                row.append(i)
                col.append(j)
                val.append(math.log1p(n))
                hits[i] += n
    row, col, val = np.array(row), np.array(col), np.array(val)
    grade = np.zeros(len(rows), int)
    toxic = y == 1
    edges = np.quantile(hits[toxic], [1 / 3, 2 / 3])
    grade[toxic] = 1 + np.searchsorted(edges, hits[toxic], side="left")

    k, n = GRADES - 1, len(rows)
    w, base, gaps = np.zeros(len(names)), 1.0, np.full(k - 1, 0.5)
    theta = np.concatenate([w, [base], gaps])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    above = (grade[:, None] > np.arange(k)[None, :]).astype(float)
    for step in range(1, steps + 1):
        w, base, gaps = theta[: len(names)], theta[len(names)], theta[len(names) + 1 :]
        cuts = base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        eta = np.bincount(row, weights=w[col] * val, minlength=n)
        cum = np.hstack([np.ones((n, 1)), sig(eta[:, None] - cuts), np.zeros((n, 1))])  # P(y >= 0..K)
        p = np.maximum(cum[np.arange(n), grade] - cum[np.arange(n), grade + 1], 1e-9)
        d = cum * (1 - cum)
        high, low = d[np.arange(n), grade] / p, d[np.arange(n), grade + 1] / p
        g_eta = -(high - low) / n
        g_cut = np.zeros(k)
        np.add.at(g_cut, grade[grade > 0] - 1, high[grade > 0] / n)
        np.add.at(g_cut, grade[grade < k], -low[grade < k] / n)
        gw = np.bincount(col, weights=g_eta[row] * val, minlength=len(names)) + 1e-5 * w
        tail = np.cumsum(g_cut[::-1])[::-1]
        grad = np.concatenate([gw, [g_cut.sum()], tail[1:] * np.exp(gaps)])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    w, base, gaps = theta[: len(names)], theta[len(names)], theta[len(names) + 1 :]
    cuts = base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
    return {"weights": {f: float(w[i]) for f, i in index.items()}, "cuts": [float(c) for c in cuts]}


class _Lookup(dict):
    """word -> its known features, None for most words; emptied when it holds CACHE words."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str):
        if len(self) > CACHE:
            self.clear()
        self[word] = found = tuple(f for f in word_features(word) if f in self.weights) or None
        return found


def severity(model: dict, lookup: _Lookup, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Expected severity (0 to GRADES - 1) and the probability of any grade above 0."""
    eta = np.zeros(len(texts))
    for i, text in enumerate(texts):
        hits = list(filter(None, map(lookup.__getitem__, WORDS.findall(text.lower()))))
        if hits:
            eta[i] = sum(model["weights"][f] * math.log1p(n) for f, n in Counter(f for h in hits for f in h).items())
    above = 1 / (1 + np.exp(-np.clip(eta[:, None] - np.array(model["cuts"]), -30, 30)))
    return above.sum(1), above[:, 0]


def learn(docs: DataFrame, labels: DataFrame, where=None, per_class: int = PER_CLASS) -> dict:
    return fit(labelled_sample(docs, labels, "toxic", per_class, MAX_CHARS, where))


def score(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``docs`` with ``severity`` (expected grade, 0 to 3), ``p_toxic`` and ``rejected`` (p_toxic >= REJECT).

    Null and empty texts have no features and get the score of such a text; columns of these names
    are replaced; equal texts get equal scores; an empty table stays empty. All words of very long texts count.
    """
    cache: dict = {}

    def run(texts: list[str]) -> dict:
        lookup = cache.setdefault("l", _Lookup(model["weights"]))
        expected, p = severity(model, lookup, texts)
        return {"severity": expected, "p_toxic": p, "rejected": p >= REJECT}

    return map_texts(docs, run, {"severity": T.DoubleType(), "p_toxic": T.DoubleType(), "rejected": T.BooleanType()}, text_col)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows whose crc32(doc_id as text) mod 4 is not 2; scores all documents."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = learn(docs, table(spark, sf_dir, "labels"), where=~held)
    rows = docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "text")
    return score(rows, model).drop("text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the model does not reject, with their columns, whatever their names.

    Null and empty texts have no toxic words and stay; very long ones are judged whole; an empty table stays
    empty; all documents stay where no labels tell the classes apart."""
    small_batches(spark)
    model = learn(docs, table(spark, sf_dir, "labels"))
    packed = docs.select(F.struct("*").alias("__row"), F.col("text").alias("__t"))
    return score(packed, model, "__t").where(~F.col("rejected")).select("__row.*")
