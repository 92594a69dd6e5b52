"""Quality classifier by compression.

One zstandard dictionary is built from good and one from bad labelled text. A text is compressed
with either, block by block; the size difference, normalised, becomes a calibrated probability.
"""

from __future__ import annotations

import math

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import labelled_sample, map_texts, small_batches, table

BLOCK = 8192
DICTIONARY = 65536
#: Labelled rows of each class that are learned from at most; longer texts than MAX_CHARS are not picked.
PER_CLASS = 2400
MAX_CHARS = 40_000


def _blocks(text: str) -> list[bytes]:
    data = text.encode("utf-8", "replace")
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


def _dictionary(texts: list[str]) -> bytes:
    samples = [b for t in texts for b in _blocks(t) if len(b) >= 8]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their end serves as raw content
        return b"".join(samples)[-DICTIONARY:]


def _compressor(dictionary: bytes):
    if len(dictionary) < 8:
        return zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
    held = zstandard.ZstdCompressionDict(dictionary)
    held.precompute_compress(level=3)
    return zstandard.ZstdCompressor(level=3, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)


def _features(texts: list[str], good, bad) -> np.ndarray:
    """Rows of features, all from compressed sizes: the normalised difference, by the mean of the
    two sizes and by the raw size, and the compression ratio with its square."""
    out = np.zeros((len(texts), 5))
    for i, text in enumerate(texts):
        a = b = raw = 0
        for block in _blocks(text):
            a += len(good.compress(block))
            b += len(bad.compress(block))
            raw += len(block)
        if raw:
            ratio = math.log(min(a, b) / raw)
            by_raw = (b - a) / raw
            out[i] = ((b - a) / (a + b), by_raw, ratio, ratio * ratio, by_raw * min(1.0, raw / 1000))
    return out


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hessian, x.T @ (y - p) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(rows: list[tuple[str, int]]) -> dict:
    """The model of (text, label) rows: every second row goes to the dictionaries, the others calibrate.

    With one label only (or none) every score is the share of label 1, 0.5 without rows.
    """
    kept = [(t, y) for t, y in rows if t]
    classes = {y for _, y in kept}
    if len(classes) < 2 or min(sum(y == c for _, y in kept) for c in classes) < 2:
        return {"constant": float(np.mean([y for _, y in kept])) if kept else 0.5}
    of = {c: [t for t, y in kept if y == c] for c in (0, 1)}
    good, bad = (_dictionary(of[c][::2]) for c in (1, 0))
    held = [(t, c) for c in (0, 1) for t in of[c][1::2]]
    x = _features([t for t, _ in held], _compressor(good), _compressor(bad))
    mean, scale = x.mean(0), x.std(0) + 1e-9
    y = np.array([c for _, c in held], float)
    w = _fit_logistic(np.hstack([(x - mean) / scale, np.ones((len(x), 1))]), y)
    return {"good": good, "bad": bad, "mean": mean, "scale": scale, "w": w}


def score_texts(model: dict, texts: list[str]) -> np.ndarray:
    """Probability that a text is good; an empty text gets that of a text whose sizes do not differ."""
    if "constant" in model:
        return np.full(len(texts), model["constant"])
    if "live" not in model:
        model["live"] = _compressor(model["good"]), _compressor(model["bad"])
    x = (_features(texts, *model["live"]) - model["mean"]) / model["scale"]
    return 1 / (1 + np.exp(-np.clip(x @ model["w"][:-1] + model["w"][-1], -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, where=None, per_class: int = PER_CLASS) -> dict:
    return fit(labelled_sample(docs, labels, "quality", per_class, MAX_CHARS, where))


def score(docs: DataFrame, model: dict, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (score >= threshold).

    Null and empty texts get a score too; equal texts get equal scores; columns named score or
    predicted are replaced; an empty table stays empty. Very long texts are compressed whole.
    """
    cache: dict = {}

    def run(texts: list[str]) -> dict:
        live = cache.setdefault("m", dict(model))
        found = score_texts(live, texts)
        return {"score": found, "predicted": (found >= threshold).astype("int32")}

    return map_texts(docs, run, {"score": T.DoubleType(), "predicted": T.IntegerType()}, text_col)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = learn(docs, table(spark, sf_dir, "labels"), where=~held)
    rows = docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "text")
    return score(rows, model).select("doc_id", "held_out", "score", "predicted")
