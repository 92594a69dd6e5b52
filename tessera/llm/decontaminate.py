"""Benchmark decontamination by a broadcast hash set of normalised word windows.

Every item's windows of ten words go to a hash set that is broadcast in blocks of bounded size; each
document's word windows are looked up, hits are verified word by word, and the hit words or the
whole document can be removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, small_batches, table

WINDOW = 10
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Most bytes of items that are collected and broadcast at once; more items are scanned in more passes.
BLOCK_BYTES = 8 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(data: bytes) -> list[bytes]:
    """Words of UTF-8 text with A-Z lower-cased; bytes.lower() changes those letters only."""
    return WORDS.findall(data.lower())


class Windows:
    """The hash set of a block of items: words get numbers, windows 64-bit hashes, and an exact table verifies."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.numbers: dict[bytes, int] = {}
        self.exact: dict[int, dict[bytes, set[str]]] = {}
        for item, data in items:
            words = words_of(data)
            ids = np.array([self.numbers.setdefault(w, len(self.numbers)) for w in words], "int64")
            n = min(window, len(ids))
            if not n:
                continue
            at = self.exact.setdefault(n, {})
            for i in range(len(ids) - n + 1):
                at.setdefault(ids[i : i + n].tobytes(), set()).add(item)
        self.hashes = {n: np.unique(np.concatenate([_rolling(np.frombuffer(k, "int64"), n) for k in at])) for n, at in self.exact.items()}

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """A flag for each word that is inside an occurrence of a window, and the items with such windows."""
        hit = np.zeros(len(words), bool)
        items: set[str] = set()
        get = self.numbers.get
        ids = np.array([get(w, -1) for w in words], "int64") if words else np.zeros(0, "int64")
        unknown = np.concatenate([[0], np.cumsum(ids < 0)])
        for n, hashes in self.hashes.items():
            if len(ids) < n:
                continue
            starts = np.flatnonzero(unknown[n:] == unknown[:-n])
            if not len(starts):
                continue
            found = _rolling(ids, n)[starts]
            place = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
            for i in starts[hashes[place] == found].tolist():
                if (of := self.exact[n].get(ids[i : i + n].tobytes())) is not None:
                    hit[i : i + n] = True
                    items |= of
        return hit, items


def _rolling(ids: np.ndarray, n: int) -> np.ndarray:
    mixed = (ids.astype("uint64") + np.uint64(1)) * MULTIPLIER
    mixed ^= mixed >> np.uint64(29)
    out = np.zeros(len(ids) - n + 1, "uint64")
    for j in range(n):
        out = out * np.uint64(0x100000001B3) + mixed[j : j + len(out)]
    return out


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of about BLOCK_BYTES, one after another, so that the driver holds one at a time."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text")).where("item_id is not null and text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // BLOCK_BYTES)
    for i in range(n):
        block = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield [(r["item_id"], bytes(r["text"])) for r in block.collect()]


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, clean: bool = False) -> DataFrame:
    """``docs`` with n_words, hit_words (array of word positions), items (sorted ids as text) and, on
    request, clean_text: the text without its hit words, unchanged where nothing is hit.

    Null texts have no words; very long ones are scanned whole; an empty table stays empty. Items that
    are null or have no words match nothing. Items with equal texts are all reported, repeated rows each
    get the same result. Columns with the names of added ones are replaced.
    """
    spark = docs.sparkSession
    out = docs
    fields = {"n_words": T.LongType(), "hit_words": T.ArrayType(T.IntegerType()), "items": T.ArrayType(T.StringType())}
    for i, items in enumerate(_blocks(benchmark)):
        held = spark.sparkContext.broadcast(items)  # BLOCK_BYTES or so, kept in a file and not in the driver's memory
        cache: dict = {}

        def run(texts: list[bytes], held=held, cache=cache) -> dict:
            index = cache.get("w") or cache.setdefault("w", Windows(held.value, window))
            counts, hits, found = [], [], []
            for data in texts:
                words = words_of(data)
                hit, of = index.scan(words)
                counts.append(len(words))
                hits.append(np.flatnonzero(hit).astype("int32"))
                found.append(sorted(of))
            return {"n_words": counts, "hit_words": hits, "items": found}

        before = out if i else None
        if before is not None:
            out = out.withColumnsRenamed({"hit_words": "__hits", "items": "__items"})
        out = map_texts(out.withColumn("__bytes", F.col(text_col).cast("binary")), run, fields, "__bytes", keep=[c for c in out.columns])
        if before is not None:
            out = out.withColumns({"hit_words": F.array_distinct(F.concat("__hits", "hit_words")), "items": F.array_sort(F.array_distinct(F.concat("__items", "items")))}).drop("__hits", "__items")
    if out is docs:  # no items: the words are still counted
        count = lambda texts: {"n_words": [len(words_of(t)) for t in texts], "hit_words": [[] for _ in texts], "items": [[] for _ in texts]}
        out = map_texts(docs.withColumn("__bytes", F.col(text_col).cast("binary")), count, fields, "__bytes", keep=docs.columns)
    return out.withColumn("clean_text", without_words(F.col(text_col), F.col("hit_words"))) if clean else out


def without_words(text, hits):
    """Text without its words at the given positions; untouched texts stay as they are."""

    @F.pandas_udf(T.StringType())
    def cut(texts, positions):
        import pandas as pd

        def one(t, at):
            if t is None or at is None or not len(at):
                return t
            gone = set(int(x) for x in at)
            data = t.encode()
            out, last = [], 0
            for i, m in enumerate(WORDS.finditer(data.lower())):
                if i in gone:
                    out.append(data[last : m.start()])
                    last = m.end()
            return re.sub(r"[ \t]{2,}", " ", b"".join([*out, data[last:]]).decode("utf-8", "ignore")).strip()

        return pd.Series([one(t, a) for t, a in zip(texts, positions, strict=True)], dtype=object)

    return cut(text, hits)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    rows = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.size("hit_words").cast("long")
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold no benchmark window, with their columns, whatever their names.

    Null and empty texts hold none and stay; very long ones are scanned whole; an empty table stays empty."""
    small_batches(spark)
    packed = docs.select(F.struct("*").alias("__row"), F.col("text").alias("__t"))
    return scan(packed, table(spark, sf_dir, "benchmark"), "__t").where(F.size("hit_words") == 0).select("__row.*")
