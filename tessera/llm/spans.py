"""Substring deduplication by sliding sentence spans.

Every run of three consecutive sentences is hashed; the hashes are joined globally; sentences that
any repeated run covers are removed, except in the run's first place (smallest doc_id, then row and
position). A sentence ends at . ! ? or a line end; longer ones are also cut by the hashes of their
words, so that a passage is cut alike wherever it stands: any repeat of over 50 words, with the same
line ends, holds a complete run. A run of short sentences is hashed with those behind it and removed
with them. The end of a text, or all of a short one, is a run too, so that exact copies go whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, small_batches, table

RUN = 3
LEAST_WORDS = 10
WIDE = 8
WORDS = re.compile(r"\s*\S+\s*")
SENTENCES = re.compile(r"[^.!?\n]*(?:[.!?]+(?=\s|$)|\n+|[.!?]+|$)\s*")
#: Hot hashes: those with over this share of all repeated runs, 1 / HOT of them at most.
HOT = 1000


def sentences(text: str) -> list[str]:
    """The sentences of a text, with what separates them: joined they are the text.

    In each WIDE consecutive words of a longer one a cut is behind the last of those with the least
    hash. So none has more than WIDE words, and two copies of a passage are cut alike but for their edges.
    """
    pieces = [p for p in SENTENCES.findall(text) if p]
    spaced, low, of, ends = [], [], [], set()
    for i, piece in enumerate(pieces):
        found = WORDS.findall(piece) or [piece]
        spaced += found
        low += piece.lower().split() or [""]
        of += [i] * len(found)
        ends.add(len(spaced) - 1)
    if len(low) >= WIDE:
        hashes = np.fromiter(map(xxhash.xxh32_intdigest, low), "uint32", len(low))
        of = np.array(of)
        at = np.flatnonzero(of[: len(of) - WIDE + 1] == of[WIDE - 1 :])
        # a sentence of WIDE words or fewer stays whole
        at = at[np.bincount(of)[of[at]] > WIDE]
        windows = np.lib.stride_tricks.sliding_window_view(hashes, WIDE)[at]
        ends.update((at + WIDE - 1 - windows[:, ::-1].argmin(1)).tolist())
    cuts = sorted(ends)
    return ["".join(spaced[i + 1 : j + 1]) for i, j in zip([-1, *cuts], cuts, strict=False)]


def runs(sizes: list[int], run: int = RUN, least_words: int = LEAST_WORDS) -> list[tuple[int, int]]:
    """First and last sentence, end exclusive, of the runs of a text with so many words in its sentences.

    A run is ``run`` sentences, and as many more as it takes to have ``least_words``. Where the text ends
    before that there is one run for its end: as many of the last sentences as it takes, or the whole text.
    """
    n, ahead = len(sizes), [0, *accumulate(sizes)]
    out, j = [], 0
    for i in range(n):
        j = max(j, i + run)
        while j < n and ahead[j] - ahead[i] < least_words:
            j += 1
        if j > n or ahead[j] - ahead[i] < least_words:
            break
        out.append((i, j))
    last = next((i for i in range(max(n - run, 0), -1, -1) if ahead[n] - ahead[i] >= least_words), 0)
    if n and ahead[n] and (last, n) not in out[last : last + 1]:
        out.append((last, n))
    return out


def run_hashes(parts: list[str], run: int = RUN, least_words: int = LEAST_WORDS) -> list[int]:
    """A hash for each run of the sentences, in the order of ``runs``. Case and white space do not matter."""
    words = [p.lower().split() for p in parts]
    plain = [" ".join(w) for w in words]
    sizes = list(map(len, words))
    if 0 in sizes:  # sentences without words stand in a run but add nothing to it
        hashes = [xxhash.xxh3_64_intdigest(" ".join([p for p in plain[i:j] if p])) for i, j in runs(sizes, run, least_words)]
    else:
        hashes = [xxhash.xxh3_64_intdigest(" ".join(plain[i:j])) for i, j in runs(sizes, run, least_words)]
    return np.array(hashes, "uint64").astype("int64").tolist()


def dedup(docs: DataFrame, text_col: str = "text", run: int = RUN, least_words: int = LEAST_WORDS, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with the text cleaned and n_sentences, n_removed, removed (positions) added.

    Null and empty texts stay as they are and have no sentences; texts without words have no runs; very long
    ones are handled whole, in time that grows with their length; an empty table stays empty. Rows that repeat
    a doc_id keep one first place, in a fixed order of the rows. Texts without repeated runs come back unchanged.
    Columns with the names of added ones are replaced; those starting with two underscores are reserved.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "spans")
    added = ("n_sentences", "n_removed", "removed")
    docs = docs.select(*[c for c in docs.columns if c not in added])
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("__rid", T.LongType()), T.StructField("__n", T.IntegerType()), T.StructField("__runs", T.ArrayType(T.LongType()))])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n = TaskContext.get().partitionId() << 36
        for b in batches:
            cut = [sentences(t) if t else [] for t in b.column(at).to_pylist()]
            hashes = [run_hashes(parts, run, least_words) for parts in cut]
            arrays = [*b.columns, pa.array(np.arange(n, n + len(cut))), pa.array(list(map(len, cut)), pa.int32()), pa.array(hashes, pa.list_(pa.int64()))]
            n += len(cut)
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    rows = scratch.write(docs.mapInArrow(hashed, schema), "rows")
    # within a document a run's first place is enough for the global first; later places are known to repeat
    spans = rows.select(F.col("doc_id").cast("long").alias("d"), F.col("__rid").alias("r"), F.posexplode("__runs").alias("p", "h"))
    place = F.struct(F.coalesce("d", F.lit((1 << 63) - 1)).alias("d"), F.col("r").alias("r"), F.col("p").alias("p"))
    repeated = scratch.write(spans.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1"), "repeated")
    total = repeated.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(repeated.where(F.col("n") > max(1, total // HOT)))  # fewer than HOT rows, as their counts sum to the total at most
    cold = repeated.where(F.col("n") <= max(1, total // HOT))
    marked = spans.join(hot.select("h", F.col("first").alias("hot_first")), "h", "left")
    later = lambda f: (F.col("r") != F.col(f"{f}.r")) | (F.col("p") != F.col(f"{f}.p"))
    gone = marked.where(F.col("hot_first").isNotNull() & later("hot_first")).select("r", "p")
    gone = gone.unionByName(marked.where(F.col("hot_first").isNull()).select("h", "r", "p").join(cold.select("h", "first"), "h").where(later("first")).select("r", "p"))
    gone = gone.groupBy("r").agg(F.collect_list("p").alias("__p"))  # positions of one document
    joined = rows.drop("__runs").join(gone, F.col("__rid") == F.col("r"), "left").drop("r", "__rid")
    out = T.StructType([*docs.schema.fields, T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", T.ArrayType(T.IntegerType()))])

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts, lost = [], [], []
            for t, n, starts in zip(*(b.column(i).to_pylist() for i in (at, b.num_columns - 2, b.num_columns - 1)), strict=True):
                drop = set()
                if starts:
                    parts = sentences(t)
                    places = runs([len(p.split()) for p in parts], run, least_words)
                    drop.update(*(range(*places[s]) for s in starts))
                    t = "".join([p for i, p in enumerate(parts) if i not in drop])
                texts.append(t)
                counts.append(n)
                lost.append(sorted(drop))
            arrays = [*b.columns[:-2], pa.array(counts, pa.int64()), pa.array([len(x) for x in lost], pa.int64()), pa.array(lost, pa.list_(pa.int32()))]
            arrays[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=out.names)

    return joined.mapInArrow(cleaned, out)


def op3_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_sentences", "n_removed", "removed", "text")
