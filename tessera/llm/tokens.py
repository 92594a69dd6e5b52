"""Token ids in Parquet: list columns with dictionary encoding, small row groups and page indexes.

Texts are dealt by ranges of doc_id, encoded and written in ascending order, so a reader can select
documents by the row groups' and pages' doc_id bounds and read single columns.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, small_batches, table

END_ID = 2
VOCABULARY = "word_bpe_49k.json"
CACHE = 450_000
GROUP_CHARS = 2_000_000
#: Bytes of input files for each range of doc_ids, about.
PART_BYTES = 256 << 20
MOST_PARTS = 1_000_000
#: Row groups and pages are small enough for selective reads; Spark's writer adds page indexes by itself.
LAYOUT = {
    "parquet.block.size": str(16 << 20), "parquet.page.size": str(256 << 10), "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(1 << 20), "parquet.writer.version": "PARQUET_2_0",
}
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("local_start", T.LongType()),
    T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
])


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes texts word by word with a cache, or plainly where the tokenizer is of another kind.

    A tokenizer of lower-cased words with word ends splits at white space before it merges and drops it, so a text's ids are those of
    its space-separated pieces, one after another. New pieces are encoded together, with a special
    token between them that marks where each ends. The first CACHE pieces are kept; later ones are
    encoded for the texts at hand only, which bounds memory.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = self.specials[0] if self.specials else None
        self.mark_id = self.tokenizer.token_to_id(self.mark) if self.mark else -1
        self.by_words = _by_words(json.loads(self.tokenizer.to_str()))
        self.end_id = end_id
        self.number: dict[str, int] = {}
        self.flat, self.lengths = np.array([end_id], "int32"), np.array([1], "int64")

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces and the number of ids of each."""
        plain = self.mark is not None and not any(s in p for s in self.specials for p in pieces)
        if not plain:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
            return np.array([i for f in found for i in f], "int32"), np.array([len(f) for f in found], "int64")
        groups = [self.mark.join([*pieces[i : i + 500], ""]) for i in range(0, len(pieces), 500)]
        ids = np.concatenate([np.array(e.ids, "int32") for g in range(0, len(groups), 20) for e in self.tokenizer.encode_batch_fast(groups[g : g + 20], add_special_tokens=False)])
        marks = np.flatnonzero(ids == self.mark_id)
        return ids[ids != self.mark_id], np.diff(np.concatenate([[-1], marks])) - 1

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by the end id, and the number of ids of each text."""
        out, counts, group, size = [], [], [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size > GROUP_CHARS:
                out.append(self._some(group))
                group, size = [], 0
        if group:
            out.append(self._some(group))
        if not out:
            return np.zeros(0, "int32"), np.zeros(0, "int64")
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])

    def _some(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_words:
            found = [[*e.ids, self.end_id] for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.array([i for f in found for i in f], "int32"), np.array([len(f) for f in found], "int64")
        pieces: list[str] = []
        ends = []
        for text in texts:
            pieces.extend(_pieces(text))
            ends.append(len(pieces))
        index = np.array(list(map(self.number.get, pieces, repeat(-1))), "int64")
        missing = np.flatnonzero(index < 0)
        flat, lengths = self.flat, self.lengths
        if len(missing):
            new = {p: i for i, p in enumerate(dict.fromkeys([pieces[i] for i in missing.tolist()]), len(lengths))}
            ids, n = self._encode_pieces(list(new))
            flat, lengths = np.concatenate([flat, ids]), np.concatenate([lengths, n])
            index[missing] = [new[pieces[i]] for i in missing.tolist()]
            if len(lengths) <= CACHE:
                self.number.update(new)
                self.flat, self.lengths = flat, lengths
        index = np.insert(index, ends, 0)  # the end id behind each text
        starts = np.cumsum(lengths) - lengths
        each = lengths[index]
        upto = np.cumsum(each)
        ids = flat[np.repeat(starts[index] - (upto - each), each) + np.arange(upto[-1])]
        last = upto[np.array(ends) + np.arange(len(ends))]
        return ids, np.diff(np.concatenate([[0], last]))


def _by_words(config: dict) -> bool:
    """Whether a tokenizer folds white space and case first and merges within words, so that a text's
    ids are those of its space-separated pieces."""
    folds = {json.dumps(n, sort_keys=True) for n in (config["normalizer"] or {}).get("normalizers", [])}
    spaces = json.dumps({"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, sort_keys=True)
    splits = (config["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    return spaces in folds and json.dumps({"type": "Lowercase"}) in folds and config["model"].get("end_of_word_suffix") == "</w>" and splits[0].get("behavior") == "Removed"


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    """The encoder of this Python worker, kept between tasks."""
    return _encoders.get((path, end_id)) or _encoders.setdefault((path, end_id), Encoder(path, end_id))


#: A comma or stop that ends a word of Latin letters (of those that lower-case to one letter): the
#: tokenizer splits it off, so a space before it changes nothing.
MARKS = re.compile("[.,](?<=[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f][.,])(?=[\x20\n]|\\Z)")


def _pieces(text: str) -> list[str]:
    """Space-separated pieces. A-Z are lower-cased, as the tokenizer does, so that fewer differ; not
    where special tokens could come of it, as those are told by their case."""
    if "<|" not in text:
        text = text.lower() if text.isascii() else text.encode().lower().decode()
    text = MARKS.sub(r" \g<0>", text.replace("\n", " ").replace("\t", " ").replace("\r", " "))
    return [p for p in text.split(" ") if p]


def write_ids(docs: DataFrame, scratch: Scratch, tag: str = "ids", vocabulary: str = VOCABULARY, end_id: int = END_ID, text_col: str = "text", keep: bool = False) -> DataFrame:
    """Writes ids in ascending doc_id order and returns the files' rows: doc_id, part (range of
    doc_ids, in order), local_start (ids before it in its part), n_tokens, ids.

    Null texts count as empty and give the end id alone; very long ones are encoded whole; null doc_ids
    come first; equal doc_ids are ordered by their texts; an empty table gives files without rows. ``keep``
    keeps all other columns but those with the names of added ones. There is a part for each PART_BYTES
    of input, spark.sql.shuffle.partitions at least.
    """
    spark = docs.sparkSession
    rest = [c for c in docs.columns if keep and c not in SCHEMA.names]
    rows = docs.select(*rest, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if size < 1 << 58:  # Spark gives a size near the largest number to inputs other than files
        n = max(n, min(-(-size // PART_BYTES), MOST_PARTS))
    rows = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("__t")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("__t"), "__t")
    path = vocabulary_path(vocabulary)
    schema = T.StructType([*rows.schema.fields[: len(rest)], *SCHEMA.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, counts = encoder(path, end_id).encode(batch.column(len(rest) + 1).to_pylist())
            ends = np.cumsum(counts)
            offsets = np.concatenate([[0], ends]).astype("int32")
            arrays = [
                *batch.columns[: len(rest) + 1], pa.array(np.full(len(counts), part, "int32")), pa.array(before + ends - counts),
                pa.array(counts), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)),
            ]
            before += int(ends[-1]) if len(ends) else 0
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return scratch.write(rows.mapInArrow(run, schema), tag, **{k.replace(".", "__"): v for k, v in LAYOUT.items()})


def with_starts(files: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """``rows`` (the files' own if none) with ``start``: the ids of all documents before.

    Sums per part are as many rows as there are parts, so the running sum over them is small.
    """
    from pyspark.sql import Window

    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("__n"))
    ahead = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__ahead"))
    # One row for each write partition, MOST_PARTS at most.
    return (files if rows is None else rows).join(F.broadcast(sums), "part").withColumn("start", F.col("__ahead") + F.col("local_start")).drop("__ahead")


def digests(files: DataFrame) -> DataFrame:
    """doc_id, part, local_start, n_tokens and ids_crc32 (of each row), from the ids that the files hold."""
    schema = T.StructType([*SCHEMA.fields[:4], T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(4)
            flat = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            ends = np.cumsum(np.diff(ids.offsets.to_numpy()))
            counts = np.diff(np.concatenate([[0], ends])).astype("int64")
            view = memoryview(np.ascontiguousarray(flat)).cast("B")
            crc = [zlib.crc32(view[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(counts, pa.int64()), pa.array(crc, pa.int64())], names=schema.names)

    return files.select(*SCHEMA.names).mapInArrow(run, schema)


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    scratch = Scratch(spark, "tokens")
    files = write_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), scratch)
    return with_starts(files, digests(files)).select("doc_id", "start", "n_tokens", "ids_crc32")


def token_table(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the columns of documents but the text, with start, n_tokens and ids.

    Columns that have the names of these three are replaced; all others are kept. Null and empty texts
    give the end id alone; very long ones are encoded whole; an empty table stays empty."""
    small_batches(spark)
    scratch = Scratch(spark, "tokens")
    clash = {c: f"__own_{c}" for c in ("part", "local_start") if c in docs.columns}  # names that the files use themselves
    rest = [c for c in docs.columns if c not in ("text", "start", "n_tokens", "ids")]
    files = write_ids(docs.select(*rest, "text").withColumnsRenamed(clash), scratch, keep=True)
    rows = with_starts(files).drop(*clash).withColumnsRenamed({v: k for k, v in clash.items()})
    return rows.select(*rest, "start", "n_tokens", "ids")
