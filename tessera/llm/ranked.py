"""Ranked lexical search: MaxScore over the shards of an inverted index.

Each task cuts its documents into shards of bounded size and writes one row a shard: its terms and their
postings. Nothing is shuffled for that. A search reads the shards; a task keeps the best documents of each
query over all its shards, so that the score to beat rises, and walks the postings of a term only where the
bounds of the query's terms say that a document can still win.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, small_batches, table

#: A term: letters and digits of ASCII and all other characters; ASCII letters are in lower case.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 50
#: UTF-8 bytes of text in a shard (one document at least).
SHARD_BYTES = 32 << 20
#: Terms of all queries that go through the index together, about.
BLOCK_TERMS = 400_000
#: A row group, of which a reader holds one at a time, ends after a shard or a few small ones.
LAYOUT = {"parquet__block__size": str(8 << 20), "parquet__block__size__row__check__min": "1", "parquet__page__size__row__check__min": "1"}

INTS, LONGS = T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType())
#: doc_ids and lengths have an entry for each document, terms, ends (of its postings), most (highest tf) and
#: shortest (fewest terms of a document) for each term, docs (positions in doc_ids, ascending) and tfs for each posting.
SHARD = T.StructType([
    T.StructField("n_docs", T.LongType()), T.StructField("n_terms", T.LongType()),
    T.StructField("doc_ids", LONGS), T.StructField("lengths", INTS),
    T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("ends", INTS), T.StructField("most", INTS), T.StructField("shortest", INTS),
    T.StructField("docs", INTS), T.StructField("tfs", INTS),
])
HITS = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])


def words(text: str, find=re.compile(TERM).findall) -> list[str]:
    """The terms of a text in order."""
    return find(text.lower() if text.isascii() else text.encode().lower().decode())


class _Shard:
    """Postings of the documents added so far, documents without terms left out."""

    def __init__(self) -> None:
        self.number: defaultdict[str, int] = defaultdict(count().__next__)
        self.size = 0
        self.ids: list[np.ndarray] = []
        self.lengths: list[int] = []
        self.doc_ids: list[int | None] = []

    def add(self, doc_id: int | None, text: str) -> None:
        found = words(text)
        if found:
            self.size += len(text.encode())
            self.ids.append(np.fromiter(map(self.number.__getitem__, found), "int32", len(found)))
            self.lengths.append(len(found))
            self.doc_ids.append(doc_id)

    def pack(self) -> pa.RecordBatch:
        n, lengths = len(self.lengths), np.array(self.lengths, "int32")
        keys = np.concatenate(self.ids).astype("int64") * n + np.repeat(np.arange(n), lengths)
        keys.sort()
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        tfs = np.diff(first, append=len(keys)).astype("int32")
        term, docs = np.divmod(keys[first], n)
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        columns = [
            self.doc_ids, lengths, list(self.number), np.append(starts[1:], len(docs)), np.maximum.reduceat(tfs, starts),
            np.minimum.reduceat(lengths[docs], starts), docs, tfs,
        ]
        kinds = [pa.int64(), pa.int32(), pa.string(), *[pa.int32()] * 5]
        held = [pa.array(c, type=k) if isinstance(c, list) else pa.array(c.astype("int32")) for c, k in zip(columns, kinds, strict=True)]
        arrays = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in held]
        return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([len(keys)], pa.int64()), *arrays], names=SHARD.names)


def build_index(docs: DataFrame, scratch: Scratch, text_col: str = "text", tag: str = "index", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the shards of ``docs`` and returns their table.

    Null, empty and term-less texts are in no shard; very long ones are indexed whole and may make up a
    shard by themselves; repeated rows are documents of their own; null doc_ids stay null; an empty
    table gives no shards; columns other than doc_id and the text are left out, whatever their names.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for batch in batches:
            for doc_id, text in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                shard.add(doc_id, text)
                if shard.size >= shard_bytes:
                    yield shard.pack()
                    shard = _Shard()
        if shard.lengths:
            yield shard.pack()

    return scratch.write(source.mapInArrow(run, SHARD), tag, **LAYOUT)


def _held(batch: pa.RecordBatch, name: str, row: int) -> pa.Array:
    column = batch.column(batch.schema.get_field_index(name))
    a, b = column.offsets[row].as_py(), column.offsets[row + 1].as_py()
    return column.values.slice(a, b - a)


def frequencies(index: DataFrame, terms: list[str]) -> dict[str, int]:
    """The number of documents that hold each of a bounded list of terms; absent ones are left out."""
    wanted = index.sparkSession.sparkContext.broadcast(terms)
    schema = T.StructType([T.StructField("term", T.IntegerType()), T.StructField("df", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, total = pa.array(wanted.value, pa.string()), np.zeros(len(wanted.value), "int64")
        for batch in batches:
            for row in range(batch.num_rows):
                number = pc.index_in(_held(batch, "terms", row), asked)
                known = pc.is_valid(number).to_numpy(zero_copy_only=False)
                sizes = np.diff(_held(batch, "ends", row).to_numpy(), prepend=0)
                total[number.drop_null().to_numpy()] += sizes[known]
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype("int32")), pa.array(total[found])], names=schema.names)

    rows = index.select("terms", "ends").mapInArrow(run, schema).groupBy("term").agg(F.sum("df").alias("df")).collect()  # as many as terms
    return {terms[r["term"]]: r["df"] for r in rows}


class _Best:
    """The ``k`` best documents of a query so far: highest scores, then smallest ids, null ids last."""

    def __init__(self, k: int):
        self.k, self.floor = k, 1  # a score of 0 never counts
        self.score, self.doc, self.null = np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0, bool)

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        score, doc, null = np.append(self.score, score), np.append(self.doc, doc), np.append(self.null, null)
        best = np.lexsort((doc, null, -score))[: self.k]
        self.score, self.doc, self.null = score[best], doc[best], null[best]
        if len(best) == self.k:
            self.floor = max(self.floor, int(self.score[-1]))


def _part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds for each unit of its weight."""
    return 1_000_000_000 * tf.astype("int64") // (1000 * tf.astype("int64") + 20 * m)


def max_score(lists: list[tuple[int, int, np.ndarray, np.ndarray]], m: np.ndarray, floor: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a shard that score ``floor`` or more, among them its ``k`` best such, and their scores.

    ``lists`` has a bound, a weight, documents and frequencies for each term. The terms of the lowest bounds
    that together stay below the floor are non-essential: a document with none of the others can't reach
    it. The others' postings are added up; the non-essential ones, highest bound first, are probed for the
    documents alone whose sum and open bounds still reach the floor, which rises to the k-th best sum.
    """
    lists = sorted(lists, key=lambda x: x[0])
    open_bounds = np.cumsum([x[0] for x in lists])
    split = int(np.searchsorted(open_bounds, floor))
    total = np.zeros(len(m), "int64")
    for _, weight, docs, tfs in lists[split:]:
        total[docs] += weight * _part(tfs, m[docs])
    found = np.flatnonzero(total)
    for i in range(split - 1, -1, -1):
        if len(found) > k:
            floor = max(floor, int(np.partition(total[found], -k)[-k]))
        found = found[total[found] + open_bounds[i] >= floor]
        if not len(found):
            break
        _, weight, docs, tfs = lists[i]
        at = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
        hit = docs[at] == found
        total[found[hit]] += weight * _part(tfs[at[hit]], m[found[hit]])
    found = found[total[found] >= floor]
    return found, total[found]


def _search_block(index: DataFrame, queries: list[tuple[object, list[str]]], n: int, terms_in_all: int, k: int) -> DataFrame:
    """query (position in ``queries``), doc_id, score: the k best of each task for each query."""
    vocabulary = sorted({t for _, terms in queries for t in terms})
    df = frequencies(index, vocabulary)
    weights = {t: w for t, d in df.items() if (w := math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1)))) > 0}
    kept = sorted(weights)
    number = {t: i for i, t in enumerate(kept)}
    asked = [[number[t] for t in terms if t in number] for _, terms in queries]
    sent = index.sparkSession.sparkContext.broadcast((kept, [weights[t] for t in kept], asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weight, asked = sent.value
        known, best = pa.array(terms, pa.string()), [_Best(k) for _ in asked]
        for batch in batches:
            for row in range(batch.num_rows):
                place = pc.index_in(known, _held(batch, "terms", row)).to_numpy(zero_copy_only=False)
                place = np.where(np.isnan(place), -1, place).astype("int64") if place.dtype.kind == "f" else place
                ends, most, shortest, docs, tfs, lengths = (_held(batch, c, row).to_numpy() for c in ("ends", "most", "shortest", "docs", "tfs", "lengths"))
                starts = np.append(0, ends[:-1])
                ids = _held(batch, "doc_ids", row)
                null = pc.is_null(ids).to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy()
                norm = lambda size: 50 + 50 * size.astype("int64") * n // terms_in_all
                m = norm(lengths)
                bound = _part(most, norm(shortest))
                lists = {}
                for i in np.flatnonzero(place >= 0).tolist():
                    p = place[i]
                    lists[i] = (weight[i] * int(bound[p]), weight[i], docs[starts[p] : ends[p]], tfs[starts[p] : ends[p]])
                for kept_best, own in zip(best, asked, strict=True):
                    if mine := [lists[i] for i in own if i in lists]:
                        found, score = max_score(mine, m, kept_best.floor, k)
                        if len(found):
                            kept_best.add(score, ids[found], null[found])
        for q, b in enumerate(best):
            if len(b.score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.score), q, "int32")), pa.array(b.doc, mask=b.null), pa.array(b.score)], names=HITS.names)

    return index.drop("n_docs", "n_terms").mapInArrow(run, HITS)


def search(index: DataFrame, queries: DataFrame, id_col: str = "item_id", text_col: str = "text", k: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of each query with the highest scores above 0.

    Queries with one id count as one that has the terms of all their texts; a null id is an id as well.
    Null, empty and term-less texts, and queries that match nothing, give no rows, as do an empty index
    and an empty table of queries. Equal scores go by ascending doc_id, null ones last; documents of
    repeated rows each take a rank. Very long query texts count whole; a query's distinct terms must
    fit into memory. The queries go through the index in blocks of about ``block_terms`` terms.
    """
    spark = index.sparkSession
    stats = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("terms")).first()
    kind = queries.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("rank", T.IntegerType()), *HITS.fields[1:]])
    source = queries.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    asked = T.StructType([T.StructField("id", kind), T.StructField("term", T.StringType())])

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [list(dict.fromkeys(words(t))) for t in batch.column(1).to_pylist()]
            row = np.repeat(np.arange(len(own)), [len(o) for o in own])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array([t for o in own for t in o], pa.string())], names=asked.names)

    pairs = source.mapInArrow(terms, asked).distinct()
    total = pairs.count() if stats["n"] else 0
    blocks = -(-total // block_terms)
    found = None
    for b in range(blocks):
        block = pairs.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).groupBy("id").agg(F.array_sort(F.collect_list("term")).alias("terms"))
        held = [(r["id"], r["terms"]) for r in block.orderBy("id").collect()]  # block_terms terms, about
        if not held:
            continue
        hits = _search_block(index, held, stats["n"], stats["terms"], k)
        top = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = hits.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
        ids = spark.createDataFrame([(q, id_) for q, (id_, _) in enumerate(held)], T.StructType([T.StructField("query", T.IntegerType()), T.StructField(id_col, kind)]))
        part = ranked.join(F.broadcast(ids), "query").select(*schema.names)  # a block's ids
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found


def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    index = build_index(table(spark, sf_dir, "documents"), Scratch(spark, "ranked"))
    return search(index, table(spark, sf_dir, "benchmark"))
