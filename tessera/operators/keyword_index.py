"""An index for keyword search, kept beside the points: trigrams to words, and words to texts.

Query words hold no white space, so a text contains one if one of the text's own words does. A search goes
from the rarest trigram of each query word to the corpus words that have it, keeps those that contain the
query word, and reads these words' postings; no text is read. A block of queries that has too many such words
passes over the postings once and compares their words in its tasks. Texts are numbered in shards of bounded
size, in the order of ``pos``; a search brings the postings that it found together by shard, where the best
texts of each query are counted out.

Folders under ``root``, a segment for each build or update:

    seg-00000000/postings/bucket=*   key, full, shard, at (numbers of texts); bucket -1: shard, ids, pos
    seg-00000000/grams/bucket=*      gram, key
    seg-00000000/dead                shard, at: texts of earlier segments that this one replaces or deletes
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import scoring_words
from ..session import small_batches
from .retrieval import BASE, CAP, MAX_WINNERS, PER_MATCH, _by_blocks, _finder, top

#: Folders that words and trigrams are dealt to; a search reads those of its own.
BUCKETS = 64
#: A shard ends at so many characters of text or so many texts. It has a row for each of its distinct words, which
#: grow more slowly than the text, so fewer and larger shards have fewer rows.
SHARD_CHARS, SHARD_TEXTS = 32_000_000, 65_536
#: Longer corpus words are known by a hash and kept once a shard.
LONGEST = 64
#: Pairs of a query word and a corpus word with its rarest trigram up to this number are looked up and broadcast
#: to the postings; with more of them, or MAX_WORDS query words, tasks compare the postings' words themselves.
MAX_MATCHED, MAX_WORDS = 200_000, 1_000
#: Segments that are kept apart before ``compact`` is due.
MOST_SEGMENTS = 8

_SEGMENT = re.compile(r"seg-(\d{8})")
_KEYS = -1
_LISTS = "shard long, key string, full string, at array<int>, ids array<string>, pos array<long>"
_GRAMS, _DEAD, _MATCHED = "gram string, key string", "shard long, at array<int>", "word int, key string"
_HITS, _FOUND = "q int, shard long, at int, pos long, score double", "shard long, words array<int>, at array<int>"


def _bucket(c: str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


def grams(word: str) -> set[str]:
    return {word[i : i + 3] for i in range(len(word) - 2)}


class _Shard:
    def __init__(self) -> None:
        self.rows: list[tuple[int, str, np.ndarray]] = []
        self.number: dict[str, int] = {}
        self.chars = 0

    def add(self, pos: int, id_: str, text: str) -> None:
        number = self.number
        self.rows.append((pos, id_, np.array([number.setdefault(w, len(number)) for w in set(text.split()) if len(w) >= 3], "int32")))
        self.chars += len(text)

    @property
    def full(self) -> bool:
        return self.chars >= SHARD_CHARS or len(self.rows) >= SHARD_TEXTS

    def pack(self, shard: int, schema: pa.Schema) -> pa.RecordBatch:
        """A row for each word, after one with the ids of the texts."""
        self.rows.sort(key=lambda r: r[:2])
        found = [r[2] for r in self.rows]
        word = np.concatenate(found)
        at = np.repeat(np.arange(len(found), dtype="int32"), [len(some) for some in found])[np.argsort(word, kind="stable")]
        ends = np.concatenate([[0, 0], np.cumsum(np.bincount(word, minlength=len(self.number)))]).astype("int32")
        lists = pa.ListArray.from_arrays(pa.array(ends, mask=np.arange(len(ends)) == 0), pa.array(at))
        names, nothing = list(self.number), [None] * len(self.number)
        columns = [
            [shard] * (len(names) + 1), [None, *[w if len(w) <= LONGEST else _hashed(w) for w in names]], [None, *[w if len(w) > LONGEST else None for w in names]],
            lists, [[r[1] for r in self.rows], *nothing], [[r[0] for r in self.rows], *nothing],
        ]
        return pa.RecordBatch.from_arrays([c if c is lists else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _hashed(word: str) -> str:
    import hashlib

    return "\x00" + hashlib.blake2b(word.encode(), digest_size=16).hexdigest()


class KeywordIndex:
    """The index under ``root``. One writer at a time; a segment counts once its last folder is complete."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs

    def _files(self, path: str):
        at = self._hadoop.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def segments(self) -> list[str]:
        """Complete segments from the last compacted one on, oldest first."""
        at, files = self._files(self.root)
        if not files.exists(at):
            return []
        names = sorted(f.getPath().getName() for f in files.listStatus(at) if _SEGMENT.fullmatch(f.getPath().getName()))
        held = [n for n in names if files.exists(self._hadoop.Path(f"{self.root}/{n}/dead/_SUCCESS"))]
        whole = [i for i, n in enumerate(held) if files.exists(self._hadoop.Path(f"{self.root}/{n}/whole/_SUCCESS"))]
        return held[whole[-1] :] if whole else held

    def _read(self, part: str, schema: str, segments: list[str] | None = None) -> DataFrame:
        held = self.segments() if segments is None else segments
        if not held:
            return self.spark.createDataFrame([], schema + (", bucket int" if part != "dead" else ""))
        rows = [self.spark.read.schema(schema + (", bucket int" if part != "dead" else "")).parquet(f"{self.root}/{n}/{part}") for n in held]
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return out

    def _add(self, texts: DataFrame, gone: DataFrame | None, whole: bool) -> None:
        held = self.segments()
        at, files = self._files(self.root)
        last = max([int(m[1]) for f in (files.listStatus(at) if files.exists(at) else []) if (m := _SEGMENT.fullmatch(f.getPath().getName()))], default=-1)
        segment = last + 1
        folder = f"{self.root}/seg-{segment:08d}"
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.spark.createDataFrame([], _LISTS).schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            shard, number = _Shard(), (segment << 44) + (TaskContext.get().partitionId() << 20)
            for b in batches:
                for pos, id_, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    shard.add(pos, id_, text)
                    if shard.full:
                        yield shard.pack(number, schema)
                        shard, number = _Shard(), number + 1
            if shard.rows:
                yield shard.pack(number, schema)

        low = texts.where("id is not null").select(F.col("pos").cast("long"), F.col("id").cast("string"), F.coalesce(F.lower("text"), F.lit("")))
        # Written before it is dealt out: a task that runs again might number its texts in another order.
        low.mapInArrow(run, _LISTS).write.mode("overwrite").parquet(f"{folder}/numbered")
        lists = self.spark.read.schema(_LISTS).parquet(f"{folder}/numbered").withColumn("bucket", F.when(F.col("key").isNull(), F.lit(_KEYS)).otherwise(_bucket("key")))
        # A frequent word has a row in each shard: the shard deals them out too.
        lists.repartition("bucket", F.pmod(F.col("shard"), F.lit(8))).sortWithinPartitions("bucket", "key").write.partitionBy("bucket").mode("overwrite").parquet(f"{folder}/postings")
        made = self.spark.read.schema(_LISTS + ", bucket int").parquet(f"{folder}/postings")
        words = made.where(F.col("bucket") >= 0).groupBy("key").agg(F.first("full", ignorenulls=True).alias("full")).withColumn("w", F.coalesce("full", "key"))
        split = F.array_distinct(F.filter(F.regexp_extract_all("w", F.lit("(?s)(?=(.{1,3}))."), 1), lambda g: F.length(g) == 3))
        rows = words.select("key", F.explode(split).alias("gram")).select("gram", "key", _bucket("gram").alias("bucket"))
        rows.repartition("bucket", "gram").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").mode("overwrite").parquet(f"{folder}/grams")
        if whole:
            self.spark.range(1).write.mode("overwrite").parquet(f"{folder}/whole")
        dead = self.spark.createDataFrame([], _DEAD)
        if held and not whole:
            ids = texts.select(F.col("id").cast("string").alias("id"))
            ids = (ids if gone is None else ids.unionByName(gone.select(F.col("id").cast("string").alias("id")))).where("id is not null").distinct()
            dead = self._keys(held).join(ids, "id", "left_semi").groupBy("shard").agg(F.collect_list("at").alias("at"))  # a shard's texts at most
        dead.write.mode("overwrite").parquet(f"{folder}/dead")
        for name in [f"seg-{segment:08d}/numbered", *(held if whole else [])]:
            at, files = self._files(f"{self.root}/{name}")
            files.delete(at, True)

    def _keys(self, segments: list[str] | None = None) -> DataFrame:
        """(shard, at, id, pos) of each text."""
        rows = self._read("postings", _LISTS, segments).where(F.col("bucket") == _KEYS)
        return rows.select("shard", F.posexplode(F.arrays_zip("ids", "pos")).alias("at", "x")).select("shard", "at", "x.ids", "x.pos").withColumnRenamed("ids", "id")

    def build(self, texts: DataFrame) -> KeywordIndex:
        """Indexes ``texts`` (id, text, pos) alone, in place of all that was there. Rows without an id are left
        out; null texts count as empty; ids are compared as strings and occur once."""
        self._add(texts, None, whole=True)
        return self

    def update(self, texts: DataFrame, gone: DataFrame | None = None) -> KeywordIndex:
        """Adds texts, which replace those of equal ids, and drops the ids of ``gone``. Only new texts are
        indexed; a search passes over the replaced ones. ``texts`` may be empty."""
        self._add(texts, gone, whole=False)
        return self

    def due(self) -> bool:
        """Whether there are so many segments that a build from the points is worth its cost."""
        return len(self.segments()) > MOST_SEGMENTS

    def words_matched(self, wanted: list[str]) -> DataFrame:
        """(word, key): for each of ``wanted`` (by number) the keys of corpus words that may contain it: those
        that do, and long ones that have its rarest trigram."""
        return self._having(*self._rarest(wanted))

    def _rarest(self, wanted: list[str]) -> tuple[DataFrame, list[tuple[int, str, str]], int]:
        """The trigrams' rows, (number, rarest trigram, word) of the wanted words that may be there, and the
        rows that these trigrams have, counted for each word."""
        held = self._read("grams", _GRAMS)
        own = {g for w in wanted for g in grams(w)}
        rows = self.spark.createDataFrame([(g,) for g in sorted(own)], "gram string")
        buckets = [r[0] for r in rows.select(_bucket("gram")).distinct().collect()]
        part = held.where(F.col("bucket").isin(buckets)) if len(buckets) < BUCKETS else held
        counts = part.join(F.broadcast(rows), "gram").groupBy("gram").count().collect()  # trigrams of a block's words
        number = {r["gram"]: r["count"] for r in counts}
        chosen, total = [], 0
        for i, w in enumerate(wanted):
            least = min(grams(w), key=lambda g: (number.get(g, 0), g))
            if number.get(least):
                chosen.append((i, least, w))
                total += number[least]
        return part, chosen, total

    def _having(self, part: DataFrame, chosen: list[tuple[int, str, str]], total: int) -> DataFrame:
        asked = self.spark.createDataFrame(chosen, "word int, gram string, wanted string")
        found = part.join(F.broadcast(asked), "gram").where(F.col("key").startswith("\x00") | F.contains("key", F.col("wanted")))
        return found.select("word", "key").distinct()

    def _looked_up(self, lists: DataFrame, wanted: list[str]) -> DataFrame | None:
        """(shard, words, at): the postings of corpus words that contain query words, by way of their trigrams;
        None where these have too many corpus words."""
        if len(wanted) > MAX_WORDS:
            return None
        part, chosen, total = self._rarest(wanted)
        if total > MAX_MATCHED:
            return None
        matched = self._having(part, chosen, total).withColumn("bucket", _bucket("key"))
        few = matched.collect()  # MAX_MATCHED at most
        lists = lists.where(F.col("bucket").isin(sorted({r["bucket"] for r in few})))
        matched = F.broadcast(self.spark.createDataFrame(few, matched.schema))
        names = F.broadcast(self.spark.createDataFrame(list(enumerate(wanted)), "word int, wanted string"))  # a block's words
        rows = lists.drop("bucket").join(matched.drop("bucket"), "key").join(names, "word").where(F.contains(F.coalesce("full", "key"), F.col("wanted")))
        return rows.select("shard", F.array("word").alias("words"), "at")

    def _compared(self, lists: DataFrame, wanted: list[str]) -> DataFrame:
        """(shard, words, at): the same by one pass over all postings, which moves and joins none before."""
        small_batches(self.spark)
        held = self.spark.sparkContext.broadcast(wanted)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder, last, at = _finder(held.value), None, ()
            for b in batches:
                found = []
                for w in b.column(0).to_pylist():
                    if w != last:  # a word's rows lie together
                        last, at = w, finder(w)
                    found.append(at)
                some = pa.array([i for i, x in enumerate(found) if x], pa.int64())
                words = pa.array([x for x in found if x], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(1).take(some), words, b.column(2).take(some)], names=["shard", "words", "at"])

        return lists.select(F.coalesce("full", "key"), "shard", "at").mapInArrow(run, _FOUND)

    def search(self, queries: DataFrame, k: int = 10, texts: DataFrame | None = None) -> DataFrame:
        """What ``retrieval.keyword_search`` finds among the indexed texts: (qid, id, score, source, pos, rank),
        and the winners' ``text`` where ``texts`` (id, text) are given."""
        if k < 0:
            raise ValueError("top_k must not be negative")
        kind = queries.schema["qid"].dataType
        found = _by_blocks(queries.select("qid", "query"), lambda block: self._search(block, kind, k))
        if texts is None:
            return found
        held = texts.select(F.col("id").cast("string").alias("__id"), "text")
        return held.join(F.broadcast(found) if k <= 20 else found, F.col("id") == F.col("__id")).select("qid", "id", "text", "score", "source", "pos", "rank")

    def _search(self, block: DataFrame, kind: T.DataType, k: int) -> DataFrame:
        asked = block.select("qid", scoring_words("query").alias("words")).where(F.size("words") > 0).collect()  # a block
        wanted = sorted({w for r in asked for w in r["words"]})
        number = {w: i for i, w in enumerate(wanted)}
        held = self.spark.sparkContext.broadcast([np.unique([number[w] for w in r["words"]], return_counts=True) for r in asked])
        empty = T.StructType([T.StructField("qid", kind), *self.spark.createDataFrame([], "id string, score double, source string, pos long, rank int").schema.fields])
        segments = self.segments()
        if not wanted or not segments or not k:
            return self.spark.createDataFrame([], empty)
        lists = self._read("postings", _LISTS, segments).where(F.col("bucket") >= 0)
        rows = self._looked_up(lists, wanted)
        rows = (self._compared(lists, wanted) if rows is None else rows).select("*", F.lit(None).cast("array<long>").alias("pos"))
        marked = lambda mark: F.array(F.lit(mark)).alias("words")
        dead = self._read("dead", _DEAD, segments).select("shard", marked(-1), "at", F.lit(None).cast("array<long>").alias("pos"))
        keys = self._read("postings", _LISTS, segments).where(F.col("bucket") == _KEYS).select("shard", marked(-2), F.lit(None).cast("array<int>").alias("at"), "pos")

        def best(group: pa.Table) -> pa.Table:
            shard, words, ats = group.column("shard")[0].as_py(), group.column("words").combine_chunks(), group.column("at").combine_chunks()
            word, row = words.flatten().to_numpy(), np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy()))
            order = np.argsort(word, kind="stable")
            word, row = word[order], row[order]
            numbers, begins = ats.values.to_numpy(), ats.offsets.to_numpy().astype("int64")
            sizes, docs = np.diff(begins), {}
            for part in np.split(np.arange(len(word)), np.flatnonzero(np.diff(word)) + 1):  # a word's rows
                own = row[part]
                n = sizes[own]
                docs[int(word[part[0]])] = np.unique(numbers[np.repeat(begins[own] - np.cumsum(n) + n, n) + np.arange(n.sum())])
            pos = np.array(group.column("pos")[int(row[0])].as_py(), "int64")  # of the mark -2, the least
            docs.pop(-2)
            gone = docs.pop(-1, None)
            out: list[tuple[np.ndarray, ...]] = []
            for q, (words, times) in enumerate(held.value if docs else []):
                count = np.zeros(len(pos), "int32")
                for w, n in zip(words.tolist(), times.tolist(), strict=True):
                    if w in docs:
                        count[docs[w]] += n
                if gone is not None:
                    count[gone] = 0
                found = np.flatnonzero(count)
                if len(found) > k:  # of equal scores the first texts
                    found = found[np.argsort(-np.minimum(count[found], 6), kind="stable")[:k]]
                if len(found):
                    out.append((np.full(len(found), q, "int32"), found.astype("int32"), pos[found], np.minimum(BASE + PER_MATCH * count[found], CAP)))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, t) for t in ("int32", "int32", "int64", "float64")]
            return pa.table([columns[0], np.full(len(columns[0]), shard), *columns[1:]], names=["q", "shard", "at", "pos", "score"])

        hits = rows.unionByName(dead).unionByName(keys).groupBy("shard").applyInArrow(best, _HITS)
        ids = self.spark.createDataFrame([(i, r["qid"]) for i, r in enumerate(asked)], T.StructType([T.StructField("q", T.IntegerType()), T.StructField("qid", kind)]))
        winners = top(hits.join(F.broadcast(ids), "q").drop("q"), k)
        winners = F.broadcast(winners) if len(asked) * k <= MAX_WINNERS else winners
        return self._keys(segments).drop("pos").join(winners, ["shard", "at"]).select("qid", "id", "score", F.lit("keyword").alias("source"), "pos", "rank")
