"""Batched retrieval: every operator takes queries as rows and returns hits (qid, id, text, score,
source, pos, rank). Ties go to the smaller ``pos``, the corpus order.

Keyword and dense search go through the corpus once for a block of queries: a task keeps the k best
rows of each query and emits no others, the best of all tasks are ranked, and only the winners' texts
are fetched. ``qid`` may have any type, a struct too.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import blank_to_null, first_truthy, process_query, scoring_words
from ..session import small_batches

#: Queries that one pass over the corpus answers; larger batches are cut into blocks of about this size.
MAX_QUERIES = 10_000
#: Words of corpus texts whose matches a task remembers.
WORD_CACHE = 200_000
#: Winners up to this many rows (and MAX_QUERIES * k in all) are broadcast to fetch their texts.
MAX_WINNERS = 200_000
#: Rows times queries whose matches are counted at once.
MATCH_CELLS = 4_000_000
BASE, PER_MATCH, CAP, BOOST = 0.3, 0.1, 0.9, 0.05
# Names that a requested source stands for.
SOURCE_ALIASES = {"constitutional": ("constitutional", "corpus"), "supreme": ("supreme",), "administrative": ("administrative",)}


def _blocks(queries: DataFrame) -> list[DataFrame]:
    """The query batch in blocks of MAX_QUERIES rows or so, each small enough to be broadcast."""
    n = max(1, -(-queries.count() // MAX_QUERIES))
    return [queries.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == i) for i in range(n)] if n > 1 else [queries]


def _by_blocks(queries: DataFrame, search) -> DataFrame:
    return reduce(DataFrame.unionByName, [search(block) for block in _blocks(queries)])


def top(hits: DataFrame, k: int, order: list[Column] | None = None) -> DataFrame:
    if k < 0:
        raise ValueError("top_k must not be negative")
    order = order or [F.desc("score"), F.asc("pos")]
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("rank") <= k)


def match_count(words, text) -> Column:
    return F.size(F.filter(words, lambda w: F.contains(text, w)))


class _Best:
    """The k best (score, pos) rows of each of n queries that a task has seen."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.pos = np.full((n, k), -np.inf), np.full((n, k), np.iinfo("int64").max)
        self.id = np.full((n, k), None, object)

    def add(self, query: int, score: np.ndarray, pos: np.ndarray, ids: np.ndarray) -> None:
        """Rows of one query; more than k of them are cut first."""
        score, pos, ids = np.concatenate([self.score[query], score]), np.concatenate([self.pos[query], pos]), np.concatenate([self.id[query], ids])
        order = np.lexsort((pos, -score))[: self.k]
        self.score[query], self.pos[query], self.id[query] = score[order], pos[order], ids[order]

    def rows(self, id_type: pa.DataType) -> pa.RecordBatch:
        query, place = np.nonzero(self.score > -np.inf)
        return pa.RecordBatch.from_arrays(
            [pa.array(query.astype("int32")), pa.array(self.id[query, place].tolist(), id_type), pa.array(self.pos[query, place]), pa.array(self.score[query, place])],
            names=["q", "id", "pos", "score"],
        )


def _ranked(corpus: DataFrame, rows: DataFrame, asked: list[Row], qid_type: T.DataType, k: int, source: str) -> DataFrame:
    """The best of the tasks' candidates (q, id, pos, score) with their queries' ids and texts."""
    spark = corpus.sparkSession
    ids = spark.createDataFrame([(i, r["qid"]) for i, r in enumerate(asked)], T.StructType([T.StructField("q", T.IntegerType()), T.StructField("qid", qid_type)]))
    best = top(rows.withColumnRenamed("q", "__q").join(F.broadcast(ids), F.col("__q") == F.col("q")).drop("q", "__q"), k)
    texts = corpus.select(F.col("id").alias("__id"), F.col("pos").alias("__pos"), "text")
    winners = F.broadcast(best) if len(asked) * k <= MAX_WINNERS else best
    found = texts.join(winners, (F.col("id") == F.col("__id")) & (F.col("pos") == F.col("__pos")))
    return found.select("qid", "id", "text", "score", F.lit(source).alias("source"), "pos", "rank")


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def keyword_search(corpus: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``corpus`` (id, text, pos) against ``queries`` (qid, query): 0.3 + 0.1 for each word (of three
    characters or more, repeats count) that the text contains, 0.9 at most.

    A query word holds no white space, so a text contains it if one of the text's own words does. Each
    distinct text word is matched against the block's words once a task; a text's score for all queries
    is a sum over the words that it matches. Null texts match nothing.
    """
    if k < 0:
        raise ValueError("top_k must not be negative")
    small_batches(corpus.sparkSession)
    qid_type, id_type = queries.schema["qid"].dataType, _arrow_type(corpus, "id")
    schema = T.StructType([T.StructField("q", T.IntegerType()), T.StructField("id", corpus.schema["id"].dataType), T.StructField("pos", T.LongType()), T.StructField("score", T.DoubleType())])

    def search(block: DataFrame) -> DataFrame:
        asked = block.select("qid", scoring_words("query").alias("words")).where(F.size("words") > 0).collect()  # a block
        number: dict[str, int] = {}
        postings: list[list[int]] = []  # of each word the queries that have it, once for each time
        for i, r in enumerate(asked):
            for w in r["words"]:
                if w not in number:
                    number[w] = len(postings)
                    postings.append([])
                postings[number[w]].append(i)
        held = corpus.sparkSession.sparkContext.broadcast((list(number), [np.array(p, "int64") for p in postings], len(asked)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, lists, n = held.value
            cache: dict[str, tuple[int, ...]] = {}
            finder = _finder(words)
            best = _Best(n, k)
            for b in batches:
                pos, ids = b.column(1).to_numpy(), np.array([*b.column(0).to_pylist(), None], object)[:-1]
                order = np.argsort(pos, kind="stable")  # equal scores stay in the order of pos
                pos, ids = pos[order], ids[order]
                texts = b.column(2).take(pa.array(order)).to_pylist()
                step = max(1, MATCH_CELLS // max(n, 1))  # rows that are scored together
                for lo in range(0, len(texts), step):
                    some = texts[lo : lo + step]
                    matches = np.zeros((len(some), n), "int16")
                    for i, text in enumerate(some):
                        found: set[int] = set()
                        for w in set((text or "").split()):
                            at = cache.get(w)
                            if at is None:
                                if len(cache) >= WORD_CACHE:
                                    cache.clear()
                                at = cache[w] = finder(w)
                            if at:
                                found.update(at)
                        if found:
                            matches[i] = np.bincount(np.concatenate([lists[j] for j in found]), minlength=n)
                    capped = np.ascontiguousarray(np.minimum(matches, 6).T.astype("int8"))  # beyond six the score is the cap
                    for q in np.flatnonzero(capped.any(axis=1)):
                        at = np.flatnonzero(capped[q])
                        if len(at) > k:  # of equal scores the first rows
                            at = at[np.argsort(-capped[q, at], kind="stable")[:k]]
                        best.add(q, np.minimum(BASE + PER_MATCH * matches[at, q], CAP), pos[lo + at], ids[lo + at])
            yield best.rows(id_type)

        held_rows = corpus.where("id is not null")  # a row without an id can't be a hit
        rows = held_rows.select("id", F.col("pos").cast("long").alias("pos"), F.lower("text").alias("low")).mapInArrow(run, schema)
        return _ranked(corpus, rows, asked, qid_type, k, "keyword")

    return _by_blocks(queries.select("qid", "query"), search)


def _finder(words: list[str]):
    """A function that gives the numbers of those of ``words`` that a text contains."""
    try:
        import ahocorasick
    except ImportError:
        return lambda text: tuple(i for i, w in enumerate(words) if w in text)
    automaton = ahocorasick.Automaton()
    for i, w in enumerate(words):
        automaton.add_word(w, i)
    if not words:
        return lambda text: ()
    automaton.make_automaton()
    return lambda text: tuple({i for _, i in automaton.iter(text)})


def cosine(a, b) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def dense_search(points: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``points`` (id, text, pos, vector) against ``queries`` (qid, vector): exact cosine top-k.

    A matrix product finds the points that may be among a query's best; their cosines are computed
    plainly, so that equal vectors get equal scores. Vectors that are null, zero, of another length than
    the query's, or that hold null or non-finite components take no part. Where queries have ``cells`` and
    points a ``cell``, a query meets the points of its cells, and those of cell -1, alone.
    """
    if k < 0:
        raise ValueError("top_k must not be negative")
    small_batches(points.sparkSession)
    by_cell = "cells" in queries.columns and "cell" in points.columns
    qid_type, id_type = queries.schema["qid"].dataType, _arrow_type(points, "id")
    schema = T.StructType([T.StructField("q", T.IntegerType()), T.StructField("id", points.schema["id"].dataType), T.StructField("pos", T.LongType()), T.StructField("score", T.DoubleType())])
    fine = lambda v: F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    vector = F.col("vector").cast("array<double>")
    cell = F.col("cell") if by_cell else F.lit(-1)
    # Tasks pass over vectors that take no part: a filter here would compute a vector again for each of its tests.
    usable = points.where("id is not null").select("id", F.col("pos").cast("long").alias("pos"), vector.alias("v"), cell.alias("cell"))

    def search(block: DataFrame) -> DataFrame:
        asked = block.select("qid", vector.alias("v"), *(["cells"] if by_cell else [])).where(F.col("v").isNotNull() & fine(F.col("v"))).collect()  # a block
        by_size: dict[int, list[int]] = {}
        for i, r in enumerate(asked):
            by_size.setdefault(len(r["v"]), []).append(i)
        matrices = {d: (np.array(at), np.array([asked[i]["v"] for i in at])) for d, at in by_size.items()}
        visitors: dict[int, set[int]] = {}
        for i, r in enumerate(asked if by_cell else []):
            for c in r["cells"]:
                visitors.setdefault(c, set()).add(i)
        held = points.sparkSession.sparkContext.broadcast((matrices, len(asked), {c: np.array(sorted(v)) for c, v in visitors.items()}))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matrices, n, visitors = held.value
            unit = {d: (at, x, np.sqrt((x.T * x.T).sum(0))) for d, (at, x) in matrices.items()}
            best = _Best(n, k)
            for b in batches:
                pos, ids = b.column(1).to_numpy(), np.array([*b.column(0).to_pylist(), None], object)[:-1]
                vectors, cells = b.column(2), b.column(3).to_numpy()
                sizes = np.where(vectors.is_valid().to_numpy(zero_copy_only=False), np.diff(vectors.offsets.to_numpy()), -1)
                for c, (d, whole) in product(np.unique(cells).tolist(), unit.items()):
                    own = np.flatnonzero((sizes == d) & (cells == c))
                    of = np.isin(whole[0], visitors.get(c, ())) if by_cell and c != -1 else np.ones(len(whole[0]), bool)
                    if not len(own) or not of.any():
                        continue
                    at, x, norm = (part[of] for part in whole)
                    y = vectors.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                    usable = np.isfinite(y).all(axis=1) & y.any(axis=1)
                    own, y = own[usable], y[usable]
                    if not len(own):
                        continue
                    yy = np.ascontiguousarray((y * y).T).sum(0)
                    rough = (x / norm[:, None]) @ (y / np.sqrt(yy)[:, None]).T
                    least = np.partition(rough, -k, axis=1)[:, -k] if 0 < k < rough.shape[1] else np.full(len(x), -np.inf)
                    least = np.maximum(least, best.score[at].min(axis=1, initial=np.inf)) - 1e-9
                    for j, q in enumerate(at):
                        some = np.flatnonzero(rough[j] >= least[j])
                        if len(some) and k:
                            dot = np.ascontiguousarray((y[some] * x[j]).T).sum(0)
                            best.add(q, dot / np.sqrt(yy[some] * (x[j] * x[j])[:, None].sum(0)), pos[own[some]], ids[own[some]])
            yield best.rows(id_type)

        return _ranked(points, usable.mapInArrow(run, schema), asked, qid_type, k, "dense")

    return _by_blocks(queries.select("qid", "vector", *(["cells"] if by_cell else [])), search)


def as_hits(points: DataFrame, pos: Column | None = None) -> DataFrame:
    """Stored points (id, vector, payload) as rows to search: the payload's original id (the point's own
    where it has none), its text ('' where it has none), and ``pos``, the order that breaks ties: that of
    document and chunk unless given."""
    payload = points.schema["payload"].dataType.names
    if pos is None:
        known = {"document_id", "chunk_index"} <= set(payload)
        pos = F.coalesce(F.col("payload.document_id") * 1_000_000 + F.col("payload.chunk_index"), F.xxhash64("id")) if known else F.xxhash64("id")
    original = F.nullif(F.col("payload.original_id"), F.lit("")) if "original_id" in payload else F.lit(None).cast("string")
    kept = [c for c in ("cell",) if c in points.columns]
    return points.select(F.coalesce(original, F.col("id")).alias("id"), F.coalesce("payload.text", F.lit("")).alias("text"), pos.cast("long").alias("pos"), "vector", "payload", *kept)


def fuse(dense: DataFrame, keyword: DataFrame, k: int = 10) -> DataFrame:
    """Both lists, dense first; an id keeps its strictly higher score and its first place."""
    both = dense.withColumn("list", F.lit(0)).unionByName(keyword.withColumn("list", F.lit(1)))
    slot = F.struct("list", "rank")
    w = Window.partitionBy("qid", "id")
    best = both.withColumns({"slot": F.min(slot).over(w), "nth": F.row_number().over(w.orderBy(F.desc("score"), slot))}).where("nth = 1")
    return top(best.drop("rank", "nth", "list"), k, [F.desc("score"), F.asc("slot")]).drop("slot")


def rerank(hits: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Adds 0.05 for each raw query word in the text; the order before breaks ties."""
    words = queries.select("qid", scoring_words("query").alias("words"))
    rows = hits.join(words, "qid").withColumnRenamed("rank", "before")
    rows = rows.withColumn("score", F.col("score") + F.lit(BOOST) * match_count(F.col("words"), F.lower("text"))).drop("words")
    return top(rows, k, [F.desc("score"), F.asc("before")]).drop("before")


def cross_encoder_rerank(hits: DataFrame, queries: DataFrame, predict, k: int = 5) -> DataFrame:
    """Scores by ``predict(list of (query, text))``; a query whose model call fails keeps its order.

    The pairs of a batch go to the model together; if that fails, each query's pairs on their own, so a
    failure stays with its query.
    """
    rows = hits.join(queries.select("qid", "query"), "qid").withColumnRenamed("rank", "before")

    def scores(pairs: list[tuple[str, str]]) -> list[float] | None:
        try:
            made = [float(x) for x in predict(pairs)]
        except Exception:  # noqa: BLE001 - any failure of a model means the order before
            return None
        return made if len(made) == len(pairs) else None

    @F.pandas_udf(T.DoubleType())
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, t in batches:
            pairs = list(zip(q, t, strict=True))
            whole = scores(pairs)
            if whole is None:
                whole, groups = [None] * len(pairs), {}
                for i, (query, _) in enumerate(pairs):
                    groups.setdefault(query, []).append(i)
                for at in groups.values():
                    for i, value in zip(at, scores([pairs[i] for i in at]) or [None] * len(at), strict=True):
                        whole[i] = value
            yield pd.Series(whole, dtype="float64")

    rows = rows.withColumn("new", scored("query", "text"))
    failed = F.max(F.col("new").isNull()).over(Window.partitionBy("qid"))
    rows = rows.withColumn("failed", failed).withColumn("score", F.when(F.col("failed"), F.col("score")).otherwise(F.col("new")))
    order = [F.when(F.col("failed"), F.lit(0.0)).otherwise(-F.col("score")), F.asc("before")]
    return top(rows, k, order).drop("before", "new", "failed", "query")


def hybrid_search(points: DataFrame, queries: DataFrame, k: int = 5, rerank_results: bool = False) -> DataFrame:
    """``queries`` (qid, query, vector): dense and keyword top-k, fused, on request reranked. The
    keyword side asks for the processed query's distinct words."""
    asked = queries.withColumn("p", process_query("query"))
    dense = dense_search(points, asked.select("qid", "vector"), k)
    words = asked.select("qid", F.array_join("p.keywords", " ").alias("query"))
    found = fuse(dense, keyword_search(points, words, k), k)
    return rerank(found, queries, k) if rerank_results else found


def source_tags(source, court) -> Column:
    """Lower-cased source and court with the kind of court that either names."""
    none = F.array().cast("array<string>")
    source, court = F.lower(blank_to_null(source)), F.lower(blank_to_null(court))
    has = lambda *names: F.coalesce(sum((F.contains(court, F.lit(n)).cast("int") for n in names), F.lit(0)) > 0, F.lit(False))
    kind = F.when(has("ústavní", "ustavni"), "constitutional").when(has("nejvyšší správní", "nejvyssi spravni"), "administrative").when(has("nejvyšší", "nejvyssi"), "supreme")
    one = lambda c: F.when(c.isNotNull(), F.array(c)).otherwise(none)
    constitutional = F.when(F.coalesce(source == "corpus", F.lit(False)), F.array(F.lit("constitutional"))).otherwise(none)
    return F.array_distinct(F.concat(one(source), constitutional, one(court), one(kind)))


def matches_sources(tags, requested) -> Column:
    """True without a request, else whether a requested name or what it stands for is among the tags."""
    wanted = F.array_distinct(F.filter(F.transform(requested, lambda r: F.lower(blank_to_null(r))), lambda r: r.isNotNull()))

    def any_of(name: Column) -> Column:
        names = F.array(name)
        for alias, found in SOURCE_ALIASES.items():
            names = F.when(name == alias, F.array(*map(F.lit, found))).otherwise(names)
        return F.arrays_overlap(tags, names)

    return F.when(F.coalesce(F.size(wanted), F.lit(0)) <= 0, F.lit(True)).otherwise(F.exists(wanted, any_of))


def raw_limit(k: int, filtered: bool, overfetch: int = 5) -> int:
    return max(k, overfetch * k) if filtered else k


def filtered_retrieve(hits: DataFrame, tags: Column, requested: Column, k: int, order: str = "rank") -> DataFrame:
    """Filters hits that were fetched up to the raw limit, then cuts to k; fewer than k may stay."""
    kept = hits.where(matches_sources(tags, requested)).withColumnRenamed(order, "before")
    return top(kept, k, [F.asc("before")]).drop("before")


def retrieved_rows(hits: DataFrame, payload: str = "payload") -> DataFrame:
    """Hits as answer rows: reference, date and index come from the first field that has them."""
    have = set(hits.schema[payload].dataType.names)
    p = lambda *names: [F.col(f"{payload}.{n}").cast("string") for n in names if n in have] or [F.lit(None).cast("string")]
    reference = blank_to_null(first_truthy(*p("case_reference", "reference", "sp_zn")))
    index = F.expr(f"try_cast({payload}.chunk_index AS INT)") if "chunk_index" in have else F.lit(None).cast("int")
    return hits.select(
        *[c for c in ("qid", "rank") if c in hits.columns], F.col("id").alias("chunk_id"), "text", "score", blank_to_null(p("source")[0]).alias("source"), reference.alias("reference"), reference.alias("case_reference"),
        blank_to_null(p("court_name")[0]).alias("court_name"), blank_to_null(first_truthy(*p("decision_date", "date"))).alias("date"), p("document_id")[0].alias("document_id"), index.alias("chunk_index"),
    )
