"""A durable table of points: runs of changes, merged by size, with a coarse cell for each vector."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import POINT_FIELDS
from .keyword_index import KeywordIndex
from .points import changed_points, classify_by_sums, make_points
from .retrieval import as_hits, dense_search

#: So many runs of which each is no larger than all newer ones together become one.
MIN_RUNS = 4
#: Replaced runs stay for so many further upserts, as results that were not read yet may need them.
RETAIN = 2
#: Up to this number of ids are looked up by the runs' Bloom filters.
MAX_LOOKUP = 256
#: Vectors that cells are fitted on, and rounds of fitting.
CELL_SAMPLE, CELL_ROUNDS = 20_000, 8

_RUN = re.compile(r"v(\d+)(?:-(\d+))?")
_STORED = POINT_FIELDS + ", cell int"


def cell_of(centres: np.ndarray):
    """A column function that gives the nearest centre of a vector; -1 for vectors that have none."""

    @F.pandas_udf(T.IntegerType())
    def nearest(vectors: pd.Series) -> pd.Series:
        out = np.full(len(vectors), -1, "int32")
        fine = [i for i, v in enumerate(vectors) if v is not None and len(v) == centres.shape[1]]
        if fine:
            x = np.array([vectors.iloc[i] for i in fine], "float64")
            size = np.sqrt((x * x).sum(1))
            ok = np.isfinite(size) & (size > 0)
            out[np.array(fine)[ok]] = np.argmax((x[ok] / size[ok, None]) @ centres.T, axis=1)
        return pd.Series(out)

    return nearest


def fit_cells(vectors: np.ndarray, n: int, rounds: int = CELL_ROUNDS, seed: int = 0) -> np.ndarray:
    """Unit centres of at most ``n`` cells, by rounds of spherical k-means over a bounded sample."""
    x = vectors[np.isfinite(vectors).all(1)]
    size = np.sqrt((x * x).sum(1))
    x = x[size > 0] / size[size > 0, None]
    x = np.unique(x, axis=0)
    if len(x) <= n:
        return x
    centres = x[np.random.default_rng(seed).choice(len(x), n, replace=False)]
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norm = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-300), centres)
    return centres


class PointTable:
    """A table of points under ``root``, kept as runs: folders ``v<n>`` with the points that upsert n changed,
    and ``v<m>-<n>`` with what upserts m to n left.

    A run counts once it is complete, so the table is found again after a restart, and a run that broke off
    is written anew. An upsert reads ids and checksums, writes changed points alone, and writes nothing if
    none changed, so a batch that is delivered twice leaves the same table. The newest runs become one as
    soon as MIN_RUNS of them are each no larger than all newer ones together: a point is written again only
    when what it is merged with has doubled. One writer at a time.

    With cells (``fit``) the points of a run are laid out by the cell of their vector, and ``near`` reads
    the cells nearest to a query alone.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.counts: dict[str, int] = {}
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs

    # --- folders

    def _files(self, name: str = ""):
        at = self._hadoop.Path(f"{self.root}/{name}" if name else self.root)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _found(self) -> list[tuple[int, int, str, bool]]:
        """(first, last, name, complete) of all folders of runs."""
        at, files = self._files()
        if not files.exists(at):
            return []
        names = [f.getPath().getName() for f in files.listStatus(at) if f.isDirectory()]
        return sorted((int(m[1]), int(m[2] or m[1]), n, files.exists(self._hadoop.Path(f"{self.root}/{n}/_SUCCESS"))) for n in names if (m := _RUN.fullmatch(n)))

    def runs(self) -> list[tuple[int, int, str]]:
        """(first, last, name) of the runs that make up the table, oldest first."""
        whole = [r[:3] for r in self._found() if r[3]]
        return [r for r in whole if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in whole)]

    def bytes_of(self, name: str) -> int:
        at, files = self._files(name)
        return files.getContentSummary(at).getLength()

    @property
    def version(self) -> int:
        """Number of the last upsert that changed something; -1 without any."""
        return max((last for _, last, _ in self.runs()), default=-1)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _delete(self, name: str) -> None:
        at, files = self._files(name)
        files.delete(at, True)

    def _run(self, name: str) -> DataFrame:
        return self.spark.read.schema(_STORED).parquet(self.path(name))

    def _write(self, points: DataFrame, name: str, centres: np.ndarray | None) -> None:
        cell = cell_of(centres)(F.col("vector")) if centres is not None else F.lit(-1)
        rows = points.select("id", "vector", "payload", cell.alias("cell"))
        if centres is not None:
            rows = rows.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(16))).sortWithinPartitions("cell")  # a cell may hold a third of all points
        writer = rows.write.partitionBy("cell").mode("overwrite")
        writer.option("parquet.bloom.filter.enabled#id", "true").option("parquet.bloom.filter.adaptive.enabled", "true").parquet(self.path(name))

    # --- reading

    def _state(self, runs: list[tuple[int, int, str]], cells: list[int] | None = None) -> DataFrame:
        """(id, vector, payload, cell) that runs, in order, leave. Of each run those ids go that a newer one
        has; only ids are joined, and where the newer ids are few enough to be broadcast nothing is shuffled."""
        parts, newer = [], None
        for _, _, name in reversed(runs):
            rows = self._run(name)
            some = rows if cells is None else rows.where(F.col("cell").isin(cells))
            parts.append(some if newer is None else some.join(newer, "id", "left_anti"))
            newer = rows.select("id") if newer is None else newer.unionByName(rows.select("id"))
        return reduce(DataFrame.unionByName, reversed(parts)) if parts else self.spark.createDataFrame([], _STORED)

    def read(self) -> DataFrame:
        """The newest state (id, vector, payload) of each point."""
        return self._state(self.runs()).drop("cell")

    def sums(self, ids: list[str] | None = None) -> DataFrame:
        """(id, oid, sum) of the newest state of each point, or of the points of a few ids, which the Bloom
        filters of the files are asked for. Vectors and texts are not read."""
        held = None
        for _, last, name in self.runs():
            rows = self._run(name)
            if ids is not None:
                rows = rows.where(reduce(or_, [F.col("id") == i for i in ids])) if ids else rows.where("false")
            part = rows.select("id", F.struct(F.lit(last).alias("v"), F.coalesce("payload.original_id", "id").alias("oid"), F.col("payload.content_checksum").alias("sum")).alias("x"))
            held = part if held is None else held.unionByName(part)
        if held is None:
            return self.spark.createDataFrame([], "id string, oid string, sum string")
        return held.groupBy("id").agg(F.max("x").alias("x")).select("id", "x.oid", "x.sum")

    # --- writing

    def upsert(self, chunks: DataFrame, embed) -> bool:
        """Inserts and updates the points of chunks; whether anything changed. ``counts`` then has the chunks
        and how many were inserted, updated and skipped, counted while they are written."""
        new = make_points(chunks)
        few = self._few(new) if self.runs() else []
        classified, seen = classify_by_sums(new, self.sums(few if len(few) <= MAX_LOOKUP else None)), Observation()
        of = lambda action: F.count_if(F.col("action") == action)
        counted = classified.observe(seen, F.count(F.lit(1)).alias("total"), of("insert").alias("inserted"), of("update").alias("updated"), of("skip").alias("skipped"))
        name = f"v{self.version + 1}"
        self._write(changed_points(counted, embed), name, self.centres())
        self.counts = {k: int(v or 0) for k, v in seen.get.items()}
        if self._run(name).isEmpty():
            self._delete(name)
            return False
        self._index(name)
        self._merge_newest()
        self._vacuum()
        return True

    def _few(self, new: DataFrame) -> list[str]:
        """The distinct ids of ``new``, or some MAX_LOOKUP + 1 or more of them where there are so many; the
        first rows tell as a rule."""
        some = {r[0] for r in new.select("id").limit(4 * MAX_LOOKUP).collect()}
        return list(some) if len(some) > MAX_LOOKUP else [r[0] for r in new.select("id").distinct().limit(MAX_LOOKUP + 1).collect()]

    def _merge_newest(self) -> None:
        runs = self.runs()
        sizes = [self.bytes_of(n) for _, _, n in runs]
        at, total = len(runs) - 1, sizes[-1]
        while at > 0 and sizes[at - 1] <= total:
            at -= 1
            total += sizes[at]
        if len(runs) - at >= MIN_RUNS:
            self._merge(runs[at:])

    def _merge(self, runs: list[tuple[int, int, str]]) -> None:
        self._write(self._state(runs), f"v{runs[0][0]}-{runs[-1][1]}", self.centres())

    def compact(self) -> None:
        """Makes one run of all."""
        runs = self.runs()
        if len(runs) > 1:
            self._merge(runs)

    def _vacuum(self) -> None:
        """Deletes runs that were replaced RETAIN upserts ago or more, and what broke off before the last run."""
        found, kept, last = self._found(), {n for _, _, n in self.runs()}, self.version
        for first, end, name, complete in found:
            over = max((e for a, e, n, _ in found if n in kept and a <= first and end <= e), default=last)
            if name not in kept and last - over >= RETAIN or not complete and end < last:
                self._delete(name)

    # --- words

    def keywords(self) -> KeywordIndex:
        """The index of the points' texts, without segments before ``index_keywords``."""
        return KeywordIndex(self.spark, self.path("keywords"))

    def index_keywords(self) -> PointTable:
        """Indexes the texts of all points; from then on an upsert adds the points that it changed."""
        self.keywords().build(as_hits(self.read()))
        self._indexed_upto(self.version)
        return self

    def _indexed_upto(self, version: int) -> None:
        self.spark.range(1).select(F.lit(version).alias("version")).write.mode("overwrite").parquet(self.path("keywords/upto"))

    def _index(self, name: str) -> None:
        """Adds a new run to the index. All is indexed anew where there are many segments, or where an
        earlier upsert broke off before its points were indexed."""
        index = self.keywords()
        if not index.segments():
            return
        at, files = self._files("keywords/upto/_SUCCESS")
        behind = not files.exists(at) or self.spark.read.schema("version int").parquet(self.path("keywords/upto")).first()[0] != self.version - 1
        if behind or index.due():
            self.index_keywords()
        else:
            index.update(as_hits(self._run(name)))
            self._indexed_upto(self.version)

    def find(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """Hits of ``keyword_search`` (qid, id, score, source, pos, rank) for queries (qid, query), from the index."""
        if not self.keywords().segments():
            raise ValueError("the table has no index of its texts")
        return self.keywords().search(queries, k)

    # --- cells

    def centres(self) -> np.ndarray | None:
        """The centres of the cells; none before ``fit``."""
        at, files = self._files("cells/_SUCCESS")
        if not files.exists(at):
            return None
        rows = self.spark.read.schema("cell int, centre array<double>").parquet(self.path("cells")).orderBy("cell").collect()
        return np.array([r["centre"] for r in rows])

    def fit(self, cells: int = 256, sample: int = CELL_SAMPLE) -> PointTable:
        """Fits at most ``cells`` cells on a sample of ``sample`` vectors (those of the smallest id hashes)
        and lays out the whole table by them; later upserts keep to them. Each point lies in one cell."""
        found = self.read().where("vector is not null and size(vector) > 0").orderBy(F.xxhash64("id"), "id").select("vector").limit(sample).collect()
        size = len(found[0]["vector"]) if found else 0
        vectors = np.array([r["vector"] for r in found if len(r["vector"]) == size and None not in r["vector"]], "float64").reshape(-1, max(size, 1))
        centres, runs = fit_cells(vectors, cells), self.runs()
        self._delete("cells")  # until the end all points are searched
        if runs:
            first, last = runs[0][0], runs[-1][1]
            taken = first == last or runs[0][2] == f"v{first}-{last}"
            self._write(self._state(runs), f"v{first}-{last + taken}", centres)  # beside the runs that it replaces
        held = self.spark.createDataFrame(list(enumerate(centres.tolist())), "cell int, centre array<double>")
        held.coalesce(1).write.mode("overwrite").parquet(self.path("cells"))
        return self

    def near(self, queries: DataFrame, k: int = 10, probes: int | None = 8) -> DataFrame:
        """Hits of ``dense_search`` (qid, id, text, score, source, pos, rank) for queries (qid, vector) among
        the points of the ``probes`` cells that are nearest to each query; other cells' folders are not read.
        None, or a table without cells, searches all points. Cosines are exact."""
        centres = self.centres()
        if probes is None or centres is None or not len(centres):
            return dense_search(as_hits(self.read()), queries, k)
        asked = queries.select("qid", "vector", _nearest_cells(centres, probes)(F.col("vector")).alias("cells"))
        wanted = sorted(r[0] for r in asked.select(F.explode("cells")).distinct().collect())  # cells at most
        return dense_search(as_hits(self._state(self.runs(), wanted)), asked, k)

    def recall(self, queries: DataFrame, k: int = 10, probes: int | None = 8) -> float:
        """The share of the exact k nearest of the queries that a search of ``probes`` cells finds."""
        exact, found = self.near(queries, k, None).select("qid", "id"), self.near(queries, k, probes).select("qid", "id", F.lit(1.0).alias("hit"))
        return exact.join(found, ["qid", "id"], "left").agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0.0))), F.lit(1.0))).first()[0]


def _nearest_cells(centres: np.ndarray, probes: int):
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def order(vectors: pd.Series) -> pd.Series:
        out = []
        for v in vectors:
            fine = v is not None and len(v) == centres.shape[1] and np.isfinite(np.asarray(v, "float64")).all()
            out.append(np.argsort(-(centres @ np.asarray(v, "float64")), kind="stable")[:probes].tolist() if fine else [])
        return pd.Series(out)

    return order
