"""Approximate nearest neighbours with a hierarchical k-means tree.

The upper levels are fitted on a bounded sample by the driver; below each of their leaves a task fits
the lower ones on a larger sample, by the same rule, so the leaves grow with the table up to FINE times
as many. Every vector is put into its leaf. A query walks the tree
best-bin-first through a priority queue; the number of leaves it opens is widened until calibration
queries, compared with brute force over all vectors, reach the wanted recall, and further for each
query until its leaves hold k other vectors. Leaves are compared in groups of about GROUP vectors, which
a query enters with the leaves that it opens there. Its nearest leaves come first; of the others only
vectors within the k-th distance found there are candidates. Groups with very many vectors or queries
are cut into tiles, so that a hot leaf is spread over tasks.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, small_batches, table

#: Vectors that the tree is fitted on at most, and their bytes.
SAMPLE, SAMPLE_BYTES = 20_000, 64 << 20
BRANCH = 8
LEAF_SAMPLE = 40
#: Leaves of the upper levels at most, and leaves that the lower ones make of each.
MAX_LEAVES, FINE = 1024, 64
CALIBRATION = 64
RECALL = 0.985
#: Vectors of the leaves that are compared together, about, and queries that meet them in one task.
GROUP, TILE = 4096, 2048
K = 10
#: The first leaves, which bound the others' candidates, hold so many times k vectors.
FIRST = 40
#: Components beyond this are cut for the tree alone, whose squares they would exceed; distances are exact.
MOST = 1e100


class Tree:
    """Nodes as arrays: centre, children (empty for a leaf), leaf number."""

    def __init__(self, x: np.ndarray, seed: int = 7, most: int = MAX_LEAVES):
        self.rng = np.random.default_rng(seed)
        self.centres, self.children, self.leaf = [x.mean(0) if len(x) else np.zeros(x.shape[1])], [[]], [-1]
        queue, n_leaves = [(-len(x), 0, np.arange(len(x)))], 1
        while queue:
            size, node, rows = heapq.heappop(queue)
            if -size < 2 * LEAF_SAMPLE or n_leaves + BRANCH > most:
                continue
            groups = self._split(x[rows])
            if len(groups) < 2:
                continue
            n_leaves += len(groups) - 1
            for centre, members in groups:
                self.centres.append(centre)
                self.children.append([])
                self.leaf.append(-1)
                self.children[node].append(len(self.centres) - 1)
                heapq.heappush(queue, (-len(members), len(self.centres) - 1, rows[members]))
        self.centres = np.array(self.centres)
        self._number()

    def _number(self) -> None:
        self.n_leaves = 0
        for i, kids in enumerate(self.children):
            self.leaf[i] = -1 if kids else self.n_leaves
            self.n_leaves += not kids

    def graft(self, below: dict[int, Tree]) -> None:
        """Puts trees in the place of leaves, by the leaves' numbers."""
        centres = [self.centres]
        for node, number in [(i, n) for i, n in enumerate(self.leaf) if n in below]:
            sub, base = below[number], len(self.children) - 1  # the other's root is this leaf
            self.children[node] = [base + c for c in sub.children[0]]
            centres.append(sub.centres[1:])
            for kids in sub.children[1:]:
                self.children.append([base + c for c in kids])
                self.leaf.append(-1)
        self.centres = np.concatenate(centres)
        self._number()

    def _split(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        centres = np.unique(x[self.rng.choice(len(x), min(BRANCH, len(x)), replace=False)], axis=0)
        for _ in range(12):
            of = ((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)).argmin(1)
            centres = np.array([x[of == j].mean(0) if (of == j).any() else centres[j] for j in range(len(centres))])
        return [(centres[j], np.flatnonzero(of == j)) for j in range(len(centres)) if (of == j).any()]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row: the nearest child at each level."""
        out = np.zeros(len(x), "int32")
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            kids = self.children[node]
            if not kids or not len(rows):
                out[rows] = self.leaf[node]
                continue
            c = self.centres[kids]
            of = ((c**2).sum(1) - 2 * x[rows] @ c.T).argmin(1)
            stack += [(kid, rows[of == j]) for j, kid in enumerate(kids)]
        return out

    def visit(self, q: np.ndarray, most: int, held: np.ndarray | None = None, need: int = 0) -> list[int]:
        """The first ``most`` leaves of a best-bin-first walk, always the nearest open bin next, and as
        many more as it takes to have ``need`` vectors, where leaf i holds ``held[i]``."""
        queue, out, have = [(0.0, 0)], [], 0
        while queue and (len(out) < most or have < need):
            _, node = heapq.heappop(queue)
            kids = self.children[node]
            if not kids:
                out.append(self.leaf[node])
                have += 0 if held is None else int(held[self.leaf[node]])
                continue
            for d, kid in zip(((self.centres[kids] - q) ** 2).sum(1).tolist(), kids, strict=True):
                heapq.heappush(queue, (d, kid))
        return out


def nearest(queries: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vector id, distance) of each query's k nearest of x, ties to the smaller id; of those that
    ``allowed`` (queries by vectors) marks, if given.

    A matrix product selects all rows that could be among them; their distances are computed plainly.
    Where squares would leave the range of a double, all distances are, on scaled components.
    """
    scale = max((float(np.abs(v).max(initial=0.0)) for v in (queries, x)), default=0.0)
    least = min((float(np.abs(v).max(axis=1).min(initial=np.inf)) for v in (queries, x) if len(v)), default=1.0)
    if scale > MOST or least < 1 / MOST:
        return _nearest_scaled(queries, q_ids, x, ids, k, allowed)
    rough = (queries**2).sum(1)[:, None] - 2 * queries @ x.T + (x**2).sum(1)[None, :]
    rough[q_ids[:, None] == ids[None, :]] = np.inf
    if allowed is not None:
        rough[~allowed] = np.inf
    out_q, out_v, out_d = [], [], []
    for i in range(len(queries)):
        row = rough[i]
        if len(row) > k:
            kth = np.partition(row, k - 1)[k - 1]
            picked = np.flatnonzero(row <= kth + 1e-9 * (1 + abs(kth) + (queries[i] ** 2).sum()))
        else:
            picked = np.arange(len(row))
        picked = picked[np.isfinite(row[picked])]
        d = np.sqrt(np.ascontiguousarray(((x[picked] - queries[i]) ** 2).T).sum(0))  # component by component, in order
        order = np.lexsort((ids[picked], d))[:k]
        out_q.append(np.full(len(order), q_ids[i]))
        out_v.append(ids[picked][order])
        out_d.append(d[order])
    if not out_q:
        return np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0)
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_d)


def _nearest_scaled(queries: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    out: list[list[np.ndarray]] = [[], [], []]
    for i, (q, own) in enumerate(zip(queries, q_ids, strict=True)):
        other = np.flatnonzero(ids != own if allowed is None else (ids != own) & allowed[i])
        with np.errstate(over="ignore"):
            gap = np.abs(x[other] / 2 - q / 2)  # halves, as a difference may exceed the range itself
            most = gap.max(axis=1, initial=0.0)
            d = 2 * most * np.sqrt(((gap / np.where(most > 0, most, 1.0)[:, None]) ** 2).sum(1))
        order = np.lexsort((ids[other], d))[:k]
        for kept, value in zip(out, (np.full(len(order), own), ids[other][order], d[order]), strict=True):
            kept.append(value)
    if not len(queries):
        return np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0)
    return np.concatenate(out[0]), np.concatenate(out[1]), np.concatenate(out[2])


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): rows with an id and a vector of finite components, not all zero."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & fine)


def search(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, recall: float = RECALL, scratch: Scratch | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with ``is_query`` (a column over ``id``) its k
    nearest other rows by Euclidean distance, ties to the smaller id; all others, if there are fewer.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows
    without an id or whose vector has another length than most (the shorter of two as common). Rows that
    repeat an id count once, with their smallest distance. An empty table gives no rows. Other columns
    are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "ann")
    rows = usable(vectors, id_col, vector_col)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    common = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    if common is None:
        return empty
    dim = common["dim"]
    rows = rows.where(F.size("v") == dim)
    bound = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
    sample = rows.orderBy(F.xxhash64("id", "v")).limit(bound).select("v").toArrow().column("v").combine_chunks()
    tree = Tree(_cut(_matrix(sample, dim)))
    _refine(rows, tree, common["n"], len(sample), dim)
    held = spark.sparkContext.broadcast(tree)  # FINE * bound / LEAF_SAMPLE leaves or so at most
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("leaf", T.IntegerType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), dim)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(held.value.assign(_cut(x)))], names=["id", "v", "leaf"])

    index = scratch.write(rows.mapInArrow(assign, schema), "index")
    leaves = index.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids")).collect()  # one row a leaf
    per_leaf = {r["leaf"]: r["n"] for r in leaves}
    sizes = np.zeros(tree.n_leaves, "int64")
    for r in leaves:
        sizes[r["leaf"]] = r["ids"]
    # an id in several leaves counts once among a query's neighbours, and its own row does not count
    again = int(sizes.sum()) - index.select("id").distinct().count()
    queries = index.where(is_query).select("id", "v")
    most = _calibrate(spark, index, queries, tree, dim, k, recall)

    counts = np.array([per_leaf.get(i, 0) for i in range(tree.n_leaves)])
    group_of = ((np.cumsum(counts) - counts) // GROUP).astype("int32")  # leaves in order, GROUP vectors or so together
    in_group = np.bincount(group_of, counts, minlength=int(group_of[-1]) + 1).astype("int64")
    visited = T.StructType([*schema.fields[:2], T.StructField("grp", T.IntegerType()), T.StructField("near", T.BooleanType()), T.StructField("leaves", T.ArrayType(T.IntegerType()))])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each query and group of leaves, once for its nearest leaves and once for the others."""
        for b in batches:
            row, group, near, leaves = [], [], [], []
            for i, q in enumerate(_cut(_matrix(b.column(1), dim))):
                found = np.array(held.value.visit(q, most, sizes, k + 1 + again), "int32")
                first = np.cumsum(sizes[found]) - sizes[found] < FIRST * k + again
                key = group_of[found] * 2 + first
                order = np.argsort(key, kind="stable")
                kinds, at = np.unique(key[order], return_index=True)
                row += [i] * len(kinds)
                group += (kinds // 2).tolist()
                near += (kinds % 2 == 1).tolist()
                leaves += np.split(found[order], at[1:])
            row = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(group, pa.int32()), pa.array(near, pa.bool_()), pa.array(leaves, pa.list_(pa.int32()))], names=visited.names)

    asked = scratch.write(queries.mapInArrow(walk, visited), "asked")
    salt = lambda n: F.pmod(F.xxhash64("id", "v"), F.col(n)).cast("int")
    grouped = F.broadcast(spark.createDataFrame(list(enumerate(group_of.tolist())), "leaf int, grp int"))  # one row a leaf
    keys = ["grp", "down", "across"]

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        x = np.array(b["v"].tolist())
        leaves, leaf = np.unique(b["leaf"].to_numpy(), return_inverse=True)
        parts = []
        for i in range(0, len(a), 256):
            some = a.iloc[i : i + 256]
            open_leaves = np.array([np.isin(leaves, own) for own in some["leaves"]])
            ids = some["id"].to_numpy()
            q, v, d = nearest(np.array(some["v"].tolist()), ids, x, b["id"].to_numpy(), k, open_leaves[:, leaf])
            order = np.argsort(ids, kind="stable")
            bound = some["bound"].to_numpy()[order][np.searchsorted(ids[order], q)]
            parts.append([c[d <= bound] for c in (q, v, d)])
        return pd.DataFrame({n: np.concatenate([p[j] for p in parts]) for j, n in enumerate(("query_id", "vec_id", "score"))})

    def compared(visits: DataFrame) -> DataFrame:
        """(query_id, vec_id, score): of each tile of a group of leaves at most k rows a query, within its bound."""
        asking = {r["grp"]: r["n"] for r in visits.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a group
        tiles = [(g, -(-int(in_group[g]) // (2 * GROUP)) or 1, -(-n // TILE)) for g, n in asking.items()]
        tiled = F.broadcast(spark.createDataFrame(tiles, "grp int, down int, across int"))  # one row a group
        left = visits.join(tiled, "grp").withColumn("across", salt("across")).withColumn("down", F.explode(F.sequence(F.lit(0), F.col("down") - 1)))
        right = index.join(grouped, "leaf").join(tiled, "grp").withColumn("down", salt("down")).withColumn("across", F.explode(F.sequence(F.lit(0), F.col("across") - 1)))
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "query_id long, vec_id long, score double")
        return found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))

    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    # The nearest leaves come first: none of the k nearest is farther than the k-th found there.
    near = scratch.write(compared(asked.where("near").drop("near").withColumn("bound", F.lit(float("inf")))).withColumn("rank", place).where(F.col("rank") <= k), "near")
    bounds = near.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
    others = asked.where("not near").drop("near").join(bounds, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    found = near.drop("rank").unionByName(compared(others)).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _cut(x: np.ndarray) -> np.ndarray:
    return np.clip(x, -MOST, MOST)


def _refine(rows: DataFrame, tree: Tree, n: int, sampled: int, dim: int) -> None:
    """Grows the tree below its leaves, from distinct vectors of a sample FINE times as large as the first
    (all, if there are fewer), SAMPLE of them or SAMPLE_BYTES below one leaf at most, those of the smallest
    hashes. A leaf that holds no more of them than leaves do stays as it is."""
    rate = min(1.0, FINE * sampled / max(n, 1))
    held = rows.sparkSession.sparkContext.broadcast(tree)
    picked = rows.where(F.pmod(F.xxhash64("v", "id"), F.lit(1 << 30)) < int(rate * (1 << 30)) + 1).select("v").distinct()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held.value.assign(_cut(_matrix(b.column(0), dim))))], names=["v", "leaf"])

    def grow(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        x = _cut(np.array(part["v"].tolist()))
        below = Tree(x[np.lexsort(x.T[::-1])], most=FINE) if len(x) >= 2 * LEAF_SAMPLE else None  # in a fixed order
        return pd.DataFrame([(key[0], pickle.dumps(below))] if below and below.n_leaves > 1 else [], columns=["leaf", "below"])

    placed = picked.mapInArrow(assign, "v array<double>, leaf int")
    first = F.row_number().over(Window.partitionBy("leaf").orderBy(F.xxhash64("v")))
    placed = placed.withColumn("nth", first).where(F.col("nth") <= max(2, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))).drop("nth")
    grown = placed.groupBy("leaf").applyInPandas(grow, "leaf int, below binary").collect()  # one row a leaf
    tree.graft({r["leaf"]: pickle.loads(bytes(r["below"])) for r in grown})
    held.unpersist()


def _calibrate(spark: SparkSession, index: DataFrame, queries: DataFrame, tree: Tree, dim: int, k: int, recall: float) -> int:
    """The least number of leaf visits at which CALIBRATION queries find ``recall`` of their true
    neighbours, which brute force over all vectors gives."""
    rows = queries.orderBy(F.xxhash64("id", "v")).limit(CALIBRATION).collect()
    if not rows:
        return 1
    ids, x = np.array([r["id"] for r in rows]), np.array([r["v"] for r in rows])

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mine = b.column(0).to_numpy()
            q, v, d = nearest(x, ids, _matrix(b.column(1), dim), mine, k)
            leaf = dict(zip(mine.tolist(), b.column(2).to_pylist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(d), pa.array([leaf[i] for i in v.tolist()], pa.int32())], names=["query_id", "vec_id", "score", "leaf"])

    near = index.mapInArrow(brute, "query_id long, vec_id long, score double, leaf int")
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k).collect()  # k rows a calibration query
    order = {int(i): {leaf: n + 1 for n, leaf in enumerate(tree.visit(q, tree.n_leaves))} for i, q in zip(ids, _cut(x), strict=True)}
    needed = sorted(order[r["query_id"]][r["leaf"]] for r in best)
    visits = 1
    while needed and visits < tree.n_leaves and sum(n <= visits for n in needed) < recall * len(needed):
        visits += 1
    return visits


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
