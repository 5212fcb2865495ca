"""Nearest neighbours by largest inner product with a hierarchical k-means tree.

Inner products become distances by one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm. The tree is fitted on
a bounded sample, every row is put into a leaf, and a query takes leaves best-bin-first: a priority queue of tree nodes
gives the one with the nearest centre, until the calibrated number of leaves is reached. That number is widened until the
neighbours that an exact scan finds for a set of calibration queries are met at the wanted recall.

Equal vectors are one entry of the index with as many of their smallest ids as a result can hold. Leaves are searched in
blocks: a large leaf and the queries that visit it are both dealt into parts of bounded size, each pair of parts is one
matrix product, and the best of all parts meet per query. A query's first leaf comes first: what its other leaves find is
kept only where it is at least as near as the last of the nearest in the first.
"""

from __future__ import annotations

import heapq
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import cut

NEAREST, EVERY = 20, 20
#: The sample's bound, rows a leaf should have, branches of a node, calibration queries and the recall they have to reach.
SAMPLE, LEAF, BRANCHES, CALIBRATION, RECALL = 50_000, 500, 8, 128, 0.95
PART = 2048


class Tree:
    """centres[i] and children[i] of node i; leaves have a number instead of children."""

    def __init__(self, points: np.ndarray, leaf_points: float, branches: int = BRANCHES, seed: int = 5):
        self.rng, self.branches = np.random.default_rng(seed), branches
        self.centres, self.children, self.leaf = [points.mean(axis=0)], [[]], [-1]
        todo = [(0, points)]
        while todo:
            node, own = todo.pop()
            parts = self._split(own, min(branches, int(len(own) // max(1.0, leaf_points)))) if len(own) > leaf_points else []
            for centre, part in parts:
                self.children[node].append(len(self.centres))
                todo.append((len(self.centres), part))
                self.centres.append(centre)
                self.children.append([])
                self.leaf.append(-1)
        self.leaves = 0
        for node, below in enumerate(self.children):
            if not below:
                self.leaf[node], self.leaves = self.leaves, self.leaves + 1
        self.centres = np.array(self.centres)

    def _split(self, points: np.ndarray, k: int):
        different = np.unique(points, axis=0) if k > 1 else points[:0]
        if len(different) < 2:
            return []
        k = min(k, len(different))
        centres = different[self.rng.choice(len(different), k, replace=False)]
        for _ in range(10):
            near = _nearest(points, centres)
            centres = np.array([points[near == j].mean(axis=0) if (near == j).any() else centres[j] for j in range(k)])
        near = _nearest(points, centres)
        parts = [(centres[j], points[near == j]) for j in range(k) if (near == j).any()]
        return parts if len(parts) > 1 else []

    def assign(self, points: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(points), np.int32), [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            below = self.children[node]
            if not below:
                out[rows] = self.leaf[node]
            elif len(rows):
                near = _nearest(points[rows], self.centres[below])
                todo += [(child, rows[near == j]) for j, child in enumerate(below)]
        return out

    def best_bins(self, query: np.ndarray, visits: int) -> list[int]:
        """The leaves in the order of a best-bin-first traversal, ``visits`` of them at most."""
        order, tie, out = [(0.0, 0, 0)], count(1), []
        while order and len(out) < visits:
            _, _, node = heapq.heappop(order)
            below = self.children[node]
            if not below:
                out.append(self.leaf[node])
            else:
                apart = ((self.centres[below] - query) ** 2).sum(axis=1)
                for child, d in zip(below, apart.tolist()):
                    heapq.heappush(order, (d, next(tie), child))
        return out


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(points), np.int64)
    for at in range(0, len(points), 65536):
        p = points[at : at + 65536]
        out[at : at + 65536] = ((centres**2).sum(axis=1) - 2 * p @ centres.T).argmin(axis=1)
    return out


def _lifted(vectors: np.ndarray, largest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(0, largest**2 - (vectors**2).sum(axis=1)))
    return np.concatenate((vectors, rest[:, None]), axis=1)


def _matrix(column, dim: int) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def best(queries: np.ndarray, vectors: np.ndarray, ids: list, own: list, k: int):
    """For each query the ``k`` best (score, id), ids of its own left out: largest score, then smallest id.

    Scores are summed for each pair alone and in one order, so equal vectors score equally; the matrix product only
    chooses which pairs can be among the best.
    """
    rough = queries @ vectors.T
    slack = 1e-9 * (np.abs(queries).max() * np.abs(vectors).max() * queries.shape[1] + 1e-300)
    take = min(len(vectors), k + 1)
    edge = np.partition(rough, len(vectors) - take, axis=1)[:, len(vectors) - take] - slack
    out = []
    for i, query in enumerate(queries):
        near = np.flatnonzero(rough[i] >= edge[i])
        scores = (query * vectors[near]).sum(axis=1).tolist()
        found = [(-s, v) for s, j in zip(scores, near) for v in ids[j] if v != own[i]]
        out.append([(-s, v) for s, v in heapq.nsmallest(k, found)])
    return out


def _usable(rows: DataFrame) -> DataFrame:
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).filter(
        finite & F.exists("v", lambda x: x != 0)
    )


def neighbours(
    embeddings: DataFrame, every: int = EVERY, k: int = NEAREST, sample: int = SAMPLE, recall: float = RECALL
) -> DataFrame:
    """For each vec_id divisible by ``every``, its ``k`` nearest rows: query_id, rank (from 1), vec_id, score.

    Null ids and vectors, zero vectors and those with null or non-finite components take no part, nor do vectors of
    another length than most have. Rows that repeat an id and vector count once; all rows of the query's own id are left
    out. Equal scores rank by vec_id. With fewer candidates all are returned; an empty table gives no rows. Other columns
    are ignored.
    """
    spark = embeddings.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = _usable(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")))
    rows = cut(rows.withColumn("dim", F.size("v")), "vectors")
    dims = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if dims is None:
        return empty
    dim = dims["dim"]
    rows = rows.filter(F.col("dim") == dim).select("vec_id", "v").dropDuplicates(["vec_id", "v"])
    smallest = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(smallest)).filter(F.col("n") <= k + 1)  # limited before the shuffle
    entries = cut(few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "entries")
    entries = entries.withColumn("entry", F.element_at("ids", 1))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    total, largest = entries.agg(F.count("*"), F.max(norm)).first()
    share = int(min(1.0, 1.2 * sample / total) * (1 << 20)) + 1  # so that no task sorts many more than the sample
    picked = entries.filter(F.pmod(F.xxhash64("entry"), F.lit(1 << 20)) < share)
    picked = picked.orderBy(F.xxhash64("entry"), "entry").limit(sample).select("v").toPandas()
    points = _lifted(np.stack(picked["v"].to_numpy()).astype(float), largest)
    leaves = max(1, min(total // LEAF, len(points) // 8))
    tree = Tree(points, len(points) / leaves)
    shared = spark.sparkContext.broadcast((tree, largest, dim))  # bounded by the sample

    def assign(batches):
        tree, largest, dim = shared.value
        for batch in batches:
            leaf = tree.assign(_lifted(_matrix(batch.column("v"), dim), largest))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], names=[*batch.schema.names, "leaf"])

    index = cut(entries.mapInArrow(assign, "v array<double>, ids array<long>, entry long, leaf int"), "index")
    queries = cut(rows.filter(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), "v"), "queries")
    visits = _calibrated(index, queries, tree, largest, dim, k, recall)

    def visit(batches):
        tree, largest, dim = shared.value
        for batch in batches:
            vectors = _matrix(batch.column("v"), dim)
            lifted = np.concatenate((vectors, np.zeros((len(vectors), 1))), axis=1)
            found = [tree.best_bins(q, visits) for q in lifted]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], names=["query_id", "v", "bins"])

    going = cut(queries.mapInArrow(visit, "query_id long, v array<double>, bins array<int>"), "going")
    going = going.select("query_id", F.col("v").alias("q"), F.posexplode("bins").alias("place", "leaf"))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = going.filter("place = 0").withColumn("edge", F.lit(float("-inf")))
    found = cut(_searched(index, first, k), "first-leaves")
    top = found.withColumn("n", F.row_number().over(by_score)).filter(F.col("n") <= k)
    edges = top.groupBy("query_id").agg(F.min("score").alias("edge"), F.max("n").alias("n")).filter(F.col("n") == k)
    rest = going.filter("place > 0").join(edges.select("query_id", "edge"), "query_id", "left")
    more = _searched(index, rest.withColumn("edge", F.coalesce("edge", F.lit(float("-inf")))), k)
    unique = found.union(more).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = unique.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _searched(index: DataFrame, going: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the best ``k`` of each part of each leaf that a query goes to, none below its edge."""
    sizes = index.groupBy("leaf").agg(F.ceil(F.count("*") / PART).cast("int").alias("rows_in"))
    sizes = sizes.join(going.groupBy("leaf").agg(F.ceil(F.count("*") / PART).cast("int").alias("queries_in")), "leaf")
    sizes = F.broadcast(cut(sizes, "leaf-sizes"))  # a row a leaf
    at_rows = index.join(sizes, "leaf").select(
        "leaf", F.pmod(F.xxhash64("entry"), "rows_in").alias("a"), F.explode(F.expr("sequence(0L, queries_in - 1L)")).alias("b"), "v", "ids"
    )
    at_queries = going.join(sizes, "leaf").select(
        "leaf", F.explode(F.expr("sequence(0L, rows_in - 1L)")).alias("a"), F.pmod(F.xxhash64("query_id"), "queries_in").alias("b"), "query_id", "q", "edge"
    )

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            vectors, ids = np.stack(right["v"].to_numpy()), [x.tolist() for x in right["ids"]]
            own = left["query_id"].tolist()
            for q, edge, found in zip(own, left["edge"], best(np.stack(left["q"].to_numpy()), vectors, ids, own, k)):
                out += [(q, v, s) for s, v in found if s >= edge]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    by = ["leaf", "a", "b"]
    return at_queries.groupBy(*by).cogroup(at_rows.groupBy(*by)).applyInPandas(search, "query_id long, vec_id long, score double")


def _calibrated(index: DataFrame, queries: DataFrame, tree: Tree, largest: float, dim: int, k: int, recall: float) -> int:
    """The least number of leaf visits that meets ``recall`` of the exact neighbours of a fixed number of queries."""
    asked = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(CALIBRATION).toPandas()
    if not len(asked) or tree.leaves == 1:
        return 1
    vectors, own = np.stack(asked["v"].to_numpy()), asked["query_id"].tolist()

    def exact(batches):
        for batch in batches:
            leaf, ids = batch.column("leaf").to_pylist(), batch.column("ids").to_pylist()
            tagged = [[(v, at) for v in i] for i, at in zip(ids, leaf)]
            home = {v: at for group in tagged for v, at in group}
            for q, found in zip(own, best(vectors, _matrix(batch.column("v"), dim), ids, own, k)):
                yield pa.RecordBatch.from_pydict(
                    {"q": [q] * len(found), "s": [s for s, _ in found], "v": [v for _, v in found], "leaf": [home[v] for _, v in found]},
                    schema=pa.schema([("q", pa.int64()), ("s", pa.float64()), ("v", pa.int64()), ("leaf", pa.int32())]),
                )

    order = Window.partitionBy("q").orderBy(F.desc("s"), "v")
    near = index.mapInArrow(exact, "q long, s double, v long, leaf int").withColumn("n", F.row_number().over(order))
    truth = near.filter(F.col("n") <= k).select("q", "leaf").toPandas()  # CALIBRATION * k rows at most
    places = []
    for q, vector in zip(own, vectors):
        at = {leaf: i for i, leaf in enumerate(tree.best_bins(np.append(vector, 0.0), tree.leaves))}
        places += [at[x] for x in truth["leaf"][truth["q"] == q]]
    places = np.sort(np.array(places))
    need = int(np.ceil(recall * len(places))) - 1
    return int(places[max(0, need)]) + 1 if len(places) else 1
