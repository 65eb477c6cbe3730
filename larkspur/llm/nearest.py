"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The tree is fitted on a bounded sample and is small; every vector is dealt to
its leaf. A query walks the tree through a priority queue of branches, nearest
centre first, and visits so many leaves as calibration found necessary: for a
sample of vectors the true neighbours are found by brute force over all rows,
and the visits are widened until the share of them in visited leaves reaches
the wanted recall. Leaves are searched in blocks of bounded size.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.llm import common as C

#: The tree is fitted on at most this many vectors and calibrated on at most that many, first by the hash of their id.
FIT_ROWS, CALIBRATE_ROWS = 16_000, 200
BRANCHES, LEAF_SAMPLE = 8, 40
BLOCK = 4096


def matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def squared(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)[None], 0)


def k_means(points: np.ndarray, k: int, rng, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    distinct = np.unique(points, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:k]]
    for _ in range(rounds):
        near = squared(points, centres).argmin(1)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres, squared(points, centres).argmin(1)


class Tree:
    """Nodes with the centres of their children; a child is a node (>= 0) or leaf number -1 - child."""

    def __init__(self, sample: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaves = 0
        self.root = self._grow(sample, rng)

    def _grow(self, points: np.ndarray, rng) -> int:
        if len(points) <= LEAF_SAMPLE or len(np.unique(points, axis=0)) < 2:
            self.leaves += 1
            return -self.leaves
        node = len(self.centres)
        centres, near = k_means(points, BRANCHES, rng)
        self.centres.append(centres)
        self.children.append([])
        self.children[node] = [self._grow(points[near == i], rng) for i in range(len(centres))]
        return node

    def assign(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        stack = [(self.root, np.arange(len(points)))]
        while stack:
            node, rows = stack.pop()
            if node < 0:
                out[rows] = -1 - node
            elif len(rows):
                near = squared(points[rows], self.centres[node]).argmin(1)
                stack += [(child, rows[near == i]) for i, child in enumerate(self.children[node])]
        return out

    def best_bins(self, point: np.ndarray, visits: int) -> list[int]:
        """The first leaves to visit, nearest branch first."""
        queue, out = [(0.0, self.root)], []
        while queue and len(out) < visits:
            _, node = heapq.heappop(queue)
            if node < 0:
                out.append(-1 - node)
            else:
                for d, child in zip(((self.centres[node] - point) ** 2).sum(1).tolist(), self.children[node]):
                    heapq.heappush(queue, (d, child))
        return out


def distances(points: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - query) ** 2).sum(axis=1))


def smallest(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest scores, ties to smaller ids."""
    if len(score) > 4 * k:
        edge = np.partition(score, k - 1)[k - 1]
        rows = np.flatnonzero(score <= edge)
    else:
        rows = np.arange(len(score))
    return rows[np.lexsort((ids[rows], score[rows]))[:k]]


def best_rows(score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The place of each id's smallest score."""
    order = np.lexsort((score, ids))
    return order[np.append(True, ids[order][1:] != ids[order][:-1])]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows with an id and a vector that is neither null, zero, nor holds null or non-finite components."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & finite & F.exists(v, lambda x: x != 0))


def exact(rows: DataFrame, queries: list[tuple[int, list[float]]], dim: int, k: int) -> DataFrame:
    """(query_id, id, score): by brute force over all rows, each task's k nearest to each of a bounded list."""
    shared = rows.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(shared.value)
        for batch in batches:
            ids, points = batch.column(0).to_numpy(), matrix(batch.column(1), dim)
            for i, (q, v) in enumerate(shared.value):
                score = np.append(best[i][0], distances(points, np.array(v)))
                every = np.append(best[i][1], ids)
                other = every != q
                at = smallest(score[other], every[other], k)
                best[i] = (score[other][at], every[other][at])
        for (q, _), (score, ids) in zip(shared.value, best):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q)), pa.array(ids), pa.array(score)], names=["query_id", "id", "score"])

    return top(rows.select("id", "v").mapInArrow(run, "query_id long, id long, score double"), k)


def top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def calibrate(tree: Tree, points: dict[int, np.ndarray], truth: list[tuple[int, int]], recall: float) -> int:
    """Leaf visits after which the wanted share of true (query, leaf) pairs has been seen."""
    ranks = []
    order = {q: {leaf: i for i, leaf in enumerate(tree.best_bins(v, tree.leaves))} for q, v in points.items()}
    for q, leaf in truth:
        ranks.append(order[q][leaf] + 1)
    ranks.sort()
    return ranks[min(len(ranks) - 1, math.ceil(recall * len(ranks)) - 1)] if ranks else 1


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10, recall: float = 0.94) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found to each row whose id is divisible by every.

    Score is the Euclidean distance in double precision on the original
    vectors; ties go to the smaller id. Vectors that are null, zero, or hold
    null or non-finite components take no part, nor do null ids. A vector's
    neighbours have its length; the tree holds those of the most common length,
    the others are searched whole, in blocks. Rows that share the query's id are
    its own and no candidates; they are asked as one query, and a repeated
    candidate counts once, each by the smallest score among its rows. An empty table gives no row; fewer than k
    candidates are all returned.
    """
    spark = C.prepare(vectors.sparkSession)
    rows = usable(vectors, id_col, vector_col)
    common = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = common["dim"]
    sample = rows.where(F.size("v") == dim).orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).collect()
    tree = Tree(np.array([r["v"] for r in sample], np.float64))
    shared = spark.sparkContext.broadcast(tree)

    def deal(batches):
        for batch in batches:
            length = pc.list_value_length(batch.column(1)).to_numpy()
            leaf = -length.astype(np.int64)  # of another length: all in one leaf, named by it
            same = length == dim
            if same.any():
                leaf[same] = shared.value.assign(matrix(batch.column(1).filter(pa.array(same)), dim))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=["id", "v", "leaf"])

    kind = rows.schema["v"].dataType.simpleString()
    dealt = C.stored(rows.mapInArrow(deal, f"id long, v {kind}, leaf long"), "leaves")
    chosen = [(r["id"], list(r["v"])) for r in sample[:CALIBRATE_ROWS]]
    near = exact(dealt.where("leaf >= 0"), chosen, dim, k).select("query_id", "id")
    truth = [(r["query_id"], r["leaf"]) for r in dealt.select("id", "leaf").join(F.broadcast(near), "id").select("query_id", "leaf").collect()]
    visits = calibrate(tree, {q: np.array(v) for q, v in chosen}, truth, recall)

    # One row a leaf of the bounded tree, and one a length of vectors.
    blocks = {r["leaf"]: -(-r["n"] // BLOCK) for r in dealt.groupBy("leaf").agg(F.count("*").alias("n")).collect()}

    def block(batches):
        for batch in batches:
            ids, leaf = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            named, which = np.unique(leaf, return_inverse=True)
            parts = np.array([blocks[x] for x in named.tolist()], np.int64)[which]
            at = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=["id", "v", "leaf", "block"])

    def walk(batches, visits=visits):
        for batch in batches:
            asking = [tree.best_bins(np.array(v, float), visits) if home >= 0 else [home] for v, home in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            bins = [[(x, j) for x in b for j in range(blocks.get(x, 0))] for b in asking]
            rows = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
            picked = pa.RecordBatch.from_arrays(batch.columns[:2], names=["id", "v"]).take(pa.array(rows))
            leaf, at = (np.array([place[i] for b in bins for place in b], np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(leaf), pa.array(at)], names=["query_id", "v", "qleaf", "qblock"])

    def scan(key, members, asked):
        out_q, out_id, out_score = [], [], []
        if len(members) and len(asked):
            length = dim if key[0].as_py() >= 0 else -key[0].as_py()
            ids, points = members.column("id").to_numpy(), matrix(members.column("v").combine_chunks(), length)
            queries = matrix(asked.column("v").combine_chunks(), length)
            repeated = len(np.unique(ids)) < len(ids)
            for q, v in zip(asked.column("query_id").to_pylist(), queries):
                score = distances(points, v)
                score[ids == q] = np.inf
                kept = best_rows(score, ids) if repeated else slice(None)
                s, i = score[kept], ids[kept]
                at = smallest(s, i, k)
                at = at[i[at] != q]
                out_q.append(np.full(len(at), q))
                out_id.append(i[at])
                out_score.append(s[at])
        join = lambda parts, kind: pa.array(np.concatenate([np.zeros(0, kind), *parts]))
        return pa.table({"query_id": join(out_q, np.int64), "id": join(out_id, np.int64), "score": join(out_score, np.float64)})

    members = dealt.mapInArrow(block, f"id long, v {kind}, leaf long, block long")
    queries = dealt.where(F.col("id") % every == 0)

    def nearest(queries, walk):
        asked = queries.mapInArrow(walk, f"query_id long, v {kind}, qleaf long, qblock long")
        found = members.groupBy("leaf", "block").cogroup(asked.groupBy("qleaf", "qblock")).applyInArrow(scan, "query_id long, id long, score double")
        return top(found.groupBy("query_id", "id").agg(F.min("score").alias("score")), k)

    found = nearest(queries, walk)
    if visits < tree.leaves:
        found = C.stored(found, "found")
        enough = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("id"))
        short = C.stored(queries.join(enough, "id", "left_anti"), "short")
        if short.where("leaf >= 0").limit(1).count():  # their leaves hold fewer than k others: they visit all
            rest = nearest(short, lambda batches: walk(batches, tree.leaves))
            found = found.join(enough.withColumnRenamed("id", "query_id"), "query_id").select("query_id", "id", "score", "rank").unionByName(rest)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
