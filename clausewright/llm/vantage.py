"""Nearest neighbours by vantage-point trees, one tree a shard.

Largest inner product becomes least distance once every vector of a shard gets one more component
that lifts it to the shard's largest norm (0 for queries). A tree splits its vectors by distance to a
vantage point; a branch is left out if the triangle inequality puts all of it beyond the k-th best so
far. That bound may be multiplied by a factor: 1 is exact search, more leaves out more.

Between 64 even dimensions distances differ little, and the bound itself leaves out almost nothing. What
factors cost and save there, on the test vectors, is in the README.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clausewright.llm.shared import written

#: Vectors a shard holds, about; queries in a block.
SHARD_ROWS, BLOCK_QUERIES = 16_384, 8_192
#: Shards there are at least, so that small tables use several tasks too.
MIN_SHARDS = 8
LEAF_ROWS = 32
#: Of op4: how far the triangle inequality's bound is stretched.
FACTOR = 6.0
#: Ranks kept beyond k until the last scores are computed, for the rounding of block products.
MARGIN = 8


class VantageTree:
    """Vantage-point tree over the rows of x (no two equal), searched for many queries at once."""

    def __init__(self, x: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.x = x
        norms = np.einsum("ij,ij->i", x, x)
        self.top = float(norms.max(initial=0.0))
        self.lift = np.sqrt(np.maximum(self.top - norms, 0.0))
        self.leaf_rows = leaf_rows
        self.root = self._build(np.arange(len(x)))

    def _distances(self, rows: np.ndarray, at: int) -> np.ndarray:
        products = self.x[rows] @ self.x[at] + self.lift[rows] * self.lift[at]
        return np.sqrt(np.maximum(2 * self.top - 2 * products, 0.0))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf_rows:
            return rows
        far = rows[np.argmax(self._distances(rows, rows[0]))]  # a rim point splits best
        d = self._distances(rows, far)
        order = np.argsort(d, kind="stable")
        half = len(rows) // 2
        inner, outer = order[:half], order[half:]
        return (far, (d[inner[0]], d[inner[-1]], self._build(rows[inner])), (d[outer[0]], d[outer[-1]], self._build(rows[outer])))

    def search(self, q: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """(scores, row numbers) of the k largest inner products of each query; rows are -1 where there are fewer."""
        n = len(q)
        self._q, self._k, self._factor = q, k, factor
        self._norms = np.einsum("ij,ij->i", q, q)
        self._best = np.full((n, k), -np.inf)
        self._found = np.full((n, k), -1)
        self._first = np.full(n, -1)
        self._descend(self.root, np.arange(n))
        self._visit(self.root, np.arange(n))
        return self._best, self._found

    def _reach(self, active: np.ndarray) -> np.ndarray:
        """Distance of the k-th best so far."""
        return np.sqrt(np.maximum(self._norms[active] + self.top - 2 * self._best[active].min(axis=1), 0.0))

    def _to(self, at: int, active: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self._norms[active] + self.top - 2 * (self._q[active] @ self.x[at]), 0.0))

    def _leaf(self, rows: np.ndarray, active: np.ndarray) -> None:
        k = self._k
        for lo in range(0, len(active), 1024):
            own = active[lo : lo + 1024]
            scores = self._q[own] @ self.x[rows].T
            better = scores.max(axis=1) > self._best[own].min(axis=1)
            own, scores = own[better], scores[better]
            if len(own):
                both = np.concatenate([self._best[own], scores], axis=1)
                names = np.concatenate([self._found[own], np.broadcast_to(rows, scores.shape)], axis=1)
                keep = np.argpartition(-both, k - 1, axis=1)[:, :k]
                self._best[own] = np.take_along_axis(both, keep, axis=1)
                self._found[own] = np.take_along_axis(names, keep, axis=1)

    def _descend(self, node, active: np.ndarray) -> None:
        """A first leaf for each query, so that the visit begins with a bound."""
        if not len(active):
            return
        if isinstance(node, np.ndarray):
            if len(node):
                self._leaf(node, active)
                self._first[active] = node[0]
            return
        at, inner, outer = node
        near = self._to(at, active) <= (inner[1] + outer[0]) / 2
        self._descend(inner[2], active[near])
        self._descend(outer[2], active[~near])

    def _visit(self, node, active: np.ndarray) -> None:
        if not len(active):
            return
        if isinstance(node, np.ndarray):
            if len(node):
                self._leaf(node, active[self._first[active] != node[0]])
            return
        at, *children = node
        d = self._to(at, active)
        for low, high, child in children:
            beyond = np.maximum(np.maximum(low - d, d - high), 0.0) * self._factor
            self._visit(child, active[beyond <= self._reach(active) + 1e-9])


def _grown(rows: pd.DataFrame) -> pd.DataFrame:
    """One row: the tree of a shard's vectors, with all ids of each."""
    raw = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
    order = np.argsort(rows["vec_id"].to_numpy(), kind="stable")
    raw, ids = raw[order], rows["vec_id"].to_numpy()[order]
    x, inverse = np.unique(raw, axis=0, return_inverse=True)
    by = np.argsort(inverse, kind="stable")  # ids of equal vectors in their order
    bounds = np.r_[0, np.cumsum(np.bincount(inverse, minlength=len(x)))]
    tree = pickle.dumps((VantageTree(x), ids[by], bounds))
    return pd.DataFrame({"width": rows["width"].iloc[:1], "shard": rows["shard"].iloc[:1], "tree": [tree]})


def _shard_answers(k: int, factor: float):
    def answer(trees: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query": [], "query_id": [], "vec_id": [], "score": []})
        empty = empty.astype({"query": "int64", "query_id": "int64", "vec_id": "int64", "score": "float64"})
        if trees.empty or queries.empty:
            return empty
        tree, ids, bounds = pickle.loads(trees["tree"].iloc[0])
        q, query_ids = np.stack(queries["embedding"].to_numpy()).astype(np.float64), queries["query_id"].to_numpy()
        _, found = tree.search(q, min(len(tree.x), k + 1 + MARGIN), factor)
        out = []
        for i, query in enumerate(queries["query"]):
            own = found[i][found[i] >= 0]
            exact = (tree.x[own] * q[i]).sum(axis=1)
            # Of equal vectors, none but the k + 1 least ids can be among the k nearest; one of the query's id is itself.
            copies = [ids[bounds[r] : bounds[r + 1]][: k + 1] for r in own]
            for n, r in enumerate(own):
                if (tree.x[r] == q[i]).all():
                    same = ids[bounds[r] : bounds[r + 1]]
                    at = np.searchsorted(same, query_ids[i])
                    if at < len(same) and same[at] == query_ids[i]:
                        copies[n] = np.delete(same, at)[: k + 1]
            names = np.concatenate(copies)
            scores = np.repeat(exact, [len(c) for c in copies])
            top = np.lexsort((names, -scores))[:k]
            out.append((np.full(len(top), query), np.full(len(top), query_ids[i]), names[top], scores[top]))
        return pd.DataFrame({n: np.concatenate(c) for n, c in zip(("query", "query_id", "vec_id", "score"), zip(*out, strict=True), strict=True)})

    return answer


def usable(vectors: DataFrame, name: str = "vec_id") -> DataFrame:
    """``name`` and embedding of all rows but those whose vector is null, zero or not finite, or that have no id."""
    x = F.col("embedding")
    fit = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return vectors.where(F.col(name).isNotNull() & fit).select(name, "embedding")


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    factor: float = FACTOR,
    shard_rows: int = SHARD_ROWS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """Each query's k vectors of largest inner product, without itself: query_id, rank, vec_id, score.

    vectors: vec_id, embedding; queries: query_id, embedding (a query is a row of the same id and
    vector, and that one row is no candidate of its own). Rows that share an id are candidates each,
    and queries each, with ranks of their own. Ties go to the lesser vec_id; equal vectors are one
    point of a tree that keeps all its ids. Vectors of another length than the query's are no
    candidates. See ``usable`` for what takes no part. Empty tables give an empty result; columns of
    other names aren't read. Every shard's tree is grown once and stored; each is asked for every
    block of queries.
    """
    base = written(usable(vectors), "vectors")
    asked = written(usable(queries, "query_id").withColumn("query", F.monotonically_increasing_id()), "queries")
    n_shards = max(MIN_SHARDS, -(-base.count() // shard_rows))
    n_blocks = max(1, -(-asked.count() // block_queries))
    dealt = base.select(F.size("embedding").alias("width"), F.pmod(F.xxhash64("vec_id"), F.lit(n_shards)).alias("shard"), "vec_id", "embedding")
    trees = written(dealt.groupBy("width", "shard").applyInPandas(_grown, "width int, shard long, tree binary"), "trees")
    # Every pair of a shard and a block of queries is one group of bounded size.
    left = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    right = asked.select(
        F.size("embedding").alias("width"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long"))).alias("shard"),
        F.pmod(F.xxhash64("query"), F.lit(n_blocks)).cast("int").alias("block"),
        "query",
        "query_id",
        "embedding",
    )
    keys = ["width", "shard", "block"]
    schema = "query long, query_id long, vec_id long, score double"
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_shard_answers(k, factor), schema)
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_vantage_trees(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every embedding whose vec_id is divisible by 20, among all embeddings."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"))
