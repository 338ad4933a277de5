"""Clause trees: ancestors, subtrees in reading order, moved and reused numbers, keys made distinct."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Levels of headings that a clause file knows, and the root.
LEVELS = 7


def paths(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """nodes (id, parent, place, name) with ``depth``, ``trail`` (ancestors' names, outermost first), ``order_path``, ``root``.

    One equi-join a level, until a level is empty. Rows that no root reaches (cycles, lost parents) aren't in the result.
    ``levels`` bounds the depth that is looked for; a deeper tree is an error, not a shorter result.
    """
    own = nodes.select("id", "parent", "place", "name")
    rows = own.where("parent is null").select("id", F.array("name").alias("trail"), F.array("place").alias("order_path"), F.col("id").alias("root"))
    found = level = rows
    for depth in range(2, levels + 2):
        up = level.select(F.col("id").alias("parent"), "trail", "order_path", "root")
        level = own.join(up, "parent").select(
            "id", F.array_append("trail", F.col("name")).alias("trail"), F.array_append("order_path", F.col("place")).alias("order_path"), "root"
        )
        if level.isEmpty():
            return found.withColumn("depth", F.size("trail"))
        if depth > levels:
            raise ValueError(f"a tree is deeper than {levels} levels")
        found = found.unionByName(level)
    return found.withColumn("depth", F.size("trail"))


def subtrees(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """root, id, depth, position: every tree in reading order (parents before children, siblings by place)."""
    order = F.row_number().over(W.partitionBy("root").orderBy("order_path"))
    return paths(nodes, levels).select("root", "id", "depth", order.alias("position"))


def breadcrumbs(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """id, crumbs: the ancestors' names, outermost first, without the node's own."""
    return paths(nodes, levels).select("id", F.array_join(F.slice("trail", 1, F.col("depth") - 1), " > ").alias("crumbs"))


def continued(clauses: DataFrame) -> DataFrame:
    """version, key, moved_from, formerly of clauses (version, key, id, previous_id).

    moved_from: the key it had in the version before, if another; formerly: the id that had its key there, if another.
    """
    old = clauses.select((F.col("version") + 1).alias("version"), F.col("id").alias("previous_id"), F.col("key").alias("old_key"))
    holder = clauses.select((F.col("version") + 1).alias("version"), "key", F.col("id").alias("holder"))
    joined = clauses.join(old, ["version", "previous_id"], "left").join(holder, ["version", "key"], "left")
    other = F.when(F.col("holder").isNotNull() & ~F.col("holder").eqNullSafe(F.col("previous_id")), F.col("holder"))
    return joined.select("version", "key", F.when(F.col("old_key") != F.col("key"), F.col("old_key")).alias("moved_from"), other.alias("formerly"))


def distinct_keys(rows: DataFrame) -> DataFrame:
    """parent, place, key: a segment that a parent has used before gets ``-2``, ``-3``, ..."""
    n = F.row_number().over(W.partitionBy("parent", "segment").orderBy("place"))
    key = F.when(n == 1, F.col("segment")).otherwise(F.concat_ws("-", "segment", n))
    return rows.select("parent", "place", key.alias("key"))


def places_above(levels: int) -> Callable[[pa.Array, pa.Array], pa.Array]:
    """For an Arrow function: of trees given as lists (ids, parents), the places in its list of every node's ancestors, outermost first.

    A parent that isn't in the list ends the way up. More than ``levels`` nodes between a node and its root, as in a cycle, are an error.
    """

    def places(ids: pa.Array, parents: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
        ends = np.append(0, np.cumsum(sizes))
        n, tree = int(ends[-1]), np.repeat(np.arange(len(sizes)), sizes)
        coded = pa.concat_arrays([ids.flatten(), parents.flatten()]).dictionary_encode()
        code = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        own, asked = (tree * len(coded.dictionary) + c for c in (code[:n], code[n:]))
        own[code[:n] < 0] = -1
        order = np.argsort(own, kind="stable")
        met = order[np.minimum(np.searchsorted(own[order], asked), n - 1)] if n else order
        up = np.where((code[n:] >= 0) & (own[met] == asked), met, -1)
        steps = [up]
        while (steps[-1] >= 0).any():
            if len(steps) > levels + 1:
                raise ValueError(f"more than {levels} nodes lie between a node and its root")
            steps.append(np.where(steps[-1] >= 0, up[steps[-1]], -1))
        heights = sum((step >= 0).astype(np.int64) for step in steps)
        last = np.cumsum(heights)
        above = np.empty(int(heights.sum()), np.int32)
        for k, step in enumerate(steps):
            there = step >= 0
            above[last[there] - 1 - k] = step[there] - ends[tree[there]]
        nested = pa.ListArray.from_arrays(pa.array(np.append(0, last), pa.int32()), pa.array(above))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), nested)

    return places
