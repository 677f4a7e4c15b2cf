"""Connected components of an edge table, by repeated contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, settle


def in_one_task(batches):
    """As components(), over all edges at once: roots hook to smaller roots next to them until every edge lies in one tree."""
    held = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
    if not held:
        return
    a, b = (np.concatenate(x) for x in zip(*held))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(i):
        low = np.minimum(root[i], root[j])
        hook = root.copy()
        np.minimum.at(hook, root[i], low)
        np.minimum.at(hook, root[j], low)
        while not np.array_equal(hook, hook[hook]):
            hook = hook[hook]
        root = hook
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
    yield batch(node=pa.array(nodes), root=pa.array(nodes[root]))


def components(edges: DataFrame, few: int = 0) -> DataFrame:
    """(a long, b long) -> (node, root): every node that has an edge, with the smallest node it reaches.

    Each round hooks every node to its smallest neighbour, follows hooks to their ends by doubling, and replaces both ends
    of every edge by what they lead to; loops and repeats go. Only local minima are left, at most half of the nodes, so
    the rounds are log2(n) at most, however long a path is. Only emptiness is asked by the driver. No edges: no rows.
    Up to `few` edges are joined in one task, which saves the jobs of the rounds.
    """
    edges = settle(edges.where("a <> b").distinct())
    if few and edges.limit(few + 1).count() <= few:
        return settle(edges.select("a", "b").repartition(1).mapInArrow(in_one_task, "node long, root long"))
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = settle(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p")))
        while True:  # a hook's hook, until all have come to an end
            up = hook.select(F.col("a").alias("p"), F.col("p").alias("q"))
            hook = settle(hook.join(up, "p").select("a", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")))
            if hook.where("moved").isEmpty():
                break
            hook = hook.drop("moved")
        hook = hook.drop("moved")
        rounds.append(hook)
        left = hook.select("a", F.col("p").alias("pa"))
        right = hook.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        edges = settle(
            edges.join(left, "a").join(right, "b").where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        )
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = rounds[0].select(F.col("a").alias("node"), F.col("p").alias("root"))
    for hook in rounds[1:]:
        up = hook.select(F.col("a").alias("root"), "p")
        out = out.join(up, "root", "left").select("node", F.coalesce("p", "root").alias("root"))
    return settle(out)
