"""Connected components of an edge table, in bounded tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taleforge.llm.common import stash

#: Edges that one task contracts at once.
EDGES_PER_TASK = 1_000_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of one partition: every node beside the smallest node it reaches there."""
    parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    u, v = (np.concatenate(x) for x in zip(*parts, strict=True))
    nodes, index = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(index[: len(u)].tolist(), index[len(u) :].tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    roots = nodes[[find(x) for x in range(len(nodes))]]
    keep = roots != nodes
    yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(roots[keep])], names=["u", "v"])


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of the undirected edges (u, v: bigint); root is the smallest node reachable.

    Edges are first contracted to spanning stars in tasks of EDGES_PER_TASK edges; what is left is
    joined by alternating large-star and small-star steps until nothing changes. Each step moves
    one row per remaining edge; hot nodes are aggregated before they are shuffled. Null ends and
    loops are ignored; an empty table gives an empty table.
    """
    now = stash(edges.where("u <> v").select("u", "v"), f"{name}-edges")
    tasks = max(1, -(-now.count() // EDGES_PER_TASK))
    now = stash(now.repartition(tasks, F.abs(F.xxhash64(F.least("u", "v"))) if tasks > 1 else F.lit(0)).mapInArrow(_forest, "u bigint, v bigint"), f"{name}-contracted")
    while tasks > 1:  # one task has seen every edge: already stars
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stash(large, f"{name}-large")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        small = stash(small, f"{name}-small")
        changed = small.exceptAll(now).limit(1).count() or now.exceptAll(small).limit(1).count()
        now = small
        if not changed:
            break
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


