"""Connected components of an edge table by hash-to-min stars, without collecting anything.

Large-star and small-star steps alternate until the edges are stars around each component's least
node. Every step joins and aggregates by key; hubs are pre-aggregated where the rows are, and AQE
splits what is left of them. Tables in the shared folder cut the lineage after each round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, tidy

MOST_ROUNDS = 60


class Forest:
    """Union-find over array positions."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _local_stars(batches):
    """Replace each batch's edges by stars around the least node of its own components: fewer rows, as much known.

    A node that only loops name in the batch has a loop.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for batch in batches:
        a, b = (np.asarray(c) for c in batch.columns)
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        forest = Forest(len(nodes))
        for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
            forest.join(x, y)
        roots = np.fromiter((forest.find(k) for k in range(len(nodes))), np.int64, len(nodes))
        keep = (roots != np.arange(len(nodes))) | (np.bincount(roots, minlength=len(nodes)) == 1)
        yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(nodes[roots[keep]])], schema=schema)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node that an edge names; component is the least node reachable.

    Repeated edges and loops are harmless; edges with a null end are left out; no edges give no rows.
    """
    scratch = Scratch(edges.sparkSession, "components")
    plain = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    first = scratch.write(plain.mapInArrow(tidy(_local_stars), "a long, b long").distinct(), "edges")
    loops, stars = first.where("a = b").select("a"), first.where("a <> b")
    before = None
    for k in range(MOST_ROUNDS):
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: to the least of a node and its smaller neighbours
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        after = scratch.write(small, f"round{k}")
        told = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if k:
            scratch.drop(stars)
        stars = after
        if told == before:
            break
        before = told
    else:
        raise RuntimeError(f"no fixed point after {MOST_ROUNDS} rounds")
    leaves = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    alone = loops.select(F.col("a").alias("node"), F.col("a").alias("component"))
    return leaves.unionByName(roots).unionByName(alone.join(leaves.unionByName(roots).select("node"), "node", "left_anti"))
