"""Connected components of an edge table, as alternating star joins (Kiveris et al., 2014)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.llm.shared import settled


class Forest:
    """Union-find over 0..n-1 with path halving; the root of a tree is its smallest member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def contracted(batches):
    """Edges of a batch -> edges from each node to the least node that the batch links it with."""
    for batch in batches:
        nodes, at = np.unique(batch[["a", "b"]].to_numpy().ravel(), return_inverse=True)
        at = at.reshape(-1, 2)
        forest = Forest(len(nodes))
        for x, y in at.tolist():
            forest.join(x, y)
        roots = np.array([forest.root(x) for x in range(len(nodes))], np.int64)
        off = roots != np.arange(len(nodes))
        yield pd.DataFrame({"a": nodes[off], "b": nodes[roots[off]]})


def components(edges: DataFrame, contract: bool = True) -> DataFrame:
    """(a, b) of longs -> (node, component) for every node that is not the least of its component; component is the least
    node reached.

    ``contract``: distinct edges are contracted locally first, batch by batch; without it they are taken as they come, which
    suits few edges or ones that form stars. Every round ties the greater end of an edge to the least neighbour of its lesser
    end (large star), and a node's lesser neighbours to the least of them (small star), until each node has one lesser
    neighbour, and that none. Where each has one, the first step alone shortens all paths by half. The largest table is the
    edge table, which never grows, so that its first size bounds the partitions of all, and no node's neighbours are ever
    collected. The least neighbours are settled first, so that a join has an exchange on either side and a node of many edges
    can be split. The test for the end reads what the next round needs anyway."""
    edges = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = settled(edges.distinct().mapInPandas(contracted, "a long, b long") if contract else edges)
    n = None
    while True:
        # Edges lead from a down to b.
        both = edges.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))))
        below = F.when(F.col("other") < F.col("node"), F.col("other"))
        least = settled(both.groupBy("node").agg(F.min("other").alias("m"), F.max(below).alias("most"), F.max(F.col("other") > F.col("node")).alias("middle"), F.count(below).alias("n")), n and 2 * n)
        tied = least.where("m < node")
        forks, chains, own = tied.agg(F.coalesce(F.max(F.expr("m < most")), F.lit(False)), F.coalesce(F.max("middle"), F.lit(False)), F.sum("n")).first()
        if not forks and not chains:
            return tied.select("node", F.col("m").alias("component"))
        n = n or own
        large = settled(edges.join(least.select(F.col("node").alias("b"), F.least("node", "m").alias("m")), "b").select("a", F.col("m").alias("b")), n)
        if not forks:
            edges = large
            continue
        down = settled(large.groupBy("a").agg(F.min("b").alias("m")), n)
        # Of a node's edges at least one leads to its least neighbour and stays; each other one goes on from its end.
        edges = settled(large.join(down, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct(), n)
