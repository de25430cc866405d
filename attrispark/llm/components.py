"""Connected components of a distributed link table, and the per-task forests that feed it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._cluster import cut


class Forest:
    """Union-find over the integers met so far; keeps the links that joined two trees."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root and up != x:
            parent[x] = root
            x = up
        return root

    def join(self, x: int, y: int) -> bool:
        a, b = self.find(x), self.find(y)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        self.parent.setdefault(min(a, b), min(a, b))
        return True

    def add(self, xs: np.ndarray, ys: np.ndarray) -> None:
        for x, y in zip(xs.tolist(), ys.tolist(), strict=True):
            self.join(x, y)

    def links(self) -> tuple[list[int], list[int]]:
        """(member, smallest of its tree) for each member that isn't the smallest: as many links as a forest needs."""
        pairs = [(x, r) for x in list(self.parent) if (r := self.find(x)) != x]
        return [p[0] for p in pairs], [p[1] for p in pairs]


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): each node of the links (a, b) with the smallest node it reaches.

    Alternates large-star and small-star steps.  Each is a minimum per node,
    combined before the shuffle, joined back to the links, so no neighbourhood
    is gathered in one place.  Rounds are cut by checkpoints; the number of
    rounds grows with the logarithm of the longest chain.  Null ends are
    ignored; a table without links gives no rows.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u is not null and v is not null and u != v").distinct()
    edges = cut(edges)

    def mark(df):
        return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()

    before = mark(edges)
    if not before["n"]:
        return edges.selectExpr("u as node", "v as component")
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        own = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(own, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        edges = cut(small)
        now = mark(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components are still changing after {rounds} rounds")
    whole = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return whole.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
