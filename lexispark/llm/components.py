"""Connected components by alternating stars, over written tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written

#: Up to so many edges, 8 MB of ids, one task joins them by itself.
FEW = 500_000


def _joined(frames):
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for frame in frames:
        for u, v in zip(frame["u"].tolist(), frame["v"].tolist(), strict=True):
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pd.DataFrame({"node": pd.Series(nodes, dtype="int64"), "component": pd.Series([root(x) for x in nodes], dtype="int64")})


def _minima(pairs: DataFrame) -> DataFrame:
    return written(pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "cc-minima")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` for each node of an edge; the component is its smallest node.

    Every round writes its edges, so that a lost executor costs one round at most. A node with very
    many edges takes part through a minimum, which is aggregated before the shuffle, and through a join
    whose sides are plain tables, so that its rows can be split.
    """
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "cc-edges")
    if now.count() <= FEW:
        return now.repartition(1).mapInPandas(_joined, "node long, component long")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = _minima(both)
        large = written(both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "cc-large")
        low = _minima(large)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        before, now = now, written(small.filter("u <> v").distinct(), "cc-small")
        forget(before, lowest, large, low)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return members.unionByName(roots)
