"""Connected components of an undirected edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.storage import Stash


#: Edges that one task joins in memory.
ONE_TASK = 200_000


def _joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parent: dict = {}

    def top(v):
        root = v
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[v] != root:
            parent[v], v = root, parent[v]
        return root

    kinds = None
    for frame in frames:
        kinds = frame.dtypes
        for lo, hi in zip(frame["lo"], frame["hi"]):
            a, b = top(lo), top(hi)
            if a != b:
                parent[max(a, b)] = min(a, b)
    if parent:
        nodes = list(parent)
        yield pd.DataFrame({"node": pd.Series(nodes, dtype=kinds["lo"]), "component": pd.Series([top(v) for v in nodes], dtype=kinds["lo"])})


def star_components(edges: DataFrame, stash: Stash | None = None) -> DataFrame:
    """``node, component`` for every node of ``edges`` (a, b); the component is its least node.

    Large-star and small-star steps in turn, until nothing changes: every node links its larger neighbours
    to its least one, and then its smaller neighbours and itself to the least.  Edges stay rows throughout; a hub's are never gathered.
    Up to ``ONE_TASK`` edges are joined within a task instead of by rounds of shuffles; the result is the same.
    """
    stash = stash or Stash(edges.sparkSession, "components")
    now = stash.put(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct())
    if now.count() <= ONE_TASK:
        kind = now.schema["lo"].dataType.simpleString()
        return now.coalesce(1).mapInPandas(_joined, f"node {kind}, component {kind}")
    before = None
    while True:
        both = now.select(F.col("hi").alias("v"), F.col("lo").alias("u")).unionByName(now.select(F.col("lo").alias("v"), F.col("hi").alias("u")))
        low = both.groupBy("v").agg(F.min(F.least("v", "u")).alias("m"))
        large = both.where("u > v").join(low, "v").select(F.col("u").alias("hi"), F.col("m").alias("lo")).distinct()
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(down, "hi").select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo"))
        loops = now.where("lo = hi").select("lo", "hi")
        moved = stash.put(small.select("lo", "hi").where("lo <> hi").unionByName(loops).distinct())
        mark = tuple(moved.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first())
        stash.drop(now)
        now = moved
        if mark == before:
            break
        before = mark
    every = now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")))
    return every.groupBy("node").agg(F.min("component").alias("component"))
