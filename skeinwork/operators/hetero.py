"""Typed nodes and edges of the heterogeneous graph, their fusion and scaling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.storage import Stash


def dense_ids(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``id``: place in the order of keys within the type, from 0.

    Ranks come in two levels: ranges of keys from a range partitioning, and the place within a range,
    so that one type with most nodes is numbered by many tasks.
    """
    stash = Stash(nodes.sparkSession, "ids")
    # written once: ranges are drawn from a sample, and both sides below need the same ones
    ranged = stash.put(nodes.repartitionByRange("type", "key").withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("type", "_part").agg(F.count("*").alias("_c"))
    starts = sizes.select("type", "_part", (F.sum("_c").over(Window.partitionBy("type").orderBy("_part")) - F.col("_c")).alias("_start"))
    local = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("type", "_part").orderBy("key")))
    return local.join(starts, ["type", "_part"]).withColumn("id", F.col("_start") + F.col("_r") - 1).drop("_part", "_r", "_start")


def map_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of keys (src_type, rel, dst_type, src_key, dst_key) to edges of ids; unknown ends drop out."""
    s = nodes.select(F.col("type").alias("src_type"), F.col("key").alias("src_key"), F.col("id").alias("src"))
    d = nodes.select(F.col("type").alias("dst_type"), F.col("key").alias("dst_key"), F.col("id").alias("dst"))
    return edges.join(s, ["src_type", "src_key"]).join(d, ["dst_type", "dst_key"]).select("src_type", "rel", "dst_type", "src", "dst")


def concat_fusion(sides: list[tuple[DataFrame, int]]) -> DataFrame:
    """``key, features``: the feature arrays of the modalities end to end, zeros where a key is missing."""
    keys = reduce(lambda a, b: a.union(b), [s.select("key") for s, _ in sides]).distinct()
    out = keys
    for i, (side, width) in enumerate(sides):
        out = out.join(side.select("key", F.col("features").alias(f"_f{i}")), "key", "left").withColumn(f"_f{i}", F.coalesce(f"_f{i}", F.array_repeat(F.lit(0.0), width)))
    return out.select("key", F.concat(*[F.col(f"_f{i}") for i in range(len(sides))]).alias("features"))


def mean_fusion(sides: list[DataFrame]) -> DataFrame:
    """``key, features``: element-wise mean over the modalities that have the key."""
    every = reduce(lambda a, b: a.unionByName(b), [s.select("key", "features") for s in sides])
    each = every.select("key", F.posexplode("features").alias("at", "v")).groupBy("key", "at").agg(F.avg("v").alias("v"))
    return each.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("p")).select("key", F.col("p.v").alias("features"))


def zscore_features(nodes: DataFrame, eps: float = 1e-6, keep: int = 0) -> DataFrame:
    """Features scaled within each type by (x - mean) / (sample deviation + eps); the first ``keep``
    positions (labels, ids) stay as they are.  The statistics are one row a type and position."""
    stats = nodes.select("type", F.posexplode("features").alias("at", "v")).groupBy("type", "at").agg(F.avg("v").alias("m"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("s"))
    rows = stats.groupBy("type").agg(F.array_sort(F.collect_list(F.struct("at", "m", "s"))).alias("stats"))
    scaled = F.zip_with("features", "stats", lambda x, t: F.when(t["at"] < keep, x.cast("double")).otherwise((x - t["m"]) / (t["s"] + eps)))
    return nodes.join(F.broadcast(rows), "type").withColumn("features", scaled).drop("stats")


def element_edges(rows: DataFrame, key: str, scores: Column, cut: float, fallback: Column) -> DataFrame:
    """``key, element``: entries of a map of scores above the cut, else a fallback element."""
    kept = F.map_keys(F.map_filter(scores, lambda _, v: v > cut))
    chosen = F.when(F.size(kept) > 0, kept).otherwise(F.array(fallback))
    return rows.select(key, F.explode(chosen).alias("element"))


def column_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, least, greatest, mean, non_zero`` in one pass."""
    aggs = [F.struct(F.lit(c).alias("column"), F.min(c).cast("double").alias("least"), F.max(c).cast("double").alias("greatest"), F.avg(c).alias("mean"), F.avg((F.col(c) != 0).cast("int")).alias("non_zero")).alias(f"_{i}") for i, c in enumerate(columns)]
    return df.agg(*aggs).select(F.inline(F.array(*[F.col(f"_{i}") for i in range(len(columns))])))
