"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists") -> None:
    """``mode`` 'errorifexists' keeps finished stages, 'overwrite' makes them anew."""
    if format not in ("parquet", "json", "csv", "orc"):
        raise ValueError(f"unknown format: {format}")
    df.write.mode(mode).option("header", True).format(format).save(path)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Typed nodes and edges, each in folders by type, so that readers prune."""
    nodes.write.mode(mode).partitionBy("type").parquet(f"{path}/nodes")
    edges.write.mode(mode).partitionBy("rel").parquet(f"{path}/edges")


def save_by_session(subgraphs: DataFrame, path: str, mode: str = "errorifexists", salt: int = 8) -> None:
    """A folder a session, rows by size within a file.  A session is spread over at most ``salt`` files,
    so one with a third of all rows is not written by one task."""
    spread = subgraphs.withColumn("_salt", F.pmod(F.xxhash64("subgraph_id"), F.lit(salt)))
    rows = spread.repartition("session_id", "_salt").sortWithinPartitions("session_id", "total_nodes").drop("_salt")
    rows.write.mode(mode).partitionBy("session_id").parquet(path)


def subgraph_index(subgraphs: DataFrame) -> DataFrame:
    """Per session: subgraphs, least, greatest and mean size."""
    return subgraphs.groupBy("session_id").agg(F.count("*").alias("subgraphs"), F.min("total_nodes").alias("min_size"), F.max("total_nodes").alias("max_size"), F.avg("total_nodes").alias("mean_size"))


def missing_sessions(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """Sessions without output, for resuming."""
    return wanted.select("session_id").distinct().join(done.select("session_id").distinct(), "session_id", "left_anti")
