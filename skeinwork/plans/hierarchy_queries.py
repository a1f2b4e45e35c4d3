"""Queries over the reply hierarchy of ``comments``, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.operators.hierarchy import clean_links, descendants, resolve


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_links(spark.read.parquet(f"{sf_dir}/comments.parquet"), "commentId", "parentCommentId", "loaded_at")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve(_links(spark, sf_dir)).select(F.col("node").alias("comment_id"), F.col("root").alias("root_id"), "depth")


def p4_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every comment with its path as ids joined by '/', and whether circular replies hold it."""
    tree = resolve(_links(spark, sf_dir), paths=True)
    return tree.select(
        F.col("node").alias("comment_id"), F.col("root").alias("root_id"), "depth", "in_cycle", F.concat_ws("/", "path").alias("path")
    )


def p4_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a comment and a reply below it, at any distance."""
    pairs = descendants(resolve(_links(spark, sf_dir), paths=True))
    return pairs.select(F.col("ancestor").alias("comment_id"), F.col("node").alias("reply_id"), "distance")


_BASE = """
WITH RECURSIVE versions AS (
  SELECT commentId AS c, nullif(trim(parentCommentId, ' ' || chr(9) || chr(13) || chr(10) || chr(12) || chr(11) || chr(160) || chr(12288)), '') AS p,
         row_number() OVER (PARTITION BY commentId ORDER BY loaded_at DESC NULLS LAST,
                            nullif(trim(parentCommentId, ' ' || chr(9) || chr(13) || chr(10) || chr(12) || chr(11) || chr(160) || chr(12288)), '') DESC NULLS LAST) AS rn
  FROM comments WHERE commentId IS NOT NULL),
links AS (SELECT v.c, q.c AS p FROM versions v LEFT JOIN versions q ON q.c = v.p AND q.rn = 1 WHERE v.rn = 1),
down AS (
  SELECT c, c AS root, 0::BIGINT AS depth, [c] AS path FROM links WHERE p IS NULL
  UNION ALL SELECT l.c, d.root, d.depth + 1, list_append(d.path, l.c) FROM links l JOIN down d ON l.p = d.c),
caught AS (SELECT c, p FROM links WHERE c NOT IN (SELECT c FROM down)),
walk AS (SELECT c, p AS x FROM caught UNION SELECT w.c, k.p FROM walk w JOIN caught k ON k.c = w.x),
ring AS (SELECT c FROM walk WHERE c = x),
low AS (SELECT c, min(x) AS root FROM walk WHERE x IN (SELECT c FROM ring) GROUP BY c),
hang AS (
  SELECT c, [c] AS path FROM ring
  UNION ALL SELECT k.c, list_append(h.path, k.c) FROM caught k JOIN hang h ON k.p = h.c WHERE k.c NOT IN (SELECT c FROM ring)),
every AS (
  SELECT c, root, depth, false AS in_cycle, path FROM down
  UNION ALL SELECT h.c, low.root, -1, true, h.path FROM hang h JOIN low ON low.c = h.c)
"""

QUERIES = {"p4_found": p4_found, "p4_paths": p4_paths, "p4_descendants": p4_descendants}
SQL = {
    "p4_found": _BASE + "SELECT c AS comment_id, root AS root_id, depth FROM every",
    "p4_paths": _BASE + "SELECT c AS comment_id, root AS root_id, depth, in_cycle, array_to_string(path, '/') AS path FROM every",
    "p4_descendants": _BASE
    + """, ups AS (SELECT c, path, unnest(range(1, len(path))) AS i FROM every)
SELECT path[i] AS comment_id, c AS reply_id, (len(path) - i)::BIGINT AS distance FROM ups""",
}
