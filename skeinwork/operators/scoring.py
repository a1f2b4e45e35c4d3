"""Scores of subgraphs and the filters built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weight of a node type in the score of a subgraph.
TYPE_WEIGHTS = {"comment": 0.5, "user": 0.3, "word": 0.2}


def comment_score(attack: Column) -> Column:
    return -0.2 - 0.5 * F.least(attack, F.lit(1.0))


def user_score(share: Column) -> Column:
    """From a user's share of attacking comments; a user without comments has -0.3."""
    return F.coalesce(-0.2 - 0.8 * share, F.lit(-0.3))


def word_score(n: Column) -> Column:
    return -0.3 - 0.2 * F.least(n / 10, F.lit(1.0))


def user_risk(n: Column) -> Column:
    """Steps of risk by the number of attacking comments."""
    return F.when(n == 0, 0.0).when(n <= 2, -0.3 * n).when(n <= 5, -0.6 - 0.2 * (n - 2)).otherwise(-1.5 - 0.1 * F.least(n - 5, F.lit(10)))


def subgraph_score(parts: DataFrame, key: str, weights: dict[str, float] | None = None) -> DataFrame:
    """``key, score, n``: scores by type (``key, type, n, score``) weighted by the type's share of nodes and
    its weight, normalised, times 1 + 0.1 min(n / 15, 1)."""
    table = F.create_map(*[F.lit(x) for kv in (weights or TYPE_WEIGHTS).items() for x in kv])
    rows = parts.withColumn("w", F.coalesce(F.element_at(table, F.col("type")), F.lit(0.0)) * F.col("n"))
    out = rows.groupBy(key).agg(F.sum(F.col("w") * F.col("score")).alias("s"), F.sum("w").alias("w"), F.sum(F.when(F.col("w") > 0, F.col("n")).otherwise(0)).alias("n"))
    return out.select(key, (F.coalesce(F.col("s") / F.nullif("w", F.lit(0.0)), F.lit(0.0)) * (1 + 0.1 * F.least(F.col("n") / 15, F.lit(1.0)))).alias("score"), "n")


def sweep(scores: DataFrame, score: str, cuts: list[float]) -> DataFrame:
    """``cut, above, below, share_above`` for each threshold, in one pass over the scores."""
    aggs = [F.struct(F.lit(c).alias("cut"), F.count_if(F.col(score) > c).alias("above"), F.count_if(F.col(score) <= c).alias("below")).alias(f"_{i}") for i, c in enumerate(cuts)]
    rows = scores.where(F.col(score).isNotNull()).agg(*aggs).select(F.inline(F.array(*[F.col(f"_{i}") for i in range(len(cuts))])))
    return rows.withColumn("share_above", F.coalesce(F.col("above") / F.nullif(F.col("above") + F.col("below"), F.lit(0)), F.lit(0.0)))
