"""Similarity of subgraphs to prototypes, and session features from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.functions.vectors import cosine, distance


def shares(counts: list[Column]) -> Column:
    """Counts as an array of shares; all zero without any."""
    total = sum(counts[1:], counts[0])
    return F.array(*[F.coalesce(c / F.nullif(total, F.lit(0)), F.lit(0.0)) for c in counts])


def structural(nodes_a: Column, nodes_b: Column, edges_a: Column, edges_b: Column) -> Column:
    """0.6 cosine of node shares + 0.4 cosine of edge shares, within [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.6 * cosine(nodes_a, nodes_b) + 0.4 * cosine(edges_a, edges_b)))


def feature_similarity(a: Column, b: Column, width: float) -> Column:
    return F.greatest(F.lit(0.0), 1 - distance(a, b) / width)


def count_similarity(pairs: list[tuple[Column, Column, float]]) -> Column:
    """Weighted sum of min / max of counts; two zeros are alike."""
    parts = [w * F.when(F.greatest(a, b) == 0, 1.0).otherwise(F.least(a, b) / F.greatest(a, b)) for a, b, w in pairs]
    return sum(parts[1:], parts[0])


def relative_similarity(a: Column, b: Column) -> Column:
    """1 - |a - b| / max(a, b), 1 for two zeros."""
    top = F.greatest(a, b)
    return F.when(top == 0, 1.0).otherwise(1 - F.abs(a - b) / top)


def blend(parts: list[Column], weights: tuple[float, ...] = (0.5, 0.3, 0.2)) -> Column:
    return sum((p * w for p, w in zip(parts[1:], weights[1:])), parts[0] * weights[0])


def session_match(matches: DataFrame, session: str) -> DataFrame:
    """From ``session, prototype, similarity`` per session and prototype: maximum, mean, population
    deviation, matches above 0.5 and their share."""
    s = F.col("similarity")
    return matches.groupBy(session, "prototype").agg(
        F.max(s).alias("best"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("deviation"), F.count_if(s > 0.5).alias("hits"), (F.count_if(s > 0.5) / F.count("*")).alias("share")
    )


def aligner_features(matches: DataFrame, session: str, high: float = 0.7, low: float = 0.3) -> DataFrame:
    """Per session from prototype scores 0.7 max + 0.3 mean: bands, the mean of the best three, the
    self-weighted mean, and whether the best reaches the decision of 0.6."""
    per = matches.groupBy(session, "prototype").agg((0.7 * F.max("similarity") + 0.3 * F.avg("similarity")).alias("_s"))
    s = F.col("_s")
    out = per.groupBy(session).agg(
        F.max(s).alias("best"), F.avg(s).alias("mean"), F.count_if(s >= high).alias("high"), F.count_if((s >= low) & (s < high)).alias("medium"), F.count_if(s < low).alias("low"),
        F.coalesce(F.sum(s * s) / F.nullif(F.sum(s), F.lit(0.0)), F.lit(0.0)).alias("self_weighted"), F.slice(F.sort_array(F.collect_list(s), asc=False), 1, 3).alias("_top"),
    )  # one entry a prototype
    top = F.aggregate("_top", F.lit(0.0), lambda a, v: a + v) / F.size("_top")
    return out.select(session, "best", "mean", "high", "medium", "low", "self_weighted", top.alias("top3"), (F.col("best") >= 0.6).cast("int").alias("predicted"))
