"""User profiles, activity histograms, levels and population statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def profiles(comments: DataFrame, user: str = "user_id") -> DataFrame:
    """Per user: comments, posts, first and last time, profile values of the last and the first comment."""
    seq = F.struct("created", "comment_id")
    return comments.where(F.col(user).isNotNull()).groupBy(user).agg(
        F.count("*").alias("comments"), F.count_distinct("post_id").alias("posts"), F.min("created").alias("first_seen"), F.max("created").alias("last_seen"),
        F.max_by("username", seq).alias("last_name"), F.max_by("location", seq).alias("last_location"), F.min_by("verified", seq).alias("first_verified"),
        F.count_distinct("location").alias("locations"),
    )


def histogram(df: DataFrame, key: str, bucket: Column, buckets: list) -> DataFrame:
    """``key, counts``: an array with the number of rows in each of the given buckets.

    Counts are conditional sums, so the histogram is made in one aggregation, without a pivot.
    """
    b = df.select(key, bucket.alias("_b"))
    return b.groupBy(key).agg(F.array(*[F.count_if(F.col("_b") == v) for v in buckets]).alias("counts"))


def peak(df: DataFrame, key: str, bucket: Column, order: list[Column]) -> DataFrame:
    """``key, bucket, n``: the most frequent bucket; of equal ones the first seen."""
    counted = df.select(key, bucket.alias("bucket"), F.struct(*order).alias("_o")).where("bucket IS NOT NULL").groupBy(key, "bucket").agg(F.count("*").alias("n"), F.min("_o").alias("first"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("n").desc(), "first"))
    return counted.withColumn("_rn", rank).where("_rn = 1").select(key, "bucket", "n")


def level(share: Column, cuts: tuple[float, float, float] = (0.7, 0.4, 0.1)) -> Column:
    high, medium, low = cuts
    return F.when(share >= high, "high").when(share >= medium, "medium").when(share >= low, "low").otherwise("none")


def blended_aggression(scores: DataFrame, user: str, score: str, cut: float = 0.3) -> DataFrame:
    """0.6 mean + 0.2 maximum + 0.2 share of comments above the cut."""
    return scores.groupBy(user).agg(
        F.count("*").alias("comments"), (0.6 * F.avg(score) + 0.2 * F.max(score) + 0.2 * F.count_if(F.col(score) > cut) / F.count("*")).alias("aggression")
    )


def merge_totals(old: DataFrame, new: DataFrame, user: str) -> DataFrame:
    """Running totals ``comments, total, top, above`` of users, brought up to date with those of new rows."""
    both = old.unionByName(new)
    return both.groupBy(user).agg(F.sum("comments").alias("comments"), F.sum("total").alias("total"), F.max("top").alias("top"), F.sum("above").alias("above"))


def population(df: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """Mean, population deviation, least, greatest and median of a column, over all or by group."""
    grouped = df.groupBy(by) if by else df
    return grouped.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.percentile(value, F.lit(0.5)).alias("median"))
