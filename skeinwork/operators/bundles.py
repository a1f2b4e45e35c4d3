"""Feature bundles and vectors of subgraphs from the measures of their comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.operators.scoring import user_risk

# Weight of a node type in the weighted emotion of a subgraph.
TYPED_WEIGHTS = {"comment": 0.4, "user": 0.3, "word": 0.2, "others": 0.1}


def comment_bundle(comments: DataFrame, key: str) -> DataFrame:
    """Per ``key`` from rows of comments with ``chars, n_words, share, hits``: means of length, words and attack
    share, the greatest share, the share of comments with an attack word, and two scores from them:
    negative_intensity, mean of chars / 50 + 5 share + any; aggression_score, mean of chars / 20 + 10
    share + 2 any."""
    hit = (F.col("hits") > 0).cast("int")
    return comments.groupBy(key).agg(
        F.avg("chars").alias("avg_length"), F.avg("n_words").alias("avg_words"), F.avg("share").alias("avg_share"), F.max("share").alias("max_share"), F.avg(hit).alias("negative_ratio"),
        F.avg(F.col("chars") / 50 + 5 * F.col("share") + hit).alias("negative_intensity"), F.count("*").alias("n"), F.avg(F.col("chars") / 20 + 10 * F.col("share") + 2 * hit).alias("aggression_score"),
    )


def intensity(aggression: Column, negative: Column, users: Column, nodes: Column) -> Column:
    """0.4 min(aggression / 5, 1) + 0.3 min(negative / 3, 1) + 0.2 min(users / 10, 1) from two users on + 0.1
    min((nodes - 10) / 50, 1) above ten nodes."""
    part = lambda v, by, w: w * F.least(F.greatest(v, F.lit(0)) / by, F.lit(1.0))
    return part(aggression, 5.0, 0.4) + part(negative, 3.0, 0.3) + F.when(users > 1, part(users, 10.0, 0.2)).otherwise(0.0) + part(nodes - 10, 50.0, 0.1)


def typed_emotion(comments: DataFrame, users: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """``key, score``: the weighted mean over nodes of comment scores -(2 share + any), user risks, -0.2 for a
    word and 0 for other nodes.

    ``comments``: key, share, hits; ``users``: key, attacks (aggressive comments of a user, everywhere);
    ``counts``: key, n_word, n_other.
    """
    w = TYPED_WEIGHTS
    c = comments.groupBy(key).agg(F.count("*").alias("nc"), F.avg(-(2 * F.col("share") + (F.col("hits") > 0).cast("int"))).alias("sc"))
    u = users.groupBy(key).agg(F.count("*").alias("nu"), F.avg(user_risk(F.col("attacks"))).alias("su"))
    rows = counts.join(c, key, "left").join(u, key, "left").na.fill(0, ["nc", "sc", "nu", "su"])
    weighted = w["comment"] * F.col("nc") * F.col("sc") + w["user"] * F.col("nu") * F.col("su") + w["word"] * F.col("n_word") * -0.2
    total = w["comment"] * F.col("nc") + w["user"] * F.col("nu") + w["word"] * F.col("n_word") + w["others"] * F.col("n_other")
    return rows.select(key, F.coalesce(weighted / F.nullif(total, F.lit(0.0)), F.lit(0.0)).alias("score"))


def is_attack(share: Column, upper: Column, hits: Column) -> Column:
    return (share > 0.1) | (upper > 0.3) | (hits >= 2)


def prototype_quality(members: DataFrame, cluster: str) -> DataFrame:
    """Per cluster of rows with ``intensity, aggression, n_nodes``: size up to ten (0.25), mean intensity (0.35),
    consistency of aggression, 1 - deviation / mean (0.25), and how near the mean size is to 30 to 60 nodes (0.15)."""
    g = members.groupBy(cluster).agg(
        F.count("*").alias("size"), F.avg("intensity").alias("i"), F.greatest(F.lit(0.0), 1 - F.stddev_pop("aggression") / (F.avg("aggression") + 1e-6)).alias("c"), F.avg("n_nodes").alias("n")
    )
    shape = F.when(F.col("n").between(30, 60), 1.0).when(F.col("n") < 30, F.col("n") / 30).otherwise(F.greatest(F.lit(0.1), 1 - (F.col("n") - 60) / 40))
    return g.select(cluster, "size", (0.25 * F.least(F.col("size") / 10, F.lit(1.0)) + 0.35 * F.col("i") + 0.25 * F.col("c") + 0.15 * shape).alias("quality"))


def size_class(size: Column) -> Column:
    """compact up to 12 nodes, balanced up to 21, else extensive."""
    return F.when(size <= 12, "compact").when(size <= 21, "balanced").otherwise("extensive")


def profile(score: Column, comments: Column) -> Column:
    """A subgraph's emotion as a vector: the score three times, variance, shares of negative and very negative;
    guessed from the number of comments where there is no score."""
    known = F.array(score, score, score, F.lit(0.0), F.when(score < 0, 1.0).otherwise(0.0), F.when(score < -0.5, 1.0).otherwise(0.0))
    guess = F.when(comments > 3, F.lit(-0.3)).otherwise(F.lit(-0.1))
    guessed = F.array(guess, guess, guess, F.lit(0.1), F.when(comments > 3, 0.7).otherwise(0.3), F.when(comments > 5, 0.2).otherwise(0.0))
    return F.when(score.isNull(), guessed).otherwise(known)


def layered_emotion(score_a: Column, score_b: Column, comments_a: Column, comments_b: Column) -> Column:
    """0.8 of 1 - |difference of scores| / 2 and 0.2 of the similarity of comment counts, each only where either
    side is not 0, with the weights scaled to what is there."""
    a, b = F.coalesce(score_a, F.lit(0.0)), F.coalesce(score_b, F.lit(0.0))
    scored, counted = (a != 0) | (b != 0), F.greatest(comments_a, comments_b) > 0
    s = F.when(scored, 0.8 * (1 - F.least(F.abs(a - b) / 2, F.lit(1.0)))).otherwise(0.0)
    c = F.when(counted, 0.2 * (1 - F.abs(comments_a - comments_b) / F.greatest(comments_a, comments_b))).otherwise(0.0)
    weight = F.when(scored, 0.8).otherwise(0.0) + F.when(counted, 0.2).otherwise(0.0)
    return F.coalesce((s + c) / F.nullif(weight, F.lit(0.0)), F.lit(0.0))
