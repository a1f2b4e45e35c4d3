"""Cleaning and joining of posts, comments, labels: one row a thing, in the version that counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.functions.temporal import parse_time
from skeinwork.functions.text import strip_tags


def latest(df: DataFrame, key: str, version: str) -> DataFrame:
    """For each non-null key the row with the greatest version; ties go to the greatest row by content.

    One aggregation with map-side combine, so a key repeated without end is no problem.
    """
    rest = [c for c in df.columns if c not in (key, version)]
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(version, *rest)).alias("_r"))
    return best.select(key, *[F.col("_r")[c].alias(c) for c in df.columns if c != key])


def clean_comments(comments: DataFrame) -> DataFrame:
    """Comments of known posts in their last version, users without markup, times parsed."""
    rows = latest(comments, "commentId", "loaded_at").where("postId IS NOT NULL AND postId <> ''")
    return rows.select(
        F.col("postId").alias("post_id"), F.col("commentId").alias("comment_id"), F.col("userId").alias("user_id"), strip_tags(F.col("username")).alias("username"),
        F.col("commentText").alias("text"), parse_time(F.col("created")).alias("created"), "location", (F.col("verified") == "1").alias("verified"), (F.col("private") == "1").alias("private"), "loaded_at",
    )


def session_number(column):
    """n of a session id in any spelling; null without a number."""
    found = F.regexp_extract(F.coalesce(column, F.lit("")), r"(\d+)\D*$", 1)
    return F.when(found != "", found).cast("bigint")


def label_verdicts(labels: DataFrame) -> DataFrame:
    """``session_no, votes, is_bullying, conflict``: the verdict with more annotators counts, 1 on a tie."""
    rows = labels.select(session_number(F.col("session_id")).alias("session_no"), "is_bullying", F.coalesce("annotators", F.lit(1)).alias("n")).where("session_no IS NOT NULL AND is_bullying IS NOT NULL")
    yes, no = F.sum(F.when(F.col("is_bullying") == 1, F.col("n")).otherwise(0)), F.sum(F.when(F.col("is_bullying") != 1, F.col("n")).otherwise(0))
    return rows.groupBy("session_no").agg(
        F.count("*").alias("votes"), F.when(yes >= no, 1).otherwise(0).alias("is_bullying"), (F.count_distinct("is_bullying") > 1).alias("conflict")
    )


def video_label(column):
    """1 if the answer is 'bullying' in any case, else 0; null and empty answers have no label."""
    answer = F.lower(F.trim(column))
    return F.when(answer == "", None).otherwise((answer == "bullying").cast("int"))


def videos(posts: DataFrame) -> DataFrame:
    """One row a link: the row with the greatest content, counts parsed or 0."""
    rows = posts.select("videolink", F.struct("username", "mediacaption", "creationtime", "likecount", "question2", "column1", "column2").alias("r")).where("videolink IS NOT NULL")
    best = rows.groupBy("videolink").agg(F.max("r").alias("r"))
    return best.select(
        F.col("videolink").alias("url"), "r.username", "r.mediacaption", parse_time(F.col("r.creationtime")).alias("created"),
        F.coalesce(F.expr("try_cast(r.likecount AS int)"), F.lit(0)).alias("like_count"), video_label(F.col("r.question2")).alias("label"), "r.column1", "r.column2",
    )


def align(*sides: tuple[DataFrame, str]) -> DataFrame:
    """Inner join of modalities on ``post_id``, kept where all their labels agree."""
    first, label = sides[0]
    out = first.withColumnRenamed(label, "label")
    for i, (side, name) in enumerate(sides[1:]):
        out = out.join(side.withColumnRenamed(name, f"_l{i}"), "post_id").where(F.col("label").eqNullSafe(F.col(f"_l{i}"))).drop(f"_l{i}")
    return out


def align_adaptive(text: DataFrame, video: DataFrame, user: DataFrame) -> DataFrame:
    """``post_id, modalities``: posts in text and video if there are any such, else in text and user,
    else in video and user, else in the single side that has rows."""
    t, v, u = (s.select("post_id").distinct() for s in (text, video, user))
    for name, a, b in (("text+video", t, v), ("text+user", t, u), ("video+user", v, u)):
        both = a.join(b, "post_id", "left_semi")
        if not both.isEmpty():
            return both.select("post_id", F.lit(name).alias("modalities"))
    for name, side in (("text", t), ("video", v), ("user", u)):
        if not side.isEmpty():
            return side.select("post_id", F.lit(name).alias("modalities"))
    return t.select("post_id", F.lit("none").alias("modalities"))
