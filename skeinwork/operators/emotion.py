"""Emotion of texts by lexicon, grammar, patterns and context, and of groups of texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.functions import lexicons as L
from skeinwork.functions import text as X

# What a null or empty text has.
DEFAULTS = {"aggression": 0.0, "negative": 0.2, "positive": 0.1, "aggression_score": 0.1, "positive_norm": 0.1, "negative_norm": 0.3, "neutral_norm": 0.6}


def spoken_words(low):
    """Words of lower-case text with contractions written out; '!', '?' and '.' stay with their words."""
    plain = reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), L.EXPANSIONS.items(), low)
    kept = F.regexp_replace(F.regexp_replace(plain, r"[^\p{L}\p{N}_\s!?.]", " "), r"\s+", " ")
    return F.filter(F.split(F.trim(kept), " "), lambda w: w != "")


def text_emotion(df: DataFrame, key: str, text: str, *keep: str) -> DataFrame:
    """``key, *keep`` and the columns of ``DEFAULTS`` for every row.

    aggression, negative, positive: mean strengths of listed words in their context.  aggression_score:
    0.4 aggression + 0.2 negative + grammar (0.1 capitals + 0.05 exclamations + 0.05 repeats + 0.1 short
    sentences) + 0.1 pattern + 0.1 context, all within [0, 1].  The norms share out positive, negative
    with aggression, and what is left to 1.  A null or empty text has the defaults.  The steps are
    projections one after the other, so each expression is computed once and generated code stays small.
    """
    t = F.col("_t")
    rows = df.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("_t"), *[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)])
    held = ["_k", "_t", *[f"_keep{i}" for i in range(len(keep))]]
    listed = list(L.STRENGTHS["aggression"])
    a = rows.select(*held, F.lower(t).alias("_low"))
    b = a.select(*held, "_low", spoken_words(F.col("_low")).alias("_w"))
    c = b.select(*held, "_low", "_w", X.lexicon_hits_in_context(F.col("_w")).alias("_h"), X.longest_run(F.col("_w"), listed).alias("_run"), X.ratio(X.lexicon_hits(F.col("_w"), listed), F.size("_w")).alias("_density"))
    h, g = F.col("_h"), X.grammar_features(t)
    one = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    d = c.select(
        *held, X.mean_of(h, "aggression").alias("_a"), X.mean_of(h, "negative", "turned").alias("_n"), X.mean_of(h, "positive").alias("_p"),
        (0.1 * g["uppercase"] + 0.05 * g["exclamation"] + 0.05 * g["repetition"] + 0.1 * g["short_sentences"]).alias("_g"), X.pattern_score(F.col("_low")).alias("_m"),
        F.when(F.size("_w") > 0, F.least(F.lit(1.0), 2 * F.col("_density") + 0.5 * F.least(F.lit(1.0), F.col("_run") / 3))).otherwise(0.0).alias("_c"),
    )
    score = 0.4 * F.col("_a") + 0.2 * F.col("_n") + F.col("_g") + 0.1 * F.col("_m") + 0.1 * F.col("_c")
    e = d.select(*held, one(F.col("_a")).alias("_a"), one(F.col("_n")).alias("_n"), one(F.col("_p")).alias("_p"), one(score).alias("_s"))
    bad = F.col("_a") + F.col("_n")
    neutral = F.greatest(F.lit(0.0), 1 - F.col("_p") - bad)
    total = F.col("_p") + bad + neutral
    values = {"aggression": F.col("_a"), "negative": F.col("_n"), "positive": F.col("_p"), "aggression_score": F.col("_s"), "positive_norm": F.col("_p") / total, "negative_norm": bad / total, "neutral_norm": neutral / total}
    nothing = F.coalesce(t == "", F.lit(True))
    return e.select(F.col("_k").alias(key), *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)], *[F.when(nothing, DEFAULTS[n]).otherwise(v).alias(n) for n, v in values.items()])


def group_emotion(texts: DataFrame, group: str, text: str, score: str) -> DataFrame:
    """``group, score, texts``: mean of the texts' scores weighted by their words (plain mean without any), at most 1."""
    words = F.size(F.filter(F.split(F.trim(F.col(text)), r"\s+"), lambda w: w != ""))
    w, s = F.col("_w"), F.col(score)
    rows = texts.select(group, score, words.cast("double").alias("_w")).groupBy(group)
    return rows.agg(F.least(F.lit(1.0), F.when(F.sum(w) > 0, F.sum(w * s) / F.sum(w)).otherwise(F.avg(s))).alias("score"), F.count("*").alias("texts"))
