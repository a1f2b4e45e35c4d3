"""Queries on rule scores, embeddings, video and time-place edges, and weighted clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.functions import encoders
from skeinwork.functions import lexicons as L
from skeinwork.functions import temporal as T
from skeinwork.functions import text as X
from skeinwork.functions import vectors as V
from skeinwork.operators import cluster, hetero, prepare, users
from skeinwork.plans.subgraph_queries import _FEATURES, _STRUCTURE, _VERDICT, _feature_rows, subgraph_structure
from skeinwork.plans import oracle_words as O
from skeinwork.plans.text_queries import _RULE
from skeinwork.plans.views import NODES, VIDEOS, nodes, quoted, read, subgraphs


def rule_aggression(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir).where("comment_text IS NOT NULL").select("id", "comment_text", X.squeeze_repeats(F.col("comment_text")).alias("low"))
    return n.select("id", F.round(X.rule_aggression(F.col("comment_text"), F.col("low")), 6).alias("score"))


def rule_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir).where("comment_text IS NOT NULL").select("id", F.lower(F.regexp_replace("comment_text", r"\s+", " ")).alias("low"))
    return n.select("id", F.round(X.rule_toxicity(F.col("low")), 6).alias("score"))


def grammar_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = X.grammar_features(F.col("comment_text"))
    return nodes(spark, sf_dir).where("comment_text IS NOT NULL").select("id", *[F.round(g[c], 6).alias(c) for c in ("uppercase", "exclamation", "question", "short_sentences")])


def repeat_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).where("comment_text IS NOT NULL").select("id", X.grammar_features(F.col("comment_text"))["repetition"].alias("repetition")).where("repetition > 0")


def embedding_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heuristic scores of vectors: min(1, 2 variance + mean |x| / 2) and min(1, norm / 10 + 0.3 |skewness|)."""
    m = V.moments(F.col("embedding"))
    e = read(spark, sf_dir, "embeddings").select("vec_id", *[m[c].alias(c) for c in ("variance", "mean_abs", "norm", "skewness")])
    return e.select("vec_id", F.round(F.least(F.lit(1.0), 2 * F.col("variance") + 0.5 * F.col("mean_abs")), 6).alias("first"), F.round(F.least(F.lit(1.0), 0.1 * F.col("norm") + 0.3 * F.abs("skewness")), 6).alias("second"))


def text_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions as vectors by the hashing encoder."""
    v = prepare.videos(read(spark, sf_dir, "video_posts"))
    return encoders.encode_texts(v, "url", "mediacaption").select("url", F.size("vector").alias("width"), F.round(V.norm(F.col("vector")), 6).alias("norm"))


# Place and period associations.
_PLACES = [("morning", "home"), ("morning", "school"), ("afternoon", "school"), ("afternoon", "work"), ("evening", "home"), ("evening", "social"), ("night", "home")]
_MOODS = {"happy": "happy|excited|fun", "sad": "sad|cry", "angry": "angry|mad"}


def user_time_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' most active period of the day, from two comments in it."""
    n = nodes(spark, sf_dir).where("ts IS NOT NULL AND user_id IS NOT NULL")
    return users.peak(n, "user_id", T.period_of_day(F.hour("ts")), [F.col("ts"), F.col("id")]).where("n >= 2").select("user_id", F.col("bucket").alias("period"), "n")


def user_place_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """social from eleven comments on, home for long comments, else unknown."""
    n = nodes(spark, sf_dir).where("user_id IS NOT NULL").groupBy("user_id").agg(F.count("*").alias("c"), F.avg(F.coalesce(F.char_length("comment_text"), F.lit(0))).alias("l"))
    return n.select("user_id", F.when(F.col("c") > 10, "social").when(F.col("l") > 50, "home").otherwise("unknown").alias("place"))


def time_place_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users joined to the places that go with their most active period."""
    pairs = spark.createDataFrame(_PLACES, "period string, place string")
    return user_time_edges(spark, sf_dir).join(F.broadcast(pairs), "period").groupBy("period", "place").agg(F.count("*").alias("users"))  # seven rows


def video_mood_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos to the moods their free columns name; neutral where none is."""
    v = prepare.videos(read(spark, sf_dir, "video_posts"))
    words = F.lower(F.concat_ws(" ", "column1", "column2"))
    scores = F.create_map(*[e for m, p in _MOODS.items() for e in (F.lit(m), words.rlike(p).cast("double"))])
    return hetero.element_edges(v, "url", scores, 0.3, F.lit("neutral")).select("url", F.col("element").alias("mood"))


def video_caption_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions: characters, words without stop words, and products of likes and words as cross features."""
    v = prepare.videos(read(spark, sf_dir, "video_posts"))
    n = F.size(F.coalesce(X.tokens(F.col("mediacaption")), F.array().cast("array<string>")))
    return v.select("url", F.coalesce(F.char_length("mediacaption"), F.lit(0)).alias("chars"), n.alias("words"), (F.col("like_count").cast("bigint") * n).alias("likes_by_words"), F.round(X.ratio(F.col("like_count"), n + 1), 6).alias("likes_per_word"))


_RICH = ["comment_ratio", "user_ratio", "word_ratio", "video_ratio", "aggression", "interaction", "weight"]


def subgraph_feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, shares by type, density, aggression, interaction, and the weight by the session's verdict."""
    s = subgraph_structure(spark, sf_dir).join(subgraphs(spark, sf_dir, "emotion_score").select("subgraph_id", "session_no", "emotion_score"), "subgraph_id")
    verdicts = prepare.label_verdicts(read(spark, sf_dir, "session_labels")).select("session_no", "is_bullying")
    s = s.join(verdicts, "session_no", "left")
    n, e = F.col("n_nodes"), F.col("n_edges")
    score = F.coalesce("emotion_score", F.lit(0.0))
    values = [*[X.ratio(F.col(f"n_{t}"), n) for t in ("comment", "user", "word", "video")], F.greatest(F.lit(0.0), -score), F.when(n > 0, F.least(F.lit(1.0), e / (n + 1))).otherwise(0.0), F.when(F.col("is_bullying") == 1, 1.5).otherwise(1.0)]
    return s.select("subgraph_id", "n_nodes", "n_edges", "density", *[F.round(v, 6).alias(c) for c, v in zip(_RICH, values)])


def weighted_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality and representatives of the size bins, with members of positive sessions weighing 1.5."""
    rows = _feature_rows(spark, sf_dir).withColumn("w", F.when(F.col("label") == 1, 1.5).otherwise(1.0))
    q = cluster.weighted_quality(rows, "bin", "subgraph_id", "x", "w")
    return q.select("bin", "size", F.round("quality", 6).alias("quality"), "representative")


def merged_prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size bins whose centres point the same way, joined in order of size."""
    rows = _feature_rows(spark, sf_dir).withColumn("w", F.lit(1.0))
    sizes = rows.groupBy("bin").agg(F.count("*").alias("size"))
    return cluster.merge_similar(cluster.weighted_centres(rows, "bin", "x", "w").join(sizes, "bin"), "bin", "centroid", "size", 0.98)


QUERIES = {
    f.__name__: f
    for f in (
        rule_aggression, rule_toxicity, grammar_intensity, repeat_intensity, embedding_scores, text_vectors, user_time_edges, user_place_edges, time_place_edges, video_mood_edges, video_caption_features,
        subgraph_feature_vectors, weighted_clusters, merged_prototypes,
    )
}

_HALF = f"""h AS (SELECT user_id, hour(ts) AS h, ts, id FROM n WHERE ts IS NOT NULL AND user_id IS NOT NULL),
c AS (SELECT user_id, CASE WHEN h < 6 THEN 'night' WHEN h < 12 THEN 'morning' WHEN h < 18 THEN 'afternoon' ELSE 'evening' END AS period, count(*) AS n, min(struct_pack(a := ts, b := id)) AS f FROM h GROUP BY 1, 2),
ut AS (SELECT user_id, period, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS rn FROM c) WHERE rn = 1 AND n >= 2)"""
_UPPER = r"(CASE WHEN length(o) > 0 THEN length(regexp_replace(o, '[^\p{Lu}]', '', 'g')) / length(o) ELSE 0 END)"
_WEIGHTED = _FEATURES + """,
wf AS (SELECT fp.bin, subgraph_id, i, v, CASE WHEN label = 1 THEN 1.5 ELSE 1.0 END AS w FROM fp),
wc AS (SELECT bin, i, sum(w * v) / sum(w) AS m FROM wf GROUP BY 1, 2),
wd AS (SELECT wf.bin, subgraph_id, any_value(w) AS w, sqrt(sum((v - m) * (v - m))) AS d FROM wf JOIN wc ON wc.bin = wf.bin AND wc.i = wf.i GROUP BY 1, 2),
wq AS (SELECT bin, count(*) AS size, round(least(1.0, 1 / (1 + sum(w * d) / sum(w)) + least(0.2, 0.1 * stddev_pop(w)) + 0.3 * avg((w > 1)::INT)), 6) AS quality FROM wd GROUP BY bin),
wr AS (SELECT bin, subgraph_id AS representative FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY round(d / w, 9), subgraph_id) AS rn FROM wd) WHERE rn = 1)"""

SQL = {
    "rule_aggression": f"WITH {NODES}, {_RULE} SELECT id, round(rule, 6) AS score FROM ru",
    "rule_toxicity": f"WITH {NODES}, q AS (SELECT id, lower(regexp_replace(comment_text, '\\s+', ' ', 'g')) AS t FROM n WHERE comment_text IS NOT NULL) SELECT id, round(least(1.0, 0.4 * ({O.present(O.PRESENT_PROFANITY)} + {O.present(O.PRESENT_THREATS)} + {O.present(O.PRESENT_DISCRIMINATION)}) + 0.6 * {O.THREAT_PATTERNS})::DOUBLE, 6) AS score FROM q",
    "repeat_intensity": f"WITH {NODES}, q AS (SELECT id, comment_text AS o FROM n WHERE comment_text <> ''), {O.runs('q', 'o')} SELECT id, least(1.0, repeats / length(o) * 20)::DOUBLE AS repetition FROM q JOIN sq USING (id) WHERE repeats > 0",
    "grammar_intensity": rf"""WITH {NODES}, q AS (SELECT id, comment_text AS o FROM n WHERE comment_text IS NOT NULL),
p AS (SELECT *, list_filter(list_transform(regexp_split_to_array(o, '[.!?]+'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS ss FROM q)
SELECT id, round(least(1.0, {_UPPER} * 3), 6) AS uppercase, round(CASE WHEN length(o) > 0 THEN least(1.0, length(regexp_replace(o, '[^!]', '', 'g')) / length(o) * 50) ELSE 0 END::DOUBLE, 6) AS exclamation,
  round(CASE WHEN length(o) > 0 THEN least(1.0, length(regexp_replace(o, '[^?]', '', 'g')) / length(o) * 50) ELSE 0 END::DOUBLE, 6) AS question,
  CASE WHEN len(ss) > 0 AND list_sum(list_transform(ss, lambda x: len(string_split(x, ' ')))) / len(ss) < 3 THEN 0.3 ELSE 0.0 END::DOUBLE AS short_sentences FROM p""",
    "embedding_scores": """WITH u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings), m AS (SELECT vec_id, avg(v) AS m, avg(abs(v)) AS a, sqrt(sum(v * v)) AS l FROM u GROUP BY 1),
k AS (SELECT u.vec_id, avg((v - m) * (v - m)) AS s, avg((v - m) * (v - m) * (v - m)) AS t FROM u JOIN m USING (vec_id) GROUP BY 1)
SELECT vec_id, round(least(1.0, 2 * s + 0.5 * a), 6) AS first, round(least(1.0, 0.1 * l + 0.3 * abs(CASE WHEN s > 0 THEN t / pow(s, 1.5) ELSE 0 END)), 6) AS second FROM m JOIN k USING (vec_id)""",
    "user_time_edges": f"WITH {NODES}, {_HALF} SELECT user_id, period, n FROM ut",
    "user_place_edges": f"""WITH {NODES}, g AS (SELECT user_id, count(*) AS c, avg(coalesce(length(comment_text), 0)) AS l FROM n WHERE user_id IS NOT NULL GROUP BY user_id)
SELECT user_id, CASE WHEN c > 10 THEN 'social' WHEN l > 50 THEN 'home' ELSE 'unknown' END AS place FROM g""",
    "time_place_edges": f"WITH {NODES}, {_HALF}, p(period, place) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _PLACES) + ") SELECT p.period, place, count(*) AS users FROM ut JOIN p ON p.period = ut.period GROUP BY 1, 2",
    "video_mood_edges": f"WITH {VIDEOS}, t AS (SELECT url, lower(concat_ws(' ', column1, column2)) AS t FROM v), m AS (" + " UNION ALL ".join(f"SELECT url, '{m}' AS mood FROM t WHERE regexp_matches(t, '{p}')" for m, p in _MOODS.items())
    + ") SELECT url, mood FROM m UNION ALL SELECT url, 'neutral' FROM t WHERE url NOT IN (SELECT url FROM m)",
    "video_caption_features": rf"""WITH {VIDEOS}, t AS (SELECT url, like_count, coalesce(length(mediacaption), 0)::INT AS chars, coalesce(len(list_filter(regexp_split_to_array(regexp_replace(lower(mediacaption), '[^a-z0-9_\s]', ' ', 'g'), '\s+'),
  lambda x: length(x) >= 3 AND NOT list_contains([{quoted(L.STOP_WORDS)}], x))), 0)::INT AS words FROM v)
SELECT url, chars, words, like_count::BIGINT * words AS likes_by_words, round(like_count / (words + 1), 6) AS likes_per_word FROM t""",
    "subgraph_feature_vectors": _STRUCTURE + f""", {_VERDICT}
SELECT sx.subgraph_id, n_nodes, n_edges, round(density, 6) AS density, """ + ", ".join(f"round(CASE WHEN n_nodes > 0 THEN n_{t} / n_nodes ELSE 0 END, 6) AS {t}_ratio" for t in ("comment", "user", "word", "video")) + """,
  round(greatest(0.0, -coalesce(emotion_score, 0)), 6) AS aggression, round(CASE WHEN n_nodes > 0 THEN least(1.0, n_edges / (n_nodes + 1)) ELSE 0 END, 6) AS interaction, CASE WHEN label = 1 THEN 1.5 ELSE 1.0 END::DOUBLE AS weight
FROM sx JOIN s USING (subgraph_id) LEFT JOIN lab ON lab.session_no = sx.session_no""",
    "weighted_clusters": _WEIGHTED + " SELECT wq.bin, size, quality, representative FROM wq JOIN wr USING (bin)",
}
