"""Queries on feature bundles, vectors, prototypes and detection features, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.functions import vectors as V
from skeinwork.operators import bundles as B
from skeinwork.operators import cluster, detect, emotion, matching, prepare
from skeinwork.operators import subgraphs as S
from skeinwork.plans.subgraph_queries import _MATCHES, _STRUCTURE, _VERDICT, _feature_rows, _members, prototypes
from skeinwork.plans.text_queries import _MEASURED, COMPOSITE, _measured, aggressive
from skeinwork.plans.views import NODES, SUBGRAPHS, nodes, read, subgraphs
from skeinwork.storage import Stash

RELATIONS = ("comment_contains_word", "user_interacts_user", "user_posts_comment", "video_contains_comment")
KINDS = ("comment", "user", "word", "video")


def _comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comments of each subgraph with their measures."""
    m = _measured(spark, sf_dir).select(F.col("id").alias("cid"), "user_id", "share", "hits", "upper", "n_words", F.char_length("comment_text").alias("chars"), "marks", F.regexp_count("comment_text", F.lit(r"\?")).alias("questions"))
    return _members(spark, sf_dir).where("type = 'comment'").join(m, F.col("id") == F.col("cid")).drop("cid", "type")


def subgraph_text_emotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggression of a subgraph's comments weighted by their words."""
    texts = nodes(spark, sf_dir).where("trim(comment_text) <> ''").select("id", "comment_text")
    scored = emotion.text_emotion(texts, "id", "comment_text", "comment_text").select(F.col("id").alias("cid"), "comment_text", "aggression_score")
    rows = _members(spark, sf_dir).where("type = 'comment'").join(scored, F.col("id") == F.col("cid"))
    g = emotion.group_emotion(rows, "subgraph_id", "comment_text", "aggression_score")
    return g.select("subgraph_id", F.round("score", 6).alias("score"), "texts")


def attack_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attacking comments of each subgraph: by shares and capitals, and by an aggression score above 0.3."""
    c = _comments(spark, sf_dir).groupBy("subgraph_id").agg(F.count_if(B.is_attack(F.col("share"), F.col("upper"), F.col("hits"))).alias("by_rule"))
    e = emotion.text_emotion(nodes(spark, sf_dir), "id", "comment_text").where("aggression_score > 0.3").select(F.col("id").alias("cid"))
    s = _members(spark, sf_dir).where("type = 'comment'").join(e, F.col("id") == F.col("cid")).groupBy("subgraph_id").agg(F.count("*").alias("by_score"))
    return c.join(s, "subgraph_id", "left").na.fill(0, ["by_score"])


def _bullying(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = subgraphs(spark, sf_dir, "nodes", "emotion_score").select("subgraph_id", "session_no", "emotion_score", S.count_of(F.col("nodes"), "comment").alias("n_comment"))
    attacks = _comments(spark, sf_dir).groupBy("subgraph_id").agg(F.count_if(B.is_attack(F.col("share"), F.col("upper"), F.col("hits"))).alias("attacks"))
    s = s.join(attacks, "subgraph_id", "left").na.fill(0, ["attacks"])
    return s.withColumn("kept", F.coalesce((F.col("emotion_score") <= 0.4) & (F.col("n_comment") >= 1) & (F.col("attacks") >= 1), F.lit(False)))


def bullying_subgraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subgraphs with a score of at most 0.4, a comment, and an attacking one among them."""
    return _bullying(spark, sf_dir).where("kept").select("subgraph_id", "n_comment", "attacks")


def bullying_filter_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per session: subgraphs, those kept, and their share."""
    g = _bullying(spark, sf_dir).where("session_no IS NOT NULL").groupBy("session_no").agg(F.count("*").alias("subgraphs"), F.count_if("kept").alias("kept"))
    return g.withColumn("ratio", F.round(F.col("kept") / F.col("subgraphs"), 6))


_BUNDLE = ("avg_length", "avg_words", "avg_share", "max_share", "negative_ratio", "negative_intensity", "aggression_score")


def _bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    relations = F.size(F.filter(F.coalesce(F.map_values("edges"), F.array().cast("array<array<struct<src:bigint,dst:bigint>>>")), lambda e: F.size(e) > 0))
    s = subgraphs(spark, sf_dir, "nodes", "edges")
    st = S.structure(s.withColumn("n_relations", F.when(F.col("edges").isNull(), 0).otherwise(relations)), "subgraph_id", "session_no", "n_relations")
    b = B.comment_bundle(_comments(spark, sf_dir), "subgraph_id")
    j = st.join(b, "subgraph_id", "left").na.fill(0, [*_BUNDLE, "n"])
    return j.withColumn("intensity", B.intensity(F.col("aggression_score"), F.col("negative_intensity"), F.col("n_user"), F.col("n_nodes")))


def subgraph_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and scores of the comments of each subgraph, and its intensity."""
    return _bundles(spark, sf_dir).select("subgraph_id", *[F.round(c, 6).alias(c) for c in (*_BUNDLE, "intensity")])


def vector_23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure, counts by type, emotion, aggression and intensity as 23 columns; the share of attack words
    among words is 0, as words have no table here."""
    b = _bundles(spark, sf_dir)
    types = sum(((F.col(f"n_{t}") > 0).cast("int") for t in KINDS[1:]), (F.col("n_comment") > 0).cast("int"))
    values = ["n_nodes", "n_edges", "density", types, "n_relations", "n_user", "n_comment", "n_word", "n_video", "avg_length", "avg_words", "avg_share", "negative_ratio", "negative_intensity", "n",
              "avg_length", "avg_words", "avg_share", "max_share", "negative_ratio", "aggression_score", F.lit(0.0), "intensity"]
    return b.select("subgraph_id", *[F.round((F.col(v) if isinstance(v, str) else v).cast("double"), 6).alias(f"f{i}") for i, v in enumerate(values)])


def vector_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, score, counts and shares by type, edges, their density over whole pairs, and the session's number modulo 100."""
    s = subgraphs(spark, sf_dir, "nodes", "edges", "emotion_score")
    st = S.structure(s, "subgraph_id", "session_no", "emotion_score")
    n = F.col("n_nodes")
    ratio = lambda t: F.coalesce(F.col(f"n_{t}") / F.nullif(n, F.lit(0)), F.lit(0.0))
    pairs = F.when(n > 1, F.floor(n * (n - 1) / 2)).otherwise(1)
    values = [n, F.coalesce("emotion_score", F.lit(0.0)), *[F.col(f"n_{t}") for t in KINDS], *[ratio(t) for t in KINDS], F.col("n_edges"), F.col("n_edges") / pairs, F.coalesce(F.col("session_no") % 100, F.lit(0))]
    return st.select("subgraph_id", *[F.round(v.cast("double"), 6).alias(f"f{i}") for i, v in enumerate(values)])


def _vector_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = subgraphs(spark, sf_dir, "nodes", "edges", "subgraph_type", "extracted_at")
    st = S.structure(s, "subgraph_id", "session_no", "subgraph_type", "extracted_at")
    verdicts = prepare.label_verdicts(read(spark, sf_dir, "session_labels")).select("session_no", F.col("is_bullying").alias("label"))
    j = st.join(verdicts, "session_no")
    n, e = F.col("n_nodes"), F.col("n_edges")
    values = [n, *[F.col(f"n_{t}") for t in KINDS], e, e / F.greatest(n, F.lit(1)), F.col("label"), F.coalesce((F.col("subgraph_type") == "complete_enumeration").cast("int"), F.lit(0)), F.coalesce(F.hour("extracted_at") / 24, F.lit(0.0))]
    return j.select("subgraph_id", "session_no", "label", F.array(*[v.cast("double") for v in values]).alias("x"))


def vector_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, counts by type, edges, edges for a node, the session's verdict, the kind and the hour of the day."""
    return _vector_10(spark, sf_dir).select("subgraph_id", *[F.round(F.col("x")[i], 6).alias(f"f{i}") for i in range(10)])


def typed_emotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of subgraphs by type of node; a subgraph's users are the authors of its comments."""
    c = _comments(spark, sf_dir)
    m = _measured(spark, sf_dir)
    attacks = aggressive(m).where("user_id IS NOT NULL").groupBy("user_id").agg(F.count("*").alias("attacks"))
    users = c.where("user_id IS NOT NULL").select("subgraph_id", "user_id").distinct().join(attacks, "user_id", "left").na.fill(0, ["attacks"])
    counts = subgraphs(spark, sf_dir, "nodes").select("subgraph_id", S.count_of(F.col("nodes"), "word").alias("n_word"), S.count_of(F.col("nodes"), "video").alias("n_other"))
    return B.typed_emotion(c, users, counts, "subgraph_id").select("subgraph_id", F.round("score", 6).alias("score"))


def size_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = subgraphs(spark, sf_dir, "nodes").select(F.size(S.node_list(F.col("nodes"))).alias("n"))
    return s.groupBy(B.size_class(F.col("n")).alias("size_class")).agg(F.count("*").alias("subgraphs"), F.round(F.avg("n"), 6).alias("mean_size"))


def prototype_qualities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of the size bins as prototypes, by size, intensity, consistency and number of nodes."""
    b = _bundles(spark, sf_dir).select((F.floor(F.col("n_nodes") / 2) * 2).cast("int").alias("bin"), "intensity", F.col("aggression_score").alias("aggression"), "n_nodes")
    q = B.prototype_quality(b, "bin")
    return q.select("bin", "size", F.round("quality", 6).alias("quality"))


def cluster_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, score and weight of the members of each size bin, and its positive sessions' share."""
    s = S.structure(subgraphs(spark, sf_dir, "nodes", "edges", "emotion_score"), "subgraph_id", "session_no", "emotion_score")
    verdicts = prepare.label_verdicts(read(spark, sf_dir, "session_labels")).select("session_no", F.col("is_bullying").alias("label"))
    j = s.join(verdicts, "session_no").select(F.floor(F.col("n_nodes") / 4).cast("int").alias("bin"), F.col("n_nodes").alias("size"), F.coalesce("emotion_score", F.lit(0.0)).alias("emotion"), F.when(F.col("label") == 1, 1.5).otherwise(1.0).alias("weight"), "label")
    stats = [f(c).alias(f"{c}_{n}") for c in ("size", "emotion", "weight") for n, f in (("mean", F.avg), ("deviation", F.stddev_pop), ("least", F.min), ("greatest", F.max))]
    g = j.groupBy("bin").agg(F.count("*").alias("members"), *stats, F.count_if(F.col("label") == 1).alias("positive"))
    names = [f"{c}_{n}" for c in ("size", "emotion", "weight") for n in ("mean", "deviation", "least", "greatest")]
    return g.select("bin", "members", *[F.round(F.col(n).cast("double"), 6).alias(n) for n in names], "positive", F.round(F.col("positive") / F.col("members"), 6).alias("positive_ratio"))


def prototype_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five sessions with most members of each prototype: a top-k report."""
    from skeinwork.operators.sampling import top_per_group

    rows = _feature_rows(spark, sf_dir).groupBy("bin", "session_no").agg(F.count("*").alias("members"))
    top = top_per_group(rows, ["bin"], [F.col("members").desc(), F.col("session_no")], 5)
    return top.join(prototypes(spark, sf_dir).select("prototype", F.col("cluster").alias("bin")), "bin").select("prototype", "session_no", "members")


def dbscan_standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive sessions' subgraphs by their ten features without the verdict, scaled: clusters by DBSCAN."""
    v = _vector_10(spark, sf_dir).where("label = 1").withColumn("x", F.concat(F.slice("x", 1, 7), F.slice("x", 9, 2)))
    return cluster.standardised_dbscan(v, "subgraph_id", "x", 9, 0.5, 5)


def refined_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features times weight clustered by DBSCAN, then parts by size, then by score and aggression."""
    weight, score = F.when(F.col("label") == 1, 1.5).otherwise(1.0), F.coalesce("emotion_score", F.lit(0.0))
    rows = _feature_rows(spark, sf_dir, "emotion_score").select("subgraph_id", "x", weight.alias("w"), F.col("n_nodes").alias("size"), score.alias("score"), F.greatest(F.lit(0.0), -score).alias("aggression"))
    rows = Stash(spark, "weighted").put(rows)
    first = cluster.weighted_dbscan(rows, "subgraph_id", "x", 6, "w", 0.8, 5)
    named = first.join(rows.select("subgraph_id", "size", "score", "aggression"), "subgraph_id")
    second = cluster.refined(named, "subgraph_id", "cluster", ["size"], 0.5, 3, 10, ("score", "aggression"))
    return cluster.refined(second, "subgraph_id", "cluster", ["score", "aggression"], 0.3, 2, 8)


_COMMENT_FEATURES = ("chars", "n_words", "marks", "questions", "upper", "hits", "share")
_USER_FEATURES = ("comments", "posts", "verified", "name_length", "constant")


def _user_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir).where("user_id IS NOT NULL")
    return n.groupBy("user_id").agg(F.count("*").alias("comments"), F.count_distinct("post_id").alias("posts"), F.max(F.coalesce(F.col("verified").cast("int"), F.lit(0))).alias("verified"), F.max(F.coalesce(F.char_length("username"), F.lit(0))).alias("name_length"), F.lit(1).alias("constant"))


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per subgraph: counts of nodes by type and edges by relation, means of its comments' and users' features, score."""
    s = subgraphs(spark, sf_dir, "nodes", "edges", "emotion_score").where("session_no IS NOT NULL")
    size = lambda r: F.coalesce(F.size(F.array_distinct(F.element_at("edges", F.lit(r)))), F.lit(0))
    base = s.select("subgraph_id", "session_no", "emotion_score", *[S.count_of(F.col("nodes"), t).alias(f"n_{t}") for t in KINDS], *[size(r).alias(f"e_{r}") for r in RELATIONS])
    c = _comments(spark, sf_dir)
    means = c.groupBy("subgraph_id").agg(F.array(*[F.avg(f).cast("double") for f in _COMMENT_FEATURES]).alias("cx"))
    u = c.where("user_id IS NOT NULL").select("subgraph_id", "user_id").distinct().join(_user_facts(spark, sf_dir), "user_id")
    users = u.groupBy("subgraph_id").agg(F.array(*[F.avg(f).cast("double") for f in _USER_FEATURES]).alias("ux"))
    return base.join(means, "subgraph_id", "left").join(users, "subgraph_id", "left")


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every subgraph beside the medoid of every prototype (15 at most)."""
    p = _profiles(spark, sf_dir)
    top = prototypes(spark, sf_dir).select("prototype", F.col("medoid").alias("subgraph_id")).join(p, "subgraph_id")
    top = top.select("prototype", *[F.col(c).alias(f"p_{c}") for c in p.columns if c not in ("subgraph_id", "session_no")])
    return p.join(F.broadcast(top), how="cross")  # 15 prototypes


def _shape(prefix: str, names) -> F.Column:
    return matching.shares([F.col(f"{prefix}{n}") for n in names])


def _similar(a, b):
    """Cosine of share vectors, 0 where one has no entries."""
    return F.coalesce(V.dot(a, b) / F.nullif(V.norm(a) * V.norm(b), F.lit(0.0)), F.lit(0.0))


def _full_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _compared(spark, sf_dir)
    n, e = [f"n_{t}" for t in KINDS], [f"e_{r}" for r in RELATIONS]
    structural = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.6 * _similar(_shape("", n), _shape("p_", n)) + 0.4 * _similar(_shape("", e), _shape("p_", e))))
    sims = F.array_compact(F.array(F.when(F.col("cx").isNotNull() & F.col("p_cx").isNotNull(), matching.feature_similarity(F.col("cx"), F.col("p_cx"), 17.0)), F.when(F.col("ux").isNotNull() & F.col("p_ux").isNotNull(), matching.feature_similarity(F.col("ux"), F.col("p_ux"), 10.0))))
    feature = F.coalesce(F.aggregate(sims, F.lit(0.0), lambda x, y: x + y) / F.nullif(F.size(sims), F.lit(0)), F.lit(0.0))
    near = lambda t: F.when(F.greatest(F.col(f"n_{t}"), F.col(f"p_n_{t}")) > 0, 1 - F.abs(F.col(f"n_{t}") - F.col(f"p_n_{t}")) / F.greatest(F.col(f"n_{t}"), F.col(f"p_n_{t}"))).otherwise(0.0)
    layered = 0.5 * near("comment") + 0.3 * near("user") + 0.2 * near("word")
    rows = both.select("subgraph_id", "session_no", "prototype", structural.alias("structural"), feature.alias("feature"), layered.alias("layered"))
    return rows.withColumn("similarity", 0.5 * F.col("structural") + 0.3 * F.col("feature") + 0.2 * F.col("layered"))


def full_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural, feature and layered similarity of every subgraph to every prototype, and their blend."""
    return _full_matches(spark, sf_dir).select("subgraph_id", "prototype", *[F.round(c, 6).alias(c) for c in ("structural", "feature", "layered", "similarity")])


def profile_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emotion profiles against the prototypes': cosine, and by scores and counts of comments."""
    both = _compared(spark, sf_dir)
    a, b = B.profile(F.col("emotion_score"), F.col("n_comment")), B.profile(F.col("p_emotion_score"), F.col("p_n_comment"))
    rows = both.select("subgraph_id", "prototype", a.alias("a"), b.alias("b"), B.layered_emotion(F.col("emotion_score"), F.col("p_emotion_score"), F.col("n_comment"), F.col("p_n_comment")).alias("layered"))
    return rows.select("subgraph_id", "prototype", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), _similar(F.col("a"), F.col("b")))), 6).alias("profile"), F.round("layered", 6).alias("layered"))


def _detection_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``session_no, feature, value``: five values a prototype, means and maxima of the comments' features, means
    of the users', and totals of the subgraphs."""
    m = matching.session_match(_full_matches(spark, sf_dir), "session_no")
    named = [("best", "best"), ("mean", "mean"), ("deviation", "deviation"), ("hits", "hits"), ("share", "share")]
    entry = lambda name, value: F.struct(name.alias("feature"), value.cast("double").alias("value"))
    per = m.select("session_no", F.inline(F.array(*[entry(F.concat(F.lit("p"), F.col("prototype").cast("string"), F.lit(f"_{n}")), F.col(c)) for n, c in named])))
    c = _comments(spark, sf_dir).where("session_no IS NOT NULL")
    facts = c.groupBy("session_no").agg(*[F.avg(f).alias(f"m_{f}") for f in _COMMENT_FEATURES], *[F.max(f).alias(f"x_{f}") for f in _COMMENT_FEATURES], F.avg((F.col("hits") + F.col("share")) / 2).alias("attack_mean"), F.greatest(F.max("hits"), F.max("share")).alias("attack_most"), F.count("*").alias("comments"))
    per_comment = facts.select("session_no", F.inline(F.array(*[entry(F.lit(n), F.col(n)) for n in facts.columns[1:]])))
    u = c.where("user_id IS NOT NULL").select("session_no", "subgraph_id", "user_id").distinct().join(_user_facts(spark, sf_dir).withColumnRenamed("comments", "own"), "user_id")
    users = u.groupBy("session_no").agg(*[F.avg(f).alias(f"u_{f}") for f in ("own", "posts", "verified", "name_length")], F.count("*").alias("users"))
    per_user = users.select("session_no", F.inline(F.array(*[entry(F.lit(n), F.col(n)) for n in users.columns[1:]])))
    st = S.structure(subgraphs(spark, sf_dir, "nodes", "edges"), "subgraph_id", "session_no").where("session_no IS NOT NULL")
    totals = st.groupBy("session_no").agg(F.count("*").alias("subgraphs"), *[F.sum(f"n_{t}").alias(f"total_{t}") for t in ("comment", "user", "word")], F.sum("n_edges").alias("total_edges"), *[F.avg(f"n_{t}").alias(f"mean_{t}") for t in ("comment", "user", "word")], F.avg("n_edges").alias("mean_edges"))
    per_total = totals.select("session_no", F.inline(F.array(*[entry(F.lit(n), F.col(n)) for n in totals.columns[1:]])))
    return per.unionByName(per_comment).unionByName(per_user).unionByName(per_total)


def session_detection_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The named features that sessions are classified by."""
    return _detection_features(spark, sf_dir).select("session_no", "feature", F.round("value", 6).alias("value"))


def detection_feature_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detection_features(spark, sf_dir).groupBy("feature").agg(F.count("*").alias("sessions"))


def grid_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest and a regression by those features, each with the best of a grid in five folds; the rest predicted."""
    f = Stash(spark, "features").put(_detection_features(spark, sf_dir))
    vectors = f.groupBy("session_no").agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("m"))  # fewer than 150 features
    names = sorted(r["feature"] for r in f.select("feature").distinct().limit(1001).collect())
    truth = prepare.label_verdicts(read(spark, sf_dir, "session_labels")).select("session_no", F.col("is_bullying").alias("label"))
    rows = vectors.join(truth, "session_no").select("session_no", "label", F.array(*[F.coalesce(F.element_at("m", F.lit(n)), F.lit(0.0)) for n in names]).alias("x"))
    return detect.evaluate_grid(rows, "session_no", "label", "x")


QUERIES = {
    f.__name__: f
    for f in (
        subgraph_text_emotion, attack_comments, bullying_subgraphs, bullying_filter_ratio, subgraph_bundles, vector_23, vector_13, vector_10, typed_emotion, size_classes, prototype_qualities, cluster_statistics,
        prototype_sessions, dbscan_standardised, refined_clusters, full_similarity, profile_similarity, session_detection_features, detection_feature_names, grid_detect,
    )
}

_CM = f"""{_MEASURED}, {SUBGRAPHS},
cm AS (SELECT el.subgraph_id, el.session_no, ms.id, ms.user_id, share, hits, upper, n_words, marks, length(comment_text) AS chars, length(regexp_replace(comment_text, '[^?]', '', 'g')) AS questions FROM el JOIN ms ON ms.id = el.id WHERE kind = 'comment')"""
_ST = "ec AS" + _STRUCTURE.split("\nec AS", 1)[1]
_FULL = f"{_CM}, {_ST}, {_VERDICT}"
_BU = """rl AS (SELECT subgraph_id, count(DISTINCT rel) AS n_relations FROM ed GROUP BY 1),
bb AS (SELECT subgraph_id, avg(chars) AS avg_length, avg(n_words) AS avg_words, avg(share) AS avg_share, max(share) AS max_share, avg((hits > 0)::INT) AS negative_ratio, avg(chars / 50 + 5 * share + (hits > 0)::INT) AS negative_intensity,
  count(*) AS n, avg(chars / 20 + 10 * share + 2 * (hits > 0)::INT) AS aggression_score FROM cm GROUP BY 1),
bn AS (SELECT sx.*, coalesce(n_relations, 0) AS n_relations, coalesce(avg_length, 0) AS avg_length, coalesce(avg_words, 0) AS avg_words, coalesce(avg_share, 0) AS avg_share, coalesce(max_share, 0) AS max_share, coalesce(negative_ratio, 0) AS negative_ratio,
  coalesce(negative_intensity, 0) AS negative_intensity, coalesce(n, 0) AS n, coalesce(aggression_score, 0) AS aggression_score FROM sx LEFT JOIN rl USING (subgraph_id) LEFT JOIN bb USING (subgraph_id)),
bi AS (SELECT *, 0.4 * least(aggression_score / 5, 1) + 0.3 * least(negative_intensity / 3, 1) + CASE WHEN n_user > 1 THEN 0.2 * least(n_user / 10, 1) ELSE 0 END + CASE WHEN n_nodes > 10 THEN 0.1 * least((n_nodes - 10) / 50, 1) ELSE 0 END AS intensity FROM bn)"""
_BUL = "bl AS (SELECT s.subgraph_id, s.session_no, n_comment, coalesce(a, 0) AS attacks, coalesce(emotion_score <= 0.4 AND n_comment >= 1 AND a >= 1, false) AS kept FROM s JOIN sx USING (subgraph_id) LEFT JOIN (SELECT subgraph_id, count(*) FILTER (share > 0.1 OR upper > 0.3 OR hits >= 2) AS a FROM cm GROUP BY 1) x USING (subgraph_id))"
_COLS = lambda values: ", ".join(f"round(({v})::DOUBLE, 6) AS f{i}" for i, v in enumerate(values))
_DIST = lambda a, b, n, width: "greatest(0.0, 1 - sqrt(" + " + ".join(f"({a}[{i}] - {b}[{i}]) * ({a}[{i}] - {b}[{i}])" for i in range(1, n + 1)) + f") / {width})"


def _cosine(a: list[str], b: list[str]) -> str:
    dot = " + ".join(f"{x} * {y}" for x, y in zip(a, b))
    length = lambda v: "sqrt(" + " + ".join(f"{x} * {x}" for x in v) + ")"
    return f"coalesce(({dot}) / nullif({length(a)} * {length(b)}, 0), 0)"


_N, _E = [f"n_{t}" for t in KINDS], [f"e_{r}" for r in RELATIONS]
_NEAR = lambda t: f"(CASE WHEN greatest(n_{t}, p_n_{t}) > 0 THEN 1 - abs(n_{t} - p_n_{t}) / greatest(n_{t}, p_n_{t}) ELSE 0 END)"
_PROFILES = f"""{_MATCHES}, {_MEASURED.split('WITH ', 1)[1]},
cm AS (SELECT el.subgraph_id, el.session_no, ms.id, ms.user_id, share, hits, upper, n_words, marks, length(comment_text) AS chars, length(regexp_replace(comment_text, '[^?]', '', 'g')) AS questions FROM el JOIN ms ON ms.id = el.id WHERE kind = 'comment'),
uf AS (SELECT user_id, count(*) AS own, count(DISTINCT post_id) AS posts, max(coalesce(verified::INT, 0)) AS verified, max(coalesce(length(username), 0)) AS name_length FROM n WHERE user_id IS NOT NULL GROUP BY user_id),
xa AS (SELECT subgraph_id, [avg(chars), avg(n_words), avg(marks), avg(questions), avg(upper), avg(hits), avg(share)] AS cx FROM cm GROUP BY 1),
xb AS (SELECT subgraph_id, [avg(own), avg(posts), avg(verified), avg(name_length), 1.0] AS ux FROM (SELECT DISTINCT subgraph_id, user_id FROM cm WHERE user_id IS NOT NULL) JOIN uf USING (user_id) GROUP BY 1),
xe AS (SELECT subgraph_id, """ + ", ".join(f"count(*) FILTER (rel = '{r}') AS e_{r}" for r in RELATIONS) + """ FROM ed GROUP BY 1),
pf AS (SELECT sx.subgraph_id, sx.session_no, emotion_score, n_comment, n_user, n_word, n_video, """ + ", ".join(f"coalesce({e}, 0) AS {e}" for e in _E) + """, cx, ux FROM sx JOIN s USING (subgraph_id) LEFT JOIN xe USING (subgraph_id) LEFT JOIN xa USING (subgraph_id) LEFT JOIN xb USING (subgraph_id) WHERE sx.session_no IS NOT NULL),
pq AS (SELECT prototype, """ + ", ".join(f"{c} AS p_{c}" for c in ("emotion_score", *_N, *_E, "cx", "ux")) + f""" FROM pr JOIN md USING (bin) JOIN pf ON pf.subgraph_id = md.medoid),
fm0 AS (SELECT subgraph_id, session_no, prototype, greatest(0.0, least(1.0, 0.6 * {_cosine(_N, ['p_' + c for c in _N])} + 0.4 * {_cosine(_E, ['p_' + c for c in _E])})) AS structural,
  CASE WHEN cx IS NOT NULL AND p_cx IS NOT NULL THEN {_DIST('cx', 'p_cx', 7, 17.0)} END AS fc, CASE WHEN ux IS NOT NULL AND p_ux IS NOT NULL THEN {_DIST('ux', 'p_ux', 5, 10.0)} END AS fu,
  0.5 * {_NEAR('comment')} + 0.3 * {_NEAR('user')} + 0.2 * {_NEAR('word')} AS layered, emotion_score, p_emotion_score, n_comment, p_n_comment FROM pf, pq),
fm1 AS (SELECT *, coalesce((coalesce(fc, 0) + coalesce(fu, 0)) / nullif((fc IS NOT NULL)::INT + (fu IS NOT NULL)::INT, 0), 0) AS feature FROM fm0),
fm AS (SELECT *, 0.5 * structural + 0.3 * feature + 0.2 * layered AS similarity FROM fm1)"""  # fmt: skip
_PV = lambda s, c: [f"coalesce({s}, CASE WHEN {c} > 3 THEN -0.3 ELSE -0.1 END)"] * 3 + [f"(CASE WHEN {s} IS NULL THEN 0.1 ELSE 0 END)", f"(CASE WHEN {s} IS NULL THEN CASE WHEN {c} > 3 THEN 0.7 ELSE 0.3 END WHEN {s} < 0 THEN 1 ELSE 0 END)", f"(CASE WHEN {s} IS NULL THEN CASE WHEN {c} > 5 THEN 0.2 ELSE 0 END WHEN {s} < -0.5 THEN 1 ELSE 0 END)"]
_LONG = lambda source, names: " UNION ALL ".join(f"SELECT session_no, '{n}' AS feature, ({n})::DOUBLE AS value FROM {source}" for n in names)
_CF = [*[f"m_{f}" for f in _COMMENT_FEATURES], *[f"x_{f}" for f in _COMMENT_FEATURES], "attack_mean", "attack_most", "comments"]
_DETECTION = f"""{_PROFILES},
sp AS (SELECT session_no, prototype, max(similarity) AS best, avg(similarity) AS mean, stddev_pop(similarity) AS deviation, count(*) FILTER (similarity > 0.5) AS hits, count(*) FILTER (similarity > 0.5) / count(*) AS share FROM fm GROUP BY 1, 2),
sc AS (SELECT session_no, """ + ", ".join(f"avg({f}) AS m_{f}, max({f}) AS x_{f}" for f in _COMMENT_FEATURES) + f""", avg((hits + share) / 2) AS attack_mean, greatest(max(hits), max(share)) AS attack_most, count(*) AS comments FROM cm WHERE session_no IS NOT NULL GROUP BY 1),
su AS (SELECT session_no, avg(own) AS u_own, avg(posts) AS u_posts, avg(verified) AS u_verified, avg(name_length) AS u_name_length, count(*) AS users FROM (SELECT DISTINCT session_no, subgraph_id, user_id FROM cm WHERE user_id IS NOT NULL AND session_no IS NOT NULL) JOIN uf USING (user_id) GROUP BY 1),
sg AS (SELECT session_no, count(*) AS subgraphs, sum(n_comment) AS total_comment, sum(n_user) AS total_user, sum(n_word) AS total_word, sum(n_edges) AS total_edges, avg(n_comment) AS mean_comment, avg(n_user) AS mean_user, avg(n_word) AS mean_word, avg(n_edges) AS mean_edges
  FROM sx WHERE session_no IS NOT NULL GROUP BY 1),
df AS (""" + " UNION ALL ".join(f"SELECT session_no, 'p' || prototype || '_{n}' AS feature, ({n})::DOUBLE AS value FROM sp" for n in ("best", "mean", "deviation", "hits", "share")) + f""" UNION ALL {_LONG('sc', _CF)} UNION ALL {_LONG('su', ['u_own', 'u_posts', 'u_verified', 'u_name_length', 'users'])}
  UNION ALL {_LONG('sg', ['subgraphs', 'total_comment', 'total_user', 'total_word', 'total_edges', 'mean_comment', 'mean_user', 'mean_word', 'mean_edges'])})"""  # fmt: skip
_TYPES = " + ".join(f"(n_{t} > 0)::INT" for t in KINDS)
_RATIOS = [f"CASE WHEN n_nodes > 0 THEN n_{t} / n_nodes ELSE 0 END" for t in KINDS]
_STATS = ", ".join(f"round(({f}({c}))::DOUBLE, 6) AS {c}_{n}" for c in ("size", "emotion", "weight") for n, f in (("mean", "avg"), ("deviation", "stddev_pop"), ("least", "min"), ("greatest", "max")))

SQL = {
    "subgraph_text_emotion": f"""WITH {NODES}, {COMPOSITE}, {SUBGRAPHS}, tw AS (SELECT el.subgraph_id, aggression_score AS a, len(list_filter(regexp_split_to_array(trim(comment_text), '\\s+'), lambda y: y <> '')) AS w FROM el JOIN em ON em.id = el.id JOIN n ON n.id = el.id WHERE kind = 'comment' AND trim(comment_text) <> '')
SELECT subgraph_id, round(least(1.0, CASE WHEN sum(w) > 0 THEN sum(w * a) / sum(w) ELSE avg(a) END), 6) AS score, count(*) AS texts FROM tw GROUP BY 1""",
    "attack_comments": f"""{_CM}, {COMPOSITE.replace('t AS (SELECT id, i', 'tt AS (SELECT id, i').replace('FROM t)', 'FROM tt)').replace('FROM t WHERE', 'FROM tt WHERE')}, hi AS (SELECT el.subgraph_id, count(*) AS by_score FROM el JOIN em ON em.id = el.id WHERE kind = 'comment' AND aggression_score > 0.3 GROUP BY 1)
SELECT cm.subgraph_id, count(*) FILTER (share > 0.1 OR upper > 0.3 OR hits >= 2) AS by_rule, coalesce(any_value(by_score), 0) AS by_score FROM cm LEFT JOIN hi USING (subgraph_id) GROUP BY 1""",
    "bullying_subgraphs": f"{_FULL}, {_BUL} SELECT subgraph_id, n_comment, attacks FROM bl WHERE kept",
    "bullying_filter_ratio": f"{_FULL}, {_BUL} SELECT session_no, count(*) AS subgraphs, count(*) FILTER (kept) AS kept, round(count(*) FILTER (kept) / count(*), 6) AS ratio FROM bl WHERE session_no IS NOT NULL GROUP BY 1",
    "subgraph_bundles": f"{_FULL}, {_BU} SELECT subgraph_id, " + ", ".join(f"round(({c})::DOUBLE, 6) AS {c}" for c in (*_BUNDLE, "intensity")) + " FROM bi",
    "vector_23": f"{_FULL}, {_BU} SELECT subgraph_id, " + _COLS(["n_nodes", "n_edges", "density", _TYPES, "n_relations", "n_user", "n_comment", "n_word", "n_video", "avg_length", "avg_words", "avg_share", "negative_ratio", "negative_intensity", "n", "avg_length", "avg_words", "avg_share", "max_share", "negative_ratio", "aggression_score", "0", "intensity"]) + " FROM bi",
    "vector_13": f"{_FULL} SELECT subgraph_id, " + _COLS(["n_nodes", "coalesce(emotion_score, 0)", *_N, *_RATIOS, "n_edges", "n_edges / CASE WHEN n_nodes > 1 THEN n_nodes * (n_nodes - 1) // 2 ELSE 1 END", "coalesce(s.session_no % 100, 0)"]) + " FROM sx JOIN s USING (subgraph_id)",
    "vector_10": f"{_FULL} SELECT subgraph_id, " + _COLS(["n_nodes", *_N, "n_edges", "n_edges / greatest(n_nodes, 1)", "label", "coalesce((subgraph_type = 'complete_enumeration')::INT, 0)", "coalesce(hour(extracted_at) / 24, 0)"]) + " FROM sx JOIN s USING (subgraph_id) JOIN lab ON lab.session_no = sx.session_no",
    "typed_emotion": f"""{_FULL}, ag AS (SELECT user_id, count(*) AS attacks FROM ms WHERE user_id IS NOT NULL AND (hits > 0 OR share > 0.01 OR (length(comment_text) > 50 AND n_words > 8) OR length(comment_text) > 80) GROUP BY 1),
tu AS (SELECT subgraph_id, coalesce(attacks, 0) AS a FROM (SELECT DISTINCT subgraph_id, user_id FROM cm WHERE user_id IS NOT NULL) LEFT JOIN ag USING (user_id)),
ta AS (SELECT subgraph_id, count(*) AS nu, avg(CASE WHEN a = 0 THEN 0 WHEN a <= 2 THEN -0.3 * a WHEN a <= 5 THEN -0.6 - 0.2 * (a - 2) ELSE -1.5 - 0.1 * least(a - 5, 10) END) AS su FROM tu GROUP BY 1),
tc AS (SELECT subgraph_id, count(*) AS nc, avg(-(2 * share + (hits > 0)::INT)) AS sc FROM cm GROUP BY 1),
tx AS (SELECT subgraph_id, n_word, n_video, coalesce(nc, 0) AS nc, coalesce(sc, 0) AS sc, coalesce(nu, 0) AS nu, coalesce(su, 0) AS su FROM sx LEFT JOIN tc USING (subgraph_id) LEFT JOIN ta USING (subgraph_id))
SELECT subgraph_id, round(coalesce((0.4 * nc * sc + 0.3 * nu * su - 0.04 * n_word) / nullif(0.4 * nc + 0.3 * nu + 0.2 * n_word + 0.1 * n_video, 0), 0), 6) AS score FROM tx""",
    "size_classes": f"{_FULL} SELECT CASE WHEN n_nodes <= 12 THEN 'compact' WHEN n_nodes <= 21 THEN 'balanced' ELSE 'extensive' END AS size_class, count(*) AS subgraphs, round(avg(n_nodes), 6) AS mean_size FROM sx GROUP BY 1",
    "prototype_qualities": f"""{_FULL}, {_BU}, qz AS (SELECT (n_nodes // 2 * 2)::INT AS bin, count(*) AS size, avg(intensity) AS i, greatest(0.0, 1 - stddev_pop(aggression_score) / (avg(aggression_score) + 1e-6)) AS c, avg(n_nodes) AS n FROM bi GROUP BY 1)
SELECT bin, size, round(0.25 * least(size / 10, 1) + 0.35 * i + 0.25 * c + 0.15 * CASE WHEN n BETWEEN 30 AND 60 THEN 1.0 WHEN n < 30 THEN n / 30 ELSE greatest(0.1, 1 - (n - 60) / 40) END, 6) AS quality FROM qz""",
    "cluster_statistics": f"""{_FULL}, cs AS (SELECT (n_nodes // 4)::INT AS bin, n_nodes AS size, coalesce(emotion_score, 0) AS emotion, CASE WHEN label = 1 THEN 1.5 ELSE 1.0 END AS weight, label FROM sx JOIN s USING (subgraph_id) JOIN lab ON lab.session_no = sx.session_no)
SELECT bin, count(*) AS members, {_STATS}, count(*) FILTER (label = 1) AS positive, round(count(*) FILTER (label = 1) / count(*), 6) AS positive_ratio FROM cs GROUP BY bin""",
    "prototype_sessions": _MATCHES + ", pb AS (SELECT bin, session_no, count(*) AS members FROM fx GROUP BY 1, 2), pk AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY members DESC, session_no) AS rn FROM pb) SELECT prototype, session_no, members FROM pk JOIN pr USING (bin) WHERE rn <= 5",
    "full_similarity": f"{_PROFILES} SELECT subgraph_id, prototype, round(structural, 6) AS structural, round(feature, 6) AS feature, round(layered, 6) AS layered, round(similarity, 6) AS similarity FROM fm",
    "profile_similarity": f"""{_PROFILES} SELECT subgraph_id, prototype, round(greatest(0.0, least(1.0, {_cosine(_PV('emotion_score', 'n_comment'), _PV('p_emotion_score', 'p_n_comment'))})), 6) AS profile,
  round(coalesce(((CASE WHEN coalesce(emotion_score, 0) <> 0 OR coalesce(p_emotion_score, 0) <> 0 THEN 0.8 * (1 - least(abs(coalesce(emotion_score, 0) - coalesce(p_emotion_score, 0)) / 2, 1)) ELSE 0 END) + (CASE WHEN greatest(n_comment, p_n_comment) > 0 THEN 0.2 * {_NEAR('comment')} ELSE 0 END))
    / nullif((CASE WHEN coalesce(emotion_score, 0) <> 0 OR coalesce(p_emotion_score, 0) <> 0 THEN 0.8 ELSE 0 END) + (CASE WHEN greatest(n_comment, p_n_comment) > 0 THEN 0.2 ELSE 0 END), 0), 0), 6) AS layered FROM fm""",
    "session_detection_features": f"{_DETECTION} SELECT session_no, feature, round(value, 6) AS value FROM df",
    "detection_feature_names": f"{_DETECTION} SELECT feature, count(*) AS sessions FROM df GROUP BY 1",
}
