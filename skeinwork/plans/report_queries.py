"""Queries on session mappings, alignment reports, user similarities, video relations and older session features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinwork.operators import bundles as B
from skeinwork.operators import enumeration as E
from skeinwork.operators import hetero, matching, prepare, search
from skeinwork.operators import subgraphs as S
from skeinwork.operators.enumeration import drawn
from skeinwork.operators.sampling import stratified_split
from skeinwork.plans.enumeration_queries import _SESSIONS, _drawn, _sessions, _sources, _targets
from skeinwork.plans.prototype_queries import _CM, _FULL, _PROFILES, _PV, _comments, _compared, _cosine, _similar
from skeinwork.plans.session_queries import _SHARES
from skeinwork.plans.subgraph_queries import _MATCHES, _matches, _members
from skeinwork.plans.text_queries import _MEASURED, _measured
from skeinwork.plans.views import LABELS, NODES, SUBGRAPHS, VIDEOS, nodes, post_labels, read, subgraphs


def comment_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first session that holds each comment."""
    m = _members(spark, sf_dir).where("type = 'comment' AND session_no IS NOT NULL")
    return m.groupBy(F.col("id").alias("comment")).agg(F.min("session_no").alias("session_no"), F.count_distinct("session_no").alias("sessions"))


def user_comment_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with two comments or more: their comments, posts and sessions."""
    first = comment_sessions(spark, sf_dir).select(F.col("comment").alias("id"), "session_no")
    n = nodes(spark, sf_dir).where("user_id IS NOT NULL").join(first, "id", "left")
    return n.groupBy("user_id").agg(F.count("*").alias("comments"), F.count_distinct("post_id").alias("posts"), F.count_distinct("session_no").alias("sessions")).where("comments >= 2")


def graph_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per session whether its graph has nodes and edges."""
    s = _sessions(spark, sf_dir)
    n, e = sum((F.size(t) for t in list(E.CAPS)[1:]), F.size("comment")), sum((F.size(r) for r in list(E.RELATIONS)[1:]), F.size("user_posts_comment"))
    return s.select("session", n.alias("nodes"), e.alias("edges"), ((n > 0) & (e > 0)).alias("valid"))


def undirected_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by the types of their ends, whichever way they point."""
    s = _sessions(spark, sf_dir)
    parts = [s.select(F.lit("-".join(sorted(ends))).alias("relation"), F.size(r).alias("n")) for r, ends in E.RELATIONS.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("relation").agg(F.sum("n").alias("edges"), F.count_if(F.col("n") > 0).alias("sessions"))


def relation_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed density of each session over its relations: edges over the pairs their types allow."""
    s = _sessions(spark, sf_dir)
    pairs = {r: F.size(a) * (F.size(b) - (1 if a == b else 0)) for r, (a, b) in E.RELATIONS.items()}
    room, edges = sum(list(pairs.values())[1:], list(pairs.values())[0]), sum((F.size(r) for r in list(pairs)[1:]), F.size(list(pairs)[0]))
    return s.select("session", F.round(F.coalesce(edges / F.nullif(room, F.lit(0)), F.lit(0.0)), 6).alias("density"))


def session_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per session: comments and users of its subgraphs, attack shares and lengths of the comments."""
    c = _comments(spark, sf_dir).where("session_no IS NOT NULL").select("session_no", "id", "user_id", "share", "chars").distinct()
    g = c.groupBy("session_no").agg(F.count("*").alias("comments"), F.count_distinct("user_id").alias("users"), F.avg("share").alias("a"), F.max("share").alias("b"), F.avg("chars").alias("c"), F.stddev_pop("chars").alias("d"), F.min("chars").alias("shortest"))
    return g.select("session_no", "comments", "users", F.round("a", 6).alias("mean_share"), F.round("b", 6).alias("max_share"), F.round("c", 6).alias("mean_chars"), F.round("d", 6).alias("deviation_chars"), "shortest")


def first_comment_subgraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per session a subgraph of ten nodes around its first comment: its users, its words, then other comments."""
    s = _sessions(spark, sf_dir).where("size(comment) > 0").withColumn("seed", F.col("comment")[0])
    own = F.array_sort(F.array_distinct(F.transform(F.filter("user_posts_comment", lambda e: e["dst"] == F.col("seed")), lambda e: e["src"])))
    said = F.array_sort(F.array_distinct(F.transform(F.filter("comment_contains_word", lambda e: e["src"] == F.col("seed")), lambda e: e["dst"])))
    s = s.withColumn("u", F.slice(own, 1, 3)).withColumn("w", F.slice(said, 1, 5)).withColumn("v", F.slice("video", 1, 1))
    s = s.withColumn("c", F.slice("comment", 1, F.greatest(F.lit(1), 10 - F.size("u") - F.size("w") - F.size("v"))))
    listed = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))
    return s.select("session", "seed", listed("c").alias("comments"), listed("u").alias("users"), listed("v").alias("videos"), listed("w").alias("words"), (F.size("c") + F.size("u") + F.size("v") + F.size("w")).alias("size"))


def extraction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten sessions with most subgraphs, with their sizes and share of all: a top-k report."""
    s = subgraphs(spark, sf_dir, "nodes").where("session_no IS NOT NULL").select("session_no", F.size(S.node_list(F.col("nodes"))).alias("n"))
    g = s.groupBy("session_no").agg(F.count("*").alias("subgraphs"), F.avg("n").alias("mean"), F.min("n").alias("least"), F.max("n").alias("greatest"))
    total = g.agg(F.sum("subgraphs").alias("total"))
    top = g.orderBy(F.col("subgraphs").desc(), "session_no").limit(10)
    return top.join(F.broadcast(total), how="cross").select("session_no", "subgraphs", F.round("mean", 6).alias("mean"), "least", "greatest", F.round(F.col("subgraphs") / F.col("total"), 6).alias("share"))  # one row


def target_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A size for each comment of subgraphs, drawn by hash: one of three bands of 6 to 30, then a size in it."""
    m = _members(spark, sf_dir).where("type = 'comment'").select("id").distinct()
    key = F.col("id").cast("string")
    band = drawn(F.lit(3), "band", key)
    size = F.when(band == 0, 6 + drawn(F.lit(7), "size", key)).when(band == 1, 13 + drawn(F.lit(9), "size", key)).otherwise(22 + drawn(F.lit(9), "size", key))
    return m.select("id", size.alias("size"))


def stored_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts keep the split stored for them; those without one (a fifth, by hash) are split anew."""
    p = post_labels(spark, sf_dir).groupBy("post_id").agg(F.max("label").alias("label"))
    fresh = stratified_split(p, "post_id", "label", {"train": 0.7, "validation": 0.2, "test": 0.1})
    stored = fresh.where(F.substring(F.md5("post_id"), 1, 1).cast("string") >= "3")
    missing = p.join(stored, "post_id", "left_anti")
    again = stratified_split(missing, "post_id", "label", {"train": 0.7, "validation": 0.2, "test": 0.1})
    return stored.select("post_id", "split", F.lit(True).alias("stored")).unionByName(again.select("post_id", "split", F.lit(False).alias("stored")))


def alignment_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row on all sessions aligned: predictions and the distribution of the best similarity."""
    a = matching.aligner_features(_matches(spark, sf_dir), "session_no")
    g = a.agg(F.count("*").alias("aligned"), F.sum("predicted").alias("positive"), F.sum(1 - F.col("predicted")).alias("negative"), F.min("best").alias("least"), F.max("best").alias("greatest"), F.avg("best").alias("mean"), F.stddev_pop("best").alias("deviation"), F.median("best").alias("median"))
    return g.select("aligned", "positive", "negative", *[F.round(c, 6).alias(c) for c in ("least", "greatest", "mean", "deviation", "median")])


def representative_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment over at most five subgraphs a session, those spread evenly in order: 0.7 best + 0.3 mean a prototype."""
    m = _matches(spark, sf_dir)
    order = Window.partitionBy("session_no").orderBy("subgraph_id")
    ids = m.select("session_no", "subgraph_id").distinct().withColumns({"i": F.row_number().over(order) - 1, "n": F.count("*").over(Window.partitionBy("session_no"))})
    spaced = F.exists(F.sequence(F.lit(0), F.lit(4)), lambda k: F.floor(k * F.col("n") / 5) == F.col("i"))
    chosen = ids.where((F.col("n") <= 5) | spaced).select("session_no", "subgraph_id")
    per = m.join(chosen, ["session_no", "subgraph_id"]).groupBy("session_no", "prototype").agg((0.7 * F.max("similarity") + 0.3 * F.avg("similarity")).alias("s"))
    g = per.groupBy("session_no").agg(F.max("s").alias("best"))
    return g.select("session_no", F.round("best", 6).alias("best"), F.when(F.col("best") >= 0.6, "bullying").otherwise("normal").alias("prediction"))


def _activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _measured(spark, sf_dir).where("user_id IS NOT NULL AND post_id IS NOT NULL").join(post_labels(spark, sf_dir), "post_id", "left")
    posts = m.groupBy("user_id", "post_id").agg(F.count("*").alias("n"), F.avg(F.char_length("comment_text")).alias("l"), F.avg(F.coalesce("label", F.lit(0))).alias("b"), F.avg(F.least(F.lit(1.0), 3 * F.col("share"))).alias("s"), F.avg("share").alias("a"))
    users = posts.groupBy("user_id").agg(F.array(*[F.avg(c).cast("double") for c in ("n", "l", "b", "s", "a")]).alias("vector"))
    return users.withColumn("vec_id", F.xxhash64("user_id"))


def user_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over posts of a user's comments, their length, the post's verdict, score and attack share."""
    return _activity(spark, sf_dir).select("user_id", *[F.round(F.col("vector")[i], 6).alias(n) for i, n in enumerate(("comments", "length", "verdict", "score", "share"))])


def similar_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose number is divisible by 50 against all others: cosine of their activity above 0.6."""
    a = _activity(spark, sf_dir).withColumn("uid", F.regexp_extract("user_id", r"(\d+)$", 1)).where("uid <> ''").select("user_id", F.col("uid").cast("decimal(38,0)").alias("uid"), "vector")
    found = search.similar_totals(a.where("uid % 50 = 0").select("user_id", "vector"), a.select("user_id", "vector"), "user_id", "vector", 0.6)
    return found.select(F.col("query_id").alias("user_id"), "similar", F.round(F.col("total") / F.col("similar"), 5).alias("mean_cosine"))


def segment_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a label in order, in segments of ten, as frames of a video: mean of each segment, and frames a unit of its length."""
    order = Window.partitionBy("label").orderBy("vec_id")
    e = read(spark, sf_dir, "embeddings").withColumn("segment", F.floor((F.row_number().over(order) - 1) / 10).cast("int"))
    g = e.groupBy("label", "segment").agg(F.count("*").alias("frames"), *[F.avg(F.col("embedding")[i]).alias(f"m{i}") for i in range(4)], (F.count("*") / (F.max("vec_id") - F.min("vec_id") + 1)).alias("rate"))
    return g.select("label", "segment", "frames", *[F.round(f"m{i}", 6).alias(f"m{i}") for i in range(4)], F.round("rate", 6).alias("rate"))


# Actions that go with emotions.
_ACTIONS = [("angry", "aggressive"), ("fear", "defensive"), ("happy", "gesturing"), ("sad", "static"), ("surprise", "moving"), ("neutral", "speaking")]


def video_action_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos to the actions their free columns name, moving above five entries in those, else static."""
    v = prepare.videos(read(spark, sf_dir, "video_posts"))
    words = F.lower(F.concat_ws(" ", "column1", "column2"))
    scores = F.create_map(*[x for n, p in (("aggressive", "fight|hit|punch"), ("gesturing", "danc|wave|gestur"), ("speaking", "talk|sing|speak")) for x in (F.lit(n), words.rlike(p).cast("double"))])
    fallback = F.when(F.size(F.filter(F.split(words, r"[\s,;|]+"), lambda w: w != "")) > 5, "moving").otherwise("static")
    return hetero.element_edges(v, "url", scores, 0.3, fallback).select("url", F.col("element").alias("action"))


def video_scene_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos to the scenes their free columns name; indoor where none is."""
    v = prepare.videos(read(spark, sf_dir, "video_posts"))
    words = F.lower(F.concat_ws(" ", "column1", "column2"))
    scores = F.create_map(*[x for n, p in (("outdoor", "outdoor|park|street|beach"), ("school", "school|class"), ("home", "home|house|kitchen")) for x in (F.lit(n), words.rlike(p).cast("double"))])
    return hetero.element_edges(v, "url", scores, 0.3, F.lit("indoor")).select("url", F.col("element").alias("scene"))


def mood_action_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed pairs of moods and actions that both occur among the videos."""
    from skeinwork.plans.media_queries import video_mood_edges

    pairs = spark.createDataFrame(_ACTIONS, "mood string, action string")
    moods = video_mood_edges(spark, sf_dir).groupBy("mood").agg(F.count("*").alias("videos"))
    actions = video_action_edges(spark, sf_dir).select("action").distinct()
    return moods.join(F.broadcast(pairs), "mood").join(actions, "action", "left_semi").select("mood", "action", "videos")  # six rows


def session_profile_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by emotion profiles against the prototypes: similarities over all and the preferred prototype,
    sizes and edges of its subgraphs, and the distribution of their scores (guessed where none has one)."""
    both = _compared(spark, sf_dir)
    n, e = [f"n_{t}" for t in ("comment", "user", "word", "video")], [f"e_{r}" for r in E.RELATIONS]
    shares = lambda p, names: matching.shares([F.col(f"{p}{c}") for c in names])
    structural = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.6 * _similar(shares("", n), shares("p_", n)) + 0.4 * _similar(shares("", e), shares("p_", e))))
    a, b = B.profile(F.col("emotion_score"), F.col("n_comment")), B.profile(F.col("p_emotion_score"), F.col("p_n_comment"))
    profile = F.greatest(F.lit(0.0), F.least(F.lit(1.0), _similar(a, b)))
    layered = B.layered_emotion(F.col("emotion_score"), F.col("p_emotion_score"), F.col("n_comment"), F.col("p_n_comment"))
    m = both.select("session_no", "prototype", (0.5 * structural + 0.3 * profile + 0.2 * layered).alias("s"))
    s = F.round("s", 9)
    total = m.groupBy("session_no").agg(F.max("s").alias("best"), F.avg("s").alias("mean"), F.stddev_pop("s").alias("deviation"), (F.count_if(F.col("s") > 0.5) / F.count("*")).alias("above_half"), (F.count_if(F.col("s") > 0.7) / F.count("*")).alias("above_most"), F.max(F.struct(s.alias("s"), (-F.col("prototype")).alias("p"))).alias("top"))
    st = S.structure(subgraphs(spark, sf_dir, "nodes", "edges", "emotion_score"), "subgraph_id", "session_no", "emotion_score").where("session_no IS NOT NULL")
    score = F.when(F.col("emotion_score") != 0, F.col("emotion_score"))
    many = F.avg("n_comment")
    g = st.groupBy("session_no").agg(
        F.count("*").alias("subgraphs"), F.avg("n_nodes").alias("mean_nodes"), F.avg("n_edges").alias("mean_edges"), (F.sum("n_edges") / F.nullif(F.sum("n_nodes"), F.lit(0))).alias("edges_a_node"), F.min("n_nodes").alias("least_nodes"), F.max("n_nodes").alias("most_nodes"),
        F.stddev_pop("n_nodes").alias("deviation_nodes"), F.coalesce(F.avg(score), F.when(many > 3, -0.3).otherwise(-0.1)).alias("mean_score"), F.coalesce(F.stddev_pop(score), F.lit(0.1)).alias("deviation_score"),
        F.coalesce(F.avg((score < 0).cast("int")), F.when(many > 3, 0.7).otherwise(0.3)).alias("negative"), F.coalesce(F.avg((score < -0.5).cast("int")), F.when(many > 5, 0.2).otherwise(0.0)).alias("very_negative"),
    )
    j = total.join(g, "session_no")
    names = ["best", "mean", "deviation", "above_half", "above_most", "mean_nodes", "mean_edges", "edges_a_node", "deviation_nodes", "mean_score", "deviation_score", "negative", "very_negative"]
    return j.select("session_no", (-F.col("top.p")).alias("preferred"), "subgraphs", "least_nodes", "most_nodes", *[F.round(c, 9).alias(c) for c in names])


QUERIES = {
    f.__name__: f
    for f in (
        comment_sessions, user_comment_map, graph_validity, undirected_relations, relation_density, session_summaries, first_comment_subgraphs, extraction_report, target_sizes, stored_split, alignment_statistics,
        representative_alignment, user_activity, similar_activity, segment_means, video_action_edges, video_scene_edges, mood_action_edges, session_profile_features,
    )
}

_FIRST = "fs AS (SELECT id AS comment, min(session_no) AS session_no, count(DISTINCT session_no) AS sessions FROM el WHERE kind = 'comment' AND session_no IS NOT NULL GROUP BY 1)"
_LEN = {r: f"len({r})" for r in E.RELATIONS}
_ROOM = "(len(user) * len(comment) + len(comment) * len(word) + len(video) * len(comment) + len(user) * (len(user) - 1))"
_ALIGN = _MATCHES + ", ps AS (SELECT session_no, prototype, 0.7 * max(similarity) + 0.3 * avg(similarity) AS s FROM mt GROUP BY 1, 2), al AS (SELECT session_no, max(s) AS best FROM ps GROUP BY 1)"
_ACT = f"""{_MEASURED}, {VIDEOS}, {LABELS}, ap AS (SELECT user_id, ms.post_id, count(*) AS n, avg(length(comment_text)) AS l, avg(coalesce(label, 0)) AS b, avg(least(1.0, 3 * share)) AS s, avg(share) AS a FROM ms LEFT JOIN pl ON pl.post_id = ms.post_id
  WHERE user_id IS NOT NULL AND ms.post_id IS NOT NULL GROUP BY 1, 2),
av AS (SELECT user_id, avg(n) AS n, avg(l) AS l, avg(b) AS b, avg(s) AS s, avg(a) AS a FROM ap GROUP BY 1)"""
_WORDS_OF = "SELECT url, lower(concat_ws(' ', column1, column2)) AS t FROM v"
_NAMED = lambda pairs, last, name: " UNION ALL ".join(f"SELECT url, '{n}' AS {name} FROM tw WHERE regexp_matches(t, '{p}')" for n, p in pairs) + f" UNION ALL SELECT url, {last} FROM tw WHERE NOT regexp_matches(t, '{'|'.join(p for _, p in pairs)}')"
_ACTION = _NAMED((("aggressive", "fight|hit|punch"), ("gesturing", "danc|wave|gestur"), ("speaking", "talk|sing|speak")), r"CASE WHEN len(list_filter(regexp_split_to_array(t, '[\s,;|]+'), lambda y: y <> '')) > 5 THEN 'moving' ELSE 'static' END", "action")
_STRUCT = f"greatest(0.0, least(1.0, 0.6 * {_cosine([f'n_{t}' for t in ('comment', 'user', 'word', 'video')], [f'p_n_{t}' for t in ('comment', 'user', 'word', 'video')])} + 0.4 * {_cosine([f'e_{r}' for r in E.RELATIONS], [f'p_e_{r}' for r in E.RELATIONS])}))"
_LAYER = """coalesce(((CASE WHEN coalesce(emotion_score, 0) <> 0 OR coalesce(p_emotion_score, 0) <> 0 THEN 0.8 * (1 - least(abs(coalesce(emotion_score, 0) - coalesce(p_emotion_score, 0)) / 2, 1)) ELSE 0 END)
    + (CASE WHEN greatest(n_comment, p_n_comment) > 0 THEN 0.2 * (1 - abs(n_comment - p_n_comment) / greatest(n_comment, p_n_comment)) ELSE 0 END))
  / nullif((CASE WHEN coalesce(emotion_score, 0) <> 0 OR coalesce(p_emotion_score, 0) <> 0 THEN 0.8 ELSE 0 END) + (CASE WHEN greatest(n_comment, p_n_comment) > 0 THEN 0.2 ELSE 0 END), 0), 0)"""
_POST_SPLIT = "row_number() OVER (PARTITION BY label ORDER BY md5(post_id || '|42'), post_id) AS r, count(*) OVER (PARTITION BY label) AS n"

SQL = {
    "comment_sessions": f"WITH {SUBGRAPHS}, {_FIRST} SELECT * FROM fs",
    "user_comment_map": f"WITH {NODES}, {SUBGRAPHS}, {_FIRST} SELECT user_id, count(*) AS comments, count(DISTINCT post_id) AS posts, count(DISTINCT session_no) AS sessions FROM n LEFT JOIN fs ON fs.comment = n.id WHERE user_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 2",
    "graph_validity": f"{_SESSIONS} SELECT session, (len(comment) + len(user) + len(video) + len(word))::INT AS nodes, ({' + '.join(_LEN.values())})::INT AS edges, len(comment) + len(user) + len(video) + len(word) > 0 AND {' + '.join(_LEN.values())} > 0 AS valid FROM ss",
    "undirected_relations": f"{_SESSIONS}, ur AS (" + " UNION ALL ".join(f"SELECT '{'-'.join(sorted(ends))}' AS relation, len({r}) AS n FROM ss" for r, ends in E.RELATIONS.items()) + ") SELECT relation, sum(n)::BIGINT AS edges, count(*) FILTER (n > 0) AS sessions FROM ur GROUP BY 1",
    "relation_density": f"{_SESSIONS} SELECT session, round(coalesce(({' + '.join(_LEN.values())}) / nullif({_ROOM}, 0), 0), 6) AS density FROM ss",
    "session_summaries": f"""{_CM}, sd AS (SELECT DISTINCT session_no, id, user_id, share, chars FROM cm WHERE session_no IS NOT NULL)
SELECT session_no, count(*) AS comments, count(DISTINCT user_id) AS users, round(avg(share), 6) AS mean_share, round(max(share), 6) AS max_share, round(avg(chars), 6) AS mean_chars, round(stddev_pop(chars), 6) AS deviation_chars, min(chars)::INT AS shortest FROM sd GROUP BY 1""",
    "first_comment_subgraphs": f"""{_SESSIONS}, f0 AS (SELECT *, comment[1] AS seed FROM ss WHERE len(comment) > 0), f1 AS (SELECT *, {_sources('user_posts_comment', '[seed]')}[1:3] AS u, {_targets('comment_contains_word', '[seed]')}[1:5] AS w, video[1:1] AS v FROM f0),
f2 AS (SELECT *, comment[1:greatest(1, 10 - len(u) - len(w) - len(v))] AS c FROM f1)
SELECT session, seed, array_to_string(c, ',') AS comments, array_to_string(u, ',') AS users, array_to_string(v, ',') AS videos, array_to_string(w, ',') AS words, (len(c) + len(u) + len(v) + len(w))::INT AS size FROM f2""",
    "extraction_report": f"{_FULL}, er AS (SELECT session_no, count(*) AS subgraphs, avg(n_nodes) AS mean, min(n_nodes) AS least, max(n_nodes) AS greatest FROM sx WHERE session_no IS NOT NULL GROUP BY 1) SELECT session_no, subgraphs, round(mean, 6) AS mean, least, greatest, round(subgraphs / (SELECT sum(subgraphs) FROM er), 6) AS share FROM er ORDER BY subgraphs DESC, session_no LIMIT 10",
    "target_sizes": f"WITH {SUBGRAPHS}, ts AS (SELECT DISTINCT id FROM el WHERE kind = 'comment'), tb AS (SELECT id, {_drawn('3', "'band|' || id")} AS band FROM ts) SELECT id, (CASE band WHEN 0 THEN 6 + {_drawn('7', "'size|' || id")} WHEN 1 THEN 13 + {_drawn('9', "'size|' || id")} ELSE 22 + {_drawn('9', "'size|' || id")} END)::INT AS size FROM tb",
    "stored_split": f"""WITH {VIDEOS}, {LABELS}, p AS (SELECT post_id, max(label) AS label FROM pl GROUP BY post_id), r AS (SELECT post_id, label, {_POST_SPLIT} FROM p), a AS (SELECT post_id, label, {_SHARES.format(b='0.7 + 0.2')} FROM r),
st AS (SELECT post_id, split FROM a WHERE substr(md5(post_id), 1, 1) >= '3'), q AS (SELECT * FROM p WHERE post_id NOT IN (SELECT post_id FROM st)), z AS (SELECT post_id, {_POST_SPLIT} FROM q)
SELECT post_id, split, true AS stored FROM st UNION ALL SELECT post_id, {_SHARES.format(b='0.7 + 0.2')}, false FROM z""",
    "alignment_statistics": f"{_ALIGN} SELECT count(*) AS aligned, sum((best >= 0.6)::INT)::BIGINT AS positive, sum((best < 0.6)::INT)::BIGINT AS negative, round(min(best), 6) AS least, round(max(best), 6) AS greatest, round(avg(best), 6) AS mean, round(stddev_pop(best), 6) AS deviation, round(median(best), 6) AS median FROM al",
    "representative_alignment": f"""{_MATCHES}, ra AS (SELECT session_no, subgraph_id, row_number() OVER (PARTITION BY session_no ORDER BY subgraph_id) - 1 AS i, count(*) OVER (PARTITION BY session_no) AS n FROM (SELECT DISTINCT session_no, subgraph_id FROM mt)),
rb AS (SELECT session_no, subgraph_id FROM ra WHERE n <= 5 OR i IN (0, n // 5, 2 * n // 5, 3 * n // 5, 4 * n // 5)), rc AS (SELECT session_no, prototype, 0.7 * max(similarity) + 0.3 * avg(similarity) AS s FROM mt JOIN rb USING (session_no, subgraph_id) GROUP BY 1, 2)
SELECT session_no, round(max(s), 6) AS best, CASE WHEN max(s) >= 0.6 THEN 'bullying' ELSE 'normal' END AS prediction FROM rc GROUP BY 1""",
    "user_activity": f"{_ACT} SELECT user_id, round(n, 6) AS comments, round(l, 6) AS length, round(b, 6) AS verdict, round(s, 6) AS score, round(a, 6) AS share FROM av",
    "similar_activity": f"""{_ACT}, aw AS (SELECT *, sqrt(n * n + l * l + b * b + s * s + a * a) AS z FROM av WHERE regexp_matches(user_id, '\\d$')),
ax AS (SELECT q.user_id, (q.n * w.n + q.l * w.l + q.b * w.b + q.s * w.s + q.a * w.a) / (q.z * w.z + 1e-8) AS c FROM aw q JOIN aw w ON w.user_id <> q.user_id WHERE regexp_extract(q.user_id, '(\\d+)$', 1)::HUGEINT % 50 = 0)
SELECT user_id, count(*) AS similar, round(avg(c), 5) AS mean_cosine FROM ax WHERE c > 0.6 GROUP BY 1""",
    "segment_means": "WITH o AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 10 AS segment FROM embeddings) SELECT label, segment::INT AS segment, count(*) AS frames, " + ", ".join(f"round(avg(embedding[{i + 1}]::DOUBLE), 6) AS m{i}" for i in range(4)) + ", round(count(*) / (max(vec_id) - min(vec_id) + 1), 6) AS rate FROM o GROUP BY 1, 2",
    "video_action_edges": f"WITH {VIDEOS}, tw AS ({_WORDS_OF}) {_ACTION}",
    "video_scene_edges": f"WITH {VIDEOS}, tw AS ({_WORDS_OF}) " + _NAMED((("outdoor", "outdoor|park|street|beach"), ("school", "school|class"), ("home", "home|house|kitchen")), "'indoor'", "scene"),
    "mood_action_edges": f"""WITH {VIDEOS}, tw AS ({_WORDS_OF}), ac AS ({_ACTION}), mo AS ({_NAMED((("happy", "happy|excited|fun"), ("sad", "sad|cry"), ("angry", "angry|mad")), "'neutral'", "mood")}),
pa(mood, action) AS (VALUES ('angry', 'aggressive'), ('fear', 'defensive'), ('happy', 'gesturing'), ('sad', 'static'), ('surprise', 'moving'), ('neutral', 'speaking'))
SELECT pa.mood, pa.action, count(*) AS videos FROM mo JOIN pa USING (mood) WHERE pa.action IN (SELECT action FROM ac) GROUP BY 1, 2""",
    "session_profile_features": f"""{_PROFILES.replace('n_comment, p_n_comment FROM pf, pq', 'n_comment, p_n_comment, n_user, n_word, n_video, p_n_user, p_n_word, p_n_video, ' + ', '.join(f'e_{r}, p_e_{r}' for r in E.RELATIONS) + ' FROM pf, pq')},
sm AS (SELECT session_no, prototype, 0.5 * {_STRUCT} + 0.3 * greatest(0.0, least(1.0, {_cosine(_PV('emotion_score', 'n_comment'), _PV('p_emotion_score', 'p_n_comment'))})) + 0.2 * {_LAYER} AS s FROM fm0),
sa AS (SELECT session_no, max(s) AS best, avg(s) AS mean, stddev_pop(s) AS deviation, count(*) FILTER (s > 0.5) / count(*) AS above_half, count(*) FILTER (s > 0.7) / count(*) AS above_most FROM sm GROUP BY 1),
sq0 AS (SELECT session_no, prototype AS preferred FROM (SELECT *, row_number() OVER (PARTITION BY session_no ORDER BY round(s, 9) DESC, prototype) AS rn FROM sm) WHERE rn = 1),
sb AS (SELECT sx.session_no, count(*) AS subgraphs, avg(n_nodes) AS mean_nodes, avg(n_edges) AS mean_edges, sum(n_edges) / nullif(sum(n_nodes), 0) AS edges_a_node, min(n_nodes) AS least_nodes, max(n_nodes) AS most_nodes, stddev_pop(n_nodes) AS deviation_nodes,
  coalesce(avg(nullif(emotion_score, 0)), CASE WHEN avg(n_comment) > 3 THEN -0.3 ELSE -0.1 END) AS mean_score, coalesce(stddev_pop(nullif(emotion_score, 0)), 0.1) AS deviation_score, coalesce(avg((nullif(emotion_score, 0) < 0)::INT), CASE WHEN avg(n_comment) > 3 THEN 0.7 ELSE 0.3 END) AS negative,
  coalesce(avg((nullif(emotion_score, 0) < -0.5)::INT), CASE WHEN avg(n_comment) > 5 THEN 0.2 ELSE 0 END) AS very_negative FROM sx JOIN s USING (subgraph_id) WHERE sx.session_no IS NOT NULL GROUP BY 1)
SELECT sa.session_no, preferred, subgraphs, least_nodes, most_nodes, """ + ", ".join(f"round({c}, 9) AS {c}" for c in ["best", "mean", "deviation", "above_half", "above_most", "mean_nodes", "mean_edges", "edges_a_node", "deviation_nodes", "mean_score", "deviation_score", "negative", "very_negative"]) + " FROM sa JOIN sb USING (session_no) JOIN sq0 USING (session_no)",  # fmt: skip
}
