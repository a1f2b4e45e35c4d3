"""Queries on subgraphs, their scores, clusters, prototypes and matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.functions import vectors as V
from skeinwork.operators import cluster, detect, matching, prepare, scoring, search
from skeinwork.operators import subgraphs as S
from skeinwork.plans.graph_queries import _REPLIES, reply_edges
from skeinwork.plans.text_queries import _MEASURED, _measured
from skeinwork.plans.views import NODES, SUBGRAPHS, nodes, read, subgraphs
from skeinwork.sources.writers import subgraph_index


def subgraph_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.structure(subgraphs(spark, sf_dir, "nodes", "edges"))
    return s.withColumns({"density": F.round("density", 6), "diversity": F.round("diversity", 6)})


def subgraph_edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges counted truly, and as twice the number of relations that have any."""
    return subgraphs(spark, sf_dir, "edges").select("subgraph_id", S.edge_count(F.col("edges")).alias("n_edges"), S.edge_count_compat(F.col("edges")).alias("n_edges_compat"))


def subgraph_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.dedupe(subgraphs(spark, sf_dir, "nodes"))


def subgraph_dedupe_untyped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.dedupe(subgraphs(spark, sf_dir, "nodes"), typed=False)


def subgraph_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.validity(subgraphs(spark, sf_dir, "nodes", "subgraph_type")).select("subgraph_id", "subgraph_type")


def subgraph_connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.connected_share(subgraphs(spark, sf_dir, "edges")).withColumn("share", F.round("share", 6))


def subgraph_type_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = subgraphs(spark, sf_dir, "nodes", "subgraph_type").withColumn("n", F.size(S.node_list(F.col("nodes"))))
    return s.groupBy("subgraph_type", "n").agg(F.count("*").alias("subgraphs"), F.count_distinct("session_no").alias("sessions"))


def subgraph_session_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = subgraphs(spark, sf_dir, "nodes").where("session_no IS NOT NULL").select(F.col("session_no").alias("session_id"), F.size(S.node_list(F.col("nodes"))).alias("total_nodes"))
    return subgraph_index(s).withColumn("mean_size", F.round("mean_size", 6))


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``subgraph_id, session_no, type, id``: the distinct nodes of each subgraph."""
    s = subgraphs(spark, sf_dir, "nodes")
    e = s.select("subgraph_id", "session_no", F.explode(F.map_entries("nodes")).alias("e")).select("subgraph_id", "session_no", F.col("e.key").alias("type"), F.explode("e.value").alias("id"))
    return e.where("id IS NOT NULL").distinct()


def capped_session_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 50 comments, 8 users and 25 words of a session, by hash: a sampling operator."""
    m = _members(spark, sf_dir).where("session_no IS NOT NULL").select(F.col("session_no").alias("session"), "type", "id").distinct()
    return S.capped_nodes(m, {"comment": 50, "user": 8, "word": 25})


def induced_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each subgraph, the edges of its session with both ends among its nodes."""
    return S.induced_counts(subgraphs(spark, sf_dir, "nodes", "edges"))


def user_pair_subgraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of users of a post that reply to each other's comments."""
    return S.session_user_pairs(read(spark, sf_dir, "comment_nodes").where("post_id IS NOT NULL AND user_id IS NOT NULL"), reply_edges(spark, sf_dir))


def composition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compositions by type of sizes 4 to 8 that each session's nodes can fill."""
    return _filled(spark, sf_dir, S.compositions(spark, 4, 8, {"comment": 6, "user": 4, "video": 1, "word": 5}))


def every_composition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for sizes 6 to 15, with as many comments, users and words as the size leaves room for."""
    return _filled(spark, sf_dir, S.every_composition(spark))


def _filled(spark: SparkSession, sf_dir: str, c: DataFrame) -> DataFrame:
    m = _members(spark, sf_dir).where("session_no IS NOT NULL").select("session_no", "type", "id").distinct()
    have = m.groupBy("session_no").agg(*[F.count_if(F.col("type") == t).alias(f"h_{t}") for t in S.TYPES])
    fits = have.join(F.broadcast(c), (F.col("n_comment") <= F.col("h_comment")) & (F.col("n_user") <= F.col("h_user")) & (F.col("n_video") <= F.col("h_video")) & (F.col("n_word") <= F.col("h_word")))
    return fits.groupBy("session_no", "size").agg(F.count("*").alias("compositions"))


def sliding_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir).select("post_id", "id").where("post_id IS NOT NULL")
    return S.sliding_comments(n, 3).select("post_id", "start", F.concat_ws(",", F.col("ids").cast("array<string>")).alias("ids"))


def _grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _measured(spark, sf_dir)
    tag = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    posts = m.where("user_id IS NOT NULL").select(tag("user", "user_id").alias("a"), tag("comment", "id").alias("b"))
    words = m.select(tag("comment", "id").alias("a"), F.explode("words").alias("w")).select("a", tag("word", "w").alias("b"))
    talk = reply_edges(spark, sf_dir).select(tag("user", "src").alias("a"), tag("user", "dst").alias("b"))
    seeds = m.where("hits >= 2").select(tag("comment", "id").alias("seed"))
    return S.grow(seeds, posts.unionByName(words).unionByName(talk), 12, "extensive")


def greedy_growth_subgraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each comment with two attack words, a subgraph of up to 12 nodes grown over replies and words."""
    return _grown(spark, sf_dir).select("seed", F.concat_ws(",", "nodes").alias("nodes"), F.size("nodes").alias("size"))


def incremental_subgraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same at every size from 4 to 12."""
    return S.at_each_size(_grown(spark, sf_dir), 4, 12).select("seed", "size", F.concat_ws(",", "nodes").alias("nodes"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subgraph scores from the attack shares of their comments and users, and the number of their words."""
    m = _measured(spark, sf_dir).select(F.col("id").alias("cid"), "user_id", "share", "hits")
    mem = _members(spark, sf_dir)
    comment = mem.where("type = 'comment'").join(m, F.col("id") == F.col("cid"))
    c = comment.groupBy("subgraph_id").agg(F.lit("comment").alias("type"), F.count("*").alias("n"), F.avg(scoring.comment_score(F.col("share"))).alias("score"))
    per_user = comment.where("user_id IS NOT NULL").groupBy("subgraph_id", "user_id").agg((F.count_if(F.col("hits") > 0) / F.count("*")).alias("attack"))
    u = per_user.groupBy("subgraph_id").agg(F.lit("user").alias("type"), F.count("*").alias("n"), F.avg(scoring.user_score(F.col("attack"))).alias("score"))
    w = mem.where("type = 'word'").groupBy("subgraph_id").agg(F.lit("word").alias("type"), F.count("*").alias("n")).withColumn("score", scoring.word_score(F.col("n")))
    return scoring.subgraph_score(c.unionByName(u).unionByName(w), "subgraph_id")


def subgraph_emotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("subgraph_id", F.round("score", 6).alias("score"), "n")


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scoring.sweep(read(spark, sf_dir, "subgraph").select("subgraph_id", "emotion_score").distinct(), "emotion_score", [-0.5, -0.45, -0.4, -0.35, -0.3])
    return s.withColumn("share_above", F.round("share_above", 6))


def negative_subgraph_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per session: subgraphs, those below -0.4, and their share."""
    s = subgraphs(spark, sf_dir, "emotion_score").where("session_no IS NOT NULL AND emotion_score IS NOT NULL")
    g = s.groupBy("session_no").agg(F.count("*").alias("subgraphs"), F.count_if(F.col("emotion_score") < -0.4).alias("kept"))
    return g.withColumn("share", F.round(F.col("kept") / F.col("subgraphs"), 6))


def emotion_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skeinwork.operators.users import population

    p = population(subgraphs(spark, sf_dir, "emotion_score", "subgraph_type"), "emotion_score", "subgraph_type")
    return p.select("subgraph_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "deviation", "least", "greatest", "median")])


def size_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.size_bins(subgraphs(spark, sf_dir, "nodes").withColumn("n", F.size(S.node_list(F.col("nodes")))), "n").withColumn("bin", F.col("bin").cast("int"))


def tertile_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = subgraphs(spark, sf_dir, "emotion_score").where("emotion_score IS NOT NULL").select("subgraph_id", "emotion_score")
    return cluster.quantile_bins(s, "emotion_score", [0.33, 0.67]).select("subgraph_id", "bin")


def _feature_rows(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """``subgraph_id, session_no, label, bin, x``: structural features, the session's verdict, size bin.  With
    columns of the subgraphs to keep, also these and ``n_nodes``."""
    s = subgraphs(spark, sf_dir, "nodes", "edges", *keep)
    f = S.structure(s, "subgraph_id", "session_no", *keep)
    verdicts = prepare.label_verdicts(read(spark, sf_dir, "session_labels")).select("session_no", F.col("is_bullying").alias("label"))
    x = F.array(*[F.col(c).cast("double") for c in ("n_comment", "n_user", "n_word", "n_video", "n_edges", "density")])
    return f.join(verdicts, "session_no").select("subgraph_id", "session_no", "label", F.floor(F.col("n_nodes") / 4).cast("int").alias("bin"), x.alias("x"), *(["n_nodes", *keep] if keep else []))


def cluster_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, purity, coverage, stability and discrimination of the size bins as clusters."""
    rows = _feature_rows(spark, sf_dir)
    q = cluster.quality(rows, "bin", "x", "label", "session_no", rows.where("label = 0"))
    return q.select("bin", "size", *[F.round(c, 6).alias(c) for c in ("purity", "coverage", "stability", "discrimination")])


def cluster_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean pairwise cosine of embeddings by label."""
    return cluster.cohesion(read(spark, sf_dir, "embeddings"), "label", "embedding").select("label", "size", F.round("cohesion", 6).alias("cohesion"))


def cluster_medoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.medoids(_feature_rows(spark, sf_dir), "bin", "subgraph_id", "x").select("bin", "medoid", F.round("distance", 6).alias("distance"))


def prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 clusters of most discrimination with 8 members and a fifth of positives: a top-k report."""
    rows = _feature_rows(spark, sf_dir)
    rated = cluster.quality(rows, "bin", "x", "label", "session_no", rows.where("label = 0")).withColumnRenamed("bin", "cluster").withColumn("discrimination", F.round("discrimination", 6))
    top = cluster.top_prototypes(rated, 8, 0.2, 15).join(cluster.medoids(rows, "bin", "subgraph_id", "x"), F.col("cluster") == F.col("bin"))
    return top.select(F.col("prototype").cast("bigint").alias("prototype"), "cluster", "size", "discrimination", "medoid")


def dbscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the first two coordinates of embeddings."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))
    return cluster.dbscan(e, "vec_id", ["x", "y"], 0.01, 4)


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of every subgraph to the medoids of the prototypes."""
    s = S.structure(subgraphs(spark, sf_dir, "nodes", "edges"), "subgraph_id", "session_no").where("session_no IS NOT NULL")
    cols = ["n_comment", "n_user", "n_word", "n_video"]
    p = prototypes(spark, sf_dir).join(s, F.col("medoid") == F.col("subgraph_id")).select("prototype", *[F.col(c).alias(f"p_{c}") for c in cols], F.col("n_nodes").alias("p_nodes"), F.col("density").alias("p_density"))
    both = s.join(F.broadcast(p), how="cross")  # 15 prototypes at most
    shape = V.cosine(matching.shares([F.col(c) for c in cols]), matching.shares([F.col(f"p_{c}") for c in cols]))
    counts = matching.count_similarity([(F.col("n_comment"), F.col("p_n_comment"), 0.5), (F.col("n_user"), F.col("p_n_user"), 0.3), (F.col("n_word"), F.col("p_n_word"), 0.2)])
    size = matching.relative_similarity(F.col("n_nodes"), F.col("p_nodes"))
    parts = [shape.alias("shape"), counts.alias("counts"), size.alias("size")]
    return both.select("subgraph_id", "session_no", "prototype", *parts, matching.blend([shape, counts, size]).alias("similarity"))


_TRIPLES = [(0.5, 0.3, 0.2), (0.4, 0.4, 0.2), (0.6, 0.2, 0.2), (0.2, 0.3, 0.5)]


def weight_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 over labelled sessions of the rule 'best similarity of at least 0.9', for each weighting of its parts."""
    m = _matches(spark, sf_dir)
    triples = spark.createDataFrame([(i, *t) for i, t in enumerate(_TRIPLES)], "triple int, w0 double, w1 double, w2 double")
    tried = m.join(F.broadcast(triples), how="cross")  # four rows
    best = tried.groupBy("triple", "session_no").agg(F.max(F.round(F.col("shape") * F.col("w0") + F.col("counts") * F.col("w1") + F.col("size") * F.col("w2"), 9)).alias("best"))
    truth = prepare.label_verdicts(read(spark, sf_dir, "session_labels")).select("session_no", F.col("is_bullying").alias("label"))
    j = best.join(truth, "session_no")
    p, y = F.col("best") >= 0.9, F.col("label") == 1
    c = j.groupBy("triple").agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"))
    return c.withColumn("f1", F.round(F.coalesce(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), F.lit(0.0)), 6))


def merged_clusterings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters by size, by emotion quartile and by type, under names of their own, from eight members on."""
    s = subgraphs(spark, sf_dir, "nodes", "emotion_score", "subgraph_type")
    binned = cluster.quantile_bins(s.select("subgraph_id", "emotion_score"), "emotion_score", [0.25, 0.5, 0.75]).where("bin IS NOT NULL")
    parts = {
        "size_": s.select("subgraph_id", F.floor(F.size(S.node_list(F.col("nodes"))) / 2).cast("string").alias("c")), "emotion_": binned.select("subgraph_id", F.col("bin").cast("string").alias("c")),
        "type_": s.select("subgraph_id", F.col("subgraph_type").alias("c")),
    }
    return cluster.merge_clusterings(parts, 8)


def prototype_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir).select("subgraph_id", "prototype", F.round("similarity", 6).alias("similarity"))


def session_match_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matching.session_match(_matches(spark, sf_dir), "session_no")
    return m.select("session_no", "prototype", *[F.round(c, 6).alias(c) for c in ("best", "mean", "deviation", "share")], "hits")


def aligner_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = matching.aligner_features(_matches(spark, sf_dir), "session_no")
    return a.select("session_no", *[F.round(c, 6).alias(c) for c in ("best", "mean", "self_weighted", "top3")], "high", "medium", "low", "predicted")


def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, precision, recall, F1 and accuracy of a rule: a session with a share of low scores above a half."""
    rule = negative_subgraph_filter(spark, sf_dir).select("session_no", (F.col("share") > 0.5).cast("int").alias("predicted"))
    truth = prepare.label_verdicts(read(spark, sf_dir, "session_labels")).select("session_no", F.col("is_bullying").alias("label"))
    m = detect.confusion(rule.join(truth, "session_no"), "label", "predicted")
    return m.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


def similar_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings whose id is divisible by 50 against all others: cosine above 0.3."""
    e = read(spark, sf_dir, "embeddings")
    found = search.similar_vectors(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 0.3)
    return found.select("query_id", "vec_id", F.round("cosine", 6).alias("cosine"))


def random_forest_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.evaluate(_session_vectors(spark, sf_dir), "session_no", "label", "x", "forest")


def logistic_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.evaluate(_session_vectors(spark, sf_dir), "session_no", "label", "x", "logistic")


def perceptron_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.evaluate(_session_vectors(spark, sf_dir), "session_no", "label", "x", "perceptron")


def _session_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session features: means and maxima of the structural features of its subgraphs."""
    rows = _feature_rows(spark, sf_dir)
    aggs = [e for i in range(6) for e in (F.avg(F.col("x")[i]), F.max(F.col("x")[i]))]
    return rows.groupBy("session_no").agg(F.max("label").alias("label"), F.array(*aggs, F.count("*").cast("double")).alias("x"))


QUERIES = {
    f.__name__: f
    for f in (
        subgraph_structure, subgraph_edge_counts, subgraph_dedupe, subgraph_dedupe_untyped, subgraph_validity, subgraph_connectivity, subgraph_type_mix, subgraph_session_index, capped_session_nodes,
        induced_edges, user_pair_subgraphs, composition_counts, every_composition_counts, sliding_comments, greedy_growth_subgraphs, incremental_subgraphs, subgraph_emotion, threshold_sweep, negative_subgraph_filter, emotion_stats, size_bins,
        tertile_bins, cluster_quality, cluster_cohesion, cluster_medoids, prototypes, dbscan, prototype_similarity, session_match_features, aligner_features, weight_search, merged_clusterings, confusion_metrics, similar_vectors,
        random_forest_detect, logistic_detect, perceptron_detect,
    )
}

_STRUCTURE = f"""WITH {SUBGRAPHS},
ec AS (SELECT subgraph_id, count(*) AS n FROM (SELECT DISTINCT * FROM ed) GROUP BY subgraph_id),
nc AS (SELECT subgraph_id, count(*) AS n, """ + ", ".join(f"count(*) FILTER (kind = '{t}') AS {t}" for t in S.TYPES) + """ FROM el GROUP BY subgraph_id),
st AS (SELECT s.subgraph_id, s.session_no, """ + ", ".join(f"coalesce({t}, 0)::INT AS n_{t}" for t in S.TYPES) + """, coalesce(nc.n, 0)::INT AS n_nodes, coalesce(ec.n, 0)::INT AS n_edges FROM s LEFT JOIN nc USING (subgraph_id) LEFT JOIN ec USING (subgraph_id)),
sx AS (SELECT *, CASE WHEN n_nodes > 1 THEN 2 * n_edges / (n_nodes * (n_nodes - 1)) ELSE 0 END AS density, ((n_comment > 0)::INT + (n_user > 0)::INT + (n_video > 0)::INT + (n_word > 0)::INT) / 4 AS diversity FROM st)"""
_VERDICT = r"""lab AS (SELECT session_no, CASE WHEN coalesce(sum(n) FILTER (is_bullying = 1), 0) >= coalesce(sum(n) FILTER (is_bullying <> 1), 0) THEN 1 ELSE 0 END::INT AS label FROM (
  SELECT nullif(regexp_extract(coalesce(session_id, ''), '(\d+)\D*$', 1), '')::BIGINT AS session_no, is_bullying, coalesce(annotators, 1) AS n FROM session_labels) WHERE session_no IS NOT NULL AND is_bullying IS NOT NULL GROUP BY session_no)"""
_FEATURES = _STRUCTURE + f""", {_VERDICT},
fx AS (SELECT subgraph_id, sx.session_no, label, (n_nodes // 4)::INT AS bin, [n_comment::DOUBLE, n_user, n_word, n_video, n_edges, density] AS x FROM sx JOIN lab USING (session_no)),
fp AS (SELECT *, unnest(x) AS v, unnest(range(1, 7)) AS i FROM fx),
ce AS (SELECT bin, i, avg(v) AS m, var_pop(v) AS s, count(*) AS n FROM fp GROUP BY bin, i)"""
_QUALITY = _FEATURES + """,
qa AS (SELECT bin, count(*) AS size, avg(label) AS purity, count(DISTINCT session_no) FILTER (label = 1) AS covered FROM fx GROUP BY bin),
qb AS (SELECT bin, CASE WHEN max(n) > 1 THEN 1 / (1 + avg(s)) ELSE 0 END AS stability FROM ce GROUP BY bin),
qw AS (SELECT count(DISTINCT session_no) FILTER (label = 1) AS sessions FROM fx),
qc AS (SELECT bin, avg(d) AS discrimination FROM (SELECT ce.bin, fp.subgraph_id, sqrt(sum((m - v) * (m - v))) AS d FROM fp JOIN ce ON ce.i = fp.i WHERE fp.label = 0 GROUP BY 1, 2) GROUP BY bin),
q AS (SELECT qa.bin, size, purity, covered / greatest(sessions, 1) AS coverage, stability, coalesce(discrimination, 0) AS discrimination FROM qa JOIN qb USING (bin) LEFT JOIN qc USING (bin), qw),
md AS (SELECT bin, subgraph_id AS medoid, d FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY d, subgraph_id) AS rn FROM (
  SELECT fp.bin, subgraph_id, round(sqrt(sum((m - v) * (m - v))), 9) AS d FROM fp JOIN ce ON ce.bin = fp.bin AND ce.i = fp.i GROUP BY 1, 2)) WHERE rn = 1)"""
_PROTOTYPES = _QUALITY + """,
pr AS (SELECT row_number() OVER (ORDER BY discrimination DESC, bin) - 1 AS prototype, * FROM (SELECT bin, size, round(discrimination, 6) AS discrimination FROM q WHERE size >= 8 AND purity >= 0.2 ORDER BY 3 DESC, 1 LIMIT 15))"""


def _cos(a: list[str], b: list[str]) -> str:
    total = lambda v: "(" + " + ".join(v) + ")"
    share = lambda c, v: f"coalesce({c} / nullif({total(v)}, 0), 0)"
    dot = " + ".join(f"{share(x, a)} * {share(y, b)}" for x, y in zip(a, b))
    length = lambda v: "sqrt(" + " + ".join(f"{share(x, v)} * {share(x, v)}" for x in v) + ")"
    return f"(({dot}) / ({length(a)} * {length(b)} + 1e-8))"


_KINDS = ["n_comment", "n_user", "n_word", "n_video"]
_ALIKE = lambda a, b: f"(CASE WHEN greatest({a}, {b}) = 0 THEN 1 ELSE least({a}, {b}) / greatest({a}, {b}) END)"
_MATCHES = _PROTOTYPES + f""",
pp AS (SELECT prototype, {', '.join(f'sx.{c} AS p_{c}' for c in _KINDS)}, sx.n_nodes AS p_nodes FROM pr JOIN md USING (bin) JOIN sx ON sx.subgraph_id = md.medoid WHERE sx.session_no IS NOT NULL),
mp AS (SELECT subgraph_id, session_no, prototype, {_cos(_KINDS, [f'p_{c}' for c in _KINDS])} AS a, (0.5 * {_ALIKE('n_comment', 'p_n_comment')} + 0.3 * {_ALIKE('n_user', 'p_n_user')} + 0.2 * {_ALIKE('n_word', 'p_n_word')}) AS b,
  (CASE WHEN greatest(n_nodes, p_nodes) = 0 THEN 1 ELSE 1 - abs(n_nodes - p_nodes) / greatest(n_nodes, p_nodes) END) AS c FROM sx, pp WHERE session_no IS NOT NULL),
mt AS (SELECT subgraph_id, session_no, prototype, {_cos(_KINDS, [f'p_{c}' for c in _KINDS])} * 0.5 + (0.5 * {_ALIKE('n_comment', 'p_n_comment')} + 0.3 * {_ALIKE('n_user', 'p_n_user')} + 0.2 * {_ALIKE('n_word', 'p_n_word')}) * 0.3
  + (CASE WHEN greatest(n_nodes, p_nodes) = 0 THEN 1 ELSE 1 - abs(n_nodes - p_nodes) / greatest(n_nodes, p_nodes) END) * 0.2 AS similarity FROM sx, pp WHERE session_no IS NOT NULL)"""
_FILTER = f"""WITH {SUBGRAPHS}, nf AS (SELECT session_no, count(*) AS subgraphs, count(*) FILTER (emotion_score < -0.4) AS kept FROM s WHERE session_no IS NOT NULL AND emotion_score IS NOT NULL GROUP BY session_no),
nr AS (SELECT *, round(kept / subgraphs, 6) AS share FROM nf)"""
_DEDUPE = """, k AS (SELECT s.session_no, s.subgraph_id, coalesce(string_agg(DISTINCT {el}, '|' ORDER BY {el}), '') AS k FROM s LEFT JOIN el USING (subgraph_id) GROUP BY 1, 2)
SELECT session_no, min(subgraph_id) AS subgraph_id, count(DISTINCT subgraph_id) AS copies FROM k GROUP BY session_no, k"""

SQL = {
    "subgraph_structure": _STRUCTURE + " SELECT subgraph_id, n_comment, n_user, n_video, n_word, n_nodes, n_edges, round(density, 6) AS density, round(diversity, 6) AS diversity FROM sx",
    "subgraph_edge_counts": _STRUCTURE + ", rc AS (SELECT subgraph_id, count(DISTINCT rel) AS r FROM ed GROUP BY subgraph_id) SELECT s.subgraph_id, coalesce(ec.n, 0)::INT AS n_edges, coalesce(2 * r, 0)::INT AS n_edges_compat FROM s LEFT JOIN ec USING (subgraph_id) LEFT JOIN rc USING (subgraph_id)",
    "subgraph_dedupe": f"WITH {SUBGRAPHS}" + _DEDUPE.format(el="(kind || ':' || id)"),
    "subgraph_dedupe_untyped": f"WITH {SUBGRAPHS}" + _DEDUPE.format(el="(id::VARCHAR)"),
    "subgraph_validity": _STRUCTURE + " SELECT subgraph_id, subgraph_type FROM sx JOIN s USING (subgraph_id) WHERE n_comment > 0 AND n_nodes > n_word AND n_nodes BETWEEN 6 AND 15",
    "subgraph_connectivity": _STRUCTURE + " SELECT count(*) AS subgraphs, sum((n_edges > 0)::INT)::BIGINT AS with_edges, round(avg((n_edges > 0)::INT), 6) AS share FROM sx",
    "subgraph_type_mix": _STRUCTURE + " SELECT subgraph_type, n_nodes AS n, count(*) AS subgraphs, count(DISTINCT s.session_no) AS sessions FROM sx JOIN s USING (subgraph_id) GROUP BY 1, 2",
    "subgraph_session_index": _STRUCTURE + " SELECT session_no AS session_id, count(*) AS subgraphs, min(n_nodes) AS min_size, max(n_nodes) AS max_size, round(avg(n_nodes), 6) AS mean_size FROM sx WHERE session_no IS NOT NULL GROUP BY session_no",
    "capped_session_nodes": f"""WITH {SUBGRAPHS}, m AS (SELECT DISTINCT session_no AS session, kind AS type, id FROM el WHERE session_no IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY session, type ORDER BY md5(type || ':' || id || '|42'), id) AS rn FROM m)
SELECT session, type, id FROM r WHERE rn <= CASE type WHEN 'comment' THEN 50 WHEN 'user' THEN 8 WHEN 'word' THEN 25 ELSE 0 END""",
    "induced_edges": f"""WITH {SUBGRAPHS}, x AS (SELECT DISTINCT session_no, rel, src, dst FROM ed JOIN s USING (subgraph_id) WHERE session_no IS NOT NULL),
t AS (SELECT *, CASE rel WHEN 'user_posts_comment' THEN 'user' WHEN 'comment_contains_word' THEN 'comment' WHEN 'video_contains_comment' THEN 'video' ELSE 'user' END AS st,
  CASE rel WHEN 'comment_contains_word' THEN 'word' WHEN 'user_interacts_user' THEN 'user' ELSE 'comment' END AS dt FROM x)
SELECT a.subgraph_id, rel, count(*) AS n FROM t JOIN el a ON a.session_no = t.session_no AND a.kind = st AND a.id = src JOIN el b ON b.subgraph_id = a.subgraph_id AND b.kind = dt AND b.id = dst GROUP BY 1, 2""",
    "user_pair_subgraphs": f"""WITH {NODES}, {_REPLIES}, m AS (SELECT DISTINCT post_id, user_id FROM n WHERE post_id IS NOT NULL AND user_id IS NOT NULL), p AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e)
SELECT x.post_id, a, b FROM p JOIN m x ON x.user_id = a JOIN m y ON y.user_id = b AND y.post_id = x.post_id""",
    "composition_counts": f"""WITH {SUBGRAPHS}, m AS (SELECT DISTINCT session_no, kind, id FROM el WHERE session_no IS NOT NULL),
h AS (SELECT session_no, """ + ", ".join(f"count(*) FILTER (kind = '{t}') AS h_{t}" for t in S.TYPES) + """ FROM m GROUP BY session_no),
c AS (SELECT a AS n_comment, b AS n_user, v AS n_video, w AS n_word, (a + b + v + w)::INT AS size FROM range(1, 7) t1(a), range(0, 5) t2(b), range(0, 2) t3(v), range(0, 6) t4(w) WHERE a + b + v + w BETWEEN 4 AND 8)
SELECT session_no, size, count(*) AS compositions FROM h JOIN c ON n_comment <= h_comment AND n_user <= h_user AND n_video <= h_video AND n_word <= h_word GROUP BY 1, 2""",
    "every_composition_counts": f"""WITH {SUBGRAPHS}, m AS (SELECT DISTINCT session_no, kind, id FROM el WHERE session_no IS NOT NULL),
h AS (SELECT session_no, """ + ", ".join(f"count(*) FILTER (kind = '{t}') AS h_{t}" for t in S.TYPES) + """ FROM m GROUP BY session_no),
c AS (SELECT z::INT AS size, a AS n_comment, b AS n_user, v AS n_video, z - a - b - v AS n_word FROM range(6, 16) t0(z), range(1, 15) t1(a), range(0, 15) t2(b), range(0, 2) t3(v) WHERE a < z AND a + b + v <= z)
SELECT session_no, size, count(*) AS compositions FROM h JOIN c ON n_comment <= h_comment AND n_user <= h_user AND n_video <= h_video AND n_word <= h_word GROUP BY 1, 2""",
    "sliding_comments": f"""WITH {NODES}, r AS (SELECT post_id, id, lead(id) OVER w AS i2, lead(id, 2) OVER w AS i3, (row_number() OVER w - 1)::INT AS start FROM n WHERE post_id IS NOT NULL WINDOW w AS (PARTITION BY post_id ORDER BY id))
SELECT post_id, start, concat_ws(',', id, i2, i3) AS ids FROM r WHERE i3 IS NOT NULL""",
    "subgraph_emotion": _MEASURED + f""", {SUBGRAPHS},
cm AS (SELECT subgraph_id, ms.user_id, share, hits FROM el JOIN ms ON ms.id = el.id WHERE kind = 'comment'),
pu AS (SELECT subgraph_id, user_id, count(*) FILTER (hits > 0) / count(*) AS a FROM cm WHERE user_id IS NOT NULL GROUP BY 1, 2),
pt AS (SELECT subgraph_id, 0.5 AS w, count(*) AS n, avg(-0.2 - 0.5 * least(share, 1)) AS score FROM cm GROUP BY 1
  UNION ALL SELECT subgraph_id, 0.3, count(*), avg(-0.2 - 0.8 * a) FROM pu GROUP BY 1
  UNION ALL SELECT subgraph_id, 0.2, count(*), -0.3 - 0.2 * least(count(*) / 10, 1) FROM el WHERE kind = 'word' GROUP BY 1)
SELECT subgraph_id, round(sum(w * n * score) / sum(w * n) * (1 + 0.1 * least(sum(n) / 15, 1)), 6) AS score, sum(n)::BIGINT AS n FROM pt GROUP BY subgraph_id""",
    "threshold_sweep": """WITH r AS (SELECT DISTINCT subgraph_id, emotion_score FROM subgraph WHERE emotion_score IS NOT NULL), c AS (SELECT unnest([-0.5, -0.45, -0.4, -0.35, -0.3])::DOUBLE AS cut)
SELECT cut, count(*) FILTER (emotion_score > cut) AS above, count(*) FILTER (emotion_score <= cut) AS below, round(count(*) FILTER (emotion_score > cut) / count(*), 6) AS share_above FROM c, r GROUP BY cut""",
    "negative_subgraph_filter": _FILTER + " SELECT * FROM nr",
    "emotion_stats": f"WITH {SUBGRAPHS} SELECT subgraph_type, count(emotion_score) AS n, round(avg(emotion_score), 6) AS mean, round(stddev_pop(emotion_score), 6) AS deviation, round(min(emotion_score), 6) AS least, round(max(emotion_score), 6) AS greatest, round(quantile_cont(emotion_score, 0.5), 6) AS median FROM s GROUP BY subgraph_type",
    "size_bins": _STRUCTURE + " SELECT (n_nodes // 2 * 2)::INT AS bin, count(*) AS members FROM sx GROUP BY 1 HAVING count(*) >= 20",
    "tertile_bins": f"WITH {SUBGRAPHS}, q AS (SELECT quantile_cont(emotion_score, 0.33) AS a, quantile_cont(emotion_score, 0.67) AS b FROM s) SELECT subgraph_id, ((emotion_score > a)::INT + (emotion_score > b)::INT)::INT AS bin FROM s, q WHERE emotion_score IS NOT NULL",
    "cluster_quality": _QUALITY + " SELECT bin, size, round(purity, 6) AS purity, round(coverage, 6) AS coverage, round(stability, 6) AS stability, round(discrimination, 6) AS discrimination FROM q",
    "cluster_cohesion": """WITH u AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings), l AS (SELECT vec_id, sqrt(sum(v * v)) AS l FROM u GROUP BY 1),
s AS (SELECT label, i, sum(v / l) AS s, sum(v / l * v / l) AS q, count(*) AS n FROM u JOIN l USING (vec_id) GROUP BY 1, 2)
SELECT label, max(n) AS size, round((sum(s * s) - sum(q)) / (max(n) * (max(n) - 1)), 6) AS cohesion FROM s GROUP BY label""",
    "cluster_medoids": _QUALITY + " SELECT bin, medoid, round(d, 6) AS distance FROM md",
    "prototypes": _PROTOTYPES + " SELECT prototype, bin AS cluster, size, discrimination, medoid FROM pr JOIN md USING (bin)",
    "prototype_similarity": _MATCHES + " SELECT subgraph_id, prototype, round(similarity, 6) AS similarity FROM mt",
    "session_match_features": _MATCHES + " SELECT session_no, prototype, round(max(similarity), 6) AS best, round(avg(similarity), 6) AS mean, round(stddev_pop(similarity), 6) AS deviation, round(count(*) FILTER (similarity > 0.5) / count(*), 6) AS share, count(*) FILTER (similarity > 0.5) AS hits FROM mt GROUP BY 1, 2",
    "aligner_features": _MATCHES + """, ps AS (SELECT session_no, prototype, 0.7 * max(similarity) + 0.3 * avg(similarity) AS s FROM mt GROUP BY 1, 2), pk AS (SELECT *, row_number() OVER (PARTITION BY session_no ORDER BY s DESC) AS rn FROM ps)
SELECT session_no, round(max(s), 6) AS best, round(avg(s), 6) AS mean, round(coalesce(sum(s * s) / nullif(sum(s), 0), 0), 6) AS self_weighted, round(avg(s) FILTER (rn <= 3), 6) AS top3,
  count(*) FILTER (s >= 0.7) AS high, count(*) FILTER (s >= 0.3 AND s < 0.7) AS medium, count(*) FILTER (s < 0.3) AS low, (max(s) >= 0.6)::INT AS predicted FROM pk GROUP BY session_no""",
    "weight_search": _MATCHES + ", tr(triple, w0, w1, w2) AS (VALUES " + ", ".join(f"({i}, {a}, {b}, {c})" for i, (a, b, c) in enumerate(_TRIPLES)) + """),
bs AS (SELECT triple, session_no, max(round(a * w0 + b * w1 + c * w2, 9)) AS best FROM mp, tr GROUP BY 1, 2),
ct AS (SELECT triple, count(*) FILTER (best >= 0.9 AND label = 1) AS tp, count(*) FILTER (best >= 0.9 AND label = 0) AS fp, count(*) FILTER (best < 0.9 AND label = 1) AS fn FROM bs JOIN lab USING (session_no) GROUP BY triple)
SELECT triple, tp, fp, fn, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM ct""",
    "merged_clusterings": _STRUCTURE + """, q AS (SELECT quantile_cont(emotion_score, 0.25) AS a, quantile_cont(emotion_score, 0.5) AS b, quantile_cont(emotion_score, 0.75) AS c FROM s),
m AS (SELECT 'size_' || (n_nodes // 2) AS cluster, subgraph_id FROM sx UNION ALL SELECT 'type_' || subgraph_type, subgraph_id FROM s WHERE subgraph_type IS NOT NULL
  UNION ALL SELECT 'emotion_' || ((emotion_score > a)::INT + (emotion_score > b)::INT + (emotion_score > c)::INT), subgraph_id FROM s, q WHERE emotion_score IS NOT NULL)
SELECT cluster, count(*) AS members FROM m GROUP BY cluster HAVING count(*) >= 8""",
    "confusion_metrics": _FILTER + f""", {_VERDICT}, j AS (SELECT (share > 0.5)::INT AS p, label AS y FROM nr JOIN lab USING (session_no)),
c AS (SELECT count(*) FILTER (p = 1 AND y = 1) AS tp, count(*) FILTER (p = 1 AND y = 0) AS fp, count(*) FILTER (p = 0 AND y = 1) AS fn, count(*) FILTER (p = 0 AND y = 0) AS tn FROM j)
SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0), 6) AS accuracy FROM c""",
    "similar_vectors": """SELECT query_id, vec_id, round(c, 6) AS cosine FROM (SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) + 1e-8) AS c
FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0) WHERE c > 0.3""",
}

