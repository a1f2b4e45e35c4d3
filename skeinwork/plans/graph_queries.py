"""Queries on user networks and the heterogeneous graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.functions import lexicons as L
from skeinwork.functions import text as X
from skeinwork.operators import hetero, network, prepare
from skeinwork.plans.text_queries import _MEASURED, ATTACK, _measured, vocabulary_top_words
from skeinwork.plans.views import NODES, VIDEOS, WORDS, nodes, read, word_rows


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = prepare.latest(read(spark, sf_dir, "comments"), "commentId", "loaded_at")
    up = F.btrim("parentCommentId", F.lit(" \t"))
    return c.select(F.col("commentId").alias("comment_id"), F.when(up != "", up).alias("parent_id"), F.col("postId").alias("post_id"), F.col("userId").alias("user_id"), F.col("username"), F.col("commentText").alias("text"))


def reply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.reply_edges(_replies(spark, sf_dir))


def mention_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of another user of the same post by name."""
    n = nodes(spark, sf_dir).select("post_id", F.trim("username").alias("username"), F.col("comment_text").alias("text"))
    return network.mention_edges(n)


def pagerank_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks to a tolerance of a millionth a node; tested by brute force."""
    return network.pagerank(reply_edges(spark, sf_dir)).select("node", F.round("rank", 9).alias("rank"))


def name_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments that contain the name of another user of the same post, with or without '@'."""
    n = read(spark, sf_dir, "comment_nodes").select("post_id", F.trim("username").alias("username"), F.col("comment_text").alias("text"))
    return network.name_mentions(n)


def co_comment_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.co_comment_edges(nodes(spark, sf_dir))


def network_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.degrees(reply_edges(spark, sf_dir))


def network_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = network.shape(reply_edges(spark, sf_dir))
    return s.select("nodes", "edges", F.round("density", 9).alias("density"), F.round("reciprocity", 6).alias("reciprocity"))


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.triangles(reply_edges(spark, sf_dir))


def clustering_coefficient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.clustering(reply_edges(spark, sf_dir)).select("node", F.round("clustering", 6).alias("clustering"))


_ROUNDS = 5


def pagerank_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.pagerank(reply_edges(spark, sf_dir), _ROUNDS, tolerance=None).select("node", F.round("rank", 9).alias("rank"))


def khop_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users within two steps of those with two or more attack words."""
    m = _measured(spark, sf_dir).where("user_id IS NOT NULL")
    seeds = m.groupBy(F.col("user_id").alias("node")).agg(F.sum("hits").alias("h")).where("h >= 2").select("node")
    return network.bfs(reply_edges(spark, sf_dir), seeds, 2)


def path_centralities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closeness in each post's reply network, and betweenness in those of fewer than 1,000 users."""
    c = _replies(spark, sf_dir)
    p = c.select(F.col("comment_id").alias("parent_id"), F.col("post_id").alias("p_post"), F.col("user_id").alias("dst"))
    edges = c.join(p, "parent_id").where("post_id = p_post AND user_id <> dst").select("post_id", F.col("user_id").alias("src"), "dst")
    return network.path_centralities(edges, "post_id")


def session_network_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per post: mean and greatest degree and rank over its distinct users."""
    edges = reply_edges(spark, sf_dir)
    facts = network.degrees(edges).join(network.pagerank(edges, _ROUNDS, tolerance=None), "node", "left")
    m = nodes(spark, sf_dir).select("post_id", "user_id").where("user_id IS NOT NULL").distinct().join(facts, F.col("user_id") == F.col("node"), "left").na.fill(0, ["degree", "rank"])
    return m.groupBy("post_id").agg(F.count("*").alias("users"), F.round(F.avg("degree"), 6).alias("mean_degree"), F.max("degree").alias("max_degree"), F.round(F.avg("rank"), 9).alias("mean_rank"), F.round(F.max("rank"), 9).alias("max_rank"))


def _user_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = nodes(spark, sf_dir).where("user_id IS NOT NULL").groupBy("user_id").agg(F.count("*").alias("c"), F.count_distinct("post_id").alias("p"), F.max(F.coalesce(F.col("verified").cast("int"), F.lit(0))).alias("v"), F.max(F.coalesce(F.char_length("username"), F.lit(0))).alias("l"))
    return u.select(F.lit("user").alias("type"), F.col("user_id").alias("key"), F.array(*[F.col(c).cast("double") for c in "cpvl"], F.lit(1.0)).alias("features"))


def _word_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = vocabulary_top_words(spark, sf_dir)
    is_attack = F.col("word").isin(L.ATTACK_WORDS).cast("double")
    return top.select(F.lit("word").alias("type"), F.col("word").alias("key"), F.array(F.col("n").cast("double"), is_attack, F.char_length("word").cast("double"), F.lit(1.0)).alias("features"))


def hetero_node_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _measured(spark, sf_dir)
    questions = F.regexp_count("comment_text", F.lit(r"\?"))
    values = [F.char_length("comment_text"), F.col("n_words"), F.col("marks"), questions, F.col("upper"), F.col("hits"), F.col("share")]
    comments = m.select(F.lit("comment").alias("type"), F.col("id").cast("string").alias("key"), F.array(*[v.cast("double") for v in values]).alias("features"))
    v = prepare.videos(read(spark, sf_dir, "video_posts"))
    posts = nodes(spark, sf_dir).select("post_id").where("post_id IS NOT NULL").distinct().join(read(spark, sf_dir, "url_map"), "post_id", "left").join(v, "url", "left")
    length = lambda c: F.coalesce(F.char_length(c), F.lit(0)).cast("double")
    sessions = posts.select(
        F.lit("media_session").alias("type"), F.col("post_id").alias("key"),
        F.array(F.coalesce("label", F.lit(-1)).cast("double"), length("mediacaption"), length("username"), F.col("url").isNotNull().cast("double"), F.lit(1.0)).alias("features"),
    )
    return _user_nodes(spark, sf_dir).unionByName(comments).unionByName(_word_nodes(spark, sf_dir)).unionByName(sessions)


def hetero_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed nodes with their features in columns f0 to f6; shorter types end in null."""
    n = hetero_node_table(spark, sf_dir)
    return n.select("type", "key", *[F.round(F.get("features", F.lit(i)), 6).alias(f"f{i}") for i in range(7)])


def hetero_node_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense ids of user and word nodes in the order of their keys."""
    return hetero.dense_ids(_user_nodes(spark, sf_dir).unionByName(_word_nodes(spark, sf_dir))).select("type", "key", "id")


def hetero_edge_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed edges with their multiplicity ``n``, each once.

    A comment is one row, so its edges are cut out of it and its words counted within it; users that meet are
    pairs already.  Nothing is grouped over all edges.
    """
    text = [F.lit(t).alias(c) for t, c in (("comment", "src_type"), ("contains_word", "rel"), ("word", "dst_type"))]
    words = vocabulary_top_words(spark, sf_dir).select("word")
    counted = word_rows(spark, sf_dir).select(F.col("id").cast("string").alias("src_key"), F.explode(X.counted(F.col("words"))).alias("w")).select("src_key", F.col("w.word").alias("word"), F.col("w.n").alias("n"))
    holds = counted.join(words, "word").select(*text, "src_key", F.col("word").alias("dst_key"), "n")
    edge = lambda s, rel, key: F.when(F.col(key).isNotNull(), F.struct(F.lit(s).alias("src_type"), F.lit(rel).alias("rel"), F.lit("comment").alias("dst_type"), F.col(key).alias("src_key"), F.col("id").cast("string").alias("dst_key"), F.lit(1).cast("bigint").alias("n")))
    ids = nodes(spark, sf_dir).select("id", "post_id", "user_id")
    owned = ids.select(F.inline(F.array_compact(F.array(edge("user", "posts", "user_id"), edge("media_session", "contains", "post_id")))))
    pairs = network.co_comment_edges(read(spark, sf_dir, "comment_nodes"))
    meets = pairs.select(F.lit("user").alias("src_type"), F.lit("interacts").alias("rel"), F.lit("user").alias("dst_type"), F.col("a").alias("src_key"), F.col("b").alias("dst_key"), F.lit(1).cast("bigint").alias("n"))
    return owned.unionByName(holds).unionByName(meets)


def hetero_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed edges with their multiplicity."""
    return hetero_edge_table(spark, sf_dir)


def hetero_mapped_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from users to words they use, in dense ids."""
    ids = hetero.dense_ids(_user_nodes(spark, sf_dir).unionByName(_word_nodes(spark, sf_dir)))
    uses = word_rows(spark, sf_dir).where("user_id IS NOT NULL").select(F.lit("user").alias("src_type"), F.lit("uses").alias("rel"), F.lit("word").alias("dst_type"), F.col("user_id").alias("src_key"), F.explode(F.array_distinct("words")).alias("dst_key"))
    return hetero.map_edges(uses.distinct(), ids).select("src", "dst")


def _time_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir).where("user_id IS NOT NULL AND ts IS NOT NULL")
    return n.groupBy(F.col("user_id").alias("key")).agg(F.array(F.count_if(F.hour("ts") < 12).cast("double"), F.count_if(F.hour("ts") >= 12).cast("double")).alias("features"))


def hetero_fused_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' text and time features end to end, zeros where a side lacks the user."""
    fused = hetero.concat_fusion([(_user_nodes(spark, sf_dir), 5), (_time_side(spark, sf_dir), 2)])
    return fused.select("key", *[F.get("features", F.lit(i)).alias(f"f{i}") for i in range(7)])


def hetero_mean_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' first two text features and time features, averaged over the sides that have the user."""
    text = _user_nodes(spark, sf_dir).select("key", F.slice("features", 1, 2).alias("features"))
    fused = hetero.mean_fusion([text, _time_side(spark, sf_dir)])
    return fused.select("key", *[F.round(F.get("features", F.lit(i)), 6).alias(f"f{i}") for i in range(2)])


def hetero_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word nodes scaled within their type."""
    z = hetero.zscore_features(_word_nodes(spark, sf_dir))
    return z.select("key", *[F.round(F.get("features", F.lit(i)), 6).alias(f"f{i}") for i in range(4)])


def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by relation and nodes by type."""
    n = hetero_node_table(spark, sf_dir).groupBy(F.concat(F.lit("node:"), "type").alias("kind")).agg(F.count("*").alias("n"))
    return n.unionByName(hetero_edge_table(spark, sf_dir).groupBy(F.concat(F.lit("edge:"), "rel").alias("kind")).agg(F.sum("n").alias("n")))


QUERIES = {
    f.__name__: f
    for f in (
        reply_edges, mention_edges, co_comment_edges, name_mentions, pagerank_converged, network_degrees, network_shape, triangles, clustering_coefficient, pagerank_fixed, khop_neighbourhood, path_centralities,
        session_network_features, hetero_nodes, hetero_node_ids, hetero_edges, hetero_mapped_edges, hetero_fused_users, hetero_mean_users, hetero_zscore, graph_counts,
    )
}

_REPLIES = """r AS (SELECT commentId AS comment_id, nullif(trim(parentCommentId, ' ' || chr(9)), '') AS parent_id, postId AS post_id, userId AS user_id FROM (
  SELECT *, row_number() OVER (PARTITION BY commentId ORDER BY loaded_at DESC NULLS LAST, postId DESC NULLS LAST, userId DESC NULLS LAST, username DESC NULLS LAST, commentText DESC NULLS LAST, created DESC NULLS LAST,
    location DESC NULLS LAST, description DESC NULLS LAST, verified DESC NULLS LAST, private DESC NULLS LAST, avatarUrl DESC NULLS LAST, parentCommentId DESC NULLS LAST) AS rn
  FROM comments WHERE commentId IS NOT NULL) WHERE rn = 1),
e AS (SELECT c.user_id AS src, p.user_id AS dst, count(*) AS weight FROM r c JOIN r p ON p.comment_id = c.parent_id WHERE c.post_id = p.post_id AND c.user_id <> p.user_id GROUP BY 1, 2)"""
_UNDIRECTED = _REPLIES + """,
u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e),
t AS (SELECT x.a AS p, x.b AS q, y.b AS r FROM u x JOIN u y ON y.a = x.b JOIN u z ON z.a = x.a AND z.b = y.b),
tri AS (SELECT node, count(*) AS triangles FROM (SELECT unnest([p, q, r]) AS node FROM t) GROUP BY node),
deg AS (SELECT node, count(*) AS d FROM (SELECT unnest([a, b]) AS node FROM u) GROUP BY node)"""


def _pagerank_sql() -> str:
    parts = [
        f"WITH {_REPLIES}, l AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM e)",
        "nd AS (SELECT node, EXISTS (SELECT 1 FROM l WHERE src = node) AS live FROM (SELECT src AS node FROM l UNION SELECT dst FROM l))",
        "cn AS (SELECT count(*)::DOUBLE AS n FROM nd)",
        "r0 AS (SELECT node, live, 1 / n AS rank FROM nd, cn)",
    ]
    for i in range(1, _ROUNDS + 1):
        parts += [
            f"g{i} AS (SELECT dst AS node, sum(rank * share) AS got FROM l JOIN r{i - 1} x ON x.node = l.src GROUP BY dst)",
            f"r{i} AS (SELECT nd.node, nd.live, 0.15 / n + 0.85 * (coalesce(got, 0) + (SELECT coalesce(sum(rank), 0) FROM r{i - 1} WHERE NOT live) / n) AS rank FROM nd CROSS JOIN cn LEFT JOIN g{i} ON g{i}.node = nd.node)",
        ]
    return ", ".join(parts)


_PR = _pagerank_sql()
_DEG = "dg AS (SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, count(*) AS degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY node)"
_CO = """cm AS (SELECT DISTINCT post_id, user_id FROM n WHERE post_id IS NOT NULL AND user_id IS NOT NULL),
co AS (SELECT x.user_id AS a, y.user_id AS b, count(*) AS weight FROM cm x JOIN cm y ON x.post_id = y.post_id AND x.user_id < y.user_id GROUP BY 1, 2 HAVING count(*) >= 2)"""
_VOC = "voc AS (SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM w) GROUP BY word), top AS (SELECT word, n FROM voc ORDER BY n DESC, word LIMIT 1000)"
_USER = "un AS (SELECT user_id AS key, count(*)::DOUBLE AS f0, count(DISTINCT post_id)::DOUBLE AS f1, max(coalesce(verified::INT, 0))::DOUBLE AS f2, max(coalesce(length(username), 0))::DOUBLE AS f3, 1.0::DOUBLE AS f4 FROM n WHERE user_id IS NOT NULL GROUP BY user_id)"
_WORD = f"wn AS (SELECT word AS key, n::DOUBLE AS f0, list_contains({ATTACK}, word)::INT::DOUBLE AS f1, length(word)::DOUBLE AS f2, 1.0::DOUBLE AS f3 FROM top)"
_ALL_NODES = _MEASURED + f""", {VIDEOS}, {_VOC}, {_USER}, {_WORD},
ps AS (SELECT DISTINCT post_id FROM n WHERE post_id IS NOT NULL),
sn AS (SELECT ps.post_id AS key, coalesce(v.label, -1)::DOUBLE AS f0, coalesce(length(v.mediacaption), 0)::DOUBLE AS f1, coalesce(length(v.username), 0)::DOUBLE AS f2, (um.url IS NOT NULL)::INT::DOUBLE AS f3, 1.0::DOUBLE AS f4
  FROM ps LEFT JOIN url_map um ON um.post_id = ps.post_id LEFT JOIN v ON v.url = um.url),
nt AS (SELECT 'user' AS type, key, f0, f1, f2, f3, f4, NULL::DOUBLE AS f5, NULL::DOUBLE AS f6 FROM un
  UNION ALL SELECT 'comment', id::VARCHAR, length(comment_text)::DOUBLE, n_words::DOUBLE, marks::DOUBLE, length(regexp_replace(comment_text, '[^?]', '', 'g'))::DOUBLE, round(upper, 6), hits::DOUBLE, round(share, 6) FROM ms
  UNION ALL SELECT 'word', key, f0, f1, f2, f3, NULL, NULL, NULL FROM wn
  UNION ALL SELECT 'media_session', key, f0, f1, f2, f3, f4, NULL, NULL FROM sn)"""
_ALL_EDGES = f"""{_CO}, et AS (
  SELECT 'user' AS src_type, 'posts' AS rel, 'comment' AS dst_type, user_id AS src_key, id::VARCHAR AS dst_key FROM n WHERE user_id IS NOT NULL
  UNION ALL SELECT 'comment', 'contains_word', 'word', x.id::VARCHAR, x.word FROM (SELECT id, unnest(words) AS word FROM w) x JOIN top ON top.word = x.word
  UNION ALL SELECT 'media_session', 'contains', 'comment', post_id, id::VARCHAR FROM n WHERE post_id IS NOT NULL
  UNION ALL SELECT 'user', 'interacts', 'user', a, b FROM co)"""
_IDS = "ids AS (SELECT type, key, row_number() OVER (PARTITION BY type ORDER BY key) - 1 AS id FROM (SELECT 'user' AS type, key FROM un UNION ALL SELECT 'word', key FROM wn))"
_TIME = "tm AS (SELECT user_id AS key, count(*) FILTER (hour(ts) < 12)::DOUBLE AS t0, count(*) FILTER (hour(ts) >= 12)::DOUBLE AS t1 FROM n WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY user_id)"

SQL = {
    "name_mentions": f"""WITH {NODES}, c AS (SELECT DISTINCT post_id, lower(trim(username)) AS src, lower(comment_text) AS t FROM n WHERE trim(username) <> '' AND post_id IS NOT NULL),
u AS (SELECT DISTINCT post_id, src AS dst FROM c)
SELECT DISTINCT c.post_id, src, dst FROM c JOIN u ON u.post_id = c.post_id AND u.dst <> c.src AND contains(c.t, u.dst)""",
    "reply_edges": f"WITH {_REPLIES} SELECT src, dst, weight FROM e",
    "mention_edges": f"""WITH {NODES}, c AS (SELECT post_id, lower(trim(username)) AS u, lower(comment_text) AS t FROM n WHERE trim(username) <> '' AND post_id IS NOT NULL),
m AS (SELECT DISTINCT post_id, u AS src, unnest(regexp_extract_all(t, '@([a-z0-9_.]*[a-z0-9_])', 1)) AS dst FROM c)
SELECT DISTINCT m.post_id, m.src, m.dst FROM m JOIN (SELECT DISTINCT post_id, u FROM c) k ON k.post_id = m.post_id AND k.u = m.dst WHERE m.src <> m.dst""",
    "co_comment_edges": f"WITH {NODES}, {_CO} SELECT a, b, weight FROM co",
    "network_degrees": f"WITH {_REPLIES}, {_DEG} SELECT * FROM dg",
    "network_shape": f"""WITH {_REPLIES}, a AS (SELECT count(*) AS nodes FROM (SELECT src FROM e UNION SELECT dst FROM e)), b AS (SELECT count(*) AS edges FROM e),
c AS (SELECT count(*) AS m FROM e x WHERE EXISTS (SELECT 1 FROM e y WHERE y.src = x.dst AND y.dst = x.src))
SELECT nodes, edges, round(CASE WHEN nodes > 1 THEN edges / (nodes * (nodes - 1)) ELSE 0 END, 9) AS density, round(CASE WHEN edges > 0 THEN m / edges ELSE 0 END, 6) AS reciprocity FROM a, b, c""",
    "triangles": f"WITH {_UNDIRECTED} SELECT node, triangles FROM tri",
    "clustering_coefficient": f"WITH {_UNDIRECTED} SELECT deg.node, round(CASE WHEN d > 1 THEN 2 * coalesce(triangles, 0) / (d * (d - 1)) ELSE 0 END, 6) AS clustering FROM deg LEFT JOIN tri ON tri.node = deg.node",
    "pagerank_fixed": _PR + f" SELECT node, round(rank, 9) AS rank FROM r{_ROUNDS}",
    "khop_neighbourhood": _MEASURED + f""", {_REPLIES}, b AS (SELECT src AS x, dst AS y FROM e UNION SELECT dst, src FROM e),
s AS (SELECT user_id AS seed FROM ms WHERE user_id IS NOT NULL GROUP BY user_id HAVING sum(hits) >= 2),
h1 AS (SELECT DISTINCT seed, y AS node FROM s JOIN b ON x = seed WHERE y <> seed),
h2 AS (SELECT DISTINCT h1.seed, b.y AS node FROM h1 JOIN b ON b.x = h1.node WHERE b.y <> h1.seed AND NOT EXISTS (SELECT 1 FROM h1 k WHERE k.seed = h1.seed AND k.node = b.y))
SELECT seed, seed AS node, 0 AS hop FROM s UNION ALL SELECT seed, node, 1 FROM h1 UNION ALL SELECT seed, node, 2 FROM h2""",
    "session_network_features": _PR + f""", {_DEG}, {NODES}, m AS (SELECT DISTINCT post_id, user_id FROM n WHERE user_id IS NOT NULL)
SELECT m.post_id, count(*) AS users, round(avg(coalesce(degree, 0)), 6) AS mean_degree, max(coalesce(degree, 0)) AS max_degree, round(avg(coalesce(rank, 0)), 9) AS mean_rank, round(max(coalesce(rank, 0)), 9) AS max_rank
FROM m LEFT JOIN dg ON dg.node = m.user_id LEFT JOIN r{_ROUNDS} pr ON pr.node = m.user_id GROUP BY m.post_id""",
    "hetero_nodes": _ALL_NODES + " SELECT * FROM nt",
    "hetero_node_ids": f"WITH {NODES}, {WORDS}, {_VOC}, {_USER}, {_WORD}, {_IDS} SELECT type, key, id FROM ids",
    "hetero_edges": f"WITH {NODES}, {WORDS}, {_VOC}, {_ALL_EDGES} SELECT src_type, rel, dst_type, src_key, dst_key, count(*) AS n FROM et GROUP BY ALL",
    "hetero_mapped_edges": f"""WITH {NODES}, {WORDS}, {_VOC}, {_USER}, {_WORD}, {_IDS},
us AS (SELECT DISTINCT user_id, unnest(words) AS word FROM w WHERE user_id IS NOT NULL)
SELECT a.id AS src, b.id AS dst FROM us JOIN ids a ON a.type = 'user' AND a.key = us.user_id JOIN ids b ON b.type = 'word' AND b.key = us.word""",
    "hetero_fused_users": f"WITH {NODES}, {_USER}, {_TIME} SELECT un.key, f0, f1, f2, f3, f4, coalesce(t0, 0) AS f5, coalesce(t1, 0) AS f6 FROM un LEFT JOIN tm ON tm.key = un.key",
    "hetero_mean_users": f"WITH {NODES}, {_USER}, {_TIME} SELECT un.key, round(CASE WHEN t0 IS NULL THEN f0 ELSE (f0 + t0) / 2 END, 6) AS f0, round(CASE WHEN t1 IS NULL THEN f1 ELSE (f1 + t1) / 2 END, 6) AS f1 FROM un LEFT JOIN tm ON tm.key = un.key",
    "hetero_zscore": f"WITH {NODES}, {WORDS}, {_VOC}, {_WORD}, st AS (SELECT " + ", ".join(f"avg(f{i}) AS m{i}, stddev_samp(f{i}) AS s{i}" for i in range(4)) + " FROM wn) SELECT key, "
    + ", ".join(f"round((f{i} - m{i}) / (coalesce(s{i}, 0) + 1e-6), 6) AS f{i}" for i in range(4)) + " FROM wn, st",
    "graph_counts": _ALL_NODES + f", {_ALL_EDGES} SELECT 'node:' || type AS kind, count(*) AS n FROM nt GROUP BY 1 UNION ALL SELECT 'edge:' || rel, count(*) FROM et GROUP BY 1",
}
