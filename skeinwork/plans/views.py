"""Views of the project's tables that the queries share, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.functions import lexicons as L
from skeinwork.functions import text as X
from skeinwork.functions.temporal import parse_time
from skeinwork.operators import prepare
from skeinwork.operators.prepare import session_number


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comment nodes, each once, with parsed times.

    Rows are written twice unchanged, so the id decides; columns a query does not use are then not read.
    """
    n = read(spark, sf_dir, "comment_nodes").select("id", "comment_id", "comment_text", "username", "created", "post_id", "user_id", "verified", "location").dropDuplicates(["id"])
    return n.withColumn("ts", parse_time(F.col("created")))


def word_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).select("id", "comment_id", "post_id", "user_id", "comment_text", X.tokens(F.col("comment_text")).alias("words"))


def post_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``post_id, label`` of posts with a link whose video has an answer."""
    v = prepare.videos(read(spark, sf_dir, "video_posts")).select("url", "label")
    return read(spark, sf_dir, "url_map").join(v, "url").select("post_id", "label")


def subgraphs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Subgraphs, each id once in its latest row, with the number of their session and the columns asked for
    (all of subgraph_type, emotion_score, nodes and edges by default); no others are read."""
    columns = columns or ("subgraph_type", "emotion_score", "nodes", "edges")
    given = session_number(F.col("session_id"))
    named = F.regexp_extract("subgraph_id", r"(?i)session\D?(\d+)", 1)
    maps = [c for c in columns if c in ("nodes", "edges")]
    rows = read(spark, sf_dir, "subgraph").where("subgraph_id IS NOT NULL").select(
        "subgraph_id", F.col("extracted_at").alias("_at"), F.coalesce(given, F.when(named != "", named).cast("bigint")).alias("session_no"), *[F.map_entries(c).alias(c) if c in maps else F.col(c) for c in columns]
    )
    best = rows.groupBy("subgraph_id").agg(F.max(F.struct("_at", "session_no", *columns)).alias("r"))
    return best.select("subgraph_id", "r.session_no", *[F.map_from_entries(f"r.{c}").alias(c) if c in maps else F.col(f"r.{c}") for c in columns])


def quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_PLAIN = r"regexp_replace(regexp_replace(trim({c}), 'Z$', ''), '^(\d{{4}}-\d{{2}}-\d{{2}})T', '\1 ')"


def sql_time(column: str) -> str:
    c = _PLAIN.format(c=column)
    return f"coalesce(try_strptime({c}, '%Y-%m-%d %H:%M:%S.%f'), try_strptime({c}, '%Y-%m-%d %H:%M:%S'), try_strptime({c}, '%Y/%m/%d %H:%M:%S'))"


NODES = f"n AS (SELECT *, {sql_time('created')} AS ts FROM (SELECT DISTINCT id, comment_id, comment_text, username, created, post_id, user_id, verified, location FROM comment_nodes))"
_SPLIT = r"regexp_split_to_array(regexp_replace(lower(comment_text), '[^a-z0-9_\s]', ' ', 'g'), '\s+')"
WORDS = f"""w AS (SELECT id, comment_id, post_id, user_id, comment_text,
  list_filter({_SPLIT}, lambda x: length(x) >= 3 AND NOT list_contains([{quoted(L.STOP_WORDS)}], x)) AS words FROM n)"""
VIDEOS = f"""v AS (SELECT * FROM (
  SELECT videolink AS url, username, mediacaption, {sql_time('creationtime')} AS created, CASE WHEN regexp_full_match(trim(likecount), '[+-]?[0-9]+') THEN coalesce(try_cast(likecount AS INT), 0) ELSE 0 END AS like_count,
    CASE WHEN trim(lower(question2)) <> '' THEN (trim(lower(question2)) = 'bullying')::INT END AS label, column1, column2,
    row_number() OVER (PARTITION BY videolink ORDER BY username DESC NULLS LAST, mediacaption DESC NULLS LAST, creationtime DESC NULLS LAST,
      likecount DESC NULLS LAST, question2 DESC NULLS LAST, column1 DESC NULLS LAST, column2 DESC NULLS LAST) AS rn
  FROM video_posts WHERE videolink IS NOT NULL) WHERE rn = 1)"""
LABELS = "pl AS (SELECT m.post_id, v.label FROM url_map m JOIN v ON v.url = m.url)"
_NO = r"coalesce(nullif(regexp_extract(coalesce(session_id, ''), '(\d+)\D*$', 1), ''), nullif(regexp_extract(subgraph_id, '(?i)session\D?(\d+)', 1), ''))::BIGINT"
SUBGRAPHS = f"""s AS (SELECT * EXCLUDE (rn) FROM (SELECT subgraph_id, {_NO} AS session_no, subgraph_type, emotion_score, extracted_at, nodes, edges,
  row_number() OVER (PARTITION BY subgraph_id ORDER BY extracted_at DESC NULLS LAST) AS rn FROM subgraph WHERE subgraph_id IS NOT NULL) WHERE rn = 1),
el AS (SELECT DISTINCT subgraph_id, session_no, kind, id FROM (
  SELECT subgraph_id, session_no, e.key AS kind, unnest(e.value) AS id FROM (SELECT subgraph_id, session_no, unnest(map_entries(nodes)) AS e FROM s)) WHERE id IS NOT NULL),
ed AS (SELECT DISTINCT subgraph_id, rel, x.src AS src, x.dst AS dst FROM (
  SELECT subgraph_id, e.key AS rel, unnest(e.value) AS x FROM (SELECT subgraph_id, unnest(map_entries(edges)) AS e FROM s)))"""
