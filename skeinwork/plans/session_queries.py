"""Queries on posts, users and times: cleaning, joins, profiles, histograms, samples and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinwork.functions import temporal as T
from skeinwork.functions import text as X
from skeinwork.functions import vectors as V
from skeinwork.operators import cluster, hetero, prepare, sampling, users
from skeinwork.plans.text_queries import _MEASURED, _measured
from skeinwork.plans.views import LABELS, NODES, VIDEOS, nodes, post_labels, read
from skeinwork.sources.writers import missing_sessions


def videos_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.videos(read(spark, sf_dir, "video_posts"))


_TOPICS = [("emotion", ["emotion", "excited", "sad", "happy", "angry"]), ("topic", ["topic", "about"]), ("demographic", ["age", "gender", "teen"])]


def video_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of content the free columns of a video name, first match by emotion, topic, demographic."""
    v = prepare.videos(read(spark, sf_dir, "video_posts"))
    each = v.select("url", F.explode(F.array("column1", "column2")).alias("value")).where("value <> ''")
    low, kind = F.lower("value"), F.lit("other")
    for name, words in reversed(_TOPICS):
        kind = F.when(low.rlike("|".join(words)), name).otherwise(kind)
    return each.groupBy("url").agg(F.concat_ws(",", F.array_sort(F.collect_set(kind))).alias("kinds"), F.count("*").alias("entries"))


def post_label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return post_labels(spark, sf_dir)


def label_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.label_verdicts(read(spark, sf_dir, "session_labels"))


def label_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.label_verdicts(read(spark, sf_dir, "session_labels")).where("conflict").select("session_no", "votes")


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Text, video and user sides, each with a label: from its words, from reviewers, from many commenters."""
    m = _measured(spark, sf_dir)
    text = m.groupBy("post_id").agg((F.avg("share") > 0.01).cast("int").alias("text_label"), F.count("*").alias("comments"))
    video = post_labels(spark, sf_dir).where("label IS NOT NULL").withColumnRenamed("label", "video_label")
    user = m.groupBy("post_id").agg((F.count_if(F.col("hits") > 0) >= 2).cast("int").alias("user_label"), F.count_distinct("user_id").alias("users"))
    return text, video, user


def align_three_modalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, video, user = _sides(spark, sf_dir)
    return prepare.align((text, "text_label"), (video, "video_label"), (user, "user_label")).select("post_id", "label", "comments", "users")


def align_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.align_adaptive(*_sides(spark, sf_dir))


def post_key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with comments and posts with a link: union, intersection and differences."""
    a = read(spark, sf_dir, "comments").select(F.col("postId").alias("post_id")).where("post_id <> ''")
    b = read(spark, sf_dir, "url_map").select("post_id")
    parts = {"both": a.intersect(b), "either": a.union(b).distinct(), "comments_only": a.subtract(b), "links_only": b.subtract(a)}
    out = None
    for name, part in parts.items():
        row = part.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def unlabelled_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with subgraphs but without a verdict: an anti-join as in resuming."""
    no = prepare.session_number
    have = read(spark, sf_dir, "subgraph").select(no(F.col("session_id")).alias("session_id")).where("session_id IS NOT NULL")
    done = read(spark, sf_dir, "session_labels").select(no(F.col("session_id")).alias("session_id")).where("session_id IS NOT NULL")
    return missing_sessions(have, done)


def post_hour_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir).where("ts IS NOT NULL")
    return users.histogram(n, "post_id", F.hour("ts"), list(range(24))).withColumn("counts", F.concat_ws(",", F.col("counts").cast("array<string>")))


def post_weekday_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir).where("ts IS NOT NULL")
    return users.histogram(n, "post_id", F.weekday("ts"), list(range(7))).withColumn("counts", F.concat_ws(",", F.col("counts").cast("array<string>")))


def time_of_day_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir).where("ts IS NOT NULL")
    return n.groupBy(T.time_of_day(F.hour("ts")).alias("time_of_day"), T.period_of_day(F.hour("ts")).alias("period")).agg(F.count("*").alias("comments"))


def month_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir).where("ts IS NOT NULL")
    return n.groupBy(F.year("ts").alias("year"), F.month("ts").alias("month")).agg(F.count("*").alias("comments"), F.count_distinct("user_id").alias("users"))


def comment_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds from each comment of a user to the one before."""
    w = Window.partitionBy("user_id").orderBy("ts", "id")
    n = nodes(spark, sf_dir).where("ts IS NOT NULL AND user_id IS NOT NULL")
    return n.select("id", F.round(T.gap_seconds(F.col("ts"), F.lag("ts").over(w)), 3).alias("gap")).where("gap IS NOT NULL")


def post_timespan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per post: comments, seconds from first to last (null below two), and mean seconds between."""
    n = nodes(spark, sf_dir).where("ts IS NOT NULL")
    g = n.groupBy("post_id").agg(F.count("*").alias("comments"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    span = F.when(F.col("comments") > 1, T.gap_seconds(F.col("hi"), F.col("lo")))
    return g.select("post_id", "comments", F.round(span, 3).alias("span"), F.round(span / (F.col("comments") - 1), 3).alias("mean_gap"))


def user_peak_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir).where("ts IS NOT NULL AND user_id IS NOT NULL")
    return users.peak(n, "user_id", F.hour("ts"), [F.col("ts"), F.col("id")]).withColumnRenamed("bucket", "hour")


def post_peak_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir).where("ts IS NOT NULL")
    return users.peak(n, "post_id", T.period_of_day(F.hour("ts")), [F.col("ts"), F.col("id")]).withColumnRenamed("bucket", "period")


def user_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir).withColumn("created", F.col("ts"))
    return users.profiles(n)


def _user_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir).where("user_id IS NOT NULL").withColumn("score", F.least(F.lit(1.0), 3 * F.col("share")))


def user_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' aggression, 0.6 mean + 0.2 maximum + 0.2 share above 0.3, and its level."""
    u = users.blended_aggression(_user_scores(spark, sf_dir), "user_id", "score")
    return u.select("user_id", "comments", F.round("aggression", 6).alias("aggression"), users.level(F.round("aggression", 6)).alias("level"))


def user_level_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_levels(spark, sf_dir).groupBy("level").agg(F.count("*").alias("users"), F.round(F.avg("aggression"), 4).alias("mean"))


def user_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 most aggressive users: a top-k report."""
    return user_levels(spark, sf_dir).orderBy(F.col("aggression").desc(), "user_id").limit(10).select("user_id", "aggression")


def user_top5_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's five most aggressive comments above 0.3."""
    s = _user_scores(spark, sf_dir).where("score > 0.3")
    return sampling.top_per_group(s, ["user_id"], [F.col("score").desc(), F.col("id")], 5).select("user_id", "id", F.round("score", 6).alias("score"))


def user_totals_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals of users, those of verified comments brought up to date with the rest."""
    s = _user_scores(spark, sf_dir).join(nodes(spark, sf_dir).select("id", "verified"), "id")
    totals = lambda df: df.groupBy("user_id").agg(F.count("*").alias("comments"), F.sum("score").alias("total"), F.max("score").alias("top"), F.count_if(F.col("score") > 0.3).alias("above"))
    merged = users.merge_totals(totals(s.where("verified")), totals(s.where("NOT verified OR verified IS NULL")), "user_id")
    return merged.select("user_id", "comments", F.round("total", 6).alias("total"), F.round("top", 6).alias("top"), "above")


def population_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = users.population(read(spark, sf_dir, "events"), "value", "event_type")
    return p.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "deviation", "least", "greatest", "median")])


def user_bullying_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: comments in posts labelled 1 and 0, and the share of the former."""
    n = nodes(spark, sf_dir).where("user_id IS NOT NULL").join(post_labels(spark, sf_dir), "post_id", "left")
    g = n.groupBy("user_id").agg(F.count("*").alias("comments"), F.count_distinct("post_id").alias("posts"), F.count_if(F.col("label") == 1).alias("positive"), F.count_if(F.col("label") == 0).alias("negative"))
    return g.withColumn("ratio", F.round(X.ratio(F.col("positive"), F.col("positive") + F.col("negative")), 6))


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user of events: changes of type, most frequent type, mean positive gap to the next event."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events").withColumn("nxt", F.lead("ts").over(w)).withColumn("prev", F.lag("event_type").over(w))
    gap = T.gap_seconds(F.col("nxt"), F.col("ts"))
    g = e.groupBy("user_id").agg(F.count_if(F.col("prev") != F.col("event_type")).alias("changes"), F.round(F.avg(F.when(gap > 0, gap)), 3).alias("mean_gap"))
    top = users.peak(e, "user_id", F.col("event_type"), [F.col("ts"), F.col("event_id")]).select("user_id", F.col("bucket").alias("mode"))
    return g.join(top, "user_id")


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.min(k).alias("least"), F.max(k).alias("greatest"), F.sum(k).alias("total"), F.count(k).alias("n"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly windows over events: the batch form of the streaming operator."""
    from skeinwork.streaming.windows import tumbling

    return tumbling(read(spark, sf_dir, "events"), "ts", "1 hour", "event_type", "value").select("start", "event_type", "n", F.round("total", 6).alias("total"))


def sample_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """50 events of each type by hash: a sampling operator."""
    return sampling.sample_per_stratum(read(spark, sf_dir, "events"), "event_type", "event_id", 50).select("event_type", "event_id")


def quality_random_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 200 events: 140 of greatest value, 60 of the rest by hash."""
    return sampling.quality_then_random(read(spark, sf_dir, "events").select("event_id", "value"), "event_id", "value", 200).select("event_id", "pick")


def diverse_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by three strategies: 20 of each value bin, the 30 greatest, 25 others: a sampling operator."""
    return sampling.diverse(read(spark, sf_dir, "events"), "event_id", "value", [10.0, 50.0, 100.0], 20, 30, 25)


def evenly_spaced_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten comments of each post, evenly spaced in order of their ids: a sampling operator."""
    n = nodes(spark, sf_dir).select("post_id", "id").where("post_id IS NOT NULL")
    return sampling.evenly_spaced(n, ["post_id"], [F.col("id")], 10)


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts split 0.7 / 0.2 / 0.1 within each label."""
    p = post_labels(spark, sf_dir).groupBy("post_id").agg(F.max("label").alias("label"))
    return sampling.stratified_split(p, "post_id", "label", {"train": 0.7, "validation": 0.2, "test": 0.1})


def shuffle_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.lit(0).alias("one"))
    return sampling.stratified_split(o, "o_orderkey", "one", {"train": 0.7, "validation": 0.2, "test": 0.1})


_SCALED = ["l_quantity", "l_extendedprice", "l_discount"]


def minmax_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *_SCALED)
    out = V.scale(li, _SCALED, V.scaling(li, _SCALED))
    return out.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in _SCALED])


def zscore_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *_SCALED)
    out = V.scale(li, _SCALED, V.scaling(li, _SCALED, "zscore"))
    return out.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in _SCALED])


def column_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = hetero.column_report(read(spark, sf_dir, "lineitem"), _SCALED)
    return r.select("column", *[F.round(c, 6).alias(c) for c in ("least", "greatest", "mean", "non_zero")])


def quartile_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = cluster.quantile_bins(read(spark, sf_dir, "events").select("event_id", "value"), "value", [0.25, 0.5, 0.75])
    return b.groupBy("bin").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


def dbscan_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of event values within each type."""
    return cluster.dbscan(read(spark, sf_dir, "events"), "event_id", ["value"], 0.455, 3, "event_type")


_SHARES = "CASE WHEN r <= floor(n * 0.7 + 1e-9) THEN 'train' WHEN r <= floor(n * ({b}) + 1e-9) THEN 'validation' ELSE 'test' END AS split"
_USERS = _MEASURED + ", us AS (SELECT id, user_id, least(1.0, 3 * share) AS score FROM ms WHERE user_id IS NOT NULL)"
_LEVELS = _USERS + """, lv AS (SELECT user_id, count(*) AS comments, round(0.6 * avg(score) + 0.2 * max(score) + 0.2 * (count(*) FILTER (score > 0.3) / count(*)), 6) AS aggression FROM us GROUP BY user_id),
ll AS (SELECT *, CASE WHEN aggression >= 0.7 THEN 'high' WHEN aggression >= 0.4 THEN 'medium' WHEN aggression >= 0.1 THEN 'low' ELSE 'none' END AS level FROM lv)"""
_SIDES = _MEASURED + f""", {VIDEOS}, {LABELS},
a AS (SELECT post_id, (avg(share) > 0.01)::INT AS la, count(*) AS comments FROM ms GROUP BY post_id),
b AS (SELECT post_id, label AS lb FROM pl WHERE label IS NOT NULL),
c AS (SELECT post_id, (count(*) FILTER (hits > 0) >= 2)::INT AS lc, count(DISTINCT user_id) AS users FROM ms GROUP BY post_id)"""
_PERIOD = "CASE WHEN h < 6 THEN 'night' WHEN h < 12 THEN 'morning' WHEN h < 18 THEN 'afternoon' ELSE 'evening' END"
_V_NO = r"nullif(regexp_extract(coalesce(session_id, ''), '(\d+)\D*$', 1), '')::BIGINT"


def _hist(bucket: str, n: int) -> str:
    return f"WITH {NODES}, h AS (SELECT post_id, {bucket} AS h FROM n WHERE ts IS NOT NULL) SELECT post_id, array_to_string([" + ", ".join(f"count(*) FILTER (h = {i})" for i in range(n)) + "], ',') AS counts FROM h GROUP BY post_id"


def _scaled(kind: str) -> str:
    low, span = ("min({c})", "max({c}) - min({c})") if kind == "minmax" else ("avg({c})", "stddev_pop({c})")
    stats = ", ".join(f"{low.format(c=c)} AS a_{c}, {span.format(c=c)} AS b_{c}" for c in _SCALED)
    cols = ", ".join(f"round(({c} - a_{c}) / CASE WHEN b_{c} = 0 THEN 1 ELSE b_{c} END, 6) + 0.0 AS {c}" for c in _SCALED)
    return f"WITH p AS (SELECT {stats} FROM lineitem) SELECT l_orderkey, l_linenumber, {cols} FROM lineitem, p"


QUERIES = {
    f.__name__: f
    for f in (
        videos_clean, video_content, post_label_join, label_verdicts, label_conflicts, align_three_modalities, align_adaptive, post_key_sets, unlabelled_sessions, post_hour_histogram,
        post_weekday_histogram, time_of_day_counts, month_counts, comment_gaps, post_timespan, user_peak_hour, post_peak_period, user_profiles, user_levels, user_level_distribution, user_top_n,
        user_top5_examples, user_totals_merged, population_stats, user_bullying_ratio, event_runs, json_props, event_windows, sample_per_type, quality_random_sample, diverse_sample, evenly_spaced_comments,
        stratified_split, shuffle_split, minmax_scale, zscore_scale, column_report, quartile_bins, dbscan_1d,
    )
}

SQL = {
    "videos_clean": f"WITH {VIDEOS} SELECT url, username, mediacaption, created, like_count, label, column1, column2 FROM v",
    "video_content": f"""WITH {VIDEOS}, e AS (SELECT url, unnest([column1, column2]) AS value FROM v),
k AS (SELECT url, CASE """ + " ".join(f"WHEN regexp_matches(lower(value), '{'|'.join(w)}') THEN '{n}'" for n, w in _TOPICS) + """ ELSE 'other' END AS kind FROM e WHERE value <> '')
SELECT url, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds, count(*) AS entries FROM k GROUP BY url""",
    "post_label_join": f"WITH {VIDEOS}, {LABELS} SELECT post_id, label FROM pl",
    "label_verdicts": f"""WITH r AS (SELECT {_V_NO} AS session_no, is_bullying, coalesce(annotators, 1) AS n FROM session_labels)
SELECT session_no, count(*) AS votes, CASE WHEN coalesce(sum(n) FILTER (is_bullying = 1), 0) >= coalesce(sum(n) FILTER (is_bullying <> 1), 0) THEN 1 ELSE 0 END::INT AS is_bullying,
  count(DISTINCT is_bullying) > 1 AS conflict FROM r WHERE session_no IS NOT NULL AND is_bullying IS NOT NULL GROUP BY session_no""",
    "label_conflicts": f"WITH r AS (SELECT {_V_NO} AS session_no, is_bullying FROM session_labels) SELECT session_no, count(*) AS votes FROM r WHERE session_no IS NOT NULL AND is_bullying IS NOT NULL GROUP BY session_no HAVING count(DISTINCT is_bullying) > 1",
    "align_three_modalities": _SIDES + " SELECT a.post_id, la AS label, comments, users FROM a JOIN b ON b.post_id = a.post_id JOIN c ON c.post_id = a.post_id WHERE la = lb AND la = lc",
    "align_adaptive": _SIDES + " SELECT DISTINCT a.post_id, 'text+video' AS modalities FROM a JOIN b ON b.post_id = a.post_id",
    "post_key_sets": """WITH a AS (SELECT DISTINCT postId AS p FROM comments WHERE postId <> ''), b AS (SELECT DISTINCT post_id AS p FROM url_map WHERE post_id IS NOT NULL)
SELECT 'both' AS part, count(*) AS n FROM (SELECT p FROM a INTERSECT SELECT p FROM b) UNION ALL SELECT 'either', count(*) FROM (SELECT p FROM a UNION SELECT p FROM b)
UNION ALL SELECT 'comments_only', count(*) FROM (SELECT p FROM a EXCEPT SELECT p FROM b) UNION ALL SELECT 'links_only', count(*) FROM (SELECT p FROM b EXCEPT SELECT p FROM a)""",
    "unlabelled_sessions": f"WITH a AS (SELECT DISTINCT {_V_NO} AS session_id FROM subgraph), b AS (SELECT DISTINCT {_V_NO} AS session_id FROM session_labels) SELECT session_id FROM a WHERE session_id IS NOT NULL AND session_id NOT IN (SELECT session_id FROM b WHERE session_id IS NOT NULL)",
    "post_hour_histogram": _hist("hour(ts)", 24),
    "post_weekday_histogram": _hist("isodow(ts) - 1", 7),
    "time_of_day_counts": f"""WITH {NODES}, h AS (SELECT hour(ts) AS h FROM n WHERE ts IS NOT NULL)
SELECT CASE WHEN h >= 5 AND h < 12 THEN 'morning' WHEN h >= 12 AND h < 17 THEN 'afternoon' WHEN h >= 17 AND h < 22 THEN 'evening' ELSE 'night' END AS time_of_day, {_PERIOD} AS period, count(*) AS comments FROM h GROUP BY 1, 2""",
    "month_counts": f"WITH {NODES} SELECT year(ts)::INT AS year, month(ts)::INT AS month, count(*) AS comments, count(DISTINCT user_id) AS users FROM n WHERE ts IS NOT NULL GROUP BY 1, 2",
    "comment_gaps": f"""WITH {NODES}, g AS (SELECT id, round((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, id))) / 1e6, 3) AS gap FROM n WHERE ts IS NOT NULL AND user_id IS NOT NULL)
SELECT id, gap FROM g WHERE gap IS NOT NULL""",
    "post_timespan": f"""WITH {NODES}, g AS (SELECT post_id, count(*) AS comments, CASE WHEN count(*) > 1 THEN (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 END AS sp FROM n WHERE ts IS NOT NULL GROUP BY post_id)
SELECT post_id, comments, round(sp, 3) AS span, round(sp / nullif(comments - 1, 0), 3) AS mean_gap FROM g""",
    "user_peak_hour": f"""WITH {NODES}, c AS (SELECT user_id, hour(ts)::INT AS hour, count(*) AS n, min(struct_pack(a := ts, b := id)) AS f FROM n WHERE ts IS NOT NULL AND user_id IS NOT NULL GROUP BY 1, 2)
SELECT user_id, hour, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS rn FROM c) WHERE rn = 1""",
    "post_peak_period": f"""WITH {NODES}, h AS (SELECT post_id, hour(ts) AS h, ts, id FROM n WHERE ts IS NOT NULL), c AS (SELECT post_id, {_PERIOD} AS period, count(*) AS n, min(struct_pack(a := ts, b := id)) AS f FROM h GROUP BY 1, 2)
SELECT post_id, period, n FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY n DESC, f) AS rn FROM c) WHERE rn = 1""",
    "user_profiles": f"""WITH {NODES},
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, comment_id NULLS FIRST) AS up, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, comment_id DESC NULLS LAST) AS down FROM n WHERE user_id IS NOT NULL)
SELECT user_id, count(*) AS comments, count(DISTINCT post_id) AS posts, min(ts) AS first_seen, max(ts) AS last_seen, any_value(username) FILTER (down = 1) AS last_name,
  any_value(location) FILTER (down = 1) AS last_location, any_value(verified) FILTER (up = 1) AS first_verified, count(DISTINCT location) AS locations FROM r GROUP BY user_id""",
    "user_levels": _LEVELS + " SELECT user_id, comments, aggression, level FROM ll",
    "user_level_distribution": _LEVELS + " SELECT level, count(*) AS users, round(avg(aggression), 4) AS mean FROM ll GROUP BY level",
    "user_top_n": _LEVELS + " SELECT user_id, aggression FROM ll ORDER BY aggression DESC, user_id LIMIT 10",
    "user_top5_examples": _USERS + " SELECT user_id, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, id) AS rn FROM us WHERE score > 0.3) WHERE rn <= 5",
    "user_totals_merged": _USERS + " SELECT user_id, count(*) AS comments, round(sum(score), 6) AS total, round(max(score), 6) AS top, count(*) FILTER (score > 0.3) AS above FROM us GROUP BY user_id",
    "population_stats": "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation, round(min(value), 6) AS least, round(max(value), 6) AS greatest, round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY event_type",
    "user_bullying_ratio": f"""WITH {NODES}, {VIDEOS}, {LABELS},
g AS (SELECT user_id, count(*) AS comments, count(DISTINCT n.post_id) AS posts, count(*) FILTER (label = 1) AS positive, count(*) FILTER (label = 0) AS negative FROM n LEFT JOIN pl ON pl.post_id = n.post_id WHERE user_id IS NOT NULL GROUP BY user_id)
SELECT *, round(CASE WHEN positive + negative > 0 THEN positive / (positive + negative) ELSE 0 END, 6) AS ratio FROM g""",
    "event_runs": """WITH e AS (SELECT user_id, event_type, ts, event_id, lead(ts) OVER w AS nxt, lag(event_type) OVER w AS prev FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
x AS (SELECT *, (epoch_us(nxt) - epoch_us(ts)) / 1e6 AS gap FROM e),
g AS (SELECT user_id, count(*) FILTER (prev <> event_type) AS changes, round(avg(gap) FILTER (gap > 0), 3) AS mean_gap FROM x GROUP BY user_id),
c AS (SELECT user_id, event_type, count(*) AS n, min(struct_pack(a := ts, b := event_id)) AS f FROM e GROUP BY 1, 2),
t AS (SELECT user_id, event_type AS mode FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS rn FROM c) WHERE rn = 1)
SELECT g.user_id, changes, mean_gap, mode FROM g JOIN t ON t.user_id = g.user_id""",
    "json_props": "WITH k AS (SELECT event_type, json_extract_string(props, '$.k')::INT AS k FROM events) SELECT event_type, min(k) AS least, max(k) AS greatest, sum(k)::BIGINT AS total, count(k) AS n FROM k GROUP BY event_type",
    "event_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
    "sample_per_type": "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id || '|42'), event_id) AS rn FROM events) WHERE rn <= 50",
    "quality_random_sample": """WITH q AS (SELECT event_id FROM events ORDER BY value DESC, event_id LIMIT 140), o AS (SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM q) ORDER BY md5(event_id || '|42'), event_id LIMIT 60)
SELECT event_id, 'quality' AS pick FROM q UNION ALL SELECT event_id, 'random' FROM o""",
    "diverse_sample": """WITH b AS (SELECT event_id, value, (value >= 10)::INT + (value >= 50)::INT + (value >= 100)::INT AS bin, md5(event_id || '|42') AS h FROM events),
c AS (SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY h, event_id) AS rn FROM b) WHERE rn <= 20 UNION SELECT event_id FROM (SELECT event_id FROM b ORDER BY value DESC, event_id LIMIT 30))
SELECT event_id FROM c UNION ALL SELECT event_id FROM (SELECT event_id FROM b WHERE event_id NOT IN (SELECT event_id FROM c) ORDER BY h, event_id LIMIT 25)""",
    "evenly_spaced_comments": f"""WITH {NODES}, r AS (SELECT post_id, id, row_number() OVER (PARTITION BY post_id ORDER BY id) - 1 AS a, count(*) OVER (PARTITION BY post_id) AS c FROM n WHERE post_id IS NOT NULL)
SELECT post_id, id FROM r WHERE c <= 10 OR a IN (c * 0 // 10, c * 1 // 10, c * 2 // 10, c * 3 // 10, c * 4 // 10, c * 5 // 10, c * 6 // 10, c * 7 // 10, c * 8 // 10, c * 9 // 10)""",
    "stratified_split": f"""WITH {VIDEOS}, {LABELS}, p AS (SELECT post_id, max(label) AS label FROM pl GROUP BY post_id),
r AS (SELECT post_id, row_number() OVER (PARTITION BY label ORDER BY md5(post_id || '|42'), post_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM p)
SELECT post_id, {_SHARES.format(b='0.7 + 0.2')} FROM r""",
    "shuffle_split": f"""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(o_orderkey || '|42'), o_orderkey) AS r, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, {_SHARES.format(b='0.7 + 0.2')} FROM r""",
    "minmax_scale": _scaled("minmax"),
    "zscore_scale": _scaled("zscore"),
    "column_report": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(min({c}), 6) AS least, round(max({c}), 6) AS greatest, round(avg({c}), 6) AS mean, round(avg(({c} <> 0)::INT), 6) AS non_zero FROM lineitem" for c in _SCALED),
    "quartile_bins": """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM events)
SELECT ((value > a)::INT + (value > b)::INT + (value > c)::INT)::INT AS bin, count(*) AS n, min(value) AS low, max(value) AS high FROM events, q GROUP BY 1""",
    "dbscan_1d": """WITH c AS (SELECT event_type AS t, value AS v, count(*) AS n, min(event_id) AS k FROM events GROUP BY 1, 2),
d AS (SELECT *, sum(n) OVER (PARTITION BY t ORDER BY v RANGE BETWEEN 0.455 PRECEDING AND 0.455 FOLLOWING) >= 3 AS core FROM c),
o AS (SELECT t, v, k, coalesce((v - lag(v) OVER (PARTITION BY t ORDER BY v) > 0.455)::INT, 0) AS new FROM d WHERE core),
m AS (SELECT t, v, k, sum(new) OVER (PARTITION BY t ORDER BY v) AS no FROM o),
lab AS (SELECT t, v, min(k) OVER (PARTITION BY t, no) AS cluster FROM m),
j AS (SELECT d.t, d.v, d.core, lab.v AS cv, lab.cluster FROM d LEFT JOIN lab ON lab.t = d.t AND lab.v = d.v),
p AS (SELECT t, v, core, cluster, last_value(cv IGNORE NULLS) OVER l AS lv, last_value(cluster IGNORE NULLS) OVER l AS lc, first_value(cv IGNORE NULLS) OVER r AS rv, first_value(cluster IGNORE NULLS) OVER r AS rc
  FROM j WINDOW l AS (PARTITION BY t ORDER BY v ROWS UNBOUNDED PRECEDING), r AS (PARTITION BY t ORDER BY v ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT e.event_id, CASE WHEN core THEN cluster ELSE least(CASE WHEN p.v - lv <= 0.455 THEN lc END, CASE WHEN rv - p.v <= 0.455 THEN rc END) END AS cluster FROM events e JOIN p ON p.t = e.event_type AND p.v = e.value""",
}
