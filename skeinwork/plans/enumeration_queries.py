"""Queries that generate subgraphs of sessions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.operators import enumeration as E
from skeinwork.plans.subgraph_queries import _members
from skeinwork.plans.views import SUBGRAPHS, subgraphs


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges of each session: those of all its subgraphs together."""
    nodes = _members(spark, sf_dir).where("session_no IS NOT NULL").select(F.col("session_no").alias("session"), "type", "id")
    s = subgraphs(spark, sf_dir, "edges").where("session_no IS NOT NULL").select("session_no", F.explode(F.map_entries("edges")).alias("e"))
    edges = s.select(F.col("session_no").alias("session"), F.col("e.key").alias("rel"), F.explode("e.value").alias("x")).select("session", "rel", "x.src", "x.dst")
    return E.sessions(nodes, edges)


def multi_user_subgraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with an interacting pair among them, their comments, the video and words."""
    return E.described(E.multi_user(_sessions(spark, sf_dir)))


def connected_subgraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compositions of every size connected to windows or samples of comments."""
    return E.described(E.connected(_sessions(spark, sf_dir)))


def seed_subgraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subgraphs around sampled comments."""
    return E.described(E.around_seeds(_sessions(spark, sf_dir)))


def single_type_subgraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.described(E.single_type(_sessions(spark, sf_dir)))


def random_mix_subgraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.described(E.random_mix(_sessions(spark, sf_dir)))


def enumerate_subgraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subgraphs of all generators, each set of nodes once."""
    return E.all_kinds(_sessions(spark, sf_dir))


QUERIES = {f.__name__: f for f in (multi_user_subgraphs, connected_subgraphs, seed_subgraphs, single_type_subgraphs, random_mix_subgraphs, enumerate_subgraphs)}


def _pick(ids: str, n: str, salt: str) -> str:
    return f"list_transform(list_sort(list_transform({ids}, lambda x: struct_pack(h := md5(x::VARCHAR || '|' || {salt}), x := x))), lambda r: r.x)[1:({n})]"


def _drawn(below: str, salt: str) -> str:
    digits = " + ".join(f"{16 ** (6 - i)} * (strpos('0123456789abcdef', substr(md5({salt}), {i}, 1)) - 1)" for i in range(1, 7))
    return f"(({digits}) % ({below}))::INT"


def _sources(pairs: str, targets: str) -> str:
    return f"list_sort(list_distinct(list_transform(list_filter({pairs}, lambda e: list_contains({targets}, e.dst)), lambda e: e.src)))"


def _targets(pairs: str, sources: str) -> str:
    return f"list_sort(list_distinct(list_transform(list_filter({pairs}, lambda e: list_contains({sources}, e.src)), lambda e: e.dst)))"


_RELS = ("user_posts_comment", "comment_contains_word", "video_contains_comment", "user_interacts_user")
_EMPTY = "CAST([] AS BIGINT[])"
_SESSIONS = f"""WITH {SUBGRAPHS},
m0 AS (SELECT DISTINCT session_no AS session, kind AS type, id FROM el WHERE session_no IS NOT NULL),
m1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session, type ORDER BY md5(type || ':' || id || '|42'), id) AS rn FROM m0) WHERE rn <= CASE type WHEN 'comment' THEN 50 WHEN 'user' THEN 8 WHEN 'video' THEN 1 WHEN 'word' THEN 25 ELSE 0 END),
l0 AS (SELECT session, """ + ", ".join(f"list_sort(coalesce(list(id) FILTER (type = '{t}'), {_EMPTY})) AS {t}" for t in ("comment", "user", "video", "word")) + """ FROM m1 GROUP BY session),
e0 AS (SELECT DISTINCT session_no AS session, rel, src, dst, CASE rel WHEN 'comment_contains_word' THEN 'comment' WHEN 'video_contains_comment' THEN 'video' ELSE 'user' END AS st,
  CASE rel WHEN 'comment_contains_word' THEN 'word' WHEN 'user_interacts_user' THEN 'user' ELSE 'comment' END AS dt FROM ed JOIN s USING (subgraph_id) WHERE session_no IS NOT NULL AND rel IN ('""" + "', '".join(_RELS) + """')),
e1 AS (SELECT e0.* FROM e0 JOIN m1 a ON a.session = e0.session AND a.type = st AND a.id = src JOIN m1 b ON b.session = e0.session AND b.type = dt AND b.id = dst),
p0 AS (SELECT session, """ + ", ".join(f"coalesce(list(struct_pack(src := src, dst := dst)) FILTER (rel = '{r}'), []) AS {r}" for r in _RELS) + """ FROM e1 GROUP BY session),
ss AS (SELECT l0.*, """ + ", ".join(f"coalesce({r}, []) AS {r}" for r in _RELS) + """ FROM l0 LEFT JOIN p0 USING (session))"""  # fmt: skip
_MASK = "list_transform(user_interacts_user, lambda e: (1 << (list_position(user, e.src) - 1)) | (1 << (list_position(user, e.dst) - 1)))"
_MULTI = f"""mu0 AS (SELECT *, {_MASK} AS pairs FROM ss WHERE len(user) >= 2),
mu1 AS (SELECT *, unnest(range(3, 1 << len(user))) AS mask FROM mu0),
mu2 AS (SELECT *, list_filter(user, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS u, unnest([6, 8, 10, 12, 14]) AS want FROM mu1 WHERE bit_count(mask) BETWEEN 2 AND 5 AND len(list_filter(pairs, lambda p: bit_count(p) = 2 AND (mask & p) = p)) > 0),
mu3 AS (SELECT *, {_pick(_targets('user_posts_comment', 'u'), 'want - len(u)', "'multi|' || mask || '|' || want")} AS c FROM mu2 WHERE want > len(u)),
mu4 AS (SELECT *, video[1:least(1, want - len(u) - len(c))] AS v FROM mu3),
mu5 AS (SELECT *, {_pick('word', 'want - len(u) - len(c) - len(v)', "'multi|' || mask || '|' || want")} AS w FROM mu4),
multi_user AS (SELECT session, 'multi_user' AS kind, c, u, v, w, {', '.join(_RELS)} FROM mu5)"""
_CONNECTED = f"""cc0 AS (SELECT *, unnest(range(1, least(14, len(comment)) + 1)) AS n FROM ss WHERE (len(user) <= 1 OR len(user_interacts_user) = 0) AND len(comment) > 0),
cc1 AS (SELECT *, unnest(range(0, CASE WHEN n <= 3 THEN least(len(comment) - n + 1, 5) ELSE least(3, len(comment) // n + 1) END)) AS k FROM cc0),
cc2 AS (SELECT *, CASE WHEN n <= 3 THEN comment[(k + 1):(k + n)] ELSE {_pick('comment', 'n', "'comments|' || n || '|' || k")} END AS c FROM cc1),
cc3 AS (SELECT *, {_sources('user_posts_comment', 'c')} AS cu, {_targets('comment_contains_word', 'c')} AS cw, {_sources('video_contains_comment', 'c')} AS cv FROM cc2),
ct AS (SELECT z AS size, a AS n_comment, b AS n_user, x AS n_video, z - a - b - x AS n_word FROM range(6, 16) t0(z), range(1, 15) t1(a), range(0, 15) t2(b), range(0, 2) t3(x) WHERE a < z AND a + b + x <= z),
cc4 AS (SELECT * FROM cc3 JOIN ct ON n_comment = n AND n_user <= len(cu) AND n_video <= len(cv) AND n_word <= len(cw)),
cc5 AS (SELECT *, unnest(range(0, CASE WHEN n_user = 0 THEN 1 WHEN n_user = 1 THEN least(3, len(cu)) ELSE least(3, len(cu) // n_user + 1) END)) AS i FROM cc4),
cc6 AS (SELECT *, unnest(range(0, CASE WHEN n_word = 0 THEN 1 WHEN n_word <= 5 THEN least(4, len(cw) // n_word + 1) ELSE least(2, len(cw) // n_word + 1) END)) AS j FROM cc5),
connected AS (SELECT session, 'connected' AS kind, c, CASE WHEN n_user = 1 THEN cu[(i + 1):(i + 1)] ELSE {_pick('cu', 'n_user', "'users|' || n_user || '|' || i")} END AS u, cv[1:n_video] AS v, {_pick('cw', 'n_word', "'words|' || n_word || '|' || j")} AS w, {', '.join(_RELS)} FROM cc6)"""
_SEEDS = f"""sd0 AS (SELECT *, unnest({_pick('comment', '5', "'seed'")}) AS seed FROM ss), sd1 AS (SELECT *, unnest([6, 8, 10, 12, 14]) AS want FROM sd0),
sd2 AS (SELECT *, {_pick(_sources('user_posts_comment', '[seed]'), 'least((want - 1) // 2, 3)', "'own|' || seed || '|' || want")} AS own FROM sd1),
sd3 AS (SELECT *, {_pick(_targets('comment_contains_word', '[seed]'), 'greatest(0, least(want - 1 - len(own), 5))', "'said|' || seed || '|' || want")} AS w FROM sd2),
sd4 AS (SELECT *, greatest(0, want - 1 - len(own) - len(w)) AS room FROM sd3),
sd5 AS (SELECT *, {_pick('list_filter(comment, lambda y: y <> seed)', 'room // 2', "'others|' || seed || '|' || want")} AS oc FROM sd4),
sd6 AS (SELECT *, {_pick('list_filter(user, lambda y: NOT list_contains(own, y))', 'room - len(oc)', "'others|' || seed || '|' || want")} AS ou FROM sd5),
around_seed AS (SELECT session, 'around_seed' AS kind, list_concat([seed], oc) AS c, list_concat(own, ou) AS u, video[1:least(1, room - len(oc) - len(ou))] AS v, w, {', '.join(_RELS)} FROM sd6)"""
_SINGLE = ", ".join(
    f"st_{t} AS (SELECT session, '{t}_only' AS kind, " + ", ".join((_pick(t, "want", "'single|' || want") if x == at else _EMPTY) + f" AS {x}" for x in "cuvw") + f", {', '.join(_RELS)} FROM (SELECT *, unnest(range(6, least(len({t}), 15) + 1, 2)) AS want FROM ss WHERE len({t}) >= 6))"
    for t, at in (("comment", "c"), ("user", "u"), ("word", "w"))
) + ", single AS (SELECT * FROM st_comment UNION ALL SELECT * FROM st_user UNION ALL SELECT * FROM st_word)"


def _part(of: str, left: str, after: str) -> str:
    room = f"least(({left}) - ({after}), len({of}))"
    return f"CASE WHEN ({left}) <= 0 OR len({of}) = 0 THEN 0 WHEN ({after}) = 0 THEN least({left}, len({of})) WHEN {room} > 0 THEN " + _drawn(f"{room} + 1", f"'{of}|' || session || '|' || k") + " ELSE 0 END"


_MIX = f"""rm0 AS (SELECT *, len(comment) + len(user) + len(word) + len(video) AS total FROM ss), rm1 AS (SELECT *, unnest(range(0, greatest(1, floor(total * 0.3::DOUBLE / 5)::INT))) AS k FROM rm0 WHERE total >= 6),
rm2 AS (SELECT *, 6 + {_drawn('least(15, total) - 5', "'size|' || session || '|' || k")} AS want FROM rm1), rm3 AS (SELECT *, least(want // 2 + 1, len(comment)) AS nc FROM rm2),
rm4 AS (SELECT *, {_part('user', 'want - nc', '(len(word) > 0)::INT + (len(video) > 0)::INT')} AS nu FROM rm3), rm5 AS (SELECT *, {_part('word', 'want - nc - nu', '(len(video) > 0)::INT')} AS nw FROM rm4),
rm6 AS (SELECT *, {_part('video', 'want - nc - nu - nw', '0')} AS nv FROM rm5),
random_mix AS (SELECT session, 'random_mix' AS kind, """ + ", ".join(_pick(t, n, "'mix|' || session || '|' || k") + f" AS {x}" for x, t, n in (("c", "comment", "nc"), ("u", "user", "nu"), ("v", "video", "nv"), ("w", "word", "nw"))) + f", {', '.join(_RELS)} FROM rm6)"  # fmt: skip


def _described(source: str) -> str:
    inside = lambda r, a, b: f"len(list_filter({r}, lambda e: list_contains({a}, e.src) AND list_contains({b}, e.dst)))"
    edges = " + ".join(inside(*x) for x in (("user_posts_comment", "u", "c"), ("comment_contains_word", "c", "w"), ("video_contains_comment", "v", "c"), ("user_interacts_user", "u", "u")))
    listed = ", ".join(f"array_to_string(list_sort({x}), ',') AS {n}" for n, x in (("comments", "c"), ("users", "u"), ("videos", "v"), ("words", "w")))
    return f"SELECT DISTINCT session, kind, {listed}, (len(c) + len(u) + len(v) + len(w))::INT AS size, ({edges})::INT AS n_edges FROM {source} WHERE len(c) + len(u) + len(v) + len(w) BETWEEN 6 AND 15"


SQL = {
    "multi_user_subgraphs": f"{_SESSIONS}, {_MULTI} {_described('multi_user')}",
    "connected_subgraphs": f"{_SESSIONS}, {_CONNECTED} {_described('connected')}",
    "seed_subgraphs": f"{_SESSIONS}, {_SEEDS} {_described('around_seed')}",
    "single_type_subgraphs": f"{_SESSIONS}, {_SINGLE} {_described('single')}",
    "random_mix_subgraphs": f"{_SESSIONS}, {_MIX} {_described('random_mix')}",
    "enumerate_subgraphs": f"{_SESSIONS}, {_MULTI}, {_CONNECTED}, {_SEEDS}, {_SINGLE}, {_MIX}, ea AS ("
    + " UNION ALL ".join(_described(k) for k in ("multi_user", "connected", "around_seed", "single", "random_mix"))
    + ") SELECT session, comments, users, videos, words, size, n_edges, min(kind) AS kind, count(*) AS kinds FROM ea GROUP BY ALL",
}
