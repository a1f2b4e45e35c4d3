"""Generators of small subgraphs of a session, as table-valued operators.

A session is one row: its capped nodes by type and the edges among them, so every generator is a
projection of arrays of bounded size, spread over sessions, without a shuffle.  Where nodes are sampled,
they are taken in the order of a hash of their id and a salt of the place they are sampled for: the same
input gives the same subgraphs anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.operators.subgraphs import capped_nodes, every_composition
from skeinwork.storage import Stash

#: Most nodes of a type that take part, by hash; the sampling is the operators' own.
CAPS = {"comment": 50, "user": 8, "video": 1, "word": 25}
#: Relation -> types of its ends.
RELATIONS = {"user_posts_comment": ("user", "comment"), "comment_contains_word": ("comment", "word"), "video_contains_comment": ("video", "comment"), "user_interacts_user": ("user", "user")}
LOW, HIGH = 6, 15
_IDS, _ENDS = "array<bigint>", "array<struct<src:bigint,dst:bigint>>"


def sessions(nodes: DataFrame, edges: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """One row a session: ``session, comment, user, video, word`` (ids in order) and an array of edges for each
    relation of ``RELATIONS``, from ``session, type, id`` and ``session, rel, src, dst``.  Edges keep both ends
    among the nodes."""
    kept = capped_nodes(nodes.select("session", "type", "id").distinct(), caps or CAPS)
    lists = kept.groupBy("session").agg(*[F.array_sort(F.collect_list(F.when(F.col("type") == t, F.col("id")))).alias(t) for t in CAPS])  # at most the caps
    typed = edges.where(F.col("rel").isin(list(RELATIONS))).select("session", "rel", "src", "dst").distinct()
    side = lambda at: F.element_at(F.create_map(*[x for r, ends in RELATIONS.items() for x in (F.lit(r), F.lit(ends[at]))]), F.col("rel"))
    ends = kept.select("session", "type", "id")
    both = typed.withColumns({"s": side(0), "d": side(1)})
    both = both.join(ends.select("session", F.col("type").alias("s"), F.col("id").alias("src")), ["session", "s", "src"], "left_semi")
    both = both.join(ends.select("session", F.col("type").alias("d"), F.col("id").alias("dst")), ["session", "d", "dst"], "left_semi")
    pairs = both.groupBy("session").agg(*[F.array_sort(F.collect_list(F.when(F.col("rel") == r, F.struct("src", "dst")))).alias(r) for r in RELATIONS])
    joined = lists.join(pairs, "session", "left")
    return joined.select("session", *[F.coalesce(t, F.array().cast(_IDS)).alias(t) for t in CAPS], *[F.coalesce(r, F.array().cast(_ENDS)).alias(r) for r in RELATIONS])


def pick(ids: Column, n, *salt) -> Column:
    """The first n ids in the order of a hash with a salt."""
    tail = F.concat_ws("|", *[s if isinstance(s, Column) else F.lit(s) for s in salt])
    ranked = F.array_sort(F.transform(ids, lambda x: F.struct(F.md5(F.concat(x.cast("string"), F.lit("|"), tail)).alias("h"), x.alias("x"))))
    return F.slice(F.transform(ranked, lambda t: t["x"]), 1, n if isinstance(n, int) else n.cast("int"))


def drawn(below: Column, *salt) -> Column:
    """A number from 0 to ``below`` - 1, by hash."""
    h = F.md5(F.concat_ws("|", *[s if isinstance(s, Column) else F.lit(s) for s in salt]))
    return (F.conv(F.substring(h, 1, 6), 16, 10).cast("bigint") % below).cast("int")


def _sources(pairs: str, targets: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.filter(F.col(pairs), lambda e: F.array_contains(targets, e["dst"])), lambda e: e["src"])))


def _targets(pairs: str, sources: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.filter(F.col(pairs), lambda e: F.array_contains(sources, e["src"])), lambda e: e["dst"])))


_NODES = ("c", "u", "v", "w")


def _rows(df: DataFrame, kind: str, low: int = LOW, high: int = HIGH) -> DataFrame:
    """``session, kind, c, u, v, w`` and the relations of subgraphs of a size in range."""
    total = sum((F.size(x) for x in _NODES[1:]), F.size("c"))
    return df.where(total.between(low, high)).select("session", F.lit(kind).alias("kind"), *_NODES, *RELATIONS)


def _empty() -> Column:
    return F.array().cast(_IDS)


def multi_user(s: DataFrame, low: int = LOW, high: int = HIGH) -> DataFrame:
    """Two to five users with an interacting pair among them, at every second size: their comments first,
    then the video, then words.  Users are at most eight, so there are at most 70 sets of a number."""
    masks = F.expr("transform(user_interacts_user, e -> shiftleft(1, cast(array_position(user, e.src) - 1 AS int)) | shiftleft(1, cast(array_position(user, e.dst) - 1 AS int)))")
    rows = s.where(F.size("user") >= 2).withColumn("_pairs", masks)
    rows = rows.select("*", F.expr("explode(sequence(3, shiftleft(1, size(user)) - 1)) AS _mask"))
    rows = rows.where("bit_count(_mask) BETWEEN 2 AND 5 AND exists(_pairs, p -> bit_count(p) = 2 AND (_mask & p) = p)")
    rows = rows.withColumn("u", F.expr("filter(user, (x, i) -> (shiftright(_mask, i) & 1) = 1)"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(low), F.lit(high), F.lit(2))).alias("_size")).withColumn("_left", F.col("_size") - F.size("u")).where("_left > 0")
    key = (F.col("_mask").cast("string"), F.col("_size").cast("string"))
    rows = rows.withColumn("c", pick(_targets("user_posts_comment", F.col("u")), F.col("_left"), "multi", *key))
    rows = rows.withColumn("v", F.slice("video", 1, F.least(F.lit(1), F.col("_left") - F.size("c"))))
    rows = rows.withColumn("w", pick(F.col("word"), F.col("_left") - F.size("c") - F.size("v"), "multi", *key))
    return _rows(rows, "multi_user", low, high)


def connected(s: DataFrame, low: int = LOW, high: int = HIGH) -> DataFrame:
    """Of sessions without interacting users, every composition by type of every size, filled with what is
    connected to a window (up to three comments) or a sample of the comments."""
    rows = s.where("(size(user) <= 1 OR size(user_interacts_user) = 0) AND size(comment) > 0")
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(high - 1), F.size("comment")))).alias("_n"))
    tries = F.when(F.col("_n") <= 3, F.least(F.size("comment") - F.col("_n") + 1, F.lit(5))).otherwise(F.least(F.lit(3), F.floor(F.size("comment") / F.col("_n")).cast("int") + 1))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), tries - 1)).alias("_k"))
    window, sample = F.slice("comment", F.col("_k") + 1, F.col("_n")), pick(F.col("comment"), F.col("_n"), "comments", F.col("_n").cast("string"), F.col("_k").cast("string"))
    rows = rows.withColumn("c", F.when(F.col("_n") <= 3, window).otherwise(sample))
    rows = rows.withColumns({"_u": _sources("user_posts_comment", F.col("c")), "_w": _targets("comment_contains_word", F.col("c")), "_v": _sources("video_contains_comment", F.col("c"))})
    table = every_composition(s.sparkSession, low, high)  # of a fixed size
    rows = rows.join(F.broadcast(table), (F.col("n_comment") == F.col("_n")) & (F.col("n_user") <= F.size("_u")) & (F.col("n_video") <= F.size("_v")) & (F.col("n_word") <= F.size("_w")))
    users = F.when(F.col("n_user") == 0, 1).when(F.col("n_user") == 1, F.least(F.lit(3), F.size("_u"))).otherwise(F.least(F.lit(3), F.floor(F.size("_u") / F.col("n_user")).cast("int") + 1))
    most = F.when(F.col("n_word") <= 5, 4).otherwise(2)
    words = F.when(F.col("n_word") == 0, 1).otherwise(F.least(most, F.floor(F.size("_w") / F.col("n_word")).cast("int") + 1))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), users - 1)).alias("_i")).select("*", F.explode(F.sequence(F.lit(0), words - 1)).alias("_j"))
    one = F.slice("_u", F.col("_i") + 1, 1)
    chosen = F.when(F.col("n_user") == 1, one).otherwise(pick(F.col("_u"), F.col("n_user"), "users", F.col("n_user").cast("string"), F.col("_i").cast("string")))
    rows = rows.withColumns({"u": chosen, "v": F.slice("_v", 1, F.col("n_video")), "w": pick(F.col("_w"), F.col("n_word"), "words", F.col("n_word").cast("string"), F.col("_j").cast("string"))})
    return _rows(rows, "connected", low, high)


def around_seeds(s: DataFrame, seeds: int = 5, low: int = LOW, high: int = HIGH) -> DataFrame:
    """Around ``seeds`` sampled comments a session, at every second size: at most three of the comment's
    users and five of its words, then other comments for half of what is missing, other users, the video."""
    rows = s.select("*", F.explode(pick(F.col("comment"), seeds, "seed")).alias("_seed"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(low), F.lit(high), F.lit(2))).alias("_size"))
    key = (F.col("_seed").cast("string"), F.col("_size").cast("string"))
    own, said = _sources("user_posts_comment", F.array("_seed")), _targets("comment_contains_word", F.array("_seed"))
    rows = rows.withColumn("_u", pick(own, F.least(F.floor((F.col("_size") - 1) / 2), F.lit(3)), "own", *key))
    rows = rows.withColumn("w", pick(said, F.greatest(F.lit(0), F.least(F.col("_size") - 1 - F.size("_u"), F.lit(5))), "said", *key))
    rows = rows.withColumn("_left", F.greatest(F.lit(0), F.col("_size") - 1 - F.size("_u") - F.size("w")))
    rows = rows.withColumn("_c", pick(F.array_except("comment", F.array("_seed")), F.floor(F.col("_left") / 2), "others", *key))
    rows = rows.withColumn("_left", F.col("_left") - F.size("_c"))
    rows = rows.withColumn("_more", pick(F.array_except("user", "_u"), F.col("_left"), "others", *key))
    rows = rows.withColumn("v", F.slice("video", 1, F.least(F.lit(1), F.col("_left") - F.size("_more"))))
    return _rows(rows.withColumns({"c": F.concat(F.array("_seed"), F.col("_c")), "u": F.concat("_u", "_more")}), "around_seed", low, high)


def single_type(s: DataFrame, low: int = LOW, high: int = HIGH) -> DataFrame:
    """Nodes of one type (comments, users or words) at every second size the session has enough of."""
    parts = []
    for t, at in (("comment", "c"), ("user", "u"), ("word", "w")):
        rows = s.where(F.size(t) >= low).select("*", F.explode(F.sequence(F.lit(low), F.least(F.size(t), F.lit(high)), F.lit(2))).alias("_size"))
        rows = rows.withColumns({x: pick(F.col(t), F.col("_size"), "single", F.col("_size").cast("string")) if x == at else _empty() for x in _NODES})
        parts.append(_rows(rows, f"{t}_only", low, high))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def random_mix(s: DataFrame, share: float = 0.3, low: int = LOW, high: int = HIGH) -> DataFrame:
    """``share`` / 5 as many subgraphs as the session has nodes (one at least), of sizes drawn by hash: comments
    for half and one more, the other types by draws of what is left, the last one with the rest."""
    total = F.size("comment") + F.size("user") + F.size("word") + F.size("video")
    rows = s.withColumn("_total", total).where(F.col("_total") >= low)
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.floor(F.col("_total") * share / 5).cast("int")) - 1)).alias("_k"))
    key = (F.col("session").cast("string"), F.col("_k").cast("string"))
    rows = rows.withColumn("_size", low + drawn(F.least(F.lit(high), F.col("_total")) - low + 1, "size", *key))
    rows = rows.withColumn("_nc", F.least(F.floor(F.col("_size") / 2).cast("int") + 1, F.size("comment")))

    def part(of: str, left: Column, after: Column) -> Column:
        room = F.least(left - after, F.size(of))
        free = F.when(room > 0, drawn(room + 1, of, *key)).otherwise(0)
        return F.when((left <= 0) | (F.size(of) == 0), 0).when(after == 0, F.least(left, F.size(of))).otherwise(free)

    has = lambda t: (F.size(t) > 0).cast("int")
    rows = rows.withColumn("_nu", part("user", F.col("_size") - F.col("_nc"), has("word") + has("video")))
    rows = rows.withColumn("_nw", part("word", F.col("_size") - F.col("_nc") - F.col("_nu"), has("video")))
    rows = rows.withColumn("_nv", part("video", F.col("_size") - F.col("_nc") - F.col("_nu") - F.col("_nw"), F.lit(0)))
    rows = rows.withColumns({x: pick(F.col(t), F.col(n), "mix", *key) for x, t, n in (("c", "comment", "_nc"), ("u", "user", "_nu"), ("v", "video", "_nv"), ("w", "word", "_nw"))})
    return _rows(rows, "random_mix", low, high)


def described(rows: DataFrame) -> DataFrame:
    """``session, kind, comments, users, videos, words, size, n_edges``, each set of nodes of a kind once: ids in
    order, set off by commas, and the edges with both ends among them."""
    return _listed(rows).distinct()


def _listed(rows: DataFrame) -> DataFrame:
    listed = {n: F.concat_ws(",", F.transform(F.array_sort(c), lambda x: x.cast("string"))) for n, c in (("comments", "c"), ("users", "u"), ("videos", "v"), ("words", "w"))}
    inside = lambda r, a, b: F.size(F.filter(F.col(r), lambda e: F.array_contains(F.col(a), e["src"]) & F.array_contains(F.col(b), e["dst"])))
    at = {"comment": "c", "user": "u", "video": "v", "word": "w"}
    edges = sum((inside(r, at[a], at[b]) for r, (a, b) in list(RELATIONS.items())[1:]), inside("user_posts_comment", "u", "c"))
    size = F.size("c") + F.size("u") + F.size("v") + F.size("w")
    return rows.select("session", "kind", *[v.alias(n) for n, v in listed.items()], size.alias("size"), edges.alias("n_edges"))


_KINDS = ("around_seed", "comment_only", "connected", "multi_user", "random_mix", "user_only", "word_only")


def all_kinds(s: DataFrame) -> DataFrame:
    """All generators; a set of nodes that several of them give comes once, under the kind of least name.

    Sessions are written once, as every generator reads them.  Kinds are bits in the order of their names,
    so one grouping finds the sets, their kinds and the least of these; a set's size and edges follow from it.
    """
    s = Stash(s.sparkSession, "sessions").put(s)
    every = multi_user(s).unionByName(connected(s)).unionByName(around_seeds(s)).unionByName(single_type(s)).unionByName(random_mix(s))
    names = F.array(*[F.lit(k) for k in _KINDS])
    bit = F.expr("shiftleft(1, cast(_at - 1 AS int))")
    rows = _listed(every).withColumn("_at", F.array_position(names, F.col("kind"))).withColumn("_bit", bit)
    g = rows.groupBy("session", "comments", "users", "videos", "words").agg(F.max("size").alias("size"), F.max("n_edges").alias("n_edges"), F.bit_or("_bit").alias("_bits"), F.min("_at").alias("_at"))
    return g.select("session", "comments", "users", "videos", "words", "size", "n_edges", F.element_at(names, F.col("_at").cast("int")).alias("kind"), F.bit_count("_bits").cast("bigint").alias("kinds"))
