"""Small typed subgraphs of sessions: compositions, growth, edges, dedupe, structure."""

from __future__ import annotations

import itertools
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinwork.operators.sampling import hash_rank, top_per_group
from skeinwork.storage import Stash

TYPES = ("comment", "user", "video", "word")


def node_list(nodes: Column) -> Column:
    """Map of ids by type as a sorted array of distinct 'type:id'; null and empty maps give an empty one."""
    each = F.transform(F.map_entries(nodes), lambda e: F.transform(F.coalesce(e["value"], F.array().cast("array<bigint>")), lambda i: F.concat(e["key"], F.lit(":"), i.cast("string"))))
    return F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.coalesce(each, F.array().cast("array<array<string>>"))))))


def count_of(nodes: Column, kind: str) -> Column:
    """Distinct ids of a type."""
    return F.coalesce(F.size(F.array_compact(F.array_distinct(F.element_at(nodes, F.lit(kind))))), F.lit(0))


def edge_count(edges: Column) -> Column:
    """Distinct edges over all relations."""
    each = F.transform(F.map_values(edges), lambda v: F.size(F.array_distinct(F.coalesce(v, F.array().cast("array<struct<src:bigint,dst:bigint>>")))))
    return F.aggregate(F.coalesce(each, F.array().cast("array<int>")), F.lit(0), lambda a, n: a + n)


def edge_count_compat(edges: Column) -> Column:
    """Twice the number of relations that have an edge: what a count of the first pair's elements gives."""
    each = F.transform(F.map_values(edges), lambda v: F.when(F.size(v) > 0, 2).otherwise(0))
    return F.aggregate(F.coalesce(each, F.array().cast("array<int>")), F.lit(0), lambda a, n: a + n)


def dedupe(subgraphs: DataFrame, key: str = "subgraph_id", typed: bool = True) -> DataFrame:
    """One row for each set of nodes in a session: the one of least id.

    ``typed=False`` compares ids without their types, so comment 5 equals user 5.
    """
    names = node_list(F.col("nodes"))
    if not typed:
        names = F.array_sort(F.array_distinct(F.transform(names, lambda n: F.substring_index(n, ":", -1))))
    rows = subgraphs.select("session_no", key, F.sha2(F.concat_ws("|", names), 256).alias("_k"))
    return rows.groupBy("session_no", "_k").agg(F.min(key).alias(key), F.count_distinct(key).alias("copies")).drop("_k")


def structure(subgraphs: DataFrame, key: str = "subgraph_id", *keep: str) -> DataFrame:
    """Per row: counts by type, nodes, edges, density 2E / (n (n - 1)), share of types present; the columns of
    ``keep`` come along."""
    n = {t: count_of(F.col("nodes"), t) for t in TYPES}
    total = F.size(node_list(F.col("nodes")))
    e = edge_count(F.col("edges"))
    present = sum(((c > 0).cast("int") for c in n.values()), F.lit(0))
    return subgraphs.select(
        key, *keep, *[c.alias(f"n_{t}") for t, c in n.items()], total.alias("n_nodes"), e.alias("n_edges"),
        F.when(total > 1, 2 * e / (total * (total - 1))).otherwise(0.0).alias("density"), (present / len(TYPES)).alias("diversity"),
    )


def capped_nodes(nodes: DataFrame, caps: dict[str, int], seed: int = 42) -> DataFrame:
    """``session, type, id``: at most ``caps[type]`` nodes a session and type, by hash (the cap is the feature)."""
    cap = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])
    rank = F.row_number().over(Window.partitionBy("session", "type").orderBy(hash_rank(F.concat_ws(":", "type", F.col("id").cast("string")), seed), "id"))
    most = max(caps.values())
    first = top_per_group(nodes, ["session", "type"], [hash_rank(F.concat_ws(":", "type", F.col("id").cast("string")), seed), F.col("id")], most)
    return first.withColumn("_rn", rank).where(F.col("_rn") <= F.coalesce(F.element_at(cap, F.col("type")), F.lit(0))).drop("_rn")


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in a group's node set: ``group, src_type, rel, dst_type, src, dst``."""
    s = nodes.select("group", F.col("type").alias("src_type"), F.col("id").alias("src"))
    d = nodes.select("group", F.col("type").alias("dst_type"), F.col("id").alias("dst"))
    return edges.join(s, ["src_type", "src"]).join(d, ["group", "dst_type", "dst"]).select("group", "src_type", "rel", "dst_type", "src", "dst").distinct()


def induced_counts(subgraphs: DataFrame) -> DataFrame:
    """``subgraph_id, rel, n``: the edges of the whole session with both ends among a subgraph's nodes, by relation,
    from ``subgraph_id, session_no, nodes, edges``.

    Users and words are in very many subgraphs of a session, a comment is in few and has few neighbours.  So
    edges that have a comment are gathered at it, once a session, and met by the subgraphs that hold it,
    which bring their other nodes along; users are met as the pairs within a subgraph.  No edge is taken
    through all subgraphs that hold one of its ends.  Subgraphs go by number meanwhile.
    """
    ids = lambda t: F.coalesce(F.array_compact(F.array_distinct(F.element_at("nodes", F.lit(t)))), F.array().cast("array<bigint>")).alias(t)
    stash = Stash(subgraphs.sparkSession, "induced")
    s = stash.put(subgraphs.where("session_no IS NOT NULL").select(F.monotonically_increasing_id().alias("no"), "subgraph_id", "session_no", *[ids(t) for t in TYPES], "edges"))
    each = s.select("session_no", F.explode(F.map_entries("edges")).alias("e")).select("session_no", F.col("e.key").alias("rel"), F.explode("e.value").alias("x")).select("session_no", "rel", "x.src", "x.dst")
    at = {"user_posts_comment": ("user", "dst", "src"), "comment_contains_word": ("word", "src", "dst"), "video_contains_comment": ("video", "dst", "src")}  # other type, its comment, the other end
    comment = F.coalesce(*[F.when(F.col("rel") == r, F.col(c)) for r, (_, c, _) in at.items()])
    near = each.where(F.col("rel").isin(list(at))).groupBy("session_no", comment.alias("c")).agg(*[F.collect_set(F.when(F.col("rel") == r, F.col(o))).alias(f"_{t}") for r, (t, _, o) in at.items()])
    held = s.select("no", "session_no", "user", "word", "video", F.explode("comment").alias("c"))
    met = held.join(near, ["session_no", "c"]).select("no", *[F.size(F.array_intersect(f"_{t}", t)).alias(r) for r, (t, _, _) in at.items()], F.lit(0).alias("user_interacts_user"))
    between = each.where("rel = 'user_interacts_user'").select("session_no", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), (F.col("src") <= F.col("dst")).alias("up")).where("a IS NOT NULL AND up IS NOT NULL")
    between = between.groupBy("session_no", "a", "b").agg(F.count_distinct("up").cast("int").alias("k"))
    pairs = s.select("no", "session_no", "user", F.explode("user").alias("a")).select("no", "session_no", "a", F.explode(F.filter("user", lambda u: u >= F.col("a"))).alias("b"))
    meets = pairs.join(between, ["session_no", "a", "b"]).select("no", *[F.lit(0).alias(r) for r in at], F.col("k").alias("user_interacts_user"))
    rels = [*at, "user_interacts_user"]
    sums = met.where(" + ".join(at) + " > 0").unionByName(meets).groupBy("no").agg(*[F.sum(r).alias(r) for r in rels])
    rows = sums.join(s.select("no", "subgraph_id"), "no").select("subgraph_id", F.explode(F.array(*[F.struct(F.lit(r).alias("rel"), F.col(r).alias("n")) for r in rels])).alias("e"))
    return rows.select("subgraph_id", "e.rel", "e.n").where("n > 0")


def compositions(spark: SparkSession, low: int, high: int, most: dict[str, int]) -> DataFrame:
    """``size, n_comment, n_user, n_video, n_word``: counts by type that sum up to a size and hold a
    comment; a table of fixed size, from the limits alone."""
    rows = [
        (sum(c), *c)
        for c in itertools.product(range(1, most["comment"] + 1), range(most["user"] + 1), range(most["video"] + 1), range(most["word"] + 1))
        if low <= sum(c) <= high
    ]
    return spark.createDataFrame(rows, "size int, n_comment int, n_user int, n_video int, n_word int")


def every_composition(spark: SparkSession, low: int = 6, high: int = 15) -> DataFrame:
    """The compositions of each size with a comment and something else, a video at most, and as many of the
    other types as the size leaves room for."""
    room = high - 1
    return compositions(spark, low, high, {"comment": room, "user": room, "video": 1, "word": room}).where("n_comment < size")


def session_user_pairs(members: DataFrame, edges: DataFrame) -> DataFrame:
    """``post_id, a, b``: users of a post with an interaction between them.  Driven by the edges, so a post
    with very many users gives no more pairs than interact; an edge is looked up in the posts of the end
    that has fewer of them, so a user of very many posts is not taken through all of them for each partner."""
    m = members.select("post_id", "user_id").distinct()
    posts = m.groupBy("user_id").agg(F.count("*").alias("n"))
    e = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct()
    e = e.join(posts.select(F.col("user_id").alias("a"), F.col("n").alias("n_a")), "a").join(posts.select(F.col("user_id").alias("b"), F.col("n").alias("n_b")), "b")
    fewer = F.col("n_a") <= F.col("n_b")
    e = e.select("a", "b", F.when(fewer, F.col("a")).otherwise(F.col("b")).alias("few"), F.when(fewer, F.col("b")).otherwise(F.col("a")).alias("many"))
    left = e.join(m.withColumnRenamed("user_id", "few"), "few")
    return left.join(m.withColumnRenamed("user_id", "many"), ["post_id", "many"]).select("post_id", "a", "b")


_RANK = {"comment": 0, "user": 1, "word": 2, "time": 3, "location": 4, "video": 5}


def grow(seeds: DataFrame, edges: DataFrame, size: int, strategy: str = "compact", reach: int = 2) -> DataFrame:
    """``seed, nodes, added``: from each seed comment, nodes are added one by one from the neighbours of those
    chosen, up to ``size``.

    compact: by type (comment, user, word, ...), then id; balanced: by type and by id in turn; extensive:
    types not present yet first.  Neighbours are cut to the ``size`` least of each type and node, more than
    growth can take.  Those of the first ``reach`` steps are fetched at once; a seed that chooses a node
    beyond waits for its neighbours, fetched by a join for all such seeds, so that growth goes as far as
    it has to.  One group is a seed.  ``edges``: a, b as 'type:id', undirected.  ``nodes`` are sorted,
    ``added`` is the order of growth.
    """
    stash = Stash(edges.sparkSession, "grow")
    links = stash.put(edges.select("a", "b").where("a <> b"))
    kind = F.split("b", ":")[0]
    order = [F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in _RANK.items() for x in kv]), kind), F.lit(9)), F.col("b")]

    def neighbours(of: DataFrame) -> DataFrame:
        """``seed, a, b`` for ``seed, a``; only the edges of these nodes are shuffled."""
        ends = of.select("a").distinct()
        both = links.join(ends, "a", "left_semi").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")).join(ends, "a", "left_semi"))
        near = top_per_group(both.distinct().withColumn("_kind", kind), ["a", "_kind"], order, size)
        return of.join(near, "a").select("seed", "a", "b").distinct()

    hop = stash.put(seeds.select("seed", F.col("seed").alias("a")).distinct())
    parts = []
    for _ in range(reach):
        parts.append(stash.put(neighbours(hop)))
        hop = stash.put(parts[-1].select("seed", F.col("b").alias("a")).distinct())
    local = parts[0]
    for part in parts[1:]:
        local = local.unionByName(part)

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        near_by = defaultdict(set)
        for a, b in zip(frame["a"], frame["b"]):
            near_by[a].add(b)
        seed = frame["seed"].iloc[0]
        chosen, open_, wanted = [seed], set(near_by[seed]), None
        rank = lambda n: (_RANK.get(n.split(":")[0], 9), n)
        while len(chosen) < size and open_:
            have = {c.split(":")[0] for c in chosen}
            if strategy == "extensive":
                pick = min(open_, key=lambda n: (n.split(":")[0] in have, rank(n)))
            elif strategy == "balanced" and len(chosen) % 2:
                pick = min(open_)
            else:
                pick = min(open_, key=rank)
            chosen.append(pick)
            if pick not in near_by and len(chosen) < size:
                wanted = pick
                break
            open_ |= near_by[pick]
            open_ -= set(chosen)
        return pd.DataFrame({"seed": [seed], "nodes": [sorted(chosen)], "added": [chosen], "wanted": pd.Series([wanted], dtype="object")})

    done, local = [], stash.put(local.distinct())
    while True:
        grown = stash.put(local.groupBy("seed").applyInPandas(build, "seed string, nodes array<string>, added array<string>, wanted string"))
        done.append(grown.where("wanted IS NULL").select("seed", "nodes", "added"))
        waiting = grown.where("wanted IS NOT NULL").select("seed", F.col("wanted").alias("a"))
        if waiting.isEmpty():
            break
        local = stash.put(local.join(waiting.select("seed"), "seed", "left_semi").unionByName(neighbours(waiting)))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def at_each_size(grown: DataFrame, low: int, high: int) -> DataFrame:
    """``seed, size, nodes``: the growing subgraph at every size it reaches in the range."""
    sizes = F.filter(F.sequence(F.lit(low), F.lit(high)), lambda n: n <= F.size("added"))
    return grown.select("seed", "added", F.explode(sizes).alias("size")).select("seed", "size", F.array_sort(F.slice("added", 1, F.col("size"))).alias("nodes"))


def sliding_comments(comments: DataFrame, width: int) -> DataFrame:
    """``post_id, start, ids``: every run of ``width`` comments of a post in order of their ids."""
    rank = Window.partitionBy("post_id").orderBy("id")
    ids = F.collect_list("id").over(rank.rowsBetween(0, width - 1))
    return comments.select("post_id", (F.row_number().over(rank) - 1).alias("start"), ids.alias("ids")).where(F.size("ids") == width)


def validity(subgraphs: DataFrame, low: int = 6, high: int = 15) -> DataFrame:
    """Rows with a comment, something besides words, and a size in range."""
    n = F.size(node_list(F.col("nodes")))
    return subgraphs.where((count_of(F.col("nodes"), "comment") > 0) & (n > count_of(F.col("nodes"), "word")) & n.between(low, high))


def connected_share(subgraphs: DataFrame) -> DataFrame:
    """One row: subgraphs, those with an edge, and their share."""
    has = (edge_count(F.col("edges")) > 0).cast("int")
    return subgraphs.agg(F.count("*").alias("subgraphs"), F.sum(has).alias("with_edges"), F.avg(has).alias("share"))
