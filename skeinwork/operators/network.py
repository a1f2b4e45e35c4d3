"""User networks and graph measures on edge tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.operators.hetero import dense_ids
from skeinwork.storage import Stash


def reply_edges(comments: DataFrame) -> DataFrame:
    """``src, dst, weight`` from ``comment_id, parent_id, post_id, user_id``: replies to another user of
    the same post, weighted by their number."""
    c = comments.select("comment_id", "parent_id", "post_id", "user_id").where("user_id IS NOT NULL")
    p = c.select(F.col("comment_id").alias("parent_id"), F.col("post_id").alias("p_post"), F.col("user_id").alias("dst"))
    joined = c.where("parent_id IS NOT NULL").join(p, "parent_id").where("post_id = p_post AND user_id <> dst")
    return joined.groupBy(F.col("user_id").alias("src"), "dst").agg(F.count("*").alias("weight"))


def mention_edges(comments: DataFrame, handle: str = r"[A-Za-z0-9_.]*[A-Za-z0-9_]") -> DataFrame:
    """``post_id, src, dst`` (user names): a comment names another user of its post with '@'.

    The names a text mentions are cut out of it and joined by equality, instead of searching each text
    for every name of the post.
    """
    c = comments.select("post_id", "username", "text").where("username <> '' AND post_id IS NOT NULL")
    named = c.select("post_id", F.lower("username").alias("src"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"@({handle.lower()})"), 1)).alias("dst"))
    users = c.select("post_id", F.lower("username").alias("dst")).distinct()
    return named.where("src <> dst").distinct().join(users, ["post_id", "dst"]).select("post_id", "src", "dst")


#: Texts, and names, of a post that one task looks at together.
TEXTS, NAMES = 20_000, 200_000


def _named(longest: int):
    def run(texts: pd.DataFrame, names: pd.DataFrame) -> pd.DataFrame:
        posts: dict = {}
        for post, name in set(zip(names["post"], names["name"])):
            posts.setdefault(post, {}).setdefault(name[:longest], []).append(name)
        lengths = {post: sorted({len(h) for h in heads}) for post, heads in posts.items()}
        found = set()
        for post, src, text in zip(texts["post"], texts["writer"], texts["said"]):
            heads = posts.get(post)
            if heads is None:
                continue
            for n in lengths[post]:
                for head in {text[i : i + n] for i in range(len(text) - n + 1)} & heads.keys():
                    found.update((post, src, name) for name in heads[head] if name != src and name in text)
        return pd.DataFrame(list(found), columns=["post_id", "src", "dst"], dtype="object")

    return run


def name_mentions(comments: DataFrame, longest: int = 6) -> DataFrame:
    """``post_id, src, dst`` (user names, lower case): a comment's text contains the name of another user of its post.

    A name is found by its first ``longest`` characters (all of a shorter one): within a task, the stretches
    of a text are looked up among the heads of its post's names, and only the matches are searched for the
    whole name.  Texts meet names in groups of whole posts; a post of more than ``TEXTS`` comments or
    ``NAMES`` names is cut into blocks of texts and of names, each pair a place of its own.  Only texts and
    names are shuffled, no stretches.
    """
    c = comments.select("post_id", F.lower("username").alias("src"), F.lower("text").alias("text")).where("src <> '' AND post_id IS NOT NULL")
    names = c.select("post_id", F.col("src").alias("dst")).distinct()
    counts = c.groupBy("post_id").agg(F.count("*").alias("n"))
    crowds = names.groupBy("post_id").agg(F.count("*").alias("n"))
    groups = F.lit(max(1, c.count() // TEXTS + 1)).cast("bigint")
    blocks = lambda n, most: F.floor(F.col(n) / most) + 1
    # the few posts that are cut into blocks; the planner broadcasts them by size
    cut = counts.withColumnRenamed("n", "_t").join(crowds.withColumnRenamed("n", "_u"), "post_id").select("post_id", blocks("_t", TEXTS).alias("tb"), blocks("_u", NAMES).alias("nb")).where("tb > 1 OR nb > 1")
    one = F.lit(1).cast("bigint")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(n, one) - 1))
    at = lambda n, *key: F.pmod(F.xxhash64(*key), F.coalesce(n, one))
    texts = c.where("text <> ''").join(cut, "post_id", "left").withColumn("t", at("tb", "src", "text")).withColumn("u", every(F.col("nb")))
    placed = names.join(cut, "post_id", "left").withColumn("u", at("nb", "dst")).withColumn("t", every(F.col("tb")))
    group = F.pmod(F.xxhash64("post_id", "t", "u"), groups).alias("group")
    kind = comments.schema["post_id"].dataType.simpleString()
    left = texts.select(group, F.col("post_id").alias("post"), F.col("src").alias("writer"), F.col("text").alias("said"))
    right = placed.select(group, F.col("post_id").alias("post"), F.col("dst").alias("name"))
    return left.groupBy("group").cogroup(right.groupBy("group")).applyInPandas(_named(longest), f"post_id {kind}, src string, dst string").distinct()


def co_comment_edges(comments: DataFrame, least: int = 2, block: int = 500) -> DataFrame:
    """``a, b, weight``, a < b: users that commented on the same ``least`` (at least two) posts or more, with
    the number of such posts.

    Posts are ordered by their users.  Two users with two posts in common share one that is the largest
    of neither, so candidates come from each user's posts but the largest: the pairs of a post with a
    tenth of all comments, which is the largest of most of its users, are never formed.  The largest
    posts are then looked up for the candidates alone.  Posts that are left are cut into blocks of about
    ``block`` users, each pair of blocks joined on its own.
    """
    if least < 2:
        raise ValueError("pairs of a single post are its square: ask for two posts at least")
    members = comments.select("post_id", "user_id").where("post_id IS NOT NULL AND user_id IS NOT NULL").distinct()
    crowds = members.groupBy("post_id").agg(F.count("*").alias("users"))
    order = F.struct("users", "post_id")
    stash = Stash(comments.sparkSession, "together")
    largest = members.join(crowds, "post_id").groupBy("user_id").agg(F.count("*").alias("posts"), F.max(order).alias("most")).where(F.col("posts") >= least)
    members = stash.put(members.join(largest.select("user_id", F.col("most.post_id").alias("most")), "user_id"))
    others = members.where("post_id <> most").select("post_id", "user_id", "most")
    sizes = others.groupBy("post_id").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = others.join(sizes, "post_id").withColumn("own", F.pmod(F.xxhash64("user_id"), F.col("blocks")).cast("int"))
    meets = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    meets = meets.select("post_id", "user_id", "most", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    l, r = meets.alias("l"), meets.alias("r")
    same = (F.col("l.post_id") == F.col("r.post_id")) & (F.col("l.x") == F.col("r.x")) & (F.col("l.y") == F.col("r.y"))
    across = (F.col("l.x") == F.col("l.y")) | (F.col("l.own") != F.col("r.own"))
    pairs = l.join(r, same & (F.col("l.user_id") < F.col("r.user_id")) & across)
    shared = pairs.groupBy(F.col("l.user_id").alias("a"), F.col("r.user_id").alias("b"), F.col("l.most").alias("most_a"), F.col("r.most").alias("most_b")).agg(F.count("*").alias("n"))
    at = members.select("post_id", "user_id", F.lit(1).alias("there"))
    of_a = at.select(F.col("post_id").alias("most_a"), F.col("user_id").alias("b"), F.col("there").alias("in_a"))
    of_b = at.select(F.col("post_id").alias("most_b"), F.col("user_id").alias("a"), F.col("there").alias("in_b"))
    both = shared.join(of_a, ["most_a", "b"], "left").join(of_b, ["most_b", "a"], "left")
    weight = F.col("n") + F.coalesce("in_a", F.lit(0)) + F.when(F.col("most_a") != F.col("most_b"), F.coalesce("in_b", F.lit(0))).otherwise(F.lit(0))
    return both.select("a", "b", weight.alias("weight")).where(F.col("weight") >= least)


def degrees(edges: DataFrame) -> DataFrame:
    """``node, out_degree, in_degree, degree``, in one aggregation over both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy(F.col("e.node").alias("node")).agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"), F.count("*").alias("degree"))


def shape(edges: DataFrame) -> DataFrame:
    """One row ``nodes, edges, density, reciprocity`` of a directed graph without repeated edges."""
    facts = edges.select("src", "dst").distinct()
    both = facts.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count_if(F.col("src") != F.col("dst")).alias("n"))
    nodes = facts.select(F.explode(F.array("src", "dst")).alias("n")).distinct().agg(F.count("*").alias("nodes"))
    count = facts.agg(F.count("*").alias("edges"))
    mutual = both.agg(F.coalesce(F.sum(F.when(F.col("n") == 2, 2).otherwise(0)), F.lit(0)).alias("mutual"))
    n, e = F.col("nodes"), F.col("edges")
    row = nodes.join(count, how="cross").join(mutual, how="cross")  # one row each
    return row.select("nodes", "edges", F.when(n > 1, e / (n * (n - 1))).otherwise(0.0).alias("density"), F.when(e > 0, F.col("mutual") / e).otherwise(0.0).alias("reciprocity"))


def triangles(edges: DataFrame) -> DataFrame:
    """``node, triangles`` of the undirected graph.  Edges point from the lower degree to the higher, so a
    hub has few successors and the wedges stay near E * sqrt(E) at worst."""
    plain = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct()
    deg = plain.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    d = plain.join(deg.select(F.col("node").alias("a"), F.col("d").alias("da")), "a").join(deg.select(F.col("node").alias("b"), F.col("d").alias("db")), "b")
    up = F.struct(F.col("da"), F.col("a")) < F.struct(F.col("db"), F.col("b"))
    out = d.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("v"))
    x, y = out.alias("x"), out.alias("y")
    wedges = x.join(y, (F.col("x.u") == F.col("y.u")) & (F.col("x.v") < F.col("y.v"))).select(F.col("x.u").alias("u"), F.col("x.v").alias("v"), F.col("y.v").alias("w"))
    closed = wedges.join(plain.select(F.col("a").alias("v"), F.col("b").alias("w")), ["v", "w"])
    return closed.select(F.explode(F.array("u", "v", "w")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))


def clustering(edges: DataFrame) -> DataFrame:
    """``node, clustering`` of the undirected graph; 0 with fewer than two neighbours."""
    plain = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct()
    deg = plain.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    t = deg.join(triangles(edges), "node", "left").na.fill(0, ["triangles"])
    return t.select("node", F.when(F.col("d") > 1, 2 * F.col("triangles") / (F.col("d") * (F.col("d") - 1))).otherwise(0.0).alias("clustering"))


def pagerank(edges: DataFrame, rounds: int = 100, alpha: float = 0.85, tolerance: float | None = 1e-6) -> DataFrame:
    """``node, rank`` over weighted edges ``src, dst, weight``, when the ranks move by less than ``tolerance``
    a node on average (looked at every fourth round), or after ``rounds``; with no tolerance, after ``rounds``.

    The rank of nodes without successors is spread over all.  Edges are partitioned once, by source; a
    round shuffles one row a node.  Lineage is cut every few rounds.
    """
    stash = Stash(edges.sparkSession, "pagerank")
    weighted = edges.groupBy("src", "dst").agg(F.sum("weight").alias("w"))
    total = Window.partitionBy("src")
    links = stash.put(weighted.select("src", "dst", (F.col("w") / F.sum("w").over(total)).alias("share")))
    nodes = stash.put(links.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(links.select(F.col("src").alias("node")).distinct().withColumn("live", F.lit(True)), "node", "left"))
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    ranks = nodes.select("node", "live", F.lit(1.0 / n).alias("rank"))
    last = ranks
    for i in range(rounds):
        lost = ranks.where("live IS NULL").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        sent = links.join(ranks.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        ranks = nodes.join(sent, "node", "left").join(F.broadcast(lost), how="cross").select(
            "node", "live", ((1 - alpha) / n + alpha * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("rank")
        )
        if i % 4 == 3 or i == rounds - 1:
            before, ranks = last, stash.put(ranks)
            last = ranks
            if tolerance is not None and i >= 7:
                moved = ranks.select("node", "rank").join(before.select("node", F.col("rank").alias("old")), "node").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
                # four rounds shrink the distance to the limit by alpha^4 at least
                if moved * alpha**4 / (1 - alpha**4) < n * tolerance:
                    break
    return ranks.select("node", "rank")


def bfs(edges: DataFrame, seeds: DataFrame, hops: int, most: int | None = None) -> DataFrame:
    """``seed, node, hop`` for all nodes within ``hops`` undirected steps of each seed, seed included.

    With ``most``, a frontier is cut to the nodes of least id that fit, as the operator asks for.
    """
    stash = Stash(edges.sparkSession, "bfs")
    both = stash.put(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    seen = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("hop")).distinct()
    frontier = seen
    for hop in range(1, hops + 1):
        step = frontier.join(both, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        fresh = step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("hop", F.lit(hop))
        if most is not None:
            room = seen.groupBy("seed").agg((most - F.count("*")).alias("room"))
            rank = F.row_number().over(Window.partitionBy("seed").orderBy("node"))
            fresh = fresh.join(room, "seed").withColumn("rn", rank).where("rn <= room").select("seed", "node", "hop")
        frontier = stash.put(fresh)
        seen = seen.unionByName(frontier)
    return seen


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranges of ``sizes`` places from ``starts`` on, end to end."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


#: Places (a source beside a node or an edge) that ``_between`` works on at once; words of 64 sources, in all
#: nodes or edges, of ``_near``; edges into a node that it takes one by one.
PLACES, WORDS, FEW = 2_000_000, 3_000_000, 16


def _between(src: np.ndarray, dst: np.ndarray, graph: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each node: nodes that reach it, the sum of their distances, and the shares of shortest paths it lies on.

    ``graph`` has the number of each node's graph, nodes in the order of these.  Brandes' algorithm, for the
    sources of all graphs together: a source has a place for each node of its graph, and a step takes the
    places of one distance.
    """
    n = len(graph)
    reached, total, between = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    order = np.argsort(src, kind="stable")
    to, degree = dst[order], np.bincount(src, minlength=n)
    start = np.cumsum(degree) - degree
    size = np.bincount(graph)
    first = (np.cumsum(size) - size)[graph]
    sources = np.flatnonzero(degree)
    width = size[graph[sources]]
    cost = width + np.bincount(graph[src], minlength=len(size))[graph[sources]]
    batch = np.cumsum(cost) // PLACES
    for rows in np.split(np.arange(len(sources)), np.flatnonzero(np.diff(batch)) + 1) if len(sources) else []:
        s, w = sources[rows], width[rows]
        shift = np.cumsum(w) - w - first[s]  # of a row: place less node
        dist, paths, gain, mark = np.full(w.sum(), -1, np.int32), np.zeros(w.sum()), np.zeros(w.sum()), np.empty(w.sum(), np.int64)
        row, node = np.arange(len(s)), s
        at = shift + s
        dist[at], paths[at] = 0, 1.0
        steps, hop = [], 0
        while len(at):
            hop += 1
            out = degree[node]
            node = to[_spread(start[node], out)]
            row, before = np.repeat(row, out), np.repeat(at, out)
            after = shift[row] + node
            new = dist[after] < 0
            row, node, before, after = row[new], node[new], before[new], after[new]
            dist[after] = hop
            np.add.at(paths, after, paths[before])
            steps.append((before, after))
            mark[after] = np.arange(len(after))
            once = mark[after] == np.arange(len(after))
            row, node, at = row[once], node[once], after[once]
            found = np.bincount(node, minlength=n)
            reached += found
            total += hop * found
        for before, after in reversed(steps):
            np.add.at(gain, before, paths[before] / paths[after] * (1 + gain[after]))
        gain[shift + s] = 0.0
        between += np.bincount(np.repeat(first[s], w) + _spread(np.zeros_like(w), w), weights=gain, minlength=n)
    return reached, total, between


def _near(n: int, src: np.ndarray, dst: np.ndarray, part: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """For each node: nodes among the sources of ``part`` that reach it, and the sum of their distances.

    Breadth-first search of blocks of sources, one bit each.  Sources that lead to the same nodes stand
    together, so that few words are busy in a step.
    """
    reached, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    degree, entering = np.bincount(src, minlength=n), np.bincount(dst, minlength=n)
    by_src = np.argsort(src, kind="stable")
    start = np.cumsum(degree) - degree
    lead = np.arange(n)
    rising = np.argsort(entering[dst], kind="stable")
    lead[src[rising]] = dst[rising]  # the last written: the neighbour of most edges
    sources = np.flatnonzero(degree)
    keys, ahead = [sources], lead
    for _ in range(4):
        keys.append(ahead[sources])
        ahead = ahead[ahead]
    sources = sources[np.lexsort(keys)]
    sources = sources[len(sources) * part // parts : len(sources) * (part + 1) // parts]
    words = int(min(64, max(1, WORDS // max(n, len(src)))))
    for low in range(0, len(sources), 64 * words):
        at = sources[low : low + 64 * words]
        bit = np.arange(len(at))
        seen, fresh, on = np.zeros((n, words), np.uint64), np.zeros((n, words), np.uint64), np.zeros(n, bool)
        seen[at, bit >> 6] = np.left_shift(np.uint64(1), (bit & 63).astype(np.uint64))
        fresh[at], on[at] = seen[at], True
        hop = 0
        while len(at):
            hop += 1
            if 16 * (leaving := degree[at]).sum() < len(src):
                edges = np.sort(by_src[_spread(start[at], leaving)])
            else:
                edges = np.flatnonzero(on[src])
            on[at] = False
            if not len(edges):
                break
            ends, begins = dst[edges], src[edges]
            head = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1]])
            size = np.diff(np.r_[head, len(ends)])
            got = fresh[begins[head]]
            more, k = np.flatnonzero(size > 1), 1
            while len(more) and k < FEW:
                got[more] |= fresh[begins[head[more] + k]]
                k += 1
                more = more[size[more] > k]
            if len(more):
                left = size[more] - k
                got[more] |= np.bitwise_or.reduceat(fresh[begins[_spread(head[more] + k, left)]], np.cumsum(left) - left, axis=0)
            at = ends[head]
            got &= ~seen[at]
            live = np.flatnonzero(got.any(axis=1))
            at, got = at[live], got[live]
            on[at], fresh[at] = True, got
            seen[at] |= got
            found = np.bitwise_count(got).sum(axis=1, dtype=np.int64)
            reached[at] += found
            total[at] += hop * found
    return reached, total


def _graphs(component: str):
    def measure(frame: pd.DataFrame) -> pd.DataFrame:
        graph, graphs = pd.factorize(frame["type"])
        ends, names = pd.factorize(pd.concat([frame["src"], frame["dst"]], ignore_index=True), sort=True)
        keys, place = np.unique(np.r_[graph, graph] * len(names) + ends, return_inverse=True)
        src, dst = place[: len(frame)], place[len(frame) :]
        of = keys // len(names)
        r, t, share = _between(src[src != dst], dst[src != dst], of)
        n = np.bincount(of)[of]
        close = np.where(t > 0, r / np.maximum(t, 1) * r / np.maximum(n - 1, 1), 0.0)
        return pd.DataFrame({component: graphs.take(of), "node": names.take(keys % len(names)), "closeness": close, "betweenness": share / np.maximum((n - 1) * (n - 2), 1)})

    return measure


def _parts(batches):
    for batch in batches:
        for kind, n, part, parts, edges in zip(batch["type"], batch["n"], batch["part"], batch["parts"], batch["edges"]):
            codes = edges.values.to_numpy(zero_copy_only=False)
            r, t = _near(n.as_py(), codes >> 32, codes & 0xFFFFFFFF, part.as_py(), parts.as_py())
            ids = np.flatnonzero(r)
            kinds = pa.array([kind.as_py()], type=kind.type).take(pa.array(np.zeros(len(ids), np.int32)))
            yield pa.RecordBatch.from_arrays([kinds, pa.array(ids), pa.array(r[ids]), pa.array(t[ids])], names=["type", "id", "reached", "total"])


def closeness(edges: DataFrame, component: str) -> DataFrame:
    """``component, node, closeness`` within each graph, of any size, by breadth-first search from all nodes.

    Sources are numbered within their graph and go in blocks of 64, one bit each: a row holds the sources
    of a block that reach a node, so a round is one join with the edges and one ``bit_or``.  Edges are
    never gathered.  There are as many rounds as the longest shortest path has steps.
    """
    stash = Stash(edges.sparkSession, "closeness")
    links = stash.put(edges.where("src <> dst").select(F.col(component).alias("type"), "src", "dst").distinct())
    nodes = edges.select(F.col(component).alias("type"), F.explode(F.array("src", "dst")).alias("key")).distinct()
    known = stash.put(dense_ids(nodes).select("type", F.col("key").alias("node"), "id"))
    own = F.expr("shiftleft(1L, cast(id % 64 AS int))")
    zero = F.lit(0).cast("bigint")
    state = known.select("type", "node", F.floor(F.col("id") / 64).alias("block"), own.alias("seen"), own.alias("fresh"), zero.alias("reached"), zero.alias("total"))
    hop = 0
    while True:
        hop += 1
        sent = state.where("fresh <> 0").withColumnRenamed("node", "src").join(links, ["type", "src"]).groupBy("type", F.col("dst").alias("node"), "block").agg(F.bit_or("fresh").alias("got"))
        both = state.drop("fresh").join(sent, ["type", "node", "block"], "full")
        seen = F.coalesce("seen", zero)
        fresh = F.coalesce("got", zero).bitwiseAND(F.bitwise_not(seen))
        more = F.bit_count("fresh").cast("bigint")
        after = both.select("type", "node", "block", seen.alias("seen"), fresh.alias("fresh"), F.coalesce("reached", zero).alias("reached"), F.coalesce("total", zero).alias("total"))
        state, before = stash.put(after.withColumns({"seen": F.col("seen").bitwiseOR(F.col("fresh")), "reached": F.col("reached") + more, "total": F.col("total") + hop * more})), state
        stash.drop(before)
        if state.where("fresh <> 0").isEmpty():
            break
    sizes = known.groupBy("type").agg(F.count("*").alias("n"))
    sums = state.groupBy("type", "node").agg(F.sum("reached").alias("r"), F.sum("total").alias("t"))
    value = F.when(F.col("t") > 0, F.col("r") / F.col("t") * F.col("r") / (F.col("n") - 1)).otherwise(0.0)
    return sums.join(sizes, "type").select(F.col("type").alias(component), "node", value.alias("closeness"))


#: Edges of small graphs that one task looks at together; edges up to which a graph fits into a task; edges
#: times nodes of a part of its sources, and the most parts.
TOGETHER, WITHIN, WORK, PARTS = 20_000, 2_000_000, 1_000_000_000, 96


def path_centralities(edges: DataFrame, component: str, limit: int | None = None, between: int = 1000, within: int = WITHIN) -> DataFrame:
    """``component, node, closeness, betweenness`` within each graph; edges with a null drop out.

    A graph is the rows of one ``component`` value (a post's network, say).  Betweenness is defined for
    graphs of fewer than ``between`` nodes only, larger ones give null; so does closeness with a ``limit``,
    which then holds for both.  Closeness counts paths towards a node, scaled by the share of nodes that
    reach it.

    Small graphs are done many to a task.  A larger one of at most ``within`` edges goes as numbers to
    several tasks, each of which searches from a part of its nodes; the edges of one above that are never
    gathered (``closeness``).
    """
    stash = Stash(edges.sparkSession, "paths")
    known = F.col(component).isNotNull() & F.col("src").isNotNull() & F.col("dst").isNotNull()
    plain = stash.put(edges.where(known).select(F.col(component).alias("type"), "src", "dst").distinct())
    most = between if limit is None else limit
    ends = F.explode(F.array("src", "dst"))
    # a graph has at most two nodes an edge: the nodes of few need counting
    counts = plain.groupBy("type").agg(F.count("*").alias("m")).where(2 * F.col("m") >= most)
    nodes = plain.join(counts.select("type"), "type", "left_semi").select("type", ends.alias("key")).distinct()
    large = stash.put(nodes.groupBy("type").agg(F.count("*").alias("n")).where(F.col("n") >= most).join(counts, "type"))
    kind, node_kind = edges.schema[component].dataType.simpleString(), edges.schema["src"].dataType.simpleString()

    small = plain.join(large.select("type"), "type", "left_anti")
    groups = max(1, plain.count() // TOGETHER)
    done = small.groupBy(F.pmod(F.xxhash64("type"), F.lit(groups))).applyInPandas(_graphs(component), f"{component} {kind}, node {node_kind}, closeness double, betweenness double")
    crowd = plain.join(large, "type")
    null = F.lit(None).cast("double")
    if limit is not None:
        return done.unionByName(crowd.select(F.col("type").alias(component), ends.alias("node")).distinct().select("*", null.alias("closeness"), null.alias("betweenness")))

    parts = F.least(F.lit(PARTS), F.ceil(F.col("n") * F.col("m") / WORK)).cast("int")
    fits = F.col("m") <= within
    facts = large.agg(F.sum(F.when(fits, parts)).alias("parts"), F.count_if(~fits).alias("over")).first()
    if facts["parts"]:
        crowd_within = crowd.where(fits)
        numbers = stash.put(dense_ids(crowd_within.select("type", ends.alias("key")).distinct()))
        side = lambda end: numbers.select("type", F.col("key").alias(end), F.col("id").alias(f"{end}_id"))
        code = F.shiftleft("src_id", 32).bitwiseOR(F.col("dst_id"))
        rows = crowd_within.where("src <> dst").join(side("src"), ["type", "src"]).join(side("dst"), ["type", "dst"]).groupBy("type").agg(F.collect_list(code).alias("edges"))
        rows = rows.join(large, "type").select("type", "n", parts.alias("parts"), "edges").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        found = rows.repartition(min(200, facts["parts"])).mapInArrow(_parts, f"type {kind}, id bigint, reached bigint, total bigint")
        sums = found.groupBy("type", "id").agg(F.sum("reached").alias("r"), F.sum("total").alias("t"))
        value = F.when(F.col("t") > 0, F.col("r") / F.col("t") * F.col("r") / (F.col("n") - 1)).otherwise(0.0)
        near = numbers.join(large, "type").join(sums, ["type", "id"], "left")
        done = done.unionByName(near.select(F.col("type").alias(component), F.col("key").alias("node"), value.alias("closeness"), null.alias("betweenness")))
    if facts["over"]:
        rest = crowd.where(~fits).select(F.col("type").alias(component), "src", "dst")
        done = done.unionByName(closeness(rest, component).withColumn("betweenness", null))
    return done
