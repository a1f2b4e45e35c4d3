"""Operators against brute force and on edge cases."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinwork.operators import cluster, components, detect, hetero, matching, network, prepare, sampling, search, subgraphs, users
from skeinwork.storage import Stash


def test_latest_version(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), ("b", None, "z"), (None, 9, "n")], "k string, v int, t string")
    assert sorted(map(tuple, prepare.latest(df, "k", "v").collect())) == [("a", 2, "y"), ("b", None, "z")]


def test_labels(spark):
    df = spark.createDataFrame([("media_session_5", 1, 2), ("session-5", 0, 1), ("x", 1, 1), (None, 1, 1), ("session_7", 0, None), ("session_7", 1, 1)], "session_id string, is_bullying int, annotators int")
    got = {r["session_no"]: (r["votes"], r["is_bullying"], r["conflict"]) for r in prepare.label_verdicts(df).collect()}
    assert got == {5: (2, 1, True), 7: (2, 1, True)}


def test_align(spark):
    a = spark.createDataFrame([("p", 1), ("q", 0), ("r", None)], "post_id string, la int")
    b = spark.createDataFrame([("p", 1), ("q", 1), ("r", None), ("s", 0)], "post_id string, lb int")
    assert sorted(r["post_id"] for r in prepare.align((a, "la"), (b, "lb")).collect()) == ["p", "r"]
    empty = a.where("false")
    assert prepare.align_adaptive(a, empty, b).first()["modalities"] == "text+user"
    assert prepare.align_adaptive(empty, empty, b).first()["modalities"] == "user"
    assert prepare.align_adaptive(empty, empty, empty).count() == 0


def test_sampling(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 2).withColumn("s", F.col("id") * 1.0)
    assert sampling.sample_per_stratum(df, "g", "id", 7).count() == 14
    assert sorted(r["id"] for r in sampling.evenly_spaced(spark.range(10).withColumn("g", F.lit(1)), ["g"], [F.col("id")], 4).collect()) == [int(i * 10 / 4) for i in range(4)]
    picked = sampling.quality_then_random(df, "id", "s", 10).collect()
    assert sorted(r["id"] for r in picked if r["pick"] == "quality") == list(range(93, 100)) and len({r["id"] for r in picked}) == 10
    split = sampling.stratified_split(df, "id", "g", {"train": 0.7, "test": 0.3})
    assert Counter(r["split"] for r in split.collect()) == {"train": 70, "test": 30}
    assert sampling.stratified_split(df.where("false"), "id", "g", {"train": 1.0}).count() == 0


def _graph(spark, n=30, e=90, seed=1):
    rng = random.Random(seed)
    pairs = {(f"u{rng.randrange(n)}", f"u{rng.randrange(n)}") for _ in range(e)}
    pairs = {(a, b) for a, b in pairs if a != b}
    return pairs, spark.createDataFrame([(a, b, 1) for a, b in pairs], "src string, dst string, weight int")


def test_network_measures(spark):
    pairs, edges = _graph(spark)
    und = {tuple(sorted(p)) for p in pairs}
    names = sorted({x for p in pairs for x in p})
    tri = Counter()
    for a, b, c in itertools.combinations(names, 3):
        if {(a, b), (a, c), (b, c)} <= und:
            tri.update([a, b, c])
    assert {r["node"]: r["triangles"] for r in network.triangles(edges).collect()} == dict(tri)
    shape = network.shape(edges).first()
    assert (shape["nodes"], shape["edges"]) == (len(names), len(pairs))
    assert shape["reciprocity"] == pytest.approx(sum((b, a) in pairs for a, b in pairs) / len(pairs))
    rank = {n: 1 / len(names) for n in names}
    for _ in range(7):
        lost = sum(rank[n] for n in names if not any(a == n for a, _ in pairs))
        nxt = {n: 0.15 / len(names) + 0.85 * lost / len(names) for n in names}
        for a, b in pairs:
            nxt[b] += 0.85 * rank[a] / sum(x == a for x, _ in pairs)
        rank = nxt
    got = {r["node"]: r["rank"] for r in network.pagerank(edges, 7).collect()}
    assert got == pytest.approx(rank)
    assert sum(got.values()) == pytest.approx(1)


def test_bfs_and_paths(spark):
    edges = spark.createDataFrame([("g", "a", "b"), ("g", "b", "c"), ("g", "c", "d"), ("g", "a", "d")], "g string, src string, dst string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {(r["node"], r["hop"]) for r in network.bfs(edges, seeds, 1).collect()} == {("a", 0), ("b", 1), ("d", 1)}
    got = {r["node"]: (r["closeness"], r["betweenness"]) for r in network.path_centralities(edges, "g").collect()}
    assert got["b"][1] == pytest.approx(1 / 6) and got["a"] == pytest.approx((0.0, 0.0)) and got["b"][0] == pytest.approx(1 / 3)
    assert network.path_centralities(edges, "g", 3).where("closeness IS NULL").count() == 4


def test_closeness_of_large_graphs(spark):
    rng = random.Random(8)
    pairs = {("g", f"u{a:03}", f"u{b:03}") for a, b in ((rng.randrange(150), rng.randrange(150)) for _ in range(190))} | {("h", f"u{i}", f"u{i + 1}") for i in range(9)}
    edges = spark.createDataFrame(sorted(pairs), "g string, src string, dst string")
    whole = {(r["g"], r["node"]): r["closeness"] for r in network.path_centralities(edges, "g").collect()}
    cut = network.path_centralities(edges, "g", between=20).collect()
    assert {(r["g"], r["node"]): r["closeness"] for r in cut} == pytest.approx(whole) and all(v is not None for v in whole.values())
    assert {r["g"] for r in cut if r["betweenness"] is None} == {"g"}


def test_path_centralities_of_long_threads(spark, monkeypatch):
    # as many steps as users: no stage is written for a step
    put, stages = Stash.put, []
    monkeypatch.setattr(Stash, "put", lambda self, *args: stages.append(1) or put(self, *args))
    edges = spark.createDataFrame([("g", f"u{i:02}", f"u{i + 1:02}") for i in range(29)] + [("g", "u29", "u29")], "g string, src string, dst string")
    got = {r["node"]: (r["closeness"], r["betweenness"]) for r in network.path_centralities(edges, "g", between=20).collect()}
    assert got == {f"u{i:02}": (pytest.approx(2 * i / (i + 1) / 29), None) for i in range(30)}
    assert len(stages) < 10
    over = network.path_centralities(edges.where("src < 'u05'"), "g", between=2, within=3).collect()
    assert {r["node"]: r["closeness"] for r in over} == {f"u{i:02}": pytest.approx(2 * i / (i + 1) / 5) for i in range(6)}


def test_path_centralities_of_odd_edges(spark):
    rows = [("g", "a", "b"), ("g", "a", "b"), ("g", "c", "c"), ("g", "a", None), (None, "a", "b"), ("h", "d", "d")]
    edges = spark.createDataFrame(rows, "g string, src string, dst string")
    want = {("g", "a"): 0.0, ("g", "b"): 0.5, ("g", "c"): 0.0, ("h", "d"): 0.0}
    for between in (1000, 2, 1):
        assert {(r["g"], r["node"]): r["closeness"] for r in network.path_centralities(edges, "g", between=between).collect()} == want
    assert network.path_centralities(edges.where("g = 'x'"), "g").count() == 0


def test_path_kernels_in_parts(monkeypatch):
    rng = random.Random(3)
    for places, words, few in ((1, 1, 1), (300, 200, 2), (10**6, 10**6, 16)):
        for name, value in (("PLACES", places), ("WORDS", words), ("FEW", few)):
            monkeypatch.setattr(network, name, value)
        n, half = 170, 20  # two graphs; a hub in the second
        pairs = {(rng.randrange(half), rng.randrange(half)) for _ in range(40)} | {(rng.randrange(half, n), rng.choice([half, rng.randrange(half, n)])) for _ in range(400)}
        pairs = sorted((a, b) for a, b in pairs if a != b)
        src, dst = np.array(pairs).T
        out = {v: [b for a, b in pairs if a == v] for v in range(n)}
        reached, total, between = [0] * n, [0] * n, [0.0] * n
        for s in range(n):
            dist, count, order = {s: 0}, {s: 1}, [s]
            for v in order:
                for w in out[v]:
                    if w not in dist:
                        dist[w], count[w] = dist[v] + 1, 0
                        order.append(w)
                    count[w] += count[v] * (dist[w] == dist[v] + 1)
            gain = dict.fromkeys(order, 0.0)
            for v in reversed(order):
                gain[v] = sum(count[v] / count[w] * (1 + gain[w]) for w in out[v] if dist[w] == dist[v] + 1)
                if v != s:
                    reached[v], total[v], between[v] = reached[v] + 1, total[v] + dist[v], between[v] + gain[v]
        r, t, b = network._between(src, dst, np.array([0] * half + [1] * (n - half)))
        assert r.tolist() == reached and t.tolist() == total and b == pytest.approx(between)
        r, t = sum(np.array(network._near(n, src, dst, part, 3)) for part in range(3))
        assert r.tolist() == reached and t.tolist() == total


def test_edges_from_comments(spark):
    rows = [("1", None, "p", "u", "Uma", "hi"), ("2", "1", "p", "v", "vic.1", "@Uma hey @uma."), ("3", "1", "p", "u", "Uma", "@vic.1, no"), ("4", "1", "q", "v", "vic.1", "@uma"), ("5", "2", "p", None, "", "@uma"), ("6", "2", "p", "w", None, None)]
    df = spark.createDataFrame(rows, "comment_id string, parent_id string, post_id string, user_id string, username string, text string")
    assert {tuple(r) for r in network.reply_edges(df).collect()} == {("v", "u", 1), ("w", "v", 1)}
    assert {tuple(r) for r in network.mention_edges(df).collect()} == {("p", "vic.1", "uma"), ("p", "uma", "vic.1")}


@pytest.mark.parametrize("block", [2, 500])
def test_co_comments(spark, block):
    rng = random.Random(3)
    rows = [(f"p{rng.randrange(6)}", f"u{rng.randrange(9)}") for _ in range(60)]
    posts = defaultdict(set)
    for p, u in rows:
        posts[p].add(u)
    want = Counter(pair for us in posts.values() for pair in itertools.combinations(sorted(us), 2))
    df = spark.createDataFrame(rows, "post_id string, user_id string")
    assert {(r["a"], r["b"]): r["weight"] for r in network.co_comment_edges(df, 2, block).collect()} == {k: v for k, v in want.items() if v >= 2}


def test_components(spark):
    links = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("x", "y"), ("z", "z"), ("b", "a")]
    got = {r["node"]: r["component"] for r in components.star_components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert {got[f"n{i:03}"] for i in range(61)} == {"n000"} and got["y"] == "x" and got["z"] == "z" and got["b"] == "a"


def brute_dbscan(points, eps, least):
    near = {i: [j for j in points if sum((a - b) ** 2 for a, b in zip(points[i], points[j])) ** 0.5 <= eps] for i in points}
    core = {i for i in points if len(near[i]) >= least}
    label = {}
    for i in sorted(core):
        if i in label:
            continue
        stack, label[i] = [i], i
        while stack:
            for j in near[stack.pop()]:
                if j in core and j not in label:
                    label[j] = i
                    stack.append(j)
    return {i: label.get(i, min((label[j] for j in near[i] if j in core), default=None)) for i in points}


@pytest.mark.parametrize("dims", [1, 2, 3])
def test_dbscan(spark, dims):
    rng = random.Random(dims)
    points = {i: tuple(round(rng.random() * (6 if dims == 1 else 3), 3) for _ in range(dims)) for i in range(90)}
    points |= {100 + i: points[0] for i in range(5)}
    df = spark.createDataFrame([(i, *p) for i, p in points.items()] + [(999, *[None] * dims)], "id int, " + ", ".join(f"x{k} double" for k in range(dims)))
    eps = 0.0301 if dims == 1 else 0.2501
    got = {r["id"]: r["cluster"] for r in cluster.dbscan(df, "id", [f"x{k}" for k in range(dims)], eps, 4).collect()}
    assert got.pop(999) is None
    assert got == brute_dbscan(points, eps, 4)


def test_cluster_measures(spark):
    rows = [(0, 1, "s1", [1.0, 0.0]), (0, 1, "s2", [3.0, 0.0]), (1, 0, "s3", [0.0, 2.0]), (1, 1, "s1", [0.0, 2.0])]
    df = spark.createDataFrame(rows, "c int, label int, s string, x array<double>")
    q = {r["c"]: r for r in cluster.quality(df, "c", "x", "label", "s", df.where("label = 0")).collect()}
    assert q[0]["purity"] == 1 and q[0]["coverage"] == 1 and q[0]["stability"] == pytest.approx(1 / 1.5) and q[0]["discrimination"] == pytest.approx(8**0.5)
    assert q[1]["stability"] == 1 and q[1]["coverage"] == 0.5
    assert {r["c"]: r["cohesion"] for r in cluster.cohesion(df, "c", "x").collect()} == {0: pytest.approx(1), 1: pytest.approx(1)}
    binned = cluster.quantile_bins(spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,)], "v double"), "v", [0.25, 0.5, 0.75])
    assert [r["bin"] for r in binned.orderBy("v").collect()] == [0, 1, 2, 3]


def test_subgraphs(spark):
    kind = "map<string,array<bigint>>"
    edge = "map<string,array<struct<src:bigint,dst:bigint>>>"
    rows = [(1, "b", {"comment": [5, 5, None], "user": [5]}, {"r": [(5, 5)]}), (1, "a", {"user": [5], "comment": [5]}, {"r": [(5, 5), (5, 6), (5, 6)], "q": []}), (1, "c", {}, None), (2, "d", None, {}), (2, "e", {"comment": None}, {"r": None})]
    df = spark.createDataFrame(rows, f"session_no int, subgraph_id string, nodes {kind}, edges {edge}")
    s = {r["subgraph_id"]: r for r in subgraphs.structure(df).collect()}
    assert (s["b"]["n_nodes"], s["b"]["n_edges"], s["a"]["n_edges"], s["c"]["n_nodes"], s["d"]["n_edges"], s["e"]["n_nodes"]) == (2, 1, 2, 0, 0, 0)
    assert {(r["session_no"], r["subgraph_id"], r["copies"]) for r in subgraphs.dedupe(df).collect()} == {(1, "a", 2), (1, "c", 1), (2, "d", 2)}
    comps = subgraphs.compositions(spark, 2, 3, {"comment": 2, "user": 1, "video": 1, "word": 1})
    assert comps.count() == sum(2 <= sum(c) <= 3 for c in itertools.product((1, 2), (0, 1), (0, 1), (0, 1)))


@pytest.mark.parametrize("strategy", ["compact", "balanced", "extensive"])
def test_growth_is_connected_and_bounded(spark, strategy):
    edges = [("comment:1", "user:1"), ("comment:1", "word:a"), ("word:a", "comment:2"), ("user:1", "user:2"), ("comment:2", "user:3"), ("comment:9", "user:9")]
    grown = subgraphs.grow(spark.createDataFrame([("comment:1",)], "seed string"), spark.createDataFrame(edges, "a string, b string"), 5, strategy).first()
    assert sorted(grown["added"]) == grown["nodes"] and grown["added"][0] == "comment:1"
    assert len(grown["nodes"]) == 5 and "comment:9" not in grown["nodes"] and "comment:1" in grown["nodes"]


def test_every_composition(spark):
    got = {tuple(r) for r in subgraphs.every_composition(spark).collect()}
    assert got == {(n, c, u, v, n - c - u - v) for n in range(6, 16) for c in range(1, n) for u in range(n - c + 1) for v in range(min(n - c - u, 1) + 1)}
    assert (15, 2, 6, 1, 6) in got and (6, 6, 0, 0, 0) not in got


@pytest.mark.parametrize("strategy", ["compact", "balanced", "extensive"])
def test_growth_beyond_two_steps(spark, strategy):
    rng = random.Random(4)
    chain = [f"{'comment' if i % 2 == 0 else 'user'}:{i:02}" for i in range(20)]
    nodes = [f"{rng.choice(['comment', 'user', 'word'])}:n{i:02}" for i in range(60)]
    edges = list(zip(chain, chain[1:])) + [tuple(rng.sample(nodes, 2)) for _ in range(75)]
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b), near[b].add(a)
    rank = lambda n: (["comment", "user", "word"].index(n.split(":")[0]), n)
    want = {}
    for seed in [chain[0]] + sorted(n for n in near if n.startswith("comment:n")):
        chosen = [seed]
        while len(chosen) < 9 and (free := {n for c in chosen for n in near[c]} - set(chosen)):
            have = {c.split(":")[0] for c in chosen}
            if strategy == "extensive":
                chosen.append(min(free, key=lambda n: (n.split(":")[0] in have, rank(n))))
            else:
                chosen.append(min(free) if strategy == "balanced" and len(chosen) % 2 else min(free, key=rank))
        want[seed] = chosen
    grown = subgraphs.grow(spark.createDataFrame([(k,) for k in want], "seed string"), spark.createDataFrame(edges, "a string, b string"), 9, strategy)
    assert {r["seed"]: r["added"] for r in grown.collect()} == want
    assert len(want[chain[0]]) == 9


def test_hetero(spark):
    nodes = spark.createDataFrame([("u", "b", [1.0, 2.0]), ("u", "a", [3.0, 2.0]), ("w", "z", [0.0])], "type string, key string, features array<double>")
    ids = {(r["type"], r["key"]): r["id"] for r in hetero.dense_ids(nodes).collect()}
    assert ids == {("u", "a"): 0, ("u", "b"): 1, ("w", "z"): 0}
    a, b = nodes.where("type = 'u'").select("key", "features"), spark.createDataFrame([("a", [9.0, 9.0]), ("c", [7.0, 7.0])], "key string, features array<double>")
    assert {r["key"]: r["features"] for r in hetero.concat_fusion([(a, 2), (b, 2)]).collect()} == {"a": [3.0, 2.0, 9.0, 9.0], "b": [1.0, 2.0, 0.0, 0.0], "c": [0.0, 0.0, 7.0, 7.0]}
    assert {r["key"]: r["features"] for r in hetero.mean_fusion([a, b]).collect()} == {"a": [6.0, 5.5], "b": [1.0, 2.0], "c": [7.0, 7.0]}
    z = {r["key"]: r["features"] for r in hetero.zscore_features(nodes).collect()}
    assert z["a"][0] == pytest.approx(2**-0.5, abs=1e-5) and z["a"][1] == 0 and z["z"] == [0.0]


def test_matching(spark):
    m = spark.createDataFrame([(1, 0, 0.9), (1, 0, 0.7), (1, 1, 0.2), (2, 0, 0.5)], "s int, prototype int, similarity double")
    a = {r["s"]: r for r in matching.aligner_features(m, "s").collect()}
    assert a[1]["best"] == pytest.approx(0.87) and (a[1]["high"], a[1]["low"], a[1]["predicted"]) == (1, 1, 1) and a[2]["predicted"] == 0
    f = {(r["s"], r["prototype"]): r["hits"] for r in matching.session_match(m, "s").collect()}
    assert f == {(1, 0): 2, (1, 1): 0, (2, 0): 0}


def test_confusion(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (None, 1)], "y int, p int")
    assert tuple(detect.confusion(df, "y", "p").first()) == (1, 1, 1, 1, 0.5, 0.5, 0.5, 0.5)
    assert tuple(detect.confusion(df.where("false"), "y", "p").first())[4:] == (0, 0, 0, 0)


def test_detectors_learn(spark):
    rng = random.Random(5)
    rows = [(i, int(i % 3 == 0), [rng.gauss(2.0 if i % 3 == 0 else 0.0, 0.5), rng.random()]) for i in range(150)]
    df = spark.createDataFrame(rows, "k int, y int, x array<double>")
    for kind in ("forest", "logistic", "perceptron"):
        out = detect.evaluate(df, "k", "y", "x", kind)
        assert detect.confusion(out.where("split = 'test'"), "y", "predicted").first()["accuracy"] > 0.85


def test_vector_search(spark):
    rows = [(i, [float(i % 3 == 0), float(i % 3 == 1), float(i % 3 == 2)]) for i in range(12)] + [(99, None)]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    got = {(r["query_id"], r["id"]) for r in search.similar_vectors(df.where("id = 0"), df, "id", "v", 0.5).collect()}
    assert got == {(0, 3), (0, 6), (0, 9)}


def test_user_windows(spark):
    df = spark.createDataFrame([("u", 9, 1), ("u", 14, 2), ("u", 14, 3), ("u", 9, 4)], "u string, h int, t int")
    assert tuple(users.peak(df, "u", F.col("h"), [F.col("t")]).first()) == ("u", 9, 2)
    assert users.histogram(df, "u", F.col("h"), [9, 10, 14]).first()["counts"] == [2, 0, 2]


def test_weighted_quality_and_merging(spark):
    rows = [(0, "a", [0.0, 0.0], 1.0), (0, "b", [4.0, 0.0], 3.0), (1, "c", [1.0, 1.0], 1.0)]
    df = spark.createDataFrame(rows, "c int, k string, x array<double>, w double")
    q = {r["c"]: r for r in cluster.weighted_quality(df, "c", "k", "x", "w").collect()}
    # centre 3; distances 3 and 1; weighted mean 1.5; deviation of weights 1; half weigh above one
    assert q[0]["quality"] == pytest.approx(1 / 2.5 + 0.1 + 0.15) and q[0]["representative"] == "b"
    assert q[1]["quality"] == 1 and q[1]["representative"] == "c"
    p = spark.createDataFrame([(1, [1.0, 0.0], 5), (2, [0.9, 0.1], 9), (3, [0.0, 1.0], 7), (4, [0.0, 0.0], 1)], "p int, x array<double>, n int")
    assert {r["p"]: r["merged_into"] for r in cluster.merge_similar(p, "p", "x", "n").collect()} == {1: 2, 2: 2, 3: 3, 4: 4}


def test_growth_sizes_diverse_and_merged(spark):
    grown = spark.createDataFrame([("s", ["a", "b", "c"], ["c", "a", "b"])], "seed string, nodes array<string>, added array<string>")
    assert [(r["size"], r["nodes"]) for r in subgraphs.at_each_size(grown, 2, 9).orderBy("size").collect()] == [(2, ["a", "c"]), (3, ["a", "b", "c"])]
    df = spark.range(100).withColumn("v", F.col("id") * 1.0)
    got = [r["id"] for r in sampling.diverse(df, "id", "v", [50.0], 5, 4, 3).collect()]
    assert len(got) == len(set(got)) and 10 <= len(got) <= 17 and {96, 97, 98, 99} <= set(got)
    parts = {"x_": df.select(F.lit("1").alias("c")), "y_": df.select(F.when(F.col("id") < 3, "2").alias("c"))}
    assert [tuple(r) for r in cluster.merge_clusterings(parts, 4).collect()] == [("x_1", 100)]
