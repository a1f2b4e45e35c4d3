"""The reply hierarchy against brute force, and its edge cases."""

import random

import pytest

from skeinwork.operators.hierarchy import clean_links, descendants, resolve


def brute(links: dict):
    out = {}
    for v in links:
        path, at, seen = [v], links[v], {v}
        while at in links and at not in seen:
            path.append(at), seen.add(at)
            at = links[at]
        if at not in links:
            out[v] = (path[-1], len(path) - 1, False, path[::-1])
            continue
        ring = path[path.index(at) :]
        out[v] = (min(ring), -1, True, path[: path.index(at) + 1][::-1])
    return out


def solve(spark, rows, paths=True):
    df = spark.createDataFrame(rows, "commentId string, parentCommentId string, loaded_at int")
    return {r["node"]: (r["root"], r["depth"], r["in_cycle"], list(r["path"])) for r in resolve(clean_links(df, "commentId", "parentCommentId", "loaded_at"), paths).collect()}


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = 120
    links = {}
    for i in range(n):
        kind = rng.random()
        links[f"c{i}"] = None if kind < 0.1 else f"c{rng.randrange(max(1, i))}" if kind < 0.8 else f"c{rng.randrange(n + 5)}"
    assert solve(spark, [(k, v, 0) for k, v in links.items()]) == brute(links)


def test_deep_chain_and_large_ring(spark):
    links = {f"a{i:04}": f"a{i - 1:04}" if i else None for i in range(700)}
    links |= {f"r{i:03}": f"r{(i + 1) % 90:03}" for i in range(90)}
    links |= {f"t{i:03}": f"t{i - 1:03}" if i else "r007" for i in range(40)}
    assert solve(spark, [(k, v, 0) for k, v in links.items()]) == brute(links)


def test_splitterless_rings_and_what_leads_there(spark):
    links = {"self": "self", "x": "y", "y": "x", "z": "x", "w": "z"}
    links |= {f"q{i}": "w" for i in range(60)}
    links |= {f"p{i}": f"q{i}" for i in range(60)}
    assert solve(spark, [(k, v, 0) for k, v in links.items()]) == brute(links)


def test_dirt(spark):
    rows = [
        ("a", None, 1), ("b", " a\t", 1), ("c", "", 1), ("d", "   ", 1), ("e", "nowhere", 1), (None, "a", 1), (None, None, None),
        ("v", "a", 1), ("v", "b", 2), ("v", "b", 2), ("n", "a", None), ("n", "b", 1), ("", "a", 1), ("long" * 5000, "b", 1),
    ]
    got = solve(spark, rows)
    assert got["b"][:2] == ("a", 1) and got["c"][:2] == ("c", 0) and got["d"][:2] == ("d", 0) and got["e"][:2] == ("e", 0)
    assert got["v"][:2] == ("a", 2) and got["n"][:2] == ("a", 2) and got[""][:2] == ("a", 1) and got["long" * 5000][:2] == ("a", 2)
    assert None not in got


def test_star_with_most_rows(spark):
    rows = [("hub", None, 0)] + [(f"s{i}", "hub", 0) for i in range(3000)]
    assert all(v[:2] == ("hub", 1) for k, v in solve(spark, rows).items() if k != "hub")


def test_empty_and_clashing_columns(spark):
    assert solve(spark, []) == {}
    df = spark.createDataFrame([("a", None, 1, "x", "y", "z", "w")], "commentId string, parentCommentId string, loaded_at int, node string, ptr string, root string, parent string")
    assert [tuple(r) for r in resolve(clean_links(df, "commentId", "parentCommentId", "loaded_at")).collect()] == [("a", "a", 0, False)]


def test_descendants(spark):
    df = spark.createDataFrame([("a", None, 0), ("b", "a", 0), ("c", "b", 0), ("x", "x", 0), ("y", "x", 0)], "commentId string, parentCommentId string, loaded_at int")
    pairs = descendants(resolve(clean_links(df, "commentId", "parentCommentId", "loaded_at"), True))
    assert {tuple(r) for r in pairs.collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("x", "y", 1)}
