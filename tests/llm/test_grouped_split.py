import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from skeinwork.llm import grouped_split as G

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def run(spark, rows, keys=("author", "source"), schema="id string, author string, source string"):
    out = G.grouped_split(spark.createDataFrame(rows, schema), "id", list(keys)).collect()
    assert len(out) == len({r["record"] for r in out})
    return {r["record"]: (r["component"], r["split"]) for r in out}


def brute(rows):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a, s in rows:
        for k in (("a", a), ("s", s)):
            if i is not None and k[1] is not None:
                parent[find(("r", i))] = find(k)
    return {i: find(("r", i)) for i, _, _ in rows if i is not None}


def test_links_through_any_key(spark):
    rng = random.Random(4)
    rows = [(f"r{i}", f"a{rng.randrange(150)}" if rng.random() < 0.8 else None, f"s{rng.randrange(150)}" if rng.random() < 0.6 else None) for i in range(200)]
    rows += [("r0", "a1", None), ("r0", "a2", "s3"), ("r5", "a9", "s9"), ("r5", "a9", "s9"), (None, "a1", "s1")]
    got, want = run(spark, rows), brute(rows)
    assert set(got) == set(want)
    mine, theirs, splits = defaultdict(set), defaultdict(set), defaultdict(set)
    for i in want:
        mine[got[i][0]].add(i), theirs[want[i]].add(i), splits[want[i]].add(got[i][1])
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))
    assert all(len(s) == 1 for s in splits.values())


def test_shares_with_a_hot_key(spark):
    rows = [(f"r{i}", "hot" if i % 10 == 0 else f"a{i % 400}", None) for i in range(4000)]
    got = run(spark, rows)
    assert G.imbalance(SHARES, Counter(s for _, s in got.values())) < 0.01


def test_many_small_groups(spark):
    df = spark.range(30000).select(F.col("id").cast("string").alias("id"), (F.col("id") % 9000).cast("string").alias("author"))
    out = G.grouped_split(df, "id", ["author"]).groupBy("split").count().collect()
    assert G.imbalance(SHARES, {r["split"]: r["count"] for r in out}) < 0.002


def test_dirt(spark):
    assert run(spark, []) == {}
    one = run(spark, [("x", None, None)])
    assert list(one) == ["x"] and one["x"][1] in SHARES
    clash = spark.createDataFrame([("r", "a", 1, "hub", "c")], "id string, author string, size int, hub string, component string")
    assert G.grouped_split(clash, "id", ["author"]).count() == 1
    assert run(spark, [("r", "a" * 100_000, None), ("q", "a" * 100_000, None)])["r"] == run(spark, [("r", "a" * 100_000, None), ("q", "a" * 100_000, None)])["q"]


def test_same_answer_twice(spark):
    rows = [(f"r{i}", f"a{i % 13}", f"s{i % 7}") for i in range(80)]
    assert run(spark, rows) == run(spark, rows[::-1])
