import itertools
import random

import pytest
from pyspark.sql import functions as F

from skeinwork.llm import set_join


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, els array<string>, cls string, size int, a string, record string").select("*") if rows and len(rows[0]) > 2 else spark.createDataFrame(rows, "id string, els array<string>")


def brute(sets):
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 7 * len(sets[a] | sets[b])}


def pairs(df):
    rows = [tuple(r) for r in set_join.similar_pairs(df, "id", F.col("els")).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("block", [3, 200])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(set_join, "BLOCK", block)
    rng = random.Random(1)
    sets = {}
    for i in range(60):
        base = {f"e{rng.randrange(300)}" for _ in range(rng.randrange(1, 15))}
        for j in range(4):
            changed = set(base)
            for _ in range(rng.randrange(4)):
                changed ^= {f"e{rng.randrange(300)}"}
            sets[f"r{i}_{j}"] = changed
    assert pairs(frame(spark, [(k, sorted(v)) for k, v in sets.items()])) == brute(sets)


def test_exact_threshold(spark):
    ten = [f"e{i}" for i in range(10)]
    rows = [("a", ten), ("b", ten[:7]), ("c", ten[:6] + ["x"]), ("d", ten[:9])]
    assert pairs(frame(spark, rows)) == {("a", "b"), ("a", "d"), ("b", "d"), ("b", "c")}


def test_dirt(spark):
    rows = [("a", ["x", "x", None, "y"]), ("b", ["y", "x"]), ("a", ["y", "x"]), ("c", []), ("d", None), (None, ["x", "y"]), ("e", [None]), ("f", ["x"]), ("f", ["y"]), ("", ["q"])]
    assert pairs(frame(spark, rows)) == {("a", "b"), ("a", "f"), ("b", "f")}
    assert pairs(frame(spark, rows).where("false")) == set()


def test_copies_and_clashing_columns(spark):
    rows = [(f"r{i:03}", ["x", "y", "z"], "c", 1, "a", "q") for i in range(40)] + [("s", ["x", "y", "z", "w"], "c", 1, "a", "q")]
    df = frame(spark, rows)
    assert len(pairs(df)) == 41 * 40 // 2
    links = {r["record"]: (r["copies"], r["links"]) for r in set_join.links_per_record(df, "id", F.col("els")).collect()}
    assert links["s"] == (1, 40) and links["r000"] == (40, 1)


def test_long_sets(spark):
    big = [f"e{i}" for i in range(20000)]
    assert pairs(frame(spark, [("a", big), ("b", big[:19000]), ("c", big[:5000])])) == {("a", "b")}


def test_between_tables(spark):
    left, right = frame(spark, [("a", ["x", "y"]), ("b", ["q"])]), frame(spark, [("a", ["x", "y"]), ("c", ["y", "x"]), ("d", ["z"])])
    assert {tuple(r) for r in set_join.similar_between(left, right, "id", F.col("els")).collect()} == {("a", "a"), ("a", "c")}


def test_missed_pairs_are_rare():
    assert (1 - 0.7**3) ** set_join.bands_for(0.7, 3) < 1e-6
