import os
from collections import Counter

import numpy as np
import pytest

from skeinwork.llm import encoding, mixing

pytestmark = pytest.mark.skipif(not os.path.isdir(encoding.TOKENIZERS), reason="no tokenizers")
SCHEMA = "doc_id long, text string, source string, block int, ids string"
TARGETS = "source string, target_weight double, max_repeats int"


def run(spark, rows, targets, **options):
    df = spark.createDataFrame([(*r, 7, "clash") for r in rows], SCHEMA)
    return mixing.mix(df, "doc_id", "text", "source", spark.createDataFrame(targets, TARGETS), **options)


def test_shares_repeats_and_order(spark):
    rows = [(i, f"words of document {i} " * (1 + i % 9), ("A", "b ", " C")[i % 3]) for i in range(600)]
    rows += [(1000 + i, "small source text", "d") for i in range(20)] + [(2000, None, "a"), (2001, "", "a"), (2002, "x", None), (2003, "y", "unlisted"), (None, "z", "a"), (5, "words", "c")]
    targets = [("a", 5.0, 1), ("B", 3.0, 2), ("c", 2.0, 1), ("d", 0.5, 3), ("none", 1.0, 4), (None, 1.0, 1), ("zero", 0.0, 1), ("nul", None, None)]
    mixture, shares = run(spark, rows, targets, block=16, shard_blocks=32)
    got = mixture.collect()
    s = {r["source"]: r for r in shares.collect()}
    assert set(s) == {"a", "b", "c", "d", "none", "zero", "nul"} and s["none"]["tokens"] == 0 and s["none"]["target_share"] == 0
    for name in "abcd":
        assert abs(s[name]["actual_share"] - s[name]["target_share"]) < 0.02
    uses = Counter((r["source"], r["block"]) for r in got)
    assert all(n <= {"a": 1, "b": 2, "c": 1, "d": 3}[source] for (source, _), n in uses.items())
    documents = Counter(d for r in got for d in set(r["doc_ids"]) if r["source"] == "d")
    assert len({(r["shard"], r["slot"]) for r in got}) == len(got) and all(len(r["ids"]) == r["n_tokens"] <= 16 for r in got)
    assert documents and not {2000, 2001, 2002, 2003} & {d for r in got for d in r["doc_ids"]}
    assert {tuple(r["ids"]) for r in run(spark, rows, targets, block=16, shard_blocks=32)[0].collect()} == {tuple(r["ids"]) for r in got}


def test_blocks_hold_every_token(spark):
    from skeinwork.storage import Stash

    rows = [(i, f"some text number {i} " * (i % 40), "hot" if i % 3 else "cold") for i in range(300)]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA)
    tokens = encoding.encode(df.selectExpr("struct(doc_id AS doc, source) AS key", "text"), "key", "text").select("key.doc", "key.source", "ids")
    packed = mixing.pack(tokens, 32, Stash(spark, "t")).collect()
    total = Counter()
    for r in tokens.collect():
        total[r["source"]] += len(r["ids"])
    have = Counter()
    for r in packed:
        have[r["source"]] += len(r["ids"])
    assert have == total
    for source in have:
        sizes = sorted((r["block"], len(r["ids"])) for r in packed if r["source"] == source)
        assert [b for b, _ in sizes] == list(range(len(sizes))) and all(n == 32 for _, n in sizes[:-1])


def test_asked_size_and_emptiness(spark):
    rows = [(i, "word " * 50, "a") for i in range(50)]
    assert run(spark, rows, [("a", 1.0, 1)], block=10, total_blocks=17)[0].count() == 17
    empty, shares = run(spark, [], [("a", 1.0, 1)])
    assert empty.count() == 0 and shares.first()["tokens"] == 0
    assert run(spark, rows, [])[0].count() == 0 and run(spark, rows, [])[1].count() == 0


def test_permutation_and_draws():
    for n in (1, 2, 3, 10, 1000, 4097):
        i = np.arange(n)
        p = mixing.permuted(i, np.full(n, n), np.full(n, -5))
        assert sorted(p.tolist()) == i.tolist()
    drawn = mixing.draw_shards({"a": 70, "b": 30}, 10, 1)
    assert Counter({n: sum(c for _, m, _, c in drawn if m == n) for n in "ab"}) == {"a": 70, "b": 30}
    assert all(sum(c for s, _, _, c in drawn if s == shard) == 10 for shard in range(10))
    q = mixing.quotas({"a": 1, "b": 1}, {"a": 10, "b": 100}, {"a": 2, "b": 1})
    assert q == {"a": 20, "b": 20}
