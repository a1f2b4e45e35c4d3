import random

import numpy as np
import pytest

from skeinwork.llm import shared_spans as S


def brute(rows, span):
    texts = [(k, t) for k, t in set(rows) if k is not None and t]
    where = {}
    for k, t in texts:
        for p in range(len(t) - span + 1):
            where.setdefault(t[p : p + span], set()).add(k)
    cover = {}
    for k, t in texts:
        for p in range(len(t) - span + 1):
            if len(where[t[p : p + span]]) > 1:
                cover.setdefault(k, set()).update(range(p, p + span))
    return {k: len(v) for k, v in cover.items()}


def run(spark, rows, span, kind="long"):
    df = spark.createDataFrame([(*r, "c", "c", 1) for r in rows], f"doc_id {kind}, text string, run string, key string, start int")
    return {r["doc_id"]: r["shared_chars"] for r in S.shared_chars(df, "doc_id", "text", span).collect()}


@pytest.mark.parametrize("span", [100, 20, 7])
def test_against_brute_force(spark, span):
    rng = random.Random(span)
    word = lambda: "".join(rng.choice("abcdeé😀 ") for _ in range(rng.randint(1, 2 * span)))
    common = [word() for _ in range(6)]
    rows = [(i, "".join(rng.choice(common) if rng.random() < 0.4 else word() for _ in range(rng.randint(0, 6)))) for i in range(60)]
    assert run(spark, rows, span) == brute(rows, span)


@pytest.mark.parametrize("span", [128, 200, 250, 300])
def test_long_spans(spark, span):
    rng = random.Random(9)
    draw = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    common = [draw(n) for n in (300, 420, 650, 1100)]
    rows = [(i, draw(rng.randint(0, 90)) + rng.choice(common)[rng.randint(0, 60) :] + draw(rng.randint(0, 90))) for i in range(24)]
    assert run(spark, rows, span) == brute(rows, span)


def test_edges(spark):
    a, b = "x1" * 60, "".join(chr(97 + i % 26) + str(i) for i in range(80))
    rows = [(1, b[:100]), (2, "zz" + b[:100] + "yy"), (3, b[:99]), (4, a), (5, None), (6, ""), (None, b), (7, b[1:101]), (8, "q" * 500), (8, "q" * 500), (9, "ab" * 30 + b[:100] + "ab" * 30 + b[:100])]
    assert run(spark, rows, 100) == brute(rows, 100)
    assert run(spark, [], 100) == {}
    assert run(spark, [(1, b), (1, b)], 100) == {}
    assert run(spark, [("k", b), ("l", b)], 100, "string") == {"k": len(b), "l": len(b)}


def test_long_texts_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 512)
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh") for _ in range(4000))
    assert list(S.runs_of(long, 100, 50))[3][0][0] == 1536
    big = "".join(rng.choice("abcdefgh") for _ in range(700_000))
    rows = [(1, big), (2, big[300_000:300_250] + "zzz"), (3, big[262_000:262_300])]
    assert run(spark, rows, 100) == {1: 550, 2: 250, 3: 300}


def test_group_of_copies(spark):
    text = "".join(chr(97 + (i * 7 + i // 11) % 26) for i in range(400))
    rows = [(i, text) for i in range(300)] + [(1000 + i, f"own {i} " * 40) for i in range(100)]
    got = run(spark, rows, 100)
    assert all(got[i] == 400 for i in range(300))
    assert got == brute(rows, 100)


def test_a_full_sketch_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(S, "MIN_BITS", 3)
    monkeypatch.setattr(S, "MAX_BITS", 3)
    text = "".join(random.Random(9).choices("abcdefghij", k=300))
    assert run(spark, [(1, text), (2, text[50:200]), (3, text[::-1])], 100) == {1: 150, 2: 150}


def test_spans(spark):
    text = "".join(random.Random(9).choices("abcdefghij", k=300))
    df = spark.createDataFrame([(1, text), (2, "AAA" + text[20:150] + "BBB" + text[180:300])], "doc_id long, text string")
    spans = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in S.shared_chars(df, "doc_id", "text").collect()}
    assert spans == {1: [(20, 130), (180, 120)], 2: [(3, 130), (136, 120)]}


def test_window_hashes():
    codes = np.array([ord(c) for c in "abcabcabd"], dtype=np.uint32)
    h = S.window_hashes(codes, 3, 0)
    assert len(h) == 7 and h[0] == h[3] and len(set(h.tolist())) == 4 and len(S.window_hashes(codes, 10, 0)) == 0
