import os
import re
import zlib

import numpy as np
import pytest

from skeinwork.llm import abuse
from skeinwork.llm.boosting import Boosted, Calibrated, isotonic

SAMPLES = [
    ("you are such a dumb freak", "abusive"), ("nobody likes you trash", "abusive"), ("@kim ur a gross pig", "abusive"), ("i swear i'm gonna slap you", "abusive"),
    ("send them back where they came from", "hateful"), ("they are vermin and should be kept out", "hateful"), ("send me nudes @kim", "sexual"), ("hot naked singles on cam", "sexual"),
    ("trash can basketball is my sport", "none"), ("my guinea pig is calm", "none"), ("i love this song", "none"), ("what song is this?", "none"),
    ("someone called me ugly and this made me smile", "none"), ("the lamp and the ending, iconic", "none"), ("teach me how to bake", "none"), ("you killed it", "none"),
]


def samples(spark):
    return spark.createDataFrame([(i, t, v) for i, (t, v) in enumerate(SAMPLES * 8)], "sample_id long, sample_text string, verdict string")


def model(spark):
    return abuse.fit(samples(spark), "sample_id", "sample_text", "verdict", [])


def test_disguises_are_undone():
    f = abuse.Features([])
    for disguise in ("l0s3r", "l o s e r", "l.o.s.e.r", "ｌｏｓｅｒ", "lоsеr", "lo​ser", "looooser", "LOSER", "l***r", "los er", "lo_ser"):
        assert "loser" in f.normal(f"you {disguise}")[0], disguise


def test_scores(spark):
    m = model(spark)
    texts = {
        "a": "u are a p4th3t1c l o s e r", "b": "what a lovely garden", "c": None, "d": "", "e": "  ", "f": "i am such an idiot lol", "g": "my fat cat and my guinea pig",
        "h": "you absolute moron", "i": "word " * 50_000 + "nobody likes you freak", "j": "he said 'you are a loser' to me and i walked away", "k": "ты такой тупой", "l": "你真是个废物",
    }
    df = spark.createDataFrame(list(texts.items()) + [(None, "you idiot")], "comment_id string, comment_text string").withColumn("score", abuse.F.lit("clash")).withColumn("_text", abuse.F.lit(1))
    got = {r["comment_id"]: r["score"] for r in abuse.score(df, "comment_id", "comment_text", m, []).collect()}
    assert len(got) == len(texts) + 1
    assert {k for k, v in got.items() if v >= 0.5} == {"a", "h", "i", "k", "l", None}
    assert got["c"] == got["d"] == got["e"] == 0.0


def test_rates(spark):
    df = spark.createDataFrame([("1", "p", 0.9), ("1", "p", 0.9), ("2", "p", 0.1), ("3", None, 0.7), (None, "p", 0.9)], "id string, post string, score double")
    assert {r["post"]: (r["records"], r["flagged"], r["rate"]) for r in abuse.rates(df, "id", "post").collect()} == {"p": (2, 1, 0.5), None: (1, 1, 1.0)}


def test_empty_tables(spark):
    m = abuse.fit(samples(spark).where("false"), "sample_id", "sample_text", "verdict", [])
    df = spark.createDataFrame([("1", "text")], "comment_id string, comment_text string")
    assert abuse.score(df, "comment_id", "comment_text", m, []).count() == 1
    assert abuse.score(df.where("false"), "comment_id", "comment_text", m, []).count() == 0


def test_word_table(spark):
    df = spark.createDataFrame([(" Rat",), ("rat ",), ("",), (None,), ("shut up",)], "word string")
    assert abuse.word_table(df, "word") == ["rat", "shut up"]


def test_boosting_on_held_out_rows():
    rng = np.random.default_rng(0)
    x = rng.random((600, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.6)).astype(float)
    noisy = np.where(rng.random(600) < 0.05, 1 - y, y)
    m = Calibrated.fit(x[:400], noisy[:400], depth=3, trees=120)
    assert ((m.predict(x[400:]) >= 0.5) == y[400:]).mean() > 0.9
    assert Boosted().fit(x[:0], y[:0]).score(x[:3]).tolist() == [0.0] * 3


def test_isotonic_is_monotone():
    x, p = isotonic(np.array([3.0, 1.0, 2.0, 4.0, 5.0]), np.array([0.0, 0.0, 1.0, 1.0, 1.0]))
    assert (np.diff(p) >= 0).all() and x.tolist() == sorted(x.tolist()) and 0.5 < p[-1] < 1


def skeleton(text):
    """A text without mentions, numbers and its rarer words, so that wordings of one kind fall together."""
    return " ".join(re.sub(r"@\S+|\d+", "", text.lower()).split()[:3])


def test_accuracy_on_held_out_wordings(spark):
    """Fitted on the project's examples but a fifth of their wordings, applied to those; every fifth in turn."""
    path = "/root/testdata/sf0.01/abuse_samples.parquet"
    if not os.path.exists(path):
        pytest.skip("no examples here")
    rows = [r for r in spark.read.parquet(path).orderBy("sample_id").collect() if r["sample_text"] and r["verdict"]]
    y = np.array([float(r["verdict"] != "none") for r in rows])
    fold = np.array([zlib.crc32(skeleton(r["sample_text"]).encode()) % 5 for r in rows])
    texts, p = [r["sample_text"] for r in rows], np.zeros(len(rows))
    for k in range(5):
        m = abuse.Scorer.fit([t for t, f in zip(texts, fold) if f != k], y[fold != k], [])
        p[fold == k] = m.predict([t for t, f in zip(texts, fold) if f == k], [])
    assert ((p >= 0.5) == y).mean() > 0.9
    assert len(np.unique(p.round(6))) > 20


def test_sentences_and_contractions(spark):
    """Wordings of no example and no table; an apostrophe opens no quotation."""
    m = model(spark)
    bad = [
        "you are a stupid idiot and you cannot change that", "you're a stupid idiot and you can't change that", "you’re a stupid idiot and you can’t change that", "don't you get it, you stupid moron, nobody's fooled",
        "drink bleach", "I will carve you up tonight", "your face makes babies cry", "those immigrants are a disease", "people from that country are parasites, they should all be locked away",
    ]
    good = ["he said 'you are a loser' to me and i walked away", "she wrote \"" + "nobody likes you and " * 20 + "you idiot\" under it", "it's the dogs' bowl, isn't it", "we'll beat you at chess", "i love this dog"]
    p = m.predict(bad + good, [])
    assert (p[: len(bad)] >= 0.5).all() and (p[len(bad) :] < 0.5).all(), dict(zip(bad + good, p))


def test_nearest_positions():
    assert abuse.nearest([1, 9], [4, 20]) == 3 and abuse.nearest([], [1]) is None
