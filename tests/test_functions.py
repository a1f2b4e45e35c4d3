"""Scalar functions on worked examples."""

import datetime as dt

from pyspark.sql import functions as F

from skeinwork.functions import lexicons as L
from skeinwork.functions import temporal as T
from skeinwork.functions import text as X
from skeinwork.functions import vectors as V
from skeinwork.operators import scoring, users


def one(spark, expr, **values):
    df = spark.range(1)
    for name, value in values.items():
        df = df.withColumn(name, F.lit(value))
    return df.select(expr.alias("r")).first()["r"]


def test_tokens(spark):
    t = F.lit("You ARE so dumb, dumb!!")
    assert one(spark, X.tokens(t)) == ["you", "dumb", "dumb"]
    assert one(spark, X.lexicon_hits(X.tokens(t), L.ATTACK_WORDS)) == 2
    assert round(one(spark, X.upper_ratio(t)), 6) == round(4 / 23, 6)
    assert one(spark, X.count_matches(t, "!")) == 2
    assert one(spark, X.tokens(F.lit(""))) == [] and one(spark, X.tokens(F.lit(None).cast("string"))) is None
    assert one(spark, X.tokens_plain(F.lit("it's the dog!"))) == ["its", "dog"]
    assert one(spark, X.tokens_web(F.lit("see http://a.b/c <b>walking</b> dogs 12"))) == ["see", "walk", "dog"]


def test_negative_score(spark):
    got = one(spark, X.negative_score(F.lit(2 / 3), F.lit(2), F.lit(4 / 23), F.lit(2)))
    assert round(got, 6) == 3.307246
    assert one(spark, X.is_negative(F.lit(0.0), F.lit(1), F.lit(0.2), F.lit(2))) is True
    assert one(spark, X.is_negative(F.lit(0.1), F.lit(1), F.lit(0.3), F.lit(1))) is False
    assert round(one(spark, X.offensive_score(F.lit(0.1))), 6) == 0.142857


def test_normalising(spark):
    assert one(spark, X.squeeze_repeats(F.lit("  Sooooo   COOOOL!!!! "))) == "soo cool!!"
    assert one(spark, X.strip_tags(F.lit(" <b>kim</b> "))) == "kim"
    assert one(spark, X.expand_contractions(F.lit("I can't, they're"))) == "i cannot, they are"
    assert one(spark, X.occurrences(F.lit("aXaXa"), "X")) == 2
    assert one(spark, X.pattern_score(F.lit("what a loser, shut up"))) == 0.7
    assert one(spark, X.longest_run(F.array(*[F.lit(w) for w in ["a", "x", "x", "a", "x"]]), ["x"])) == 2


def test_lexicon_in_context(spark):
    def means(text):
        hits = X.lexicon_hits_in_context(X.tokens(F.lit(text), 1, []))
        return [round(one(spark, X.mean_of(hits, *n)), 6) for n in (["aggression"], ["negative", "turned"], ["positive"])]

    assert means("very stupid") == [1.2, 0.0, 0.0]
    assert means("not stupid") == [0.24, 0.0, 0.0]
    assert means("not very good") == [0.0, round(0.5 * 1.5 * 0.7, 6), 0.0]
    assert means("nothing here") == [0.0, 0.0, 0.0]


def test_times(spark):
    for text in ("2012-03-01T20:59:30Z", "2012-03-01 20:59:30", "2012/03/01 20:59:30", "2012-03-01T20:59:30.000000", " 2012-03-01T20:59:30Z "):
        assert one(spark, T.parse_time(F.lit(text))) == dt.datetime(2012, 3, 1, 20, 59, 30)
    for text in ("04.03.12, 18h", "", "soon", None):
        assert one(spark, T.parse_time(F.lit(text).cast("string"))) is None
    assert [one(spark, T.time_of_day(F.lit(h))) for h in (4, 5, 12, 17, 22)] == ["night", "morning", "afternoon", "evening", "night"]
    assert [one(spark, T.period_of_day(F.lit(h))) for h in (5, 6, 12, 18)] == ["night", "morning", "afternoon", "evening"]


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))
    assert one(spark, V.dot(a, b)) == 24 and round(one(spark, V.cosine(a, b)), 6) == 0.96 and round(one(spark, V.distance(a, b)), 6) == round(2**0.5, 6)
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "x double, y double")
    assert [tuple(r) for r in V.scale(df, ["x", "y"], V.scaling(df, ["x", "y"])).collect()] == [(0.0, 0.0), (1.0, 0.0), (None, 0.0)]


def test_scores(spark):
    assert [one(spark, F.round(scoring.user_risk(F.lit(n)), 6)) for n in (0, 2, 4, 8)] == [0.0, -0.6, -1.0, -1.8]
    assert [one(spark, users.level(F.lit(v))) for v in (0.7, 0.4, 0.1, 0.05)] == ["high", "medium", "low", "none"]
    s = spark.createDataFrame([(-0.5,), (-0.4,), (None,)], "v double")
    assert [tuple(r) for r in scoring.sweep(s, "v", [-0.45]).collect()] == [(-0.45, 1, 1, 0.5)]


def test_rule_scores(spark):
    import math

    assert round(one(spark, X.rule_aggression(F.lit("stupid idiot"), F.lit("stupid idiot"))), 6) == round(1 / (1 + math.exp(2 - 1.6)), 6)
    assert one(spark, X.rule_aggression(F.lit("  "), F.lit(""))) == 0
    assert round(one(spark, X.rule_toxicity(F.lit("i will hurt you"))), 6) == 1.0
    g = X.grammar_features(F.lit("No!! Go. aaaa bbb"))
    assert round(one(spark, g["exclamation"]), 6) == 1.0 and one(spark, g["short_sentences"]) == 0.3
    assert round(one(spark, g["repetition"]), 6) == 1.0
    assert one(spark, X.grammar_features(F.lit(""))["short_sentences"]) == 0.0


def test_moments_and_encoder(spark):
    from skeinwork.functions.encoders import encode_texts

    m = V.moments(F.array(F.lit(1.0), F.lit(2.0), F.lit(6.0)))
    assert round(one(spark, m["variance"]), 6) == round(14 / 3, 6) and one(spark, m["skewness"]) > 0
    df = spark.createDataFrame([("a", "some text"), ("b", None), ("c", ""), ("d", "some text")], "k string, t string")
    v = {r["k"]: r["vector"] for r in encode_texts(df, "k", "t").collect()}
    assert v["a"] == v["d"] and v["b"] == v["c"] and len(v["a"]) == 64
