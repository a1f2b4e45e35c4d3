from collections import Counter, defaultdict

import regex
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from skeinwork.llm import terms


def brute(rows):
    seen, occ, rec = set(), Counter(), defaultdict(set)
    for r, t in rows:
        if r is None or t is None or (r, t) in seen:
            continue
        seen.add((r, t))
        for w in regex.findall(terms.TERM, t.lower()):
            occ[w] += 1
            rec[w].add(r)
    return {w: (occ[w], len(rec[w])) for w in occ}


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "id string, text string")
    return {r["term"]: (r["occurrences"], r["records"]) for r in terms.term_counts(df, "id", "text", **options).collect()}


def test_dirt(spark):
    rows = [("1", "Foo foo bar_1 ab"), ("1", "Foo foo bar_1 ab"), ("1", "other foo"), ("2", None), ("3", ""), (None, "foo"), ("4", "x" * 200_000 + " foo"), ("5", "ÉCOLE école 日本語 １２３ a̋bc no-way"), ("6", "İstanbul")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == {}


def test_small_flushes(spark):
    rows = [(str(i % 7), f"alpha beta{i % 3} gamma gamma{i}") for i in range(60)]
    assert run(spark, rows, max_counters=2) == brute(rows)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.sampled_from("abc")), st.one_of(st.none(), st.text(st.sampled_from("aAbB ._é1"), max_size=30))), max_size=20))
def test_any_rows(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_marks(spark):
    counts = spark.createDataFrame([("rare", 9, 4), ("mid", 9, 5), ("edge", 50, 10), ("common", 50, 11)], "term string, occurrences long, records long")
    n = spark.createDataFrame([(200,)], "n long")
    assert {r["term"]: r["mark"] for r in terms.mark_terms(counts, n).collect()} == {"rare": "rare", "mid": None, "edge": None, "common": "common"}
    df = spark.createDataFrame([("1", "a"), ("1", "a"), ("2", None), (None, "b")], "id string, text string")
    assert terms.record_count(df, "id").first()["n"] == 2
