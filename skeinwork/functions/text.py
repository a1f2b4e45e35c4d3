"""Scalar functions on text, as expressions of built-ins.  Null text gives null, or the stated default."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from skeinwork.functions import lexicons as L


def tokens(text: Column, min_length: int = 3, stop_words: list[str] | None = None) -> Column:
    """Lower-cased words: every character but letters a-z, digits, '_' and blanks separates."""
    stop = L.STOP_WORDS if stop_words is None else stop_words
    words = F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9_\s]", " "), r"\s+")
    return F.filter(words, lambda w: (F.char_length(w) >= min_length) & ~w.isin(stop))


def tokens_plain(text: Column, min_length: int = 2, stop_words: list[str] | None = None) -> Column:
    """Lower-cased words split at blanks, with ASCII punctuation removed rather than replaced."""
    stop = L.STOP_WORDS if stop_words is None else stop_words
    words = F.split(F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", ""), r"\s+")
    return F.filter(words, lambda w: (F.char_length(w) >= min_length) & ~w.isin(stop))


def tokens_web(text: Column, stop_words: list[str] | None = None) -> Column:
    """Words without URLs, tags and pure numbers, in light stems (plural, -ing, -ed)."""
    stop = L.STOP_WORDS if stop_words is None else stop_words
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), r"https?://\S+|www\.\S+", " "), r"<[^>]+>", " ")
    words = F.filter(F.split(F.regexp_replace(plain, r"[^a-z0-9_\s]", " "), r"\s+"), lambda w: (w != "") & ~w.isin(stop) & ~w.rlike(r"^[0-9]+$"))
    return F.transform(words, lambda w: F.regexp_replace(w, r"(?<=[a-z]{3})(?:ing|ed|es|s)$", ""))


def counted(words: Column) -> Column:
    """Distinct words of an array with their number there, ``word, n``, from the runs of the sorted array."""

    def runs(ws: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(ws)), lambda i: (i < F.size(ws)) & ((i == 0) | (F.get(ws, i) != F.get(ws, i - 1))))
        ends = lambda at: F.transform(at, lambda s, j: F.struct(F.get(ws, s).alias("word"), (F.coalesce(F.get(at, j + 1), F.size(ws)) - s).cast("bigint").alias("n")))
        return F.get(F.transform(F.array(starts), ends), F.lit(0))

    return F.get(F.transform(F.array(F.array_sort(words)), runs), F.lit(0))  # an array within an array is sorted once


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def upper_ratio(text: Column) -> Column:
    """Capitals over all characters; 0 for empty text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\p{Lu}")) / F.nullif(F.char_length(text), F.lit(0)), F.lit(0.0))


def special_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r'[!@#$%^&*(),.?":{}|<>]'))


def squeeze_repeats(text: Column) -> Column:
    """Lower case, single blanks, and at most two equal characters in a row."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(text)), r"\s+", " "), r"(?d)(.)\1{2,}", "$1$1")


def strip_tags(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"<[^>]+>", ""))


def expand_contractions(text: Column) -> Column:
    return reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), L.CONTRACTIONS.items(), F.lower(text))


def lexicon_hits(words: Column, lexicon: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(lexicon)))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where there is nothing to divide by."""
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def offensive_score(share: Column) -> Column:
    return F.least(F.lit(1.0), share / 0.7)


def occurrences(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of a substring."""
    return (F.char_length(text) - F.char_length(F.replace(text, F.lit(word)))) / len(word)


def category_hits(text: Column, words: list[str]) -> Column:
    """Occurrences of all listed words.  The list is an array, not a chain of expressions: generated code
    stays small for long lists.  ``text`` should be a plain column, as it is looked at once a word."""
    each = lambda a, w: a + (F.char_length(text) - F.char_length(F.replace(text, w))) / F.char_length(w)
    return F.aggregate(F.array(*[F.lit(w) for w in words]), F.lit(0.0), each)


def pattern_score(text: Column, patterns: list[tuple[str, float]] | None = None) -> Column:
    """The greatest score among the patterns found; 0 if none is."""
    low = F.lower(text)
    return F.greatest(*[F.when(low.rlike(p), F.lit(s)).otherwise(F.lit(0.0)) for p, s in (patterns or L.PATTERNS)], F.lit(0.0))


def lexicon_hits_in_context(words: Column, strengths: dict[str, dict[str, float]] | None = None) -> Column:
    """array<struct<aggression, negative, turned, positive>>: the strengths of each listed word.

    The one or two words before decide: an intensifier multiplies; a negation takes 0.3 of a negative or
    aggressive word and turns 0.7 of a positive one negative.  The nearer word counts first.
    """
    table = strengths or L.STRENGTHS
    listed = sorted({w for d in table.values() for w in d})
    maps = {c: F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) for c, d in table.items()}
    boost = F.create_map(*[F.lit(x) for kv in L.INTENSIFIERS.items() for x in kv])
    before = lambda i, k: F.coalesce(F.when(i >= k, F.get(words, i - k)), F.lit(""))
    placed = F.transform(words, lambda w, i: F.struct(w.alias("w"), before(i, 1).alias("p"), before(i, 2).alias("q")))
    found = F.filter(placed, lambda t: t["w"].isin(listed))

    def scored(t):
        factor = F.coalesce(F.element_at(boost, t["p"]), F.element_at(boost, t["q"]), F.lit(1.0))
        negated = t["p"].isin(L.NEGATIONS) | t["q"].isin(L.NEGATIONS)
        s = {c: F.element_at(maps[c], t["w"]) * factor for c in maps}
        return F.struct(
            F.when(negated, s["aggression"] * 0.3).otherwise(s["aggression"]).alias("aggression"),
            F.when(negated, s["negative"] * 0.3).otherwise(s["negative"]).alias("negative"),
            F.when(negated, s["positive"] * 0.7).alias("turned"),
            F.when(~negated, s["positive"]).alias("positive"),
        )

    return F.transform(found, scored)


def mean_of(hits: Column, *names: str) -> Column:
    """Mean of the named strengths over the hits that have them; 0 without any."""
    values = F.filter(F.flatten(F.transform(hits, lambda e: F.array(*[e[n] for n in names]))), lambda v: v.isNotNull())
    return F.coalesce(F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(values), F.lit(0)), F.lit(0.0))


def longest_run(words: Column, lexicon: list[str]) -> Column:
    """Greatest number of listed words in a row."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(acc, w):
        now = F.when(w.isin(lexicon), acc["now"] + 1).otherwise(F.lit(0))
        return F.struct(now.alias("now"), F.greatest(acc["best"], now).alias("best"))

    return F.aggregate(words, start, step, lambda acc: acc["best"])


def negative_score(share: Column, hits: Column, upper: Column, marks: Column) -> Column:
    """3 share + 2 min(hits/5, 1) + upper + min(marks/3, 1) / 2."""
    return 3 * share + 2 * F.least(hits / 5, F.lit(1.0)) + upper + 0.5 * F.least(marks / 3, F.lit(1.0))


def is_negative(share: Column, hits: Column, upper: Column, marks: Column) -> Column:
    return (share > 0.1) | ((hits >= 1) & (upper > 0.3)) | (hits >= 2) | ((hits >= 1) & (marks >= 2))


# Weight of each category of aggressive words.
CATEGORY_WEIGHTS = {"insults": 0.8, "threats": 1.0, "profanity": 0.6, "discrimination": 0.9, "mockery": 0.5}


def words_present(text: Column, words: list[str]) -> Column:
    """How many of the listed words occur anywhere in the text."""
    return F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w)))


def plain_lower(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(text)), r"\s+", " ")


def repeats(text: Column) -> Column:
    """Runs of three and more equal characters of a line."""
    return F.regexp_count(text, F.lit(r"(?d)(.)\1{2,}"))


def rule_aggression(text: Column, low: Column) -> Column:
    """Weighted word hits, raised by negations, intensifiers, capitals, marks and repeated characters, damped
    for long texts, through 1 / (1 + exp(2 - x)); 0 for blank text.  ``low`` is the column of
    :func:`squeeze_repeats`."""
    n = F.size(F.split(low, " "))
    hits = reduce(lambda a, b: a + b, [category_hits(low, w) * CATEGORY_WEIGHTS[c] for c, w in L.AGGRESSION.items()])
    marks, questions = count_matches(text, "!"), count_matches(text, r"\?")
    raised = hits * (1 + 0.2 * words_present(low, L.RULE_NEGATIONS)) * (1 + 0.3 * words_present(low, L.RULE_INTENSIFIERS))
    raised = raised * F.when(upper_ratio(text) > 0.3, 1.2).otherwise(1.0) * (1 + 0.1 * marks) * F.when(questions > 1, 1 + 0.05 * questions).otherwise(1.0) * (1 + 0.1 * repeats(text))
    damped = raised * F.when(n > 20, 20.0 / n).otherwise(1.0)
    return F.when(low == "", 0.0).otherwise(1 / (1 + F.exp(2 - damped)))


def present_aggression(text: Column, low: Column) -> Column:
    """Aggression by listed words that are present: 0.3 a word and 0.2 a category, each at most 1, marks and
    capitals, and repeated characters at most 0.3; at most 1 in all.  ``low`` is the lower-case text."""
    found = [words_present(low, w) for w in L.PRESENT.values()]
    words = reduce(lambda a, b: a + b, found)
    categories = reduce(lambda a, b: a + b, [(n > 0).cast("int") for n in found])
    capped = lambda x, top=1.0: F.least(x, F.lit(top))
    grammar = capped(0.1 * count_matches(text, "!") + 0.5 * upper_ratio(text))
    return capped(capped(0.3 * words) + capped(0.2 * categories) + grammar + capped(0.1 * repeats(low), 0.3))


def polarity_aggression(negative: Column, positive: Column) -> Column:
    """(negative - positive + 1) / 2 of a classifier's class shares, within [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (negative - positive + 1) / 2))


def blended_aggression(model: Column | None, rule: Column) -> Column:
    """0.7 of a model's score and 0.3 of the rule's; the rule's alone without a model, or where it has none."""
    return rule if model is None else F.coalesce(0.7 * model + 0.3 * rule, rule)


# Fixed values.
THREAT_PATTERNS = ["(kill|die|death|hurt|harm).*you", "you.*should.*(die|kill)", "go.*kill.*yourself", "i.*will.*(kill|hurt|destroy)"]


def rule_toxicity(low: Column) -> Column:
    """min(1, 0.4 toxic words present + 0.6 threat patterns found) of lower-case text."""
    threats = reduce(lambda a, b: a + b, [low.rlike(p).cast("int") for p in THREAT_PATTERNS])
    return F.least(F.lit(1.0), 0.4 * words_present(low, L.PRESENT["profanity"] + L.PRESENT["threats"] + L.PRESENT["discrimination"]) + 0.6 * threats)


def grammar_features(text: Column) -> dict[str, Column]:
    """Intensities of capitals, marks and repeats for the length, and whether sentences are very short."""
    size = F.nullif(F.char_length(text), F.lit(0))
    per = lambda n, k: F.when(size > 0, F.least(F.lit(1.0), n / size * k)).otherwise(0.0)
    sentences = F.filter(F.split(text, r"[.!?]+"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")) != "")
    words = F.aggregate(sentences, F.lit(0), lambda a, s: a + F.size(F.split(F.trim(F.regexp_replace(s, r"\s+", " ")), " ")))
    return {
        "uppercase": F.least(F.lit(1.0), upper_ratio(text) * 3), "exclamation": per(count_matches(text, "!"), 50), "question": per(count_matches(text, r"\?"), 50),
        "repetition": per(repeats(text), 20), "short_sentences": F.when(words / F.nullif(F.size(sentences), F.lit(0)) < 3, 0.3).otherwise(0.0),
    }
