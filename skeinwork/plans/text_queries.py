"""Queries on comment text: statistics, vocabularies, lexicon scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.functions import lexicons as L
from skeinwork.functions import text as X
from skeinwork.operators import emotion
from skeinwork.plans import oracle_words as O
from skeinwork.plans.oracle_words import ATTACK
from skeinwork.plans.views import LABELS, NODES, VIDEOS, WORDS, nodes, post_labels, read, word_rows



def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = word_rows(spark, sf_dir).where("comment_text IS NOT NULL")
    hits = X.lexicon_hits(F.col("words"), L.ATTACK_WORDS)
    return w.select(
        "id", "comment_id", "post_id", "user_id", "comment_text", "words", F.size("words").alias("n_words"), hits.alias("hits"), X.ratio(hits, F.size("words")).alias("share"),
        X.upper_ratio(F.col("comment_text")).alias("upper"), X.count_matches(F.col("comment_text"), "!").alias("marks"),
    )


_MEASURED = rf"""WITH {NODES}, {WORDS},
m AS (SELECT id, comment_id, post_id, user_id, comment_text, words, len(words)::INT AS n_words, len(list_filter(words, lambda x: list_contains({ATTACK}, x)))::INT AS hits,
  length(regexp_replace(comment_text, '[^!]', '', 'g'))::INT AS marks,
  CASE WHEN length(comment_text) > 0 THEN length(regexp_replace(comment_text, {O.NO_CAPITALS}, '', 'g')) / length(comment_text) ELSE 0 END AS upper FROM w WHERE comment_text IS NOT NULL),
ms AS (SELECT *, CASE WHEN n_words > 0 THEN hits / n_words ELSE 0 END AS share FROM m)"""


def session_offensive_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per post: comments, words, attack words, their shares, capitals, and the post's label."""
    m = _measured(spark, sf_dir)
    posts = m.groupBy("post_id").agg(
        F.count("*").alias("comments"), F.sum("n_words").alias("words"), F.sum("hits").alias("attack_words"), F.round(F.avg("share"), 6).alias("mean_share"),
        F.round(F.max("share"), 6).alias("max_share"), F.round(F.avg("upper"), 6).alias("mean_upper"),
    )
    return posts.join(post_labels(spark, sf_dir), "post_id", "left")


def comment_text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("comment_text")
    rows = word_rows(spark, sf_dir).where("comment_text IS NOT NULL")
    unique = F.size(F.array_distinct("words"))
    return rows.select(
        "id", F.char_length(t).alias("chars"), F.size("words").alias("n_words"), X.count_matches(t, "!").alias("exclamations"), X.count_matches(t, r"\?").alias("questions"),
        X.special_count(t).alias("specials"), F.round(X.upper_ratio(t), 6).alias("upper"), F.round(X.ratio(unique, F.size("words")), 6).alias("unique_share"),
        F.round(X.ratio(F.aggregate("words", F.lit(0), lambda a, w: a + F.char_length(w)), F.size("words")), 6).alias("mean_length"),
    )


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_rows(spark, sf_dir).select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def vocabulary_top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 1,000 most frequent words: the word nodes of the graph."""
    return _vocabulary(spark, sf_dir).orderBy(F.col("n").desc(), "word").limit(1000)


def vocabulary_min_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocabulary(spark, sf_dir).where("n >= 5").select("word", "n", F.col("word").isin(L.ATTACK_WORDS).alias("is_attack"))


def offensive_table_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and comments of each single word of the table of offensive words."""
    listed = read(spark, sf_dir, "offensive_words").select(F.lower(F.trim("word")).alias("word")).where("word <> ''").distinct()
    each = word_rows(spark, sf_dir).select("id", F.explode("words").alias("word"))
    return each.join(listed, "word").groupBy("word").agg(F.count("*").alias("n"), F.count_distinct("id").alias("comments"))


def attack_word_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments with an attack word, and which."""
    m = _measured(spark, sf_dir).where("hits > 0")
    found = F.array_sort(F.array_distinct(F.filter("words", lambda w: w.isin(L.ATTACK_WORDS))))
    return m.select("id", "hits", F.concat_ws(",", found).alias("attack_words"))


def rule_negative_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _measured(spark, sf_dir)
    args = [F.col(c) for c in ("share", "hits", "upper", "marks")]
    return m.where(X.is_negative(*args)).select("id", "post_id", F.round(X.negative_score(*args), 6).alias("score"))


def negative_score_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 comments of greatest negativity: a top-k report."""
    return rule_negative_comments(spark, sf_dir).orderBy(F.col("score").desc(), "id").limit(100)


def lexicon_category_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nodes(spark, sf_dir).where("comment_text IS NOT NULL").select("id", F.lower("comment_text").alias("low"))
    return rows.select("id", *[X.category_hits(F.col("low"), words).cast("int").alias(c) for c, words in L.AGGRESSION.items()])


def pattern_aggression(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.regexp_replace("comment_text", r"\s+", " ")
    return nodes(spark, sf_dir).where("comment_text IS NOT NULL").select("id", X.pattern_score(t).alias("score")).where("score > 0")


def lexicon_emotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean strengths by class, with the words before each taken into account."""
    listed = F.array(*[F.lit(w) for d in L.STRENGTHS.values() for w in d])
    rows = nodes(spark, sf_dir).where("comment_text IS NOT NULL").select("id", X.tokens(F.col("comment_text"), 1, []).alias("words"))
    hits = rows.where(F.arrays_overlap("words", listed)).select("id", X.lexicon_hits_in_context(F.col("words")).alias("hits"))
    means = {"aggression": ["aggression"], "negative": ["negative", "turned"], "positive": ["positive"]}
    return hits.select("id", *[F.round(X.mean_of(F.col("hits"), *n), 6).alias(c) for c, n in means.items()]).where("aggression > 0 OR negative > 0 OR positive > 0")


def context_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density and longest run of aggressive words: min(1, 2 density + min(run / 3, 1) / 2)."""
    listed = list(L.STRENGTHS["aggression"])
    rows = word_rows(spark, sf_dir).where("size(words) > 0")
    run = X.longest_run(F.col("words"), listed)
    density = X.ratio(X.lexicon_hits(F.col("words"), listed), F.size("words"))
    return rows.select("id", run.alias("run"), F.round(F.least(F.lit(1.0), 2 * density + 0.5 * F.least(F.lit(1.0), run / 3)), 6).alias("score")).where("run > 0")


def squeezed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).select("id", X.squeeze_repeats(F.col("comment_text")).alias("text"), F.regexp_count("comment_text", F.lit(r"(.)\1{2,}")).alias("repeats"))


def clean_usernames(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = read(spark, sf_dir, "comments").where("userId IS NOT NULL").select("userId", X.strip_tags(F.col("username")).alias("username"))
    return users.groupBy("userId").agg(F.min("username").alias("username"), F.count("*").alias("rows"), F.count_distinct("username").alias("names"))


def emotion_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The composite emotion of every comment."""
    e = emotion.text_emotion(nodes(spark, sf_dir), "id", "comment_text")
    return e.select("id", *[F.round(c, 6).alias(c) for c in emotion.DEFAULTS])


def blended_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0.7 of a classifier's score and 0.3 of the rule's; the classifier's class shares are those of the composite emotion."""
    e = emotion.text_emotion(nodes(spark, sf_dir), "id", "comment_text", "comment_text").withColumn("low", X.squeeze_repeats(F.col("comment_text")))
    model = X.polarity_aggression(F.col("negative_norm"), F.col("positive_norm"))
    score = F.when(F.coalesce(F.trim("comment_text") == "", F.lit(True)), 0.0).otherwise(X.blended_aggression(model, X.rule_aggression(F.col("comment_text"), F.col("low"))))
    return e.select("id", F.round(score, 6).alias("score"))


def rule_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggression and toxicity by listed words that are present, and 0.6 and 0.4 of them."""
    n = nodes(spark, sf_dir).where("comment_text IS NOT NULL").select("id", "comment_text", F.lower("comment_text").alias("low"))
    n = n.select("id", X.present_aggression(F.col("comment_text"), F.col("low")).alias("a"), X.rule_toxicity(F.col("low")).alias("t"))
    return n.select("id", F.round("a", 6).alias("aggression"), F.round("t", 6).alias("toxicity"), F.round(0.6 * F.col("a") + 0.4 * F.col("t"), 9).alias("emotion"))


def relaxed_negative_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments with any attack word, or more than half capitals, or more than a twentieth attack words."""
    return _measured(spark, sf_dir).where("hits > 0 OR upper > 0.5 OR share > 0.05").select("id", "post_id")


def aggressive(measured: DataFrame) -> DataFrame:
    """Of measured comments those with attack words or of great length, with 2 share + any + capitals / 2."""
    long = F.char_length("comment_text")
    kept = measured.where((F.col("hits") > 0) | (F.col("share") > 0.01) | (long > 50) & (F.col("n_words") > 8) | (long > 80))
    return kept.withColumn("aggressiveness", 2 * F.col("share") + (F.col("hits") > 0).cast("int") + 0.5 * F.col("upper"))


def aggressive_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggressive(_measured(spark, sf_dir)).select("id", F.round("aggressiveness", 6).alias("aggressiveness"))


QUERIES = {
    f.__name__: f
    for f in (
        session_offensive_profile, comment_text_stats, vocabulary_top_words, vocabulary_min_freq, offensive_table_hits, attack_word_flags, rule_negative_comments, negative_score_topk,
        lexicon_category_hits, pattern_aggression, lexicon_emotion, context_runs, squeezed_texts, clean_usernames, emotion_scores, blended_scores,
        rule_presence, relaxed_negative_comments, aggressive_comments,
    )
}

_VOCABULARY = f"WITH {NODES}, {WORDS}, voc AS (SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM w) GROUP BY word)"
_NEGATIVE = _MEASURED + """, neg AS (SELECT id, post_id, round(3 * share + 2 * least(hits / 5, 1) + upper + 0.5 * least(marks / 3, 1), 6) AS score FROM ms
  WHERE share > 0.1 OR (hits >= 1 AND upper > 0.3) OR hits >= 2 OR (hits >= 1 AND marks >= 2))"""


_IN_CONTEXT = f"""t AS (SELECT id, i, ws[i] AS w, ws[i - 1] AS p1, CASE WHEN i > 2 THEN ws[i - 2] END AS p2 FROM (SELECT id, ws, unnest(range(1, len(ws) + 1)) AS i FROM b)),
p AS (SELECT id, w, CASE WHEN i > 1 THEN p1 END AS p1, p2 FROM t),
f AS (SELECT id, w, coalesce({O.INTENSIFIERS}[p1], {O.INTENSIFIERS}[p2], 1.0)::DOUBLE AS k,
  coalesce(list_contains({O.NEGATIONS}, p1), false) OR coalesce(list_contains({O.NEGATIONS}, p2), false) AS neg FROM p),
g AS (SELECT id, neg, {O.AGGRESSIVE}[w] * k AS ag, {O.NEGATIVE}[w] * k AS ng, {O.POSITIVE}[w] * k AS po FROM f),
h AS (SELECT id, CASE WHEN neg THEN ag * 0.3 ELSE ag END AS ag, CASE WHEN neg THEN ng * 0.3 ELSE ng END AS ng, CASE WHEN neg THEN po * 0.7 END AS turned, CASE WHEN NOT neg THEN po END AS po FROM g),
r AS (SELECT id, coalesce(avg(ag), 0) AS aggression, coalesce((coalesce(sum(ng), 0) + coalesce(sum(turned), 0)) / nullif(count(ng) + count(turned), 0), 0) AS negative, coalesce(avg(po), 0) AS positive FROM h GROUP BY id)"""
_EMOTION = rf"""WITH {NODES},
a AS (SELECT id, regexp_split_to_array(regexp_replace(lower(comment_text), '[^a-z0-9_\s]', ' ', 'g'), '\s+') AS raw FROM n WHERE comment_text IS NOT NULL),
b AS (SELECT id, list_filter(raw, lambda x: length(x) >= 1) AS ws FROM a), {_IN_CONTEXT}
SELECT id, round(aggression, 6) AS aggression, round(negative, 6) AS negative, round(positive, 6) AS positive FROM r WHERE aggression > 0 OR negative > 0 OR positive > 0"""
#: The composite score of every comment: ``em`` with id and the columns of an emotion.
COMPOSITE = rf"""q0 AS (SELECT id, comment_text AS o, lower(comment_text) AS t FROM n WHERE comment_text <> ''),
x0 AS (SELECT id, {O.EXPANDED} AS x FROM q0),
b AS (SELECT id, list_filter(string_split(trim(regexp_replace(regexp_replace(x, '[^\p{{L}}\p{{N}}_\s!?.]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda y: y <> '') AS ws FROM x0), {_IN_CONTEXT},
{O.runs('q0', 'o')},
gi AS (SELECT id, i - row_number() OVER (PARTITION BY id ORDER BY i) AS island FROM t WHERE w IN (SELECT unnest(map_keys({O.AGGRESSIVE})))),
gc AS (SELECT id, sum(c) AS total, max(c) AS longest FROM (SELECT id, island, count(*) AS c FROM gi GROUP BY id, island) GROUP BY id),
ps AS (SELECT id, o, {O.PATTERNS} AS pattern, list_filter(list_transform(regexp_split_to_array(o, '[.!?]+'), lambda y: trim(regexp_replace(y, '\s+', ' ', 'g'))), lambda y: y <> '') AS ss FROM q0),
gr AS (SELECT id, pattern, 0.1 * least(1.0, length(regexp_replace(o, '[^\p{{Lu}}]', '', 'g')) / length(o) * 3) + 0.05 * least(1.0, length(regexp_replace(o, '[^!]', '', 'g')) / length(o) * 50)
    + 0.05 * least(1.0, coalesce(repeats, 0) / length(o) * 20) + 0.1 * CASE WHEN len(ss) > 0 AND list_sum(list_transform(ss, lambda y: len(string_split(y, ' ')))) / len(ss) < 3 THEN 0.3 ELSE 0 END AS grammar
  FROM ps LEFT JOIN sq USING (id)),
cx AS (SELECT id, coalesce(aggression, 0) AS a, coalesce(negative, 0) AS g, coalesce(positive, 0) AS p, grammar, pattern, CASE WHEN len(ws) > 0 THEN least(1.0, 2 * (coalesce(total, 0) / len(ws)) + 0.5 * least(1.0, coalesce(longest, 0) / 3)) ELSE 0 END AS ctx
  FROM b JOIN gr USING (id) LEFT JOIN r USING (id) LEFT JOIN gc USING (id)),
cy AS (SELECT id, least(1.0, a) AS a, least(1.0, g) AS g, least(1.0, p) AS p, greatest(0.0, least(1.0, 0.4 * a + 0.2 * g + grammar + 0.1 * pattern + 0.1 * ctx)) AS s FROM cx),
em AS (SELECT id, a AS aggression, g AS negative, p AS positive, s AS aggression_score, p / (p + a + g + greatest(0.0, 1 - p - a - g)) AS positive_norm, (a + g) / (p + a + g + greatest(0.0, 1 - p - a - g)) AS negative_norm,
    greatest(0.0, 1 - p - a - g) / (p + a + g + greatest(0.0, 1 - p - a - g)) AS neutral_norm FROM cy
  UNION ALL SELECT id, 0.0, 0.2, 0.1, 0.1, 0.1, 0.3, 0.6 FROM n WHERE comment_text IS NULL OR comment_text = '')"""

_UPPER = r"(CASE WHEN length(o) > 0 THEN length(regexp_replace(o, '[^\p{Lu}]', '', 'g')) / length(o) ELSE 0 END)"
_WEIGHTED_HITS = f"0.8 * {O.hits(O.INSULTS)} + 1.0 * {O.hits(O.THREATS)} + 0.6 * {O.hits(O.PROFANITY)} + 0.9 * {O.hits(O.DISCRIMINATION)} + 0.5 * {O.hits(O.MOCKERY)}"
#: The rule score of every comment: ``ru`` with id and rule.
_RULE = rf"""lo AS (SELECT id, comment_text AS o, regexp_replace(trim(lower(comment_text)), '\s+', ' ', 'g') AS z FROM n WHERE comment_text IS NOT NULL),
{O.runs('lo', 'z').replace('ch AS', 'ch3 AS').replace('FROM ch)', 'FROM ch3)').replace('rn AS', 'rn3 AS').replace('FROM rn GROUP', 'FROM rn3 GROUP').replace('sq AS', 'sq3 AS')},
{O.runs('lo', 'o').replace('ch AS', 'ch4 AS').replace('FROM ch)', 'FROM ch4)').replace('rn AS', 'rn4 AS').replace('FROM rn GROUP', 'FROM rn4 GROUP').replace('sq AS', 'sq4 AS')},
ro AS (SELECT lo.id, o, coalesce(sq3.s, '') AS t, coalesce(sq4.repeats, 0) AS rp FROM lo LEFT JOIN sq3 USING (id) LEFT JOIN sq4 USING (id)),
rs AS (SELECT id, t, len(string_split(t, ' ')) AS n, ({_WEIGHTED_HITS}) * (1 + 0.2 * {O.present(O.RULE_NEGATIONS)}) * (1 + 0.3 * {O.present(O.RULE_INTENSIFIERS)}) * (CASE WHEN {_UPPER} > 0.3 THEN 1.2 ELSE 1.0 END)
  * (1 + 0.1 * length(regexp_replace(o, '[^!]', '', 'g'))) * (CASE WHEN length(regexp_replace(o, '[^?]', '', 'g')) > 1 THEN 1 + 0.05 * length(regexp_replace(o, '[^?]', '', 'g')) ELSE 1.0 END) * (1 + 0.1 * rp) AS s FROM ro),
ru AS (SELECT id, CASE WHEN t = '' THEN 0 ELSE 1 / (1 + exp(2 - s * (CASE WHEN n > 20 THEN 20.0 / n ELSE 1.0 END))) END AS rule FROM rs)"""
SQL = {
    "session_offensive_profile": _MEASURED + f""", {VIDEOS}, {LABELS},
p AS (SELECT post_id, count(*) AS comments, sum(n_words)::BIGINT AS words, sum(hits)::BIGINT AS attack_words, round(avg(share), 6) AS mean_share, round(max(share), 6) AS max_share,
  round(avg(upper), 6) AS mean_upper FROM ms GROUP BY post_id)
SELECT p.*, pl.label FROM p LEFT JOIN pl ON pl.post_id = p.post_id""",
    "comment_text_stats": rf"""WITH {NODES}, {WORDS}
SELECT id, length(comment_text)::INT AS chars, len(words)::INT AS n_words, length(regexp_replace(comment_text, '[^!]', '', 'g'))::INT AS exclamations,
  length(regexp_replace(comment_text, '[^?]', '', 'g'))::INT AS questions, length(regexp_replace(comment_text, '[^!@#$%^&*(),.?":{{}}|<>]', '', 'g'))::INT AS specials,
  round(CASE WHEN length(comment_text) > 0 THEN length(regexp_replace(comment_text, {O.NO_CAPITALS}, '', 'g')) / length(comment_text) ELSE 0 END, 6) AS upper,
  round(CASE WHEN len(words) > 0 THEN len(list_distinct(words)) / len(words) ELSE 0 END, 6) AS unique_share,
  round(CASE WHEN len(words) > 0 THEN list_sum(list_transform(words, lambda x: length(x))) / len(words) ELSE 0 END, 6) AS mean_length
FROM w WHERE comment_text IS NOT NULL""",
    "vocabulary_top_words": _VOCABULARY + " SELECT word, n FROM voc ORDER BY n DESC, word LIMIT 1000",
    "vocabulary_min_freq": _VOCABULARY + f" SELECT word, n, list_contains({ATTACK}, word) AS is_attack FROM voc WHERE n >= 5",
    "offensive_table_hits": f"""WITH {NODES}, {WORDS}, t AS (SELECT DISTINCT lower(trim(word)) AS word FROM offensive_words WHERE trim(word) <> ''),
e AS (SELECT id, unnest(words) AS word FROM w)
SELECT e.word, count(*) AS n, count(DISTINCT id) AS comments FROM e JOIN t ON t.word = e.word GROUP BY e.word""",
    "attack_word_flags": _MEASURED + f" SELECT id, hits, array_to_string(list_sort(list_distinct(list_filter(words, lambda x: list_contains({ATTACK}, x)))), ',') AS attack_words FROM ms WHERE hits > 0",
    "rule_negative_comments": _NEGATIVE + " SELECT id, post_id, score FROM neg",
    "negative_score_topk": _NEGATIVE + " SELECT id, post_id, score FROM neg ORDER BY score DESC, id LIMIT 100",
    "lexicon_category_hits": f"WITH {NODES}, t AS (SELECT id, lower(comment_text) AS t FROM n WHERE comment_text IS NOT NULL) SELECT id, " + ", ".join(f"({O.hits(w)})::INT AS {c}" for c, w in (("insults", O.INSULTS), ("threats", O.THREATS), ("profanity", O.PROFANITY), ("discrimination", O.DISCRIMINATION), ("mockery", O.MOCKERY))) + " FROM t",
    "pattern_aggression": f"WITH {NODES}, t AS (SELECT id, lower(regexp_replace(comment_text, '\\s+', ' ', 'g')) AS t FROM n WHERE comment_text IS NOT NULL), r AS (SELECT id, {O.PATTERNS} AS score FROM t) SELECT * FROM r WHERE score > 0",
    "lexicon_emotion": _EMOTION,
    "context_runs": f"""WITH {NODES}, {WORDS},
t AS (SELECT id, len(words) AS n, i, words[i] IN (SELECT unnest(map_keys({O.AGGRESSIVE}))) AS hit FROM (SELECT id, words, unnest(range(1, len(words) + 1)) AS i FROM w WHERE len(words) > 0)),
g AS (SELECT *, i - row_number() OVER (PARTITION BY id ORDER BY i) AS island FROM t WHERE hit),
r AS (SELECT id, any_value(n) AS n, island, count(*) AS c FROM g GROUP BY id, island)
SELECT id, max(c)::INT AS run, round(least(1.0, 2 * (sum(c) / any_value(n)) + 0.5 * least(1.0, max(c) / 3)), 6) AS score FROM r GROUP BY id""",
    "squeezed_texts": rf"""WITH {NODES}, p AS (SELECT id, comment_text AS o, regexp_replace(trim(lower(comment_text)), '\s+', ' ', 'g') AS t FROM n),
{O.runs('p', 't')}, raw AS (SELECT id, 0 AS z FROM p),
{O.runs('p', 'o').replace('ch AS', 'ch2 AS').replace('FROM ch)', 'FROM ch2)').replace('rn AS', 'rn2 AS').replace('FROM rn GROUP', 'FROM rn2 GROUP').replace('sq AS', 'sq2 AS')}
SELECT p.id, CASE WHEN p.o IS NULL THEN NULL ELSE coalesce(sq.s, '') END AS text, CASE WHEN p.o IS NULL THEN NULL ELSE coalesce(sq2.repeats, 0) END::INT AS repeats FROM p LEFT JOIN sq USING (id) LEFT JOIN sq2 USING (id)""",
    "emotion_scores": f"WITH {NODES}, {COMPOSITE} SELECT id, " + ", ".join(f"round({c}, 6) AS {c}" for c in emotion.DEFAULTS) + " FROM em",
    "blended_scores": f"WITH {NODES}, {COMPOSITE}, {_RULE} SELECT id, round(CASE WHEN n.comment_text IS NULL OR trim(n.comment_text) = '' THEN 0 ELSE 0.7 * greatest(0.0, least(1.0, (negative_norm - positive_norm + 1) / 2)) + 0.3 * rule END, 6) AS score FROM em JOIN n USING (id) LEFT JOIN ru USING (id)",
    "rule_presence": f"""WITH {NODES}, q AS (SELECT id, comment_text AS o, lower(comment_text) AS t FROM n WHERE comment_text IS NOT NULL), {O.runs('q', 't')},
f AS (SELECT q.id, {O.present(O.PRESENT_INSULTS)} AS a, {O.present(O.PRESENT_THREATS)} AS b, {O.present(O.PRESENT_PROFANITY)} AS c, {O.present(O.PRESENT_DISCRIMINATION)} AS d, {O.present(O.PRESENT_MOCKERY)} AS e,
  least(1.0, 0.1 * length(regexp_replace(o, '[^!]', '', 'g')) + 0.5 * {_UPPER}) AS g, least(0.3, 0.1 * coalesce(repeats, 0)) AS r, {O.THREAT_PATTERNS} AS th FROM q LEFT JOIN sq USING (id)),
s AS (SELECT id, least(1.0, least(1.0, 0.3 * (a + b + c + d + e)) + least(1.0, 0.2 * ((a > 0)::INT + (b > 0)::INT + (c > 0)::INT + (d > 0)::INT + (e > 0)::INT)) + g + r)::DOUBLE AS aggression, least(1.0, 0.4 * (b + c + d) + 0.6 * th)::DOUBLE AS toxicity FROM f)
SELECT id, round(aggression, 6) AS aggression, round(toxicity, 6) AS toxicity, round(0.6 * aggression + 0.4 * toxicity, 9) AS emotion FROM s""",
    "relaxed_negative_comments": _MEASURED + " SELECT id, post_id FROM ms WHERE hits > 0 OR upper > 0.5 OR share > 0.05",
    "aggressive_comments": _MEASURED + " SELECT id, round(2 * share + (hits > 0)::INT + 0.5 * upper, 6) AS aggressiveness FROM ms WHERE hits > 0 OR share > 0.01 OR (length(comment_text) > 50 AND n_words > 8) OR length(comment_text) > 80",
    "clean_usernames": """WITH u AS (SELECT userId, trim(regexp_replace(username, '<[^>]+>', '', 'g')) AS username FROM comments WHERE userId IS NOT NULL)
SELECT userId, min(username) AS username, count(*) AS rows, count(DISTINCT username) AS names FROM u GROUP BY userId""",
}
