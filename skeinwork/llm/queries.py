"""Queries of the training-data operators over the project's tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm import abuse, encoding, grouped_split, mixing, personal_info, set_join, shared_spans, terms


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def node_elements():
    """``subgraph.nodes`` as strings type:id; null ids drop out."""
    per_type = F.transform(F.map_entries("nodes"), lambda e: F.transform(F.coalesce(e["value"], F.array().cast("array<bigint>")), lambda i: F.concat(e["key"], F.lit(":"), i.cast("string"))))
    return F.flatten(F.coalesce(per_type, F.array().cast("array<array<string>>")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = set_join.similar_pairs(_read(spark, sf_dir, "subgraph"), "subgraph_id", node_elements())
    return pairs.select(F.col("record_a").alias("subgraph_a"), F.col("record_b").alias("subgraph_b"))


def p1_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each subgraph with its class of equal node sets and its number of links to other sets."""
    links = set_join.links_per_record(_read(spark, sf_dir, "subgraph"), "subgraph_id", node_elements())
    return links.select(F.col("record").alias("subgraph_id"), F.col("representative").alias("class_id"), "copies", "links")


def _scored(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    table = abuse.word_table(_read(spark, sf_dir, "offensive_words"), "word")
    model = abuse.fit(_read(spark, sf_dir, "abuse_samples"), "sample_id", "sample_text", "verdict", table)
    return abuse.score(_read(spark, sf_dir, "comment_nodes"), "comment_id", "comment_text", model, table, keep)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = _scored(spark, sf_dir).where(F.col("score") >= abuse.THRESHOLD)
    return flagged.where("comment_id IS NOT NULL").select("comment_id").distinct()


def p2_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every comment with its score."""
    return _scored(spark, sf_dir).where("comment_id IS NOT NULL").groupBy("comment_id").agg(F.max("score").alias("score"))


def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments, flagged comments and their rate for each post."""
    return abuse.rates(_scored(spark, sf_dir, "post_id"), "comment_id", "post_id")


def _term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _read(spark, sf_dir, "comment_nodes")
    counts = terms.term_counts(nodes, "comment_id", "comment_text")
    return terms.mark_terms(counts, terms.record_count(nodes, "comment_id"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _term_counts(spark, sf_dir).where("mark IS NOT NULL").select("term", "mark")


def p3_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term with its occurrences, records and mark."""
    return _term_counts(spark, sf_dir)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, items = personal_info.search(_read(spark, sf_dir, "comment_nodes"), "comment_id", "comment_text")
    return items.select(F.col("record").alias("comment_id"), "kind").distinct()


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every comment with its personal information replaced by placeholders."""
    return personal_info.redact(_read(spark, sf_dir, "comment_nodes"), "comment_id", "comment_text")


def session_number():
    """The number of the session a subgraph belongs to: by ``session_id``, else by ``subgraph_id``."""
    given = F.regexp_extract(F.coalesce("session_id", F.lit("")), r"(\d+)\D*$", 1)
    named = F.regexp_extract(F.coalesce("subgraph_id", F.lit("")), r"(?i)session\D?(\d+)", 1)
    return F.when(given != "", given).when(named != "", named).cast("bigint")


def _splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "subgraph").select("subgraph_id", session_number().alias("session_no"))
    return grouped_split.grouped_split(rows, "subgraph_id", ["session_no"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subgraphs with the session that their component stands for; null for one without a session."""
    number = F.regexp_extract("component", r"^k0\x1f(-?\d+)$", 1)
    return _splits(spark, sf_dir).select(F.col("record").alias("subgraph_id"), F.when(number != "", number).cast("bigint").alias("session_no"))


def p6_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each subgraph with its component and split."""
    return _splits(spark, sf_dir).select(F.col("record").alias("subgraph_id"), "component", "split")


def p6_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each split, whether its share of subgraphs is within two hundredths of the one asked for, and
    the components that are in another split as well."""
    splits = _splits(spark, sf_dir)
    torn = splits.groupBy("component").agg(F.min("split").alias("split"), F.max("split").alias("other")).where("split <> other")
    counts = splits.groupBy("split").agg(F.count("*").alias("n"))
    asked = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split string, asked double")
    all_of = counts.agg(F.sum("n").alias("total"))
    near = F.abs(F.coalesce("n", F.lit(0)) / F.col("total") - F.col("asked")) <= 0.02
    facts = asked.join(F.broadcast(counts), "split", "left").join(F.broadcast(all_of), how="cross")  # three rows, one row
    return facts.join(F.broadcast(torn.agg(F.count("*").alias("torn"))), how="cross").select("split", near.alias("near"), "torn")


def p6_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subgraphs with the least session of their component, where sessions that hold a subgraph of the
    very same nodes belong together too."""
    nodes = F.array_sort(F.array_compact(F.array_distinct(node_elements())))
    rows = _read(spark, sf_dir, "subgraph").select("subgraph_id", session_number().alias("session_no"), F.when(F.size(nodes) > 0, F.sha2(F.to_json(nodes), 256)).alias("node_set"))
    splits = grouped_split.grouped_split(rows, "subgraph_id", ["session_no", "node_set"])
    known = splits.join(rows.select(F.col("subgraph_id").alias("record"), "session_no"), "record")
    least = known.groupBy("component").agg(F.min("session_no").alias("least_session"))
    return splits.join(least, "component").select(F.col("record").alias("subgraph_id"), "least_session")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode(_read(spark, sf_dir, "documents"), "doc_id", "text")


def p7_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letters of documents with 2,048 ids in a row as one unsplit text, encoded by tree concatenation: its length,
    and whether the ids equal those of encoding it in one piece and decode to it."""
    documents = _read(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select(F.floor(F.col("doc_id") / 2048).alias("block"), "doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "").alias("letters"))
    joined = documents.groupBy("block").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "letters"))), lambda d: d["letters"])).alias("text"))  # at most 2,048 documents
    ids = encoding.encode(joined, "block", "text")
    source = encoding.tokenizer_source()

    @F.pandas_udf("boolean")
    def same(texts: pd.Series, found: pd.Series) -> pd.Series:
        tokenizer = encoding.load(source)
        return pd.Series([tokenizer.encode(t, add_special_tokens=False).ids == list(i) and tokenizer.decode(list(i)) == t for t, i in zip(texts, found)], dtype=bool)

    return joined.join(ids, "block").select("block", F.char_length("text").cast("bigint").alias("n_chars"), same("text", "ids").alias("exact"))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(_read(spark, sf_dir, "documents"), "doc_id", "text", "source", _read(spark, sf_dir, "mix_targets"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture: blocks of tokens by output shard and slot."""
    return _mix(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of tokens each source was to have and has."""
    return _mix(spark, sf_dir)[1]


def p8_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source asked for, whether its tokens are as near to its share of all as whole blocks allow, and its
    repeats within the limit.  A quota is rounded to a block, and the last block of a source may be short each use."""
    targets = _read(spark, sf_dir, "mix_targets")
    limit = targets.select(mixing.clean_source(F.col("source")).alias("source"), "max_repeats").groupBy("source").agg(F.max("max_repeats").alias("most"))
    shares = _mix(spark, sf_dir)[1]
    all_of = shares.agg(F.sum("tokens").alias("total"), F.sum("uses").alias("all_uses"))
    rows = shares.join(F.broadcast(limit), "source", "left").join(F.broadcast(all_of), how="cross")  # at most MAX_SOURCES rows, one row
    near = F.abs(F.col("tokens") - F.col("target_share") * F.col("total")) <= mixing.BLOCK * (2 + F.col("all_uses"))
    return rows.select("source", near.alias("near"), (F.col("uses") <= F.coalesce("most", F.lit(0))).alias("within"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.shared_chars(_read(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "shared_chars")


def p9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maximal shared stretches themselves: document, start and length in characters."""
    shared = shared_spans.shared_chars(_read(spark, sf_dir, "documents"), "doc_id", "text")
    return shared.select("doc_id", F.explode("spans").alias("s")).select("doc_id", F.col("s.start").alias("start"), F.col("s.length").alias("length"))


def p9_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p9_found, for passages of at least 200 characters."""
    return shared_spans.shared_chars(_read(spark, sf_dir, "documents"), "doc_id", "text", 200).select("doc_id", "shared_chars")


QUERIES = {
    "p1_found": p1_found,
    "p1_links": p1_links,
    "p2_found": p2_found,
    "p2_scores": p2_scores,
    "p2_rates": p2_rates,
    "p3_found": p3_found,
    "p3_terms": p3_terms,
    "p5_found": p5_found,
    "p5_redacted": p5_redacted,
    "p6_found": p6_found,
    "p6_splits": p6_splits,
    "p6_shares": p6_shares,
    "p6_linked": p6_linked,
    "p7_ids": p7_ids,
    "p7_joined": p7_joined,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p8_kept": p8_kept,
    "p9_found": p9_found,
    "p9_spans": p9_spans,
    "p9_long": p9_long,
}

_SETS = """
WITH els AS (
  SELECT DISTINCT subgraph_id AS s, e.k || ':' || unnest(e.v)::VARCHAR AS el
  FROM (SELECT subgraph_id, unnest(map_entries(nodes)) AS kv FROM subgraph WHERE subgraph_id IS NOT NULL) m,
       LATERAL (SELECT m.kv.key AS k, m.kv.value AS v) e),
full_els AS (SELECT * FROM els WHERE el IS NOT NULL),
sizes AS (SELECT s, count(*) AS n FROM full_els GROUP BY s),
common AS (SELECT a.s AS a, b.s AS b, count(*) AS c FROM full_els a JOIN full_els b ON a.el = b.el AND a.s < b.s GROUP BY 1, 2),
pairs AS (SELECT a, b FROM common JOIN sizes x ON x.s = a JOIN sizes y ON y.s = b WHERE 10 * c >= 7 * (x.n + y.n - c))
"""
_TERMS = r"""
WITH texts AS (SELECT DISTINCT comment_id, comment_text FROM comment_nodes WHERE comment_id IS NOT NULL),
found AS (SELECT comment_id, unnest(regexp_extract_all(lower(comment_text), '[\p{L}\p{N}_]{3,}')) AS term FROM texts),
counts AS (SELECT term, count(*) AS occurrences, count(DISTINCT comment_id) AS records FROM found GROUP BY term),
total AS (SELECT count(DISTINCT comment_id) AS n FROM comment_nodes),
marked AS (SELECT term, occurrences, records,
  CASE WHEN records < 5 THEN 'rare' WHEN records > n / 20.0 THEN 'common' END AS mark FROM counts, total)
"""


def _windows(span: int) -> str:
    return f"""
WITH d AS (SELECT doc_id, text FROM documents WHERE length(text) >= {span}),
w AS (SELECT doc_id, p, substr(text, p, {span}) AS w FROM (SELECT doc_id, text, unnest(range(1, length(text) - {span - 2})) AS p FROM d)),
many AS (SELECT w FROM w GROUP BY w HAVING min(doc_id) < max(doc_id))"""


def _shared(span: int) -> str:
    return f"""{_windows(span)},
hit AS (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS nxt FROM w WHERE w IN (SELECT w FROM many))
SELECT doc_id, sum(least({span}, coalesce(nxt - p, {span})))::BIGINT AS shared_chars FROM hit GROUP BY doc_id"""


SQL = {
    "p1_found": _SETS + "SELECT a AS subgraph_a, b AS subgraph_b FROM pairs",
    "p3_found": _TERMS + "SELECT term, mark FROM marked WHERE mark IS NOT NULL",
    "p3_terms": _TERMS + "SELECT term, occurrences, records, mark FROM marked",
    "p6_found": r"""
WITH n AS (SELECT subgraph_id, coalesce(nullif(regexp_extract(coalesce(session_id, ''), '(\d+)\D*$', 1), ''),
                                        nullif(regexp_extract(subgraph_id, '(?i)session\D?(\d+)', 1), ''))::BIGINT AS no
           FROM subgraph WHERE subgraph_id IS NOT NULL)
SELECT subgraph_id, min(no) AS session_no FROM n GROUP BY subgraph_id""",
    "p1_links": _SETS
    + """, kind AS (SELECT s, string_agg(el, '|' ORDER BY el) AS k FROM full_els GROUP BY s),
classes AS (SELECT k, min(s) AS class_id, count(*) AS copies FROM kind GROUP BY k),
sides AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
others AS (SELECT a, count(*) AS links FROM sides JOIN kind x ON x.s = a JOIN kind y ON y.s = b WHERE x.k <> y.k GROUP BY a)
SELECT kind.s AS subgraph_id, class_id, copies, coalesce(links, 0) AS links FROM kind JOIN classes USING (k) LEFT JOIN others ON a = kind.s""",
    "p6_shares": "SELECT unnest(['train', 'validation', 'test']) AS split, true AS near, 0::BIGINT AS torn",
    "p6_linked": r"""
WITH RECURSIVE row_of AS (SELECT row_number() OVER () AS i, subgraph_id AS s, nodes,
    coalesce(nullif(regexp_extract(coalesce(session_id, ''), '(\d+)\D*$', 1), ''), nullif(regexp_extract(subgraph_id, '(?i)session\D?(\d+)', 1), ''))::BIGINT AS no
  FROM subgraph WHERE subgraph_id IS NOT NULL),
els AS (SELECT DISTINCT i, e.k || ':' || unnest(e.v)::VARCHAR AS el
  FROM (SELECT i, unnest(map_entries(nodes)) AS kv FROM row_of) m, LATERAL (SELECT m.kv.key AS k, m.kv.value AS v) e),
sets AS (SELECT i, string_agg(el, '|' ORDER BY el) AS k FROM els WHERE el IS NOT NULL GROUP BY i),
keys AS (SELECT s, 'n' || no AS key FROM row_of WHERE no IS NOT NULL UNION SELECT s, 's' || k FROM row_of JOIN sets USING (i)),
near AS (SELECT DISTINCT a.key AS x, b.key AS y FROM keys a JOIN keys b USING (s)),
by_session AS (SELECT DISTINCT a.x AS p, b.y AS q FROM near a JOIN near b ON a.y = b.x WHERE a.x LIKE 'n%' AND b.y LIKE 'n%'),
reach(p, q) AS (SELECT p, q FROM by_session UNION SELECT r.p, e.q FROM reach r JOIN by_session e ON r.q = e.p)
SELECT keys.s AS subgraph_id, min(substr(q, 2)::BIGINT) AS least_session FROM keys JOIN reach ON p = key GROUP BY keys.s""",
    "p7_joined": "SELECT doc_id // 2048 AS block, sum(length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')))::BIGINT AS n_chars, true AS exact FROM documents GROUP BY 1",
    "p8_kept": "SELECT DISTINCT nullif(lower(trim(source)), '') AS source, true AS near, true AS within FROM mix_targets WHERE trim(source) <> ''",
    "p9_found": _shared(100),
    "p9_long": _shared(200),
    "p9_spans": _windows(100)
    + """, mark AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS opens FROM w WHERE w IN (SELECT w FROM many)),
part AS (SELECT doc_id, p, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM mark)
SELECT doc_id, min(p) - 1 AS start, max(p) - min(p) + 100 AS length FROM part GROUP BY doc_id, g""",
}
