"""Mixing of sources to target shares of tokens, with a capped number of repeats.

Method
    1. The tokens of each source are laid end to end, in an order drawn from a hash of the document,
       and packed into blocks of ``block`` tokens (the last of a source may be shorter).  Offsets come
       from prefix sums in two levels, hash buckets and documents within one, so a source with a third
       of all documents is no single task.
    2. The mix has as many blocks as the scarcest source allows.  For each output shard the counts of
       the sources are drawn from a multinomial over what is still to be placed, so the drawn counts
       sum up to the target shares exactly.  The draws come in two levels: the driver draws for groups
       of shards, of bounded number, and the tasks draw for the shards of each group.
    3. The n-th slot of a source takes block ``permutation(n mod blocks)`` of its pass ``n div blocks``;
       each pass has its own pseudorandom permutation of the indexes, so a block, and with it every
       document, is used once a pass and at most ``max_repeats`` times.
    4. Slots and blocks are joined by source and index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.llm.encoding import encode
from skeinwork.storage import Stash, spread

BLOCK = 512
#: Groups of shards, and numbers (groups times sources), that the driver draws at most.
GROUPS, DRAWN = 4096, 200_000
SHARD_BLOCKS = 256
MAX_SOURCES = 10_000
BUCKET_DOCS = 20_000


def clean_source(column):
    """Case and outer blanks of a source's name don't matter; an empty name is none."""
    name = F.lower(F.trim(column))
    return F.when(name != "", name)


def pack(tokens: DataFrame, block: int, stash: Stash) -> DataFrame:
    """``source, block, doc_ids, ids`` from rows ``doc, source, ids`` (one for each document)."""
    spark = tokens.sparkSession
    rows = tokens.where("source IS NOT NULL AND size(ids) > 0").select("doc", "source", F.size("ids").cast("bigint").alias("n"), "ids")
    docs = rows.count()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs // BUCKET_DOCS + 1)
    placed = rows.withColumn("h", F.xxhash64("doc", F.lit("order"))).withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets)))
    sizes = placed.groupBy("source", "bucket").agg(F.sum("n").alias("size"))
    starts = sizes.select("source", "bucket", (F.sum("size").over(Window.partitionBy("source").orderBy("bucket")) - F.col("size")).alias("start"))
    within = Window.partitionBy("source", "bucket").orderBy("h", "doc")
    local = placed.withColumn("before", F.sum("n").over(within) - F.col("n"))
    at = local.join(starts, ["source", "bucket"]).withColumn("at", F.col("start") + F.col("before"))
    first, last = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("n") - 1) / block)
    parts = at.select("doc", "source", "at", "n", "ids", F.explode(F.sequence(first, last)).alias("block"))
    skip = F.greatest(F.lit(0).cast("bigint"), F.col("block") * block - F.col("at"))
    upto = F.least(F.col("n"), (F.col("block") + 1) * block - F.col("at"))
    parts = parts.select("source", "block", "at", "doc", F.slice("ids", (skip + 1).cast("int"), (upto - skip).cast("int")).alias("part"))
    packed = parts.groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("at", "doc", "part"))).alias("parts"))  # at most `block` tokens
    return stash.put(packed.select("source", "block", F.col("parts.doc").alias("doc_ids"), F.flatten("parts.part").alias("ids")))


def quotas(weights: dict[str, float], blocks: dict[str, int], repeats: dict[str, int], total: int | None = None) -> dict[str, int]:
    """Blocks of each source: shares of those sources that have any, by largest remainders."""
    live = {s: w for s, w in weights.items() if w > 0 and blocks.get(s, 0) > 0 and repeats[s] > 0}
    whole = sum(live.values())
    if not live:
        return {}
    room = {s: blocks[s] * repeats[s] for s in live}
    most = min(int(room[s] * whole / w) for s, w in live.items())
    size = most if total is None else total
    exact = {s: size * w / whole for s, w in live.items()}
    got = {s: min(room[s], int(e)) for s, e in exact.items()}
    for s in sorted(live, key=lambda s: (int(exact[s]) - exact[s], s)):
        if sum(got.values()) >= size:
            break
        if got[s] < room[s]:
            got[s] += 1
    return got


def draw_shards(quota: dict[str, int], shard_blocks: int, seed: int) -> list[tuple[int, str, int, int]]:
    """(shard, source, first slot, slots): multinomial draws over what is left, shard by shard."""
    names = sorted(quota)
    left = np.array([quota[n] for n in names], dtype=np.int64)
    rng, done, out = np.random.default_rng(seed), np.zeros(len(names), dtype=np.int64), []
    for shard in range(-(-int(left.sum()) // shard_blocks)):
        want = min(shard_blocks, int(left.sum()))
        counts = np.zeros(len(names), dtype=np.int64)
        while want:
            drawn = np.minimum(rng.multinomial(want, left / left.sum()), left)
            counts, left, want = counts + drawn, left - drawn, want - int(drawn.sum())
        out += [(shard, n, int(d), int(c)) for n, d, c in zip(names, done, counts) if c]
        done += counts
    return out


def draw_groups(quota: dict[str, int], shard_blocks: int, seed: int) -> list[tuple[int, int, list[str], list[int], list[int]]]:
    """(group, its first shard, sources, first slots, slots): whole numbers of shards, so many that DRAWN holds."""
    shards = -(-sum(quota.values()) // shard_blocks)
    width = -(-shards // max(1, min(GROUPS, DRAWN // max(1, len(quota))))) or 1
    groups: dict[int, list[tuple[str, int, int]]] = {}
    for group, name, first, n in draw_shards(quota, width * shard_blocks, seed):
        groups.setdefault(group, []).append((name, first, n))
    return [(g, g * width, [n for n, _, _ in rows], [f for _, f, _ in rows], [c for _, _, c in rows]) for g, rows in groups.items()]


def _draw_within(shard_blocks: int, seed: int, blocks: dict[str, int]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for group, shard, names, firsts, counts in frame.itertuples(index=False):
                start = dict(zip(names, (int(f) for f in firsts)))
                drawn = draw_shards(dict(zip(names, (int(c) for c in counts))), shard_blocks, seed * 1_000_003 + group + 1)
                for at in range(0, len(drawn), 10_000):
                    yield pd.DataFrame([(shard + s, n, start[n] + first, c, blocks[n]) for s, n, first, c in drawn[at : at + 10_000]], columns=["shard", "source", "first", "n", "blocks"])

    return run


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of range(size) for each key: four Feistel rounds with cycle walking."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, size, key = index.astype(np.uint64), size.astype(np.uint64), key.astype(np.int64).view(np.uint64)
    todo = np.ones(len(x), dtype=bool)
    while todo.any():
        left, right, m, k = x[todo] >> half[todo], x[todo] & mask[todo], mask[todo], key[todo]
        for turn in range(4):
            f = (right ^ (k + np.uint64(turn * 0x9E3779B97F4A7C15 % (1 << 64)))) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & m)
        x[todo] = (left << half[todo]) | right
        todo = x >= size
    return x.astype(np.int64)


def mix(
    df: DataFrame, doc: str, text: str, source: str, targets: DataFrame, block: int = BLOCK, total_blocks: int | None = None,
    shard_blocks: int = SHARD_BLOCKS, seed: int = 0, tokenizer_path: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(mixture: shard, slot, source, block, use, n_tokens, doc_ids, ids; shares: one row a source).

    ``targets`` has ``source, target_weight, max_repeats``, at most ``MAX_SOURCES`` rows; names are
    compared without case and outer blanks, the greatest row of a repeated name counts, null weights
    and repeats are 0.  Shares: ``source, documents, available_tokens, target_share, tokens,
    actual_share, uses``.  Weights refer to the sources that have documents; one without has the
    target 0.  Documents of a null or unlisted source, without text or without id are not used; rows
    of one document count once, with the greatest text.  ``total_blocks`` asks for a size, else the
    mix is as large as the scarcest source allows.  An empty table gives an empty mixture.
    """
    spark = df.sparkSession
    stash = Stash(spark, "mix")
    rows = targets.select(clean_source(F.col("source")).alias("source"), F.struct(F.coalesce("target_weight", F.lit(0.0)), F.coalesce("max_repeats", F.lit(0))).alias("t")).where("source IS NOT NULL")
    listed = rows.groupBy("source").agg(F.max("t").alias("t")).limit(MAX_SOURCES + 1).collect()
    if len(listed) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    weights, repeats = {r["source"]: float(r["t"][0]) for r in listed}, {r["source"]: int(r["t"][1]) for r in listed}
    table = spark.createDataFrame([(s,) for s in weights], "source string")

    once = df.select(F.col(doc).alias("doc"), clean_source(F.col(source)).alias("source"), F.col(text).cast("string").alias("text")).where("doc IS NOT NULL AND text <> ''")
    once = once.groupBy("doc").agg(F.max(F.struct("text", "source")).alias("d")).select("doc", "d.source", "d.text")
    wanted = once.join(F.broadcast(table), "source", "left_semi")  # at most MAX_SOURCES names
    keyed = wanted.select(F.struct("doc", "source").alias("key"), "text")
    tokens = stash.put(encode(keyed, "key", "text", tokenizer_path).select("key.doc", "key.source", "ids"))
    packed = pack(tokens, block, stash)
    blocks = {r["source"]: r["n"] for r in packed.groupBy("source").agg(F.count("*").alias("n")).collect()}
    quota = quotas(weights, blocks, repeats, total_blocks)

    groups = spark.createDataFrame(draw_groups(quota, shard_blocks, seed), "grp int, shard bigint, names array<string>, firsts array<bigint>, counts array<bigint>")
    plan = spread(spark, groups, "grp").mapInPandas(_draw_within(shard_blocks, seed, {s: blocks[s] for s in quota}), "shard bigint, source string, first bigint, n bigint, blocks bigint")
    # at most shard_blocks slots a row
    slots = plan.select("shard", "source", "blocks", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("at"))

    @F.pandas_udf("bigint")
    def place(index: pd.Series, size: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series(permuted(index.to_numpy(), size.to_numpy(), key.to_numpy()), dtype="int64")

    use = F.floor(F.col("at") / F.col("blocks"))
    key = F.xxhash64("source", use, F.lit(seed))
    slots = slots.select("shard", "source", "at", (use + 1).cast("int").alias("use"), place(F.col("at") % F.col("blocks"), "blocks", key).alias("block"))
    order = Window.partitionBy("shard").orderBy(F.xxhash64("source", "at", F.lit(seed)), "source", "at")
    slots = stash.put(slots.select("shard", (F.row_number().over(order) - 1).alias("slot"), "source", "block", "use"))
    mixture = slots.join(packed, ["source", "block"]).select("shard", "slot", "source", "block", "use", F.size("ids").alias("n_tokens"), "doc_ids", "ids")

    have = tokens.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.size("ids")).alias("available_tokens"))
    counted = slots.join(packed.select("source", "block", F.size("ids").cast("bigint").alias("n")), ["source", "block"])
    used = counted.groupBy("source").agg(F.sum("n").alias("tokens"), F.max("use").alias("uses"))
    live = sum(weights[s] for s in quota) or 1.0
    asked = spark.createDataFrame([(s, weights[s] / live if s in quota else 0.0) for s in weights], "source string, target_share double")
    facts = asked.join(have, "source", "left").join(used, "source", "left").na.fill(0)
    total = used.agg(F.sum("tokens").alias("total"))
    shares = facts.join(F.broadcast(total), how="cross").select(
        "source", "documents", "available_tokens", "target_share", "tokens", F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)).alias("actual_share"), "uses"
    )  # one row a source
    return mixture, shares
