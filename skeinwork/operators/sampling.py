"""Deterministic samples and splits: order by a hash of the id, so any engine and any retry agrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_rank(key: Column, seed: int | str = 42) -> Column:
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group.  Spark turns the rank filter into a per-partition top-k before the
    shuffle (WindowGroupLimit), so a hot group sends k rows a task."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")


def sample_per_stratum(df: DataFrame, stratum: str, key: str, n: int, seed: int = 42) -> DataFrame:
    return top_per_group(df, [stratum], [hash_rank(F.col(key), seed), F.col(key)], n)


def quality_then_random(df: DataFrame, key: str, score: str, quota: int, share: float = 0.7, seed: int = 42) -> DataFrame:
    """``quota`` rows: the best ``share`` of them by score, the rest by hash among the others."""
    best = df.orderBy(F.col(score).desc(), key).limit(int(quota * share))
    others = df.join(best.select(key), key, "left_anti")
    rest = others.orderBy(hash_rank(F.col(key), seed), key).limit(quota - int(quota * share))
    return best.withColumn("pick", F.lit("quality")).unionByName(rest.withColumn("pick", F.lit("random")))


def diverse(df: DataFrame, key: str, score: str, edges: list[float], per_bin: int, best: int, random: int, seed: int = 42) -> DataFrame:
    """``key``: rows of a stratified sample (``per_bin`` of each score bin [lo, hi)), the ``best`` by score,
    and ``random`` of those not chosen by either; each row once."""
    which = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col(score)))
    strata = sample_per_stratum(df.where(F.col(score).isNotNull()).withColumn("_bin", which), "_bin", key, per_bin, seed).select(key)
    top = df.orderBy(F.col(score).desc(), key).limit(best).select(key)
    chosen = strata.union(top).distinct()
    rest = df.join(chosen, key, "left_anti").orderBy(hash_rank(F.col(key), seed), key).limit(random).select(key)
    return chosen.union(rest)


def evenly_spaced(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """Rows at the indexes floor(i * n / k), i < k, of each group; all rows where n <= k."""
    n = F.count("*").over(Window.partitionBy(*group))
    at = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    ranked = df.withColumn("_n", n).withColumn("_at", at)
    # index a is picked if some i has floor(i n / k) = a
    i = F.ceil(F.col("_at") * k / F.col("_n"))
    return ranked.where((F.col("_n") <= k) | (F.floor(i * F.col("_n") / k) == F.col("_at")) & (i < k)).drop("_n", "_at")


def stratified_split(df: DataFrame, key: str, stratum: str, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """``key, split``: each stratum is cut at the given shares, in hash order, to the row.

    Ranks come in two levels, the first byte of the hash and the place within it, so that a stratum with
    most rows is ordered by many tasks.
    """
    h = hash_rank(F.col(key), seed)
    rows = df.select(key, F.col(stratum).alias("_s"), h.alias("_h")).withColumn("_b", F.substring("_h", 1, 2))
    sizes = rows.groupBy("_s", "_b").agg(F.count("*").alias("_c"))
    over = Window.partitionBy("_s").orderBy("_b")
    starts = sizes.select("_s", "_b", (F.sum("_c").over(over) - F.col("_c")).alias("_start"), F.sum("_c").over(Window.partitionBy("_s")).alias("_n"))
    local = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_s", "_b").orderBy("_h", key)))
    ranked = local.join(starts, (local["_s"].eqNullSafe(starts["_s"])) & (local["_b"] == starts["_b"])).select(key, local["_s"], (F.col("_start") + F.col("_r")).alias("_at"), "_n")
    total, bound, split = sum(shares.values()), 0.0, None
    for name, share in shares.items():
        bound += share / total
        cut = F.col("_at") <= F.floor(F.col("_n") * F.lit(bound) + F.lit(1e-9))
        split = F.when(cut, name) if split is None else split.when(cut, name)
    return ranked.select(key, split.otherwise(name).alias("split"))
