"""Train, validation and test splits that keep related records together.

Method: hash-to-min components over the keys records share, then weighted rendezvous hashing.

* A record with several keys (author, source, entity) links them.  Only keys are nodes of the graph,
  so a key with a third of all records is one node, not a star of records.
* Hash-to-min: every node holds a cluster, at first itself and its neighbours.  Each round it sends
  its cluster to the smallest member and the smallest member to the rest, until nothing changes.
  Clusters are kept as rows (node, member), never gathered into an array.
* Weighted rendezvous hashing gives each component, by a hash of its id and each split's name, to the
  split with the best score, among the splits whose share of records can hold it (or the largest, if
  none can).  The weights are set so that the shares come out as asked.  What a hash cannot reach, as
  components have sizes of their own, is mended by moving at most ``REPAIR`` components, those whose
  best score is least ahead of their second.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.storage import Stash

REPAIR = 1000
ROUNDS = 12


def components(links: DataFrame, stash: Stash) -> DataFrame:
    """``node, component`` for every node of ``links`` (a, b; undirected); the component is its least node."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    loops = both.select("a", F.col("a").alias("b")).distinct()
    clusters = stash.put(both.unionByName(loops).distinct().select(F.col("a").alias("node"), F.col("b").alias("member")))
    before = None
    while True:
        least = clusters.groupBy("node").agg(F.min("member").alias("low"))
        sent = clusters.join(least, "node")
        moved = sent.select(F.col("low").alias("node"), "member").unionByName(sent.select(F.col("member").alias("node"), F.col("low").alias("member")))
        moved = stash.put(moved.distinct())
        # a settled graph is a star around each least node; the sums tell whether anything changed
        mark = moved.agg(F.count("*"), F.sum(F.xxhash64("node", "member").cast("decimal(38,0)"))).first()
        stash.drop(clusters)
        clusters = moved
        if tuple(mark) == before:
            return clusters.groupBy("node").agg(F.min("member").alias("component"))
        before = tuple(mark)


def _score(component: Column, split: str, weight: float, seed: int) -> Column:
    """-w / ln(u), u uniform in (0, 1): the largest of these falls to a split in proportion to its weight."""
    u = (F.pmod(F.xxhash64(component, F.lit(split), F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return F.lit(float(weight)) / -F.log(u)


def scores(component: Column, size: Column, weights: dict[str, float], room: dict[str, float], seed: int) -> dict[str, Column]:
    """Score of each split; negative where the split cannot hold ``size`` records and another could."""
    widest = max(sorted(room), key=lambda n: room[n])
    return {n: F.when((size <= room[n]) | F.lit(n == widest), _score(component, n, w, seed)).otherwise(F.lit(-1.0)) for n, w in sorted(weights.items())}


def rendezvous(scored: dict[str, Column]) -> Column:
    """The split with the best score; ties go to the name that sorts first."""
    best = F.greatest(*scored.values(), F.lit(-2.0))
    return reduce(lambda rest, n: F.when(scored[n] == best, n).otherwise(rest), reversed(list(scored)), F.lit(next(iter(scored))))


def _moves(candidates: list, error: dict[str, float]) -> dict:
    """Moves of candidates (component, size, split, in order of preference) while they lower the total error."""
    moved, error, rest = {}, dict(error), list(candidates)
    while rest:
        best, at, to = 0.0, None, None
        for i, row in enumerate(rest):
            if error[row["split"]] <= 0:
                continue
            for n, e in error.items():
                if e < 0:
                    gain = error[row["split"]] - e - abs(error[row["split"]] - row["size"]) - abs(e + row["size"])
                    if gain > best + 1e-9:
                        best, at, to = gain, i, n
        if at is None:
            break
        row = rest.pop(at)
        moved[row["component"]] = to
        error[row["split"]] -= row["size"]
        error[to] += row["size"]
    return moved


def split_components(sizes: DataFrame, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """``component, split`` for components with their ``size``; shares refer to the sum of sizes."""
    shares = {n: w for n, w in sorted(shares.items()) if w > 0}
    total, whole = sizes.agg(F.sum("size")).first()[0] or 0, sum(shares.values())
    target = {n: total * w / whole for n, w in shares.items()}
    close = max(1.0, total * 1e-4)
    weights, best = {n: w / whole for n, w in shares.items()}, None
    for _ in range(ROUNDS if total else 0):
        split = rendezvous(scores(F.col("component"), F.col("size"), weights, target, seed))
        got = {r["split"]: r["size"] for r in sizes.groupBy(split.alias("split")).agg(F.sum("size").alias("size")).collect()}  # a row for each split
        error = {n: got.get(n, 0) - target[n] for n in target}
        if best is None or sum(map(abs, error.values())) < sum(map(abs, best[1].values())):
            best = weights, error
        if max(map(abs, error.values())) <= close:
            break
        weights = {n: w * min(2.0, max(0.5, (target[n] + 1) / (got.get(n, 0) + 1))) for n, w in weights.items()}
    if best is None:
        return sizes.select("component", F.lit(None).cast("string").alias("split")).where("false")
    weights, error = best
    scored = scores(F.col("component"), F.col("size"), weights, target, seed)
    chosen = sizes.select("component", "size", rendezvous(scored).alias("split"), F.array_sort(F.array(*scored.values())).alias("s"))
    if max(map(abs, error.values())) <= close or len(target) < 2:
        return chosen.select("component", "split")
    over = [n for n, e in error.items() if e > 0]
    margin = F.element_at("s", -2) / F.element_at("s", -1)
    near = chosen.where(F.col("split").isin(over)).orderBy(margin.desc(), "component").select("component", "size", "split").limit(REPAIR).collect()
    moved = _moves(near, error)
    if not moved:
        return chosen.select("component", "split")
    kind = sizes.schema["component"].dataType.simpleString()
    table = sizes.sparkSession.createDataFrame(list(moved.items()), f"component {kind}, fixed string")  # at most REPAIR rows
    return chosen.join(F.broadcast(table), "component", "left").select("component", F.coalesce("fixed", "split").alias("split"))


def grouped_split(df: DataFrame, record: str, keys: list[str], shares: dict[str, float] | None = None, seed: int = 0) -> DataFrame:
    """``record, component, split``: one row for each distinct non-null record.

    All records that share a value in a column of ``keys``, directly or through others, get the same
    split.  Null keys link nothing; a record without any key is a component of its own.  A record in
    several rows has the keys of all of them.  ``shares`` (default 0.8, 0.1, 0.1) refer to records.
    An empty table gives an empty result.
    """
    shares = shares or {"train": 0.8, "validation": 0.1, "test": 0.1}
    stash = Stash(df.sparkSession, "split")
    own = F.concat(F.lit("r\x1f"), F.col(record).cast("string"))
    tagged = [F.when(F.col(k).isNotNull(), F.concat(F.lit(f"k{i}\x1f"), F.col(k).cast("string"))) for i, k in enumerate(keys)]
    rows = df.where(F.col(record).isNotNull()).select(F.col(record).alias("record"), own.alias("own"), *[t.alias(f"k{i}") for i, t in enumerate(tagged)])
    cols = [F.col(f"k{i}") for i in range(len(keys))]
    # every record under its least key; rows with further keys link those to it
    hub = stash.put(rows.groupBy("record").agg(F.min(F.coalesce(F.least(*cols) if len(cols) > 1 else cols[0], F.col("own"))).alias("hub"), F.min("own").alias("own"), F.count_if(F.coalesce(*cols).isNull()).alias("bare"), F.max(F.greatest(*cols) if len(cols) > 1 else cols[0]).alias("top"), F.min(F.least(*cols) if len(cols) > 1 else cols[0]).alias("least")))
    hub = hub.select("record", F.coalesce("least", "own").alias("hub"), (F.col("least") < F.col("top")).alias("several"))
    wide = rows.join(hub.where("several").select("record", "hub"), "record").select(F.col("hub").alias("a"), F.explode(F.array(*cols)).alias("b")).where("b IS NOT NULL AND a <> b").distinct()
    labels = stash.put(components(stash.put(wide), stash))
    with_component = hub.join(labels, hub["hub"] == labels["node"], "left").select("record", F.coalesce("component", "hub").alias("component"))
    with_component = stash.put(with_component)
    sizes = stash.put(with_component.groupBy("component").agg(F.count("*").alias("size")))
    splits = split_components(sizes, shares, seed)
    return with_component.join(splits, "component").select("record", "component", "split")


def imbalance(shares: dict[str, float], got: dict[str, int]) -> float:
    """Largest distance of a split's share of records from the one asked for."""
    total, whole = sum(got.values()) or math.inf, sum(shares.values())
    return max(abs(got.get(n, 0) / total - s / whole) for n, s in shares.items())
