"""Clustering of feature rows, quality of clusters, and prototypes."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.functions.vectors import distance, dot, scale, scaling
from skeinwork.operators.components import star_components
from skeinwork.storage import Stash, spread

#: Distinct points that are clustered a group in a task.
LOCAL = 20_000
#: Distinct points of small groups that go to a task together, on average.
SHARE = 5_000
#: Cells of a line that one task puts in order.
CHUNK = 4096
#: Clusters whose centres may be sent to all tasks.
MAX_CENTRES = 10_000


def _blocks(x: np.ndarray, axis: int, eps: float, rows: np.ndarray, columns: np.ndarray, useful=None):
    """Some row numbers, column numbers and which of them are within eps, block by block.  Both come in order
    of the axis; ``useful`` leaves out columns that the rows need not be compared with."""
    line, of = x[columns, axis], x[rows, axis]
    low, high = np.searchsorted(line, of - eps * (1 + 1e-12)), np.searchsorted(line, of + eps * (1 + 1e-12), side="right")
    for at in range(0, len(rows), 256):
        r = rows[at : at + 256]
        c = columns[low[at] : high[at + len(r) - 1]]
        if useful is not None:
            c = useful(r, c)
        if not len(c):
            continue
        square = np.zeros((len(r), len(c)))
        for i in range(x.shape[1]):
            square += (x[r, i, None] - x[None, c, i]) ** 2
        yield r, c, np.sqrt(square) <= eps


def _link(top: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a and b in ``top``, where each number has the least of its set."""
    while (apart := top[a] != top[b]).any():
        a, b = top[a[apart]], top[b[apart]]
        np.minimum.at(top, np.maximum(a, b), np.minimum(a, b))
        while ((jump := top[top]) != top).any():
            top[:] = jump


def _group(x: np.ndarray, n: np.ndarray, keys: np.ndarray, eps: float, least: int) -> np.ndarray:
    """The clusters of the points of a group.  Points of a cell are neighbours, and cells of one cluster are not
    compared again, so no table of pairs is made."""
    axis = int(np.argmax(x.std(axis=0)))
    order = np.argsort(x[:, axis], kind="stable")
    back = np.empty(len(x), dtype=np.int64)
    back[order] = np.arange(len(x))
    x, n, keys = x[order], n[order].astype(float), keys[order]
    cell = np.unique(np.floor(x / (eps / x.shape[1] ** 0.5)), axis=0, return_inverse=True)[1].reshape(-1)
    weight = np.bincount(cell, weights=n)[cell]
    every = np.arange(len(x))
    for r, c, near in _blocks(x, axis, eps, every[weight < least], every):
        weight[r] = (near | (cell[r, None] == cell[None, c])) @ n[c]
    core = weight >= least
    inner, top = every[core], np.arange(cell.max() + 1)

    def elsewhere(r: np.ndarray, c: np.ndarray) -> np.ndarray:
        own = top[cell[r]]
        return c[top[cell[c]] != own[0]] if (own == own[0]).all() else c

    for r, c, near in _blocks(x, axis, eps, inner, inner, elsewhere):
        i, j = np.nonzero(near & (top[cell[r], None] != top[None, cell[c]]))
        _link(top, cell[r[i]], cell[c[j]])
    rank = np.empty(len(x), dtype=np.int64)
    rank[np.argsort(keys, kind="stable")] = every
    head = np.full(len(top), len(x))
    np.minimum.at(head, top[cell[inner]], rank[inner])
    out = np.full(len(x), len(x))
    out[inner] = head[top[cell[inner]]]
    for r, c, near in _blocks(x, axis, eps, every[~core], inner):
        out[r] = np.where(near | (cell[r, None] == cell[None, c]), out[None, c], len(x)).min(axis=1)
    return np.append(np.sort(keys).astype(object), None)[out[back]]


def _in_memory(eps: float, least: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for g, rows in frame.groupby("g", sort=False):
            clusters = _group(np.stack(rows["x"].to_numpy()), rows["n"].to_numpy(), rows["k"].to_numpy(), eps, least)
            parts.append(pd.DataFrame({"g": g, "x": rows["x"].to_numpy(), "cluster": pd.Series(clusters, dtype=object)}))
        return pd.concat(parts)

    return run


def dbscan(df: DataFrame, key: str, columns: list[str], eps: float, least: int, by: str | None = None) -> DataFrame:
    """``key, cluster``: DBSCAN; the cluster is the least key of its core points, null for noise.

    With ``by``, rows cluster within equal values of that column only.  Equal points become one weighted
    point first, so copies cost nothing.  Points are put into fine cells of eps / sqrt(d): points of one
    cell are neighbours without looking at pairs.  A group of up to ``LOCAL`` distinct points is done within a
    task, with others.  The points of larger groups are compared where they are in different fine cells and
    their coarse cells, of eps in the (at most three) columns that spread most, touch: 27 cells at most,
    whatever the number of columns.  Neighbours are counted for points of light cells only, core cells are linked
    as cells, and pairs are grouped as they are met, never written.  A border point joins the reachable
    cluster of least core key.  Both ways have the same result.  Rows with a null coordinate are noise.  One
    column goes by :func:`dbscan_line` instead.
    """
    if len(columns) == 1:
        return dbscan_line(df, key, columns[0], eps, least, by)
    stash = Stash(df.sparkSession, "dbscan")
    d = len(columns)
    side = eps / (d**0.5)
    coords = F.array(*[F.col(c).cast("double") for c in columns])
    group = F.coalesce(F.col(by).cast("string"), F.lit("")) if by else F.lit("")
    rows = df.select(F.col(key).alias("k"), group.alias("g"), coords.alias("x"))
    full = ~F.exists("x", lambda v: v.isNull() | F.isnan(v))
    points = rows.where(full).groupBy("g", "x").agg(F.count("*").alias("n"), F.min("k").alias("k"))
    points = stash.put(points.select("k", "g", "x", "n", F.struct("g", F.transform("x", lambda v: F.floor(v / side)).alias("c")).alias("cell")))
    sizes = points.groupBy("g").agg(F.count("*").alias("m"))
    total, most = sizes.agg(F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.max("m"), F.lit(0))).first()
    kind = df.schema[key].dataType.simpleString()
    small = points.select("g", "x", "n", "k")
    if most > LOCAL:
        large = stash.put(sizes.where(F.col("m") > LOCAL).select("g"))
        small, points = small.join(large, "g", "left_anti"), stash.put(points.join(large, "g", "left_semi"))
    if total > SHARE:
        small = spread(df.sparkSession, small.withColumn("part", F.pmod(F.xxhash64("g"), F.lit(total // SHARE + 1))), "part")
    else:
        small = small.withColumn("part", F.lit(0))
    at = small.groupBy("part").applyInPandas(_in_memory(eps, least), f"g string, x array<double>, cluster {kind}")
    if most > LOCAL:
        at = at.unionByName(_by_cells(points, stash, eps, least, d))
    return rows.join(at, ["g", "x"], "left").select(F.col("k").alias(key), "cluster")


def _by_cells(points: DataFrame, stash: Stash, eps: float, least: int, d: int) -> DataFrame:
    """``g, x, cluster`` of groups too large for a task."""
    cells = points.groupBy("cell").agg(F.sum("n").alias("weight"))
    spreads = points.agg(*[F.stddev_pop(F.col("x")[i]).alias(str(i)) for i in range(d)]).first()
    used = sorted(sorted(range(d), key=lambda i: -(spreads[i] or 0.0))[:3])
    coarse = lambda of: F.concat_ws(",", "g", *[(F.floor(F.col("x")[i] / eps) + of[n]).cast("string") for n, i in enumerate(used)])
    steps = list(itertools.product((-1, 0, 1), repeat=len(used)))

    def close(some: DataFrame, others: DataFrame, which: Column) -> DataFrame:
        near = some.select("k", "x", "cell", F.explode(F.array(*[coarse(o) for o in steps])).alias("at")).alias("a")
        here = others.select("k", "x", "n", "cell", coarse([0] * len(used)).alias("at")).alias("b")
        met = near.join(here, (F.col("a.at") == F.col("b.at")) & which & (distance(F.col("a.x"), F.col("b.x")) <= eps))
        return met.select(F.col("a.k").alias("k"), F.col("a.cell").alias("cell"), F.col("b.cell").alias("qcell"), F.col("b.n").alias("n"))

    apart = F.col("a.cell") != F.col("b.cell")
    light = points.join(cells.where(F.col("weight") < least), "cell", "left_semi")
    around = close(light, points, apart).groupBy("k").agg(F.sum("n").alias("around"))
    core = points.join(cells, "cell").join(around, "k", "left").where(F.col("weight") + F.coalesce("around", F.lit(0)) >= least).select("k", "g", "x", "n", "cell")
    core = stash.put(core)
    core_cells = core.groupBy("cell").agg(F.min("k").alias("head"))
    links = close(core, core, F.col("a.cell") < F.col("b.cell")).select("cell", "qcell").distinct()
    named = core_cells.select(F.col("cell").alias("c"), "head")
    edges = links.join(named.select(F.col("c").alias("cell"), F.col("head").alias("a")), "cell").join(named.select(F.col("c").alias("qcell"), F.col("head").alias("b")), "qcell").select("a", "b")
    labels = star_components(stash.put(edges), stash)
    clusters = stash.put(core_cells.join(labels, F.col("head") == F.col("node"), "left").select("cell", F.coalesce("component", "head").alias("cluster")))
    rest = points.join(core.select("k"), "k", "left_anti")
    same_cell = rest.join(clusters, "cell").select("k", "cluster")
    other = close(rest, core, apart).select("k", "qcell").distinct().join(clusters.select(F.col("cell").alias("qcell"), "cluster"), "qcell").select("k", "cluster")
    border = same_cell.unionByName(other).groupBy("k").agg(F.min("cluster").alias("cluster"))
    named = core.join(clusters, "cell").select("k", "cluster").unionByName(border)
    return points.select("k", "g", "x").join(named, "k", "left").select("g", "x", "cluster")


def dbscan_line(df: DataFrame, key: str, column: str, eps: float, least: int, by: str | None = None) -> DataFrame:
    """DBSCAN of one column, as :func:`dbscan`, by islands instead of pairs.

    Values are cut into cells of width eps, so the core points of a cell are neighbours.  A cell sees its
    two neighbours; counts and nearest core points are window functions within it.  Cells form islands
    where the gap between their core points is at most eps; cells are numbered in two levels, ``CHUNK``
    cells and chunks, so no task orders all of them.  Four shuffles, and no rounds.
    """
    stash = Stash(df.sparkSession, "line")
    group = F.coalesce(F.col(by).cast("string"), F.lit("")) if by else F.lit("")
    rows = df.select(F.col(key).alias("k"), group.alias("g"), F.col(column).cast("double").alias("v"))
    points = rows.where("v IS NOT NULL AND NOT isnan(v)").groupBy("g", "v").agg(F.count("*").alias("n"), F.min("k").alias("k"))
    points = points.withColumn("cell", F.floor(F.col("v") / eps))
    halo = F.explode(F.array(*[(F.col("cell") + i).alias("seat") for i in (-1, 0, 1)])).alias("seat")
    around = F.expr(f"sum(n) OVER (PARTITION BY g, seat ORDER BY v RANGE BETWEEN {eps!r}D PRECEDING AND {eps!r}D FOLLOWING)")
    counted = points.select("g", "v", "n", "k", "cell", halo).withColumn("around", around).where("seat = cell")
    known = stash.put(counted.select("g", "v", "k", "cell", (F.col("around") >= least).alias("core")))
    cells = known.where("core").groupBy("g", "cell").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.min("k").alias("head")).withColumn("chunk", F.floor(F.col("cell") / CHUNK))
    chunks = Window.partitionBy("g").orderBy("chunk")
    ends = cells.groupBy("g", "chunk").agg(F.max("high").alias("end")).select("g", "chunk", F.lag("end").over(chunks).alias("before"))
    within = Window.partitionBy("g", "chunk").orderBy("cell")
    gap = F.col("low") - F.coalesce(F.lag("high").over(within), "before")
    marked = cells.join(ends, ["g", "chunk"]).withColumn("opens", F.coalesce((gap > eps).cast("int"), F.lit(1)))
    marked = stash.put(marked.withColumn("no", F.sum("opens").over(within)))
    offset = marked.groupBy("g", "chunk").agg(F.sum("opens").alias("o")).select("g", "chunk", (F.sum("o").over(chunks) - F.col("o")).alias("offset"))
    islands = marked.join(offset, ["g", "chunk"]).select("g", "cell", "head", (F.col("no") + F.col("offset")).alias("island"))
    clusters = islands.join(islands.groupBy("g", "island").agg(F.min("head").alias("cluster")), ["g", "island"]).select("g", "cell", "cluster")
    placed = known.join(clusters, ["g", "cell"], "left").withColumn("c", F.when(F.col("core"), F.struct("v", "cluster")))
    seen = placed.select("g", "v", "cell", "core", "cluster", "c", halo)
    seats = Window.partitionBy("g", "seat").orderBy("v")
    left, right = F.last("c", True).over(seats.rowsBetween(Window.unboundedPreceding, 0)), F.first("c", True).over(seats.rowsBetween(0, Window.unboundedFollowing))
    seen = seen.select("g", "v", "cell", "seat", "core", "cluster", left.alias("l"), right.alias("r")).where("seat = cell")
    border = F.least(F.when(F.col("v") - F.col("l.v") <= eps, F.col("l.cluster")), F.when(F.col("r.v") - F.col("v") <= eps, F.col("r.cluster")))
    at = seen.select("g", "v", F.when(F.col("core"), F.col("cluster")).otherwise(border).alias("cluster"))
    return rows.join(at, ["g", "v"], "left").select(F.col("k").alias(key), "cluster")


def standardised_dbscan(df: DataFrame, key: str, features: str, width: int, eps: float, least: int, by: str | None = None) -> DataFrame:
    """DBSCAN of an array column whose entries are scaled by mean and population deviation first."""
    names = [f"_f{i}" for i in range(width)]
    flat = df.select(key, *([by] if by else []), *[F.col(features)[i].cast("double").alias(n) for i, n in enumerate(names)])
    return dbscan(scale(flat, names, scaling(flat, names, "zscore")), key, names, eps, least, by)


def weighted_dbscan(df: DataFrame, key: str, features: str, width: int, weight: str, eps: float, least: int) -> DataFrame:
    """DBSCAN of an array column times a weight."""
    names = [f"_f{i}" for i in range(width)]
    return dbscan(df.select(key, *[(F.col(features)[i] * F.col(weight)).cast("double").alias(n) for i, n in enumerate(names)]), key, names, eps, least)


def refined(df: DataFrame, key: str, cluster: str, columns: list[str], eps: float, least: int, members: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """``key, cluster``: clusters of at least ``members`` rows are clustered again by ``columns``, each within
    itself; a part has the name ``cluster/least key``.  What a second clustering leaves as noise, and the
    clusters too small for it, keep their name.  All clusters are refined in one run.  The rows are written
    once: they are read four times, and a refinement of a refinement would carry the plan 16 times.  The
    columns of ``keep`` come along."""
    stash = Stash(df.sparkSession, "refined")
    named = stash.put(df.select(key, F.col(cluster).cast("string").alias("_c"), *dict.fromkeys([*columns, *keep])))
    large = named.where("_c IS NOT NULL").groupBy("_c").agg(F.count("*").alias("_n")).where(F.col("_n") >= members).select("_c")
    parts = dbscan(named.join(large, "_c"), key, columns, eps, least, "_c").select(key, F.col("cluster").alias("_part"))
    part = F.when(F.col("_part").isNotNull(), F.concat_ws("/", "_c", F.col("_part").cast("string"))).otherwise(F.col("_c"))
    return named.join(parts, key, "left").select(key, part.alias("cluster"), *keep)


def size_bins(df: DataFrame, size: str, width: int = 2, least: int = 20) -> DataFrame:
    """``bin, members`` of bins of a width that hold at least ``least`` rows."""
    return df.groupBy((F.floor(F.col(size) / width) * width).alias("bin")).agg(F.count("*").alias("members")).where(F.col("members") >= least)


def quantile_bins(df: DataFrame, value: str, cuts: list[float]) -> DataFrame:
    """``df`` with ``bin``: the number of quantiles below the value (upper bounds belong to the bin)."""
    points = df.agg(F.percentile(value, F.array(*[F.lit(c) for c in cuts])).alias("_q"))
    joined = df.join(F.broadcast(points), how="cross")  # one row
    return joined.withColumn("bin", F.when(F.col(value).isNotNull(), F.size(F.filter("_q", lambda q: q < F.col(value))))).drop("_q")


def quality(members: DataFrame, cluster: str, features: str, label: str, session: str, negatives: DataFrame) -> DataFrame:
    """Per cluster: size, purity, coverage, stability and discrimination.

    purity: share of positive labels.  coverage: positive sessions in it over all.  stability: 1 / (1 +
    mean population variance of the features), 0 for one member.  discrimination: mean distance of the
    centroid to all negative rows.
    """
    each = members.select(cluster, F.posexplode(features).alias("at", "v")).groupBy(cluster, "at").agg(F.avg("v").alias("m"), F.var_pop("v").alias("s"), F.count("*").alias("n"))
    shape = each.groupBy(cluster).agg(F.array_sort(F.collect_list(F.struct("at", "m"))).alias("_c"), F.when(F.max("n") > 1, 1 / (1 + F.avg("s"))).otherwise(0.0).alias("stability"))
    positive = F.when(F.col(label) == 1, F.col(session))
    counts = members.groupBy(cluster).agg(F.count("*").alias("size"), F.avg(label).alias("purity"), F.count_distinct(positive).alias("covered"))
    whole = members.agg(F.count_distinct(positive).alias("sessions"))
    centroids = shape.select(cluster, F.col("_c.m").alias("centroid"), "stability")
    if centroids.limit(MAX_CENTRES + 1).count() > MAX_CENTRES:
        raise ValueError(f"more than {MAX_CENTRES} clusters to compare with all negatives")
    far = negatives.select(F.col(features).alias("_x")).join(F.broadcast(centroids.select(cluster, "centroid")), how="cross").groupBy(cluster).agg(F.avg(distance(F.col("centroid"), F.col("_x"))).alias("discrimination"))
    out = counts.join(centroids, cluster).join(far, cluster, "left").join(F.broadcast(whole), how="cross")
    return out.select(cluster, "size", "purity", (F.col("covered") / F.greatest("sessions", F.lit(1))).alias("coverage"), "stability", F.coalesce("discrimination", F.lit(0.0)).alias("discrimination"))


def cohesion(members: DataFrame, cluster: str, features: str) -> DataFrame:
    """Mean cosine over pairs of a cluster, in closed form: (|sum u|^2 - sum |u|^2) / (n (n - 1)) over unit
    rows u; zero rows stay zero.  No pair is formed."""
    length = F.sqrt(dot(F.col(features), F.col(features)))
    unit = members.select(cluster, F.transform(features, lambda v: F.when(length > 0, v / length).otherwise(0.0)).alias("u"))
    sums = unit.select(cluster, F.posexplode("u").alias("at", "v")).groupBy(cluster, "at").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"), F.count("*").alias("n"))
    return sums.groupBy(cluster).agg(F.max("n").alias("size"), F.when(F.max("n") > 1, (F.sum(F.col("s") * F.col("s")) - F.sum("q")) / (F.max("n") * (F.max("n") - 1))).otherwise(0.0).alias("cohesion"))


def medoids(members: DataFrame, cluster: str, key: str, features: str) -> DataFrame:
    """``cluster, medoid, distance``: the member nearest to the centroid, the least key on a tie."""
    each = members.select(cluster, F.posexplode(features).alias("at", "v")).groupBy(cluster, "at").agg(F.avg("v").alias("m"))
    centroids = each.groupBy(cluster).agg(F.array_sort(F.collect_list(F.struct("at", "m"))).alias("_c")).select(cluster, F.col("_c.m").alias("centroid"))
    far = members.join(centroids, cluster).select(cluster, F.struct(F.round(distance(F.col(features), F.col("centroid")), 9).alias("d"), F.col(key).alias("k")).alias("r"))
    return far.groupBy(cluster).agg(F.min("r").alias("r")).select(cluster, F.col("r.k").alias("medoid"), F.col("r.d").alias("distance"))


def top_prototypes(rated: DataFrame, least_size: int, least_purity: float, k: int) -> DataFrame:
    """The k clusters of most discrimination among those large and pure enough, numbered from 0."""
    kept = rated.where((F.col("size") >= least_size) & (F.col("purity") >= least_purity)).orderBy(F.col("discrimination").desc(), "cluster").limit(k)
    return kept.withColumn("prototype", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("discrimination").desc(), "cluster")) - 1)


def consistency(value: Column) -> Column:
    """1 - coefficient of variation, at least 0."""
    return F.greatest(F.lit(0.0), 1 - F.coalesce(F.stddev_pop(value) / F.nullif(F.abs(F.avg(value)), F.lit(0.0)), F.lit(0.0)))


def weighted_centres(members: DataFrame, cluster: str, features: str, weight: str) -> DataFrame:
    """``cluster, centroid``: means of the features weighted by a column."""
    each = members.select(cluster, F.col(weight).alias("_w"), F.posexplode(features).alias("at", "v")).groupBy(cluster, "at").agg((F.sum(F.col("_w") * F.col("v")) / F.sum("_w")).alias("m"))
    return each.groupBy(cluster).agg(F.array_sort(F.collect_list(F.struct("at", "m"))).alias("_c")).select(cluster, F.col("_c.m").alias("centroid"))


def weighted_quality(members: DataFrame, cluster: str, key: str, features: str, weight: str, share: float = 0.3) -> DataFrame:
    """Per cluster: ``size, quality, representative``.

    quality: 1 / (1 + weighted mean distance to the weighted centre) + min(deviation of the weights / 10,
    0.2) + ``share`` of members weighing above 1, at most 1.  The representative has the least distance
    over weight, the least key on a tie.
    """
    far = members.join(weighted_centres(members, cluster, features, weight), cluster).select(cluster, F.col(key).alias("_k"), F.col(weight).alias("_w"), distance(F.col(features), F.col("centroid")).alias("_d"))
    out = far.groupBy(cluster).agg(
        F.count("*").alias("size"), (F.sum(F.col("_w") * F.col("_d")) / F.sum("_w")).alias("cohesion"), F.stddev_pop("_w").alias("spread"), F.avg((F.col("_w") > 1).cast("int")).alias("heavy"),
        F.min(F.struct(F.round(F.col("_d") / F.col("_w"), 9).alias("d"), F.col("_k").alias("k"))).alias("r"),
    )
    score = 1 / (1 + F.col("cohesion")) + F.least(F.lit(0.2), 0.1 * F.col("spread")) + share * F.col("heavy")
    return out.select(cluster, "size", F.least(F.lit(1.0), score).alias("quality"), F.col("r.k").alias("representative"))


def merge_similar(prototypes: DataFrame, key: str, features: str, size: str, least: float = 0.8) -> DataFrame:
    """``key, merged_into``: in order of size (greatest first, then key) each prototype joins the first kept
    one with a cosine above ``least``, else is kept.  The order decides, so this runs in one task; it is
    for a report's top prototypes, a table refused above 10,000 rows."""
    kind = prototypes.schema[key].dataType.simpleString()
    if prototypes.limit(10_001).count() > 10_000:
        raise ValueError("too many prototypes to merge in order")

    def merge(frame):
        import numpy as np
        import pandas as pd

        frame = frame.sort_values([size, key], ascending=[False, True])
        x = np.stack(frame[features].to_numpy()) if len(frame) else np.zeros((0, 1))
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        kept, into = [], []
        for i in range(len(frame)):
            close = [j for j in kept if x[j] @ x[i] > least]
            into.append(close[0] if close else i)
            if not close:
                kept.append(i)
        keys = frame[key].to_numpy()
        return pd.DataFrame({key: keys, "merged_into": [keys[j] for j in into]})

    return prototypes.select(key, features, size, F.lit(0).alias("_all")).groupBy("_all").applyInPandas(merge, f"{key} {kind}, merged_into {kind}")


def merge_clusterings(parts: dict[str, DataFrame], least: int) -> DataFrame:
    """``cluster, members`` of several clusterings (rows with a column ``c``) under prefixed names, where a
    cluster has at least ``least`` members.  Rows without a cluster are left out."""
    out = None
    for prefix, rows in parts.items():
        named = rows.where("c IS NOT NULL").select(F.concat(F.lit(prefix), "c").alias("cluster"))
        out = named if out is None else out.unionByName(named)
    return out.groupBy("cluster").agg(F.count("*").alias("members")).where(F.col("members") >= least)
