"""Parent-child rows to full hierarchies: root, depth, path and descendants, with cycles detected.

Method
    1. *Splitters.*  A node is a splitter if a hash of its id says so (one node in ``SPACING``);
       roots are splitters too.  The choice depends on the id alone, so retried tasks agree.
    2. *Walk.*  Every node walks up to its next splitter.  The walk advances by pointer jumping, so
       the rounds are the logarithm of the longest gap between splitters, not of the deepest tree.
    3. *Reduced graph.*  Splitters alone, each pointing to the next one, are solved up to the roots.
       This table has about 1/SPACING of the rows.
    4. *Expand.*  One join gives every node the answer of its splitter.
    5. *Cycles.*  Splitters that never reach a root lie on or behind a cycle that holds a splitter.
       Walks that never end lie on or behind a cycle without one; both are settled separately.

Each round joins on a unique right side, so a parent with a third of all replies makes the left side
of the join uneven at worst; adaptive execution splits such partitions.  No group is ever collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.storage import Stash

SPACING = 8
_BLANK = " \t\r\n\f\v "


def _is_splitter(node: Column) -> Column:
    return F.pmod(F.xxhash64(node, F.lit("splitter")), F.lit(SPACING)) == 0


def clean_links(df: DataFrame, node: str, parent: str, version: str | None = None) -> DataFrame:
    """One row ``(node, parent)`` for each distinct non-null node id.

    The row with the greatest ``version`` counts (nulls last; ties go to the greatest parent, so that
    repeated rows give one answer).  Parents are trimmed; an empty one becomes null.  Node ids are
    taken as they stand.  Other columns, whatever their names, are not read.
    """
    key = F.col(node).cast("string")
    up = F.btrim(F.col(parent).cast("string"), F.lit(_BLANK))
    up = F.when(up != "", up)
    order = F.struct(F.col(version) if version else F.lit(0), up)
    return (
        df.where(key.isNotNull())
        .groupBy(key.alias("node"))
        .agg(F.max(order).alias("last"))
        .select("node", F.col("last")["col2"].alias("parent"))
    )


@dataclass
class _Step:
    """Columns that travel with a pointer: how they start and how two stretches join."""

    trails: bool

    def joined(self) -> list[Column]:
        cols = [F.col("s.ptr").alias("ptr"), (F.col("t.dist") + F.col("s.dist")).alias("dist"), F.least("t.low", "s.low").alias("low")]
        return [*cols, F.concat("t.trail", "s.trail").alias("trail")] if self.trails else cols


def _jump(stash: Stash, table: DataFrame, step: _Step) -> tuple[DataFrame, DataFrame]:
    """Advance all open pointers to a terminal node; returns (settled, never settling).

    ``table``: node, ptr, dist, low, done[, trail]; a row is done when ptr is terminal, and every ptr is a
    node of the table.  So the join is an inner one, and once few rows are open the planner may send them
    to the table instead of shuffling it.  A round that
    settles nothing proves that the open rest never will: were a node at distance d > 2^r from a
    terminal still open, the nodes between it and the terminal would have settled in that round.
    """
    done_parts, open_rows = [table.where("done")], table.where("NOT done")
    left = open_rows.count()
    step_table = table
    while left:
        t, s = open_rows.alias("t"), step_table.alias("s")
        moved = stash.put(
            t.join(s, F.col("t.ptr") == F.col("s.node")).select(F.col("t.node").alias("node"), *step.joined(), F.col("s.done").alias("done"))
        )
        done_parts.append(moved.where("done"))
        open_rows = moved.where("NOT done")
        now = open_rows.count()
        if now == left:
            break
        left = now
        step_table = done_parts[0].unionByName(open_rows)
        for part in done_parts[1:]:
            step_table = step_table.unionByName(part)
    settled = done_parts[0]
    for part in done_parts[1:]:
        settled = settled.unionByName(part)
    return settled, open_rows


def _cycles(stash: Stash, table: DataFrame) -> DataFrame:
    """For nodes whose pointers never leave the table: (node, low, on_cycle).

    ``low`` is the smallest id on the cycle the node ends in.  Doubling goes on until neither the set
    of nodes still pointed at nor any running minimum changes.  The pointer map then permutes its
    image, so the image is the set of nodes on cycles and their minima are those of whole cycles.
    """
    now = stash.put(table.select("node", "ptr", "low"))
    total = now.count()
    if not total:
        none = now.select("node", "low", F.lit(False).alias("on_cycle"))
        none._stash_path = now._stash_path
        return none
    seen, steady = -1, False
    while True:
        image = now.select("ptr").distinct().count()
        if steady and image == seen:
            break
        seen = image
        t, s = now.alias("t"), now.alias("s")
        moved = stash.put(
            t.join(s, F.col("t.ptr") == F.col("s.node")).select(
                F.col("t.node").alias("node"),
                F.col("s.ptr").alias("ptr"),
                F.least("t.low", "s.low").alias("low"),
                (F.col("s.low") < F.col("t.low")).alias("fell"),
            )
        )
        steady = not moved.where("fell").limit(1).count()
        stash.drop(now)
        now = moved.drop("fell")
        now._stash_path = moved._stash_path
    ends = now.select(F.col("ptr").alias("node")).distinct()
    lows = now.join(ends, "node", "left_semi").select(F.col("node").alias("ptr"), F.col("low").alias("cycle_low"))
    return stash.put(
        now.join(lows, "ptr")
        .join(ends.withColumn("hit", F.lit(True)), "node", "left")
        .select("node", F.col("cycle_low").alias("low"), F.coalesce("hit", F.lit(False)).alias("on_cycle"))
    )


def resolve(links: DataFrame, paths: bool = False, _stash: Stash | None = None) -> DataFrame:
    """Hierarchy of ``links`` (node, parent; one row per node, as from :func:`clean_links`).

    Result: ``node, root, depth`` and ``in_cycle`` (the node is on a cycle or its chain of parents
    ends in one), and with ``paths`` also ``path``, the ids from the root down to the node.

    * A parent that is null or no node of the table makes its child a root: depth 0, itself as root.
    * On or behind a cycle: depth -1, root the smallest id on that cycle.  The path of a node on a
      cycle is the node alone; behind a cycle it starts at the node of the cycle it hangs from.
    * An empty table gives an empty result.
    """
    spark = links.sparkSession
    stash = _stash or Stash(spark, "hierarchy")
    step = _Step(paths)
    if _stash is None:
        links = stash.put(links)
    p = links.select(F.col("node").alias("p"))
    known = links.join(p, links["parent"] == F.col("p"), "left").select("node", F.col("p").alias("parent"))
    known = stash.put(known)
    root = F.col("parent").isNull()
    start = [
        F.col("node"),
        F.coalesce("parent", "node").alias("ptr"),
        F.when(root, 0).otherwise(1).cast("bigint").alias("dist"),
        F.col("node").alias("low"),
        (root | _is_splitter(F.col("parent"))).alias("done"),
    ]
    if paths:
        start.append(F.when(root, F.array().cast("array<string>")).otherwise(F.array("node")).alias("trail"))
    walked, endless = _jump(stash, known.select(*start), step)

    splitters = known.where(root | _is_splitter(F.col("node"))).select("node", root.alias("is_root"))
    tops = splitters.where("is_root").select(F.col("node").alias("top"))
    reduced = walked.join(splitters.select("node"), "node", "left_semi")
    reduced = reduced.drop("done").join(tops, F.col("ptr") == F.col("top"), "left")
    reduced = reduced.withColumn("done", F.col("top").isNotNull()).drop("top")
    # splitters whose own walk never ends stand for themselves, so that pointers to them lead somewhere
    lost = endless.join(splitters.select("node"), "node", "left_semi").withColumn("ptr", F.col("node")).withColumn("dist", F.lit(0).cast("bigint")).withColumn("low", F.col("node"))
    reduced = stash.put(reduced.unionByName(lost.select(reduced.columns)))
    solved, circular = _jump(stash, reduced, step)

    up = solved.select(
        F.col("node").alias("s"), F.col("ptr").alias("root"), F.col("dist").alias("more"), *([F.col("trail").alias("more_trail")] if paths else [])
    )
    # a splitter may sit behind a walk that never ends; such pointers stay without an answer here
    rest = walked.drop("done").join(up, walked["ptr"] == up["s"], "left")
    rest = stash.put(rest)
    good = rest.where("root IS NOT NULL").select(
        "node",
        "root",
        (F.col("dist") + F.col("more")).alias("depth"),
        F.lit(False).alias("in_cycle"),
        *([F.concat(F.array("root"), F.reverse(F.concat("trail", "more_trail"))).alias("path")] if paths else []),
    )
    bad = rest.where("root IS NULL").select("node", "ptr", "low", *(["trail"] if paths else []))
    if endless.isEmpty() and bad.isEmpty():
        if _stash is None:
            stash.keep_only(rest)
        return good

    # Cycles without a splitter are settled on their own rows.  Circular splitters either lead to one
    # of those or to a cycle among splitters.
    loops = _cycles(stash, endless.select("node", "ptr", "low"))
    stuck = loops.select(F.col("node").alias("e"))
    heads = bad.join(circular.select("node"), "node", "left_semi").join(stuck, F.col("ptr") == F.col("e"), "left")
    heads = stash.put(heads.select("node", "ptr", F.lit(0).cast("bigint").alias("dist"), "low", F.col("e").isNotNull().alias("done")))
    leading, ringed = _jump(stash, heads, _Step(False))
    leading = leading.join(loops.select(F.col("node").alias("e"), F.col("low").alias("e_low")), F.col("ptr") == F.col("e")).select(
        "node", F.col("e_low").alias("low"), F.lit(False).alias("on_cycle")
    )
    inner = _cycles(stash, ringed.select("node", "ptr", "low")).unionByName(leading)
    answer = loops.unionByName(inner).select(F.col("node").alias("s"), F.col("low").alias("root"), "on_cycle")
    behind = stash.put(bad.join(answer.select("s", "root"), F.col("ptr") == F.col("s")).select("node", "root"))
    caught = loops.select("node", F.col("low").alias("root")).unionByName(behind)
    if not paths:
        stash.keep_only(rest, loops, behind)
        return good.unionByName(caught.select("node", "root", F.lit(-1).cast("bigint").alias("depth"), F.lit(True).alias("in_cycle")))

    ring = loops.where("on_cycle").select("node").unionByName(
        bad.join(inner.where("on_cycle").select("node"), "node", "left_semi").select(F.explode("trail").alias("node"))
    )
    ring = stash.put(ring.distinct())
    cut = (
        known.join(caught.select("node"), "node", "left_semi")
        .join(ring.withColumn("on_ring", F.lit(True)), "node", "left")
        .select("node", F.when(F.col("on_ring").isNull(), F.col("parent")).alias("parent"))
    )
    trails = resolve(stash.put(cut), True, stash).select("node", "path")
    return good.unionByName(
        caught.join(trails, "node").select("node", "root", F.lit(-1).cast("bigint").alias("depth"), F.lit(True).alias("in_cycle"), "path")
    )


def descendants(tree: DataFrame) -> DataFrame:
    """Pairs ``(ancestor, node, distance)`` for every node below another, from a result with paths.

    One row per pair, so that no ancestor's descendants are gathered in one place.
    """
    size = F.size("path")
    return tree.select("node", F.posexplode("path").alias("at", "ancestor"), size.alias("n")).where("ancestor <> node").select(
        "ancestor", "node", (F.col("n") - 1 - F.col("at")).cast("bigint").alias("distance")
    )
