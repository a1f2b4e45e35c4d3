"""All pairs of records whose sets overlap above a Jaccard threshold, within or between tables.

Method
    1. Records with the same set form a class; from here on one row stands for a class, so copies
       cost nothing, however many there are.
    2. Minwise signatures, split into bands: two sets meet in a bucket of some band with probability
       1 - (1 - J^rows)^bands.  ``bands_for`` takes so many that a pair at the threshold is missed
       less often than once in a million.
    3. Classes that share a bucket are candidates.  A bucket is not joined as a whole: it is cut
       into blocks of at most ``BLOCK`` classes and each pair of blocks is a group of its own, so a
       crowded bucket spreads over many tasks.  Sizes too far apart for the threshold are dropped.
    4. Candidates are deduplicated and verified on the sets themselves, in integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.storage import Stash, spread

BLOCK = 200
MISS = 1e-6


def bands_for(threshold: float, rows: int, miss: float = MISS) -> int:
    """Bands at which a pair at the threshold escapes with probability below ``miss``."""
    return math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))


def _bands(bands: int, rows: int, seed: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        keys = rng.integers(0, 2**63, size=bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        salts = rng.integers(0, 2**63, size=bands * rows, dtype=np.uint64)

        def mix(x: np.ndarray) -> np.ndarray:
            x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
            x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
            return x ^ (x >> np.uint64(33))

        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                lists = batch.column("hashes")
                offsets = np.asarray(lists.offsets)
                flat = np.asarray(lists.values)[offsets[0] : offsets[-1]].astype(np.int64).view(np.uint64)
                starts = (offsets[:-1] - offsets[0]).astype(np.int64)
                out = np.empty((batch.num_rows, bands), dtype=np.uint64)
                for band in range(bands):
                    acc = np.full(batch.num_rows, np.uint64(band), dtype=np.uint64)
                    for i in range(band * rows, (band + 1) * rows):
                        low = np.minimum.reduceat(mix((flat + salts[i]) * keys[i]), starts)
                        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + low)
                    out[:, band] = acc
                values = pa.array(out.reshape(-1).view(np.int64))
                listed = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, bands), pa.int32()), values)
                yield pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("size"), listed], ["cls", "size", "buckets"])

    return sign


def classes(df: DataFrame, record: str, elements: Column, stash: Stash) -> tuple[DataFrame, DataFrame]:
    """(classes: cls, size, els; members: record, cls).

    A class is named by 128 bits of a digest of its set.  ``elements`` is an array<string> column.  Rows of one record are united; nulls in the array, null
    arrays and null records are left out, and so are records whose set is empty: they have no pairs.
    """
    each = df.where(F.col(record).isNotNull()).select(F.col(record).cast("string").alias("record"), F.array_sort(F.array_compact(F.array_distinct(elements))).alias("els"))
    united = each.where(F.size("els") > 0).groupBy("record").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("els")))).alias("els"))
    united = stash.put(united.select("record", "els", F.unhex(F.substring(F.sha2(F.to_json("els"), 256), 1, 32)).alias("cls")))
    kinds = united.groupBy("cls").agg(F.first("els").alias("els"))
    return stash.put(kinds.select("cls", F.size("els").alias("size"), "els")), united.select("record", "cls")


def similar_classes(kinds: DataFrame, stash: Stash, num: int, den: int, rows: int = 3, seed: int = 7) -> DataFrame:
    """``a, b, common``: classes a < b with den * common >= num * union, each pair once."""
    spark = kinds.sparkSession
    bands = bands_for(num / den, rows)
    hashed = kinds.select("cls", "size", F.transform("els", lambda e: F.xxhash64(e)).alias("hashes"))
    signed = spread(spark, hashed, "cls").mapInArrow(_bands(bands, rows, seed), "cls binary, size int, buckets array<bigint>")
    placed = stash.put(signed.select("cls", "size", F.explode("buckets").alias("bucket")))
    crowd = placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    known = placed.join(crowd, "bucket").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("cls", F.lit("block")), F.col("blocks")).cast("int")
    meets = known.withColumn("own", own).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    meets = meets.select("bucket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "cls", "size")
    a, b = meets.alias("a"), meets.alias("b")
    fits = (F.col("a.size") * den >= F.col("b.size") * num) & (F.col("b.size") * den >= F.col("a.size") * num)
    same = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.x") == F.col("b.x")) & (F.col("a.y") == F.col("b.y"))
    # within a block both sides are of it; between two blocks one side is of each
    across = F.when(F.col("a.x") == F.col("a.y"), F.lit(True)).otherwise(F.col("a.own") != F.col("b.own"))
    pairs = a.join(b, same & (F.col("a.cls") < F.col("b.cls")) & across & fits).select(F.col("a.cls").alias("a"), F.col("b.cls").alias("b")).distinct()
    left = kinds.select(F.col("cls").alias("a"), F.col("els").alias("els_a"))
    right = kinds.select(F.col("cls").alias("b"), F.col("els").alias("els_b"))
    common = F.size(F.array_intersect("els_a", "els_b"))
    checked = pairs.join(left, "a").join(right, "b").withColumn("common", common)
    union = F.size("els_a") + F.size("els_b") - F.col("common")
    return checked.where(F.col("common") * den >= union * num).select("a", "b", "common")


def similar_pairs(df: DataFrame, record: str, elements: Column, num: int = 7, den: int = 10) -> DataFrame:
    """``record_a, record_b``, a < b: all pairs of records whose sets reach the Jaccard index num/den.

    Identical sets are pairs too.  Empty sets, null sets and null records have none.  An element is
    compared as a string; repeated elements count once; rows of one record are united.
    """
    stash = Stash(df.sparkSession, "setjoin")
    kinds, members = classes(df, record, elements, stash)
    linked = stash.put(similar_classes(kinds, stash, num, den))
    a = members.select(F.col("record").alias("ra"), F.col("cls").alias("a"))
    b = members.select(F.col("record").alias("rb"), F.col("cls").alias("b"))
    across = linked.join(a, "a").join(b, "b").select(F.least("ra", "rb").alias("record_a"), F.greatest("ra", "rb").alias("record_b"))
    alike = a.join(b, (F.col("a") == F.col("b")) & (F.col("ra") < F.col("rb"))).select(F.col("ra").alias("record_a"), F.col("rb").alias("record_b"))
    return across.unionByName(alike)


def links_per_record(df: DataFrame, record: str, elements: Column, num: int = 7, den: int = 10) -> DataFrame:
    """``record, representative, copies, links``: each record with the least record of its class of equal
    sets, the records of that class, and how many records with another set it is similar to.  Copies are not expanded."""
    stash = Stash(df.sparkSession, "setjoin")
    kinds, members = classes(df, record, elements, stash)
    linked = stash.put(similar_classes(kinds, stash, num, den))
    copies = members.groupBy("cls").agg(F.min("record").alias("representative"), F.count("*").alias("copies"))
    both = linked.select(F.col("a").alias("cls"), F.col("b").alias("other")).unionByName(linked.select(F.col("b").alias("cls"), F.col("a").alias("other")))
    links = both.join(copies.select(F.col("cls").alias("other"), "copies"), "other").groupBy("cls").agg(F.sum("copies").alias("links"))
    facts = copies.join(links, "cls", "left").select("cls", "representative", "copies", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
    return members.join(facts, "cls").select("record", "representative", "copies", "links")


def similar_between(left: DataFrame, right: DataFrame, record: str, elements: Column, num: int = 7, den: int = 10) -> DataFrame:
    """``record_left, record_right``: pairs across two tables, identical sets included."""
    stash = Stash(left.sparkSession, "setjoin")
    kl, ml = classes(left, record, elements, stash)
    kr, mr = classes(right, record, elements, stash)
    kinds = stash.put(kl.unionByName(kr).groupBy("cls").agg(F.first("size").alias("size"), F.first("els").alias("els")))
    linked = stash.put(similar_classes(kinds, stash, num, den))
    every = linked.select("a", "b").unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(kinds.select(F.col("cls").alias("a"), F.col("cls").alias("b")))
    l, r = ml.select(F.col("record").alias("record_left"), F.col("cls").alias("a")), mr.select(F.col("record").alias("record_right"), F.col("cls").alias("b"))
    return every.join(l, "a").join(r, "b").select("record_left", "record_right")
