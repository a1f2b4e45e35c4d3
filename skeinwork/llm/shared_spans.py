"""Long spans that appear verbatim in more than one record.

A window is a stretch of ``span`` characters.  A character is shared if some window over it is found
in another record.  All windows of all texts take part; the work is cut down without losing any:

1. *Anchors.*  Every window names its anchor, the least hash among the shorter grams in it.  Equal
   windows have equal anchors, and neighbours mostly share one, so there are some 4 anchors for 100
   characters.  Windows in a row with one anchor form a *run* of at most span - gram + 1 windows.
2. *Count-min prefilter.*  Each partition counts its anchors in a sketch of ``DEPTH`` rows whose
   counters stop at two; the sketches are merged slice by slice on the executors.  A count-min
   sketch never underestimates, so an anchor estimated at one record has no equal elsewhere, and its
   windows cannot be shared.  The sketch grows with the corpus up to ``MAX_BITS``, what a task may
   hold in memory.  Anchors that pass are grouped by their hashes, in eight bytes each, and those of
   one record drop out: beyond the largest sketch this second filter does what a larger one would.
3. *Exact second pass.*  The runs of the anchors left are hashed window by window.  Runs are grouped
   by their whole text, so copies collapse on the map side, and the windows of the distinct runs are
   grouped by 128-bit hashes; a window with more than one record is shared.  A group keeps the least
   and greatest record only.
4. *Coverage.*  Shared windows return to their runs as bit masks and are united for each record.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.storage import Stash, spread

DEPTH = 2
MIN_BITS, MAX_BITS = 20, 26
SLICE = 1 << 20
#: Characters of one text that are hashed at a time; slices overlap so that every window is in one.
CHUNK = 1 << 18


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse, at least n of each."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 4096)
        base = _BASES[which]
        inverse = pow(base, -1, 1 << 64)
        tables = []
        for b in (base, inverse):
            steps = np.full(size, b, dtype=np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        _powers[which] = have = (tables[0], tables[1])
    return have


def window_hashes(codes: np.ndarray, length: int, which: int) -> np.ndarray:
    """A 64-bit hash of every stretch of ``length`` code points, by prefix sums modulo 2^64."""
    n = len(codes)
    if n < length:
        return np.empty(0, dtype=np.uint64)
    power, inverse = _power_table(which, n + 1)
    terms = _mix(codes.astype(np.uint64), 0x1234567 + which) * power[:n]
    prefix = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(terms, dtype=np.uint64)])
    return _mix((prefix[length:] - prefix[:-length]) * inverse[: n - length + 1], which)


def runs_of(text: str, span: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(starts, sizes, anchors, codes offset by chunk) of the runs of windows with one anchor.

    Yields per chunk: run starts (in the whole text), run sizes in windows, anchor hashes, codes.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    for at in range(0, len(codes) - span + 1, CHUNK):
        part = codes[at : at + CHUNK + span - 1]
        grams = window_hashes(part, gram, 0)
        width = span - gram + 1
        least = np.lib.stride_tricks.sliding_window_view(grams, width)
        where = least.argmin(axis=1) + np.arange(len(least))
        cuts = np.flatnonzero(np.diff(where)) + 1
        first = np.concatenate([[0], cuts])
        sizes = np.diff(np.concatenate([first, [len(where)]]))
        yield first + at, sizes, grams[where[first]], part


def _positions(anchors: np.ndarray, depth: int, bits: int) -> np.ndarray:
    return (_mix(anchors, 0xABCD + depth) >> np.uint64(64 - bits)).astype(np.int64)


RUNS = "starts array<bigint>, sizes array<int>, anchors array<bigint>"


def _anchors_of(span: int, gram: int):
    """Texts to their runs, by chunks: columns key and tid, and the starts, sizes and anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]

            def made() -> pa.RecordBatch:
                at, starts, sizes, anchors = out
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in starts])]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).astype(t, copy=False))) for x, t in ((starts, np.int64), (sizes, np.int32))]
                lists.append(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(anchors).view(np.int64))))
                picked = batch.select(["key", "tid"]).take(pa.array(at))
                for x in out:
                    x.clear()
                return pa.RecordBatch.from_arrays([*picked.columns, *lists], ["key", "tid", "starts", "sizes", "anchors"])

            for i, text in enumerate(batch.column("text").to_pylist()):
                for starts, sizes, anchors, _ in runs_of(text, span, gram):
                    for x, v in zip(out, (i, starts, sizes, anchors)):
                        x.append(v)
                if len(out[0]) >= 1000:
                    yield made()
            if out[0]:
                yield made()

    return run


def _flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths) of a list column."""
    lists = batch.column(name)
    offsets = np.asarray(lists.offsets)
    return np.asarray(lists.values)[offsets[0] : offsets[-1]], np.diff(offsets)


def anchor_sketch(runs: DataFrame, bits: int) -> DataFrame:
    """Merged sketch as rows (depth, slice, twice): packed bits of 'seen again'."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((DEPTH, 1 << bits), dtype=np.uint8)
        filled = False
        for batch in batches:
            anchors, lengths = _flat(batch, "anchors")
            filled = filled or len(anchors) > 0
            owner = np.repeat(np.arange(len(lengths)), lengths)
            # an anchor counts once for each text
            order = np.lexsort((anchors, owner))
            a, o = anchors[order], owner[order]
            first = np.concatenate([[True], (a[1:] != a[:-1]) | (o[1:] != o[:-1])]) if len(a) else np.empty(0, dtype=bool)
            once = a[first].view(np.uint64)
            for d in range(DEPTH):
                values, number = np.unique(_positions(once, d, bits), return_counts=True)
                counts[d, values] = np.minimum(counts[d, values] + np.minimum(number, 2), 2)
        if filled:
            step = min(SLICE, 1 << bits)
            for d in range(DEPTH):
                for s in range(0, 1 << bits, step):
                    part = counts[d, s : s + step]
                    if part.any():
                        once, twice = zlib.compress(np.packbits(part >= 1), 1), zlib.compress(np.packbits(part >= 2), 1)
                        yield pa.RecordBatch.from_pydict({"depth": pa.array([d], pa.int32()), "slice": pa.array([s // step], pa.int32()), "once": [once], "twice": [twice]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}  # at most the sketch's own size
        for batch in batches:
            for d, s, a, b in zip(*(batch.column(i).to_pylist() for i in range(4))):
                a, b = np.frombuffer(zlib.decompress(a), np.uint8), np.frombuffer(zlib.decompress(b), np.uint8)
                once, twice = held.get((d, s), (np.zeros_like(a), np.zeros_like(b)))
                held[d, s] = once | a, twice | b | (once & a)
        for (d, s), (_, twice) in held.items():
            yield pa.RecordBatch.from_pydict({"depth": pa.array([d], pa.int32()), "slice": pa.array([s], pa.int32()), "twice": [zlib.compress(twice.tobytes(), 1)]})

    # one sketch a task: their number follows the cores, not the data
    tasks = 4 * runs.sparkSession.sparkContext.defaultParallelism
    parts = runs.select("anchors").coalesce(tasks).mapInArrow(local, "depth int, slice int, once binary, twice binary")
    return parts.repartition("depth", "slice").mapInArrow(merge, "depth int, slice int, twice binary")


def shared_chars(df: DataFrame, record: str, text: str, span: int = 100, gram: int | None = None) -> DataFrame:
    """``record, shared_chars, spans`` for each record with a shared character.

    ``shared_chars`` counts the code points of its text in stretches of at least ``span`` code points
    that stand verbatim in the text of another record; ``spans`` is an array of (start, length) of the
    maximal shared stretches, from 0.  Repetition within one record counts for nothing.  Null keys,
    null texts and texts shorter than ``span`` share nothing.  Rows that repeat a record and its text
    count once; different texts under one record are compared with other records only, and the
    positions reported are those of each text, united.
    """
    spark = df.sparkSession
    # a run has at most span - gram + 1 windows, and their coverage is a mask of 64 bits
    gram = max(gram or span // 2, span - 61, 1)
    key_type = df.schema[record].dataType.simpleString()
    stash = Stash(spark, "spans")
    rows = df.select(F.col(record).alias("key"), F.col(text).cast("string").alias("text")).where(F.col("key").isNotNull() & (F.char_length("text") >= span))
    rows = stash.put(spread(spark, rows, "key").withColumn("tid", F.xxhash64("text")))
    anchored = stash.put(rows.mapInArrow(_anchors_of(span, gram), f"key {key_type}, tid bigint, {RUNS}"))
    anchors = anchored.agg(F.sum(F.size("anchors").cast("bigint"))).first()[0] or 0
    bits = int(min(MAX_BITS, max(MIN_BITS, np.ceil(np.log2(max(1, anchors) * 8.0)))))
    sketch = [(r["depth"], r["slice"], bytes(r["twice"])) for r in anchor_sketch(anchored, bits).toLocalIterator()]  # at most DEPTH * 2^MAX_BITS bits
    shipped = spark.sparkContext.broadcast((bits, sketch))

    def estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The runs whose anchor the sketch has seen again."""
        bits, slices = shipped.value
        twice = np.zeros((DEPTH, (1 << bits) // 8), dtype=np.uint8)
        step = min(SLICE, 1 << bits) // 8
        for d, s, packed in slices:
            twice[d, s * step : (s + 1) * step] = np.frombuffer(zlib.decompress(packed), np.uint8)
        for batch in batches:
            found, lengths = _flat(batch, "anchors")
            keep = np.ones(len(found), dtype=bool)
            for d in range(DEPTH):
                p = _positions(found.view(np.uint64), d, bits)
                keep &= (twice[d, p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 == 1
            if keep.any():
                owner = pa.array(np.repeat(np.arange(len(lengths)), lengths)[keep])
                picked = batch.select(["key", "tid"]).take(owner)
                yield pa.RecordBatch.from_arrays(
                    [*picked.columns, pa.array(_flat(batch, "starts")[0][keep]), pa.array(_flat(batch, "sizes")[0][keep]), pa.array(found[keep])], ["key", "tid", "start", "size", "anchor"]
                )

    passed = stash.put(anchored.mapInArrow(estimated, f"key {key_type}, tid bigint, start bigint, size int, anchor bigint"))
    again = passed.groupBy("anchor").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select("anchor")
    left = passed.join(again, "anchor", "left_semi").groupBy("key", "tid").agg(F.collect_list(F.struct("start", "size")).alias("runs"))  # bounded by one text
    wanted = rows.join(left, ["key", "tid"]).select("key", "text", "runs.start", "runs.size")

    def hashed_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in range(5)]
        held = 0

        def batch_of() -> pa.RecordBatch:
            keys, starts, runs, h1, h2 = out
            sizes = np.array([len(x) for x in h1], dtype=np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            made = pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, key_arrow),
                    pa.array(starts, pa.int64()),
                    pa.array(runs, pa.binary()),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(h1).view(np.int64))),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(h2).view(np.int64))),
                ],
                ["key", "start", "run", "h1", "h2"],
            )
            for x in out:
                x.clear()
            return made

        for batch in batches:
            for key, text_, starts, sizes in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), batch.column("start").to_pylist(), batch.column("size").to_pylist()):
                codes = np.frombuffer(text_.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                starts, sizes = np.array(starts, dtype=np.int64), np.array(sizes, dtype=np.int64)
                for at in np.unique(starts // CHUNK) * CHUNK:
                    part = codes[at : at + CHUNK + span - 1]
                    first, second = window_hashes(part, span, 0), window_hashes(part, span, 1)
                    here = (starts >= at) & (starts < at + CHUNK)
                    for start, size in zip(starts[here], sizes[here]):
                        a = start - at
                        h1, h2 = first[a : a + size], second[a : a + size]
                        out[0].append(key)
                        out[1].append(int(start))
                        # the first and last window hashes with the size stand for the run's whole text
                        out[2].append(h1[:1].tobytes() + h2[:1].tobytes() + h1[-1:].tobytes() + h2[-1:].tobytes() + int(size).to_bytes(2, "little"))
                        out[3].append(h1)
                        out[4].append(h2)
                        held += size
                        if held > 200_000:
                            held = 0
                            yield batch_of()
        if out[0]:
            yield batch_of()

    from pyspark.sql.pandas.types import to_arrow_type

    key_arrow = to_arrow_type(df.schema[record].dataType)
    runs = stash.put(wanted.mapInArrow(hashed_runs, f"key {key_type}, start bigint, run binary, h1 array<bigint>, h2 array<bigint>"))
    kinds = stash.put(runs.groupBy("run").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.min(F.struct("h1", "h2")).alias("h")))
    windows = kinds.select("run", "low", "high", F.posexplode(F.arrays_zip(F.col("h.h1").alias("h1"), F.col("h.h2").alias("h2"))).alias("i", "w"))
    windows = windows.select("run", "low", "high", "i", F.col("w.h1").alias("h1"), F.col("w.h2").alias("h2"))
    shared = windows.groupBy("h1", "h2").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("h1", "h2")
    single = windows.where("low = high").select("run", "i", "h1", "h2")  # a run of several records is shared as a whole
    masks = single.join(shared, ["h1", "h2"]).groupBy("run").agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("mask"))
    whole = kinds.where("low < high").select("run", F.expr("CASE WHEN size(h.h1) >= 63 THEN -1L ELSE shiftleft(1L, size(h.h1)) - 1 END").alias("mask"))
    masks = masks.unionByName(whole)
    hits = runs.select("key", "start", "run").join(masks, "run").select("key", "start", "mask")

    @F.pandas_udf("array<struct<start:bigint,length:bigint>>")
    def stretches(starts: pd.Series, found: pd.Series) -> pd.Series:
        def one(begin, mask):
            bits_ = ((np.asarray(mask, dtype=np.int64).view(np.uint64)[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(bool)
            row, bit = np.nonzero(bits_)
            at = np.unique(np.asarray(begin, dtype=np.int64)[row] + bit)
            cut = np.flatnonzero(np.diff(at) > span) + 1
            first, last = at[np.concatenate([[0], cut])], at[np.concatenate([cut - 1, [len(at) - 1]])]
            return [{"start": int(a), "length": int(b - a + span)} for a, b in zip(first, last)]

        return pd.Series([one(s, m) for s, m in zip(starts, found)])

    per_record = hits.groupBy("key").agg(F.collect_list(F.struct("start", "mask")).alias("hits"))  # bounded by one text
    spans = per_record.select("key", stretches(F.col("hits.start"), F.col("hits.mask")).alias("spans"))
    total = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["length"])
    return spans.select(F.col("key").alias(record), total.alias("shared_chars"), "spans")
