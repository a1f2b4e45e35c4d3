"""How often every distinct term occurs, and in how many records.

Method: last-seen counters.  Rows are hash-partitioned by record and sorted by it, so a partition sees
each of its records in one piece.  Every term keeps three numbers: occurrences, records, and the last
record that had it; a token adds to the records only if its record is not the last one seen.  No set
of records is kept for any term.  Partitions hold disjoint records, so their counters add up: they are
hash-partitioned by term and summed.  A term in every record arrives as one row per partition and
flush, which is what keeps the hottest terms from filling one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.storage import spread

TERM = r"[\p{L}\p{N}_]{3,}"
#: Counters a task holds before it passes them on; flushed between records only.
MAX_COUNTERS = 500_000


def _counted(pattern: str, max_counters: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        number = 0  # of the current record within the task: its identifier in the counters
        last_record = last_text = None
        counters: dict[str, list[int]] = {}

        def flush() -> pa.RecordBatch:
            rows = counters.values()
            out = pa.RecordBatch.from_arrays(
                [pa.array(counters.keys(), pa.string()), pa.array([c[0] for c in rows], pa.int64()), pa.array([c[1] for c in rows], pa.int64())],
                ["term", "occurrences", "records"],
            )
            counters.clear()
            return out

        for batch in batches:
            for record, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if record != last_record:
                    number, last_record, last_text = number + 1, record, None
                    if len(counters) >= max_counters:
                        yield flush()
                elif text == last_text:
                    continue
                last_text = text
                for term in find(text.lower()):
                    counter = counters.get(term)
                    if counter is None:
                        counters[term] = [1, 1, number]
                    else:
                        counter[0] += 1
                        if counter[2] != number:
                            counter[1] += 1
                            counter[2] = number
        if counters:
            yield flush()

    return count


def term_counts(df: DataFrame, record: str, text: str, pattern: str = TERM, max_counters: int = MAX_COUNTERS) -> DataFrame:
    """``term, occurrences, records`` over all of ``df``.

    Terms are the matches of ``pattern`` in the lower-cased text.  Rows that repeat a record with the
    same text count once; different texts of one record are all counted, as one record.  Rows without
    a record or a text give no terms.  An empty table gives an empty result.
    """
    rows = df.select(F.col(record).alias("record"), F.col(text).cast("string").alias("text")).where("record IS NOT NULL AND text <> ''")
    parted = spread(df.sparkSession, rows, "record").sortWithinPartitions("record", "text")
    partial = parted.mapInArrow(_counted(pattern, max_counters), "term string, occurrences bigint, records bigint")
    return partial.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def mark_terms(counts: DataFrame, n_records: DataFrame, rare_below: int = 5, common_above: float = 1 / 20) -> DataFrame:
    """``counts`` with ``mark``: ``rare`` (in fewer than ``rare_below`` records), else ``common`` (in
    more than ``common_above`` of all), else null.  ``n_records`` is one row with column ``n``."""
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > F.col("n") * F.lit(common_above), "common")
    return counts.join(F.broadcast(n_records), how="cross").select("term", "occurrences", "records", mark.alias("mark"))


def record_count(df: DataFrame, record: str) -> DataFrame:
    """One row: the distinct non-null records, those without text included."""
    return df.select(F.col(record).alias("r")).where("r IS NOT NULL").distinct().agg(F.count("*").alias("n"))
