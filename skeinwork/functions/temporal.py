"""Times as they come in the raw tables, and their buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LAYOUTS = ["yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy/MM/dd HH:mm:ss"]


def parse_time(text: Column) -> Column:
    """TIMESTAMP_NTZ from ISO text (with 'T', 'Z', fractions) and two further layouts; null if unreadable.
    A trailing Z is dropped: all times are taken as UTC."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), r"Z$", ""), r"^(\d{4}-\d{2}-\d{2})T", "$1 ")
    return F.coalesce(*[F.try_to_timestamp(plain, F.lit(layout)) for layout in _LAYOUTS]).cast("timestamp_ntz")


def time_of_day(hour: Column) -> Column:
    return F.when((hour >= 5) & (hour < 12), "morning").when((hour >= 12) & (hour < 17), "afternoon").when((hour >= 17) & (hour < 22), "evening").otherwise("night")


def period_of_day(hour: Column) -> Column:
    return F.when(hour < 6, "night").when(hour < 12, "morning").when(hour < 18, "afternoon").otherwise("evening")


def gap_seconds(later: Column, earlier: Column) -> Column:
    """Seconds between two times, with fractions."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1e6
