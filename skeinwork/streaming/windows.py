"""Window aggregates and user counters over an event stream; the same plans run on batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, ts: str, width: str, kind: str, value: str, late: str = "1 hour") -> DataFrame:
    """``start, kind, n, total`` of windows of a width; on a stream, rows later than ``late`` are dropped
    and a window comes out once the watermark has passed its end."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, width), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), kind, "n", "total")


def sliding(events: DataFrame, ts: str, width: str, step: str, kind: str, value: str, late: str = "1 hour") -> DataFrame:
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, width, step), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), kind, "n", "total")


def sessions(events: DataFrame, ts: str, gap: str, user: str, late: str = "1 hour") -> DataFrame:
    """``user, start, end, n``: activity without a pause longer than ``gap``."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(ts, gap), user).agg(F.count("*").alias("n")).select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def running_totals(scored: DataFrame, user: str, score: str, cut: float = 0.3) -> DataFrame:
    """Running totals of users over a stream: comments, sum, maximum and number above the cut, as state."""
    kind = scored.schema[user].dataType.simpleString()

    def update(key, frames: Iterator[pd.DataFrame], state):
        n, total, top, above = state.get if state.exists else (0, 0.0, float("-inf"), 0)
        for frame in frames:
            s = frame[score].dropna()
            n, total, above = n + len(frame), total + float(s.sum()), above + int((s > cut).sum())
            top = max(top, float(s.max())) if len(s) else top
        state.update((n, total, top, above))
        yield pd.DataFrame({user: [key[0]], "comments": [n], "total": [total], "top": [None if top == float("-inf") else top], "above": [above]})

    schema = f"{user} {kind}, comments bigint, total double, top double, above bigint"
    return scored.groupBy(user).applyInPandasWithState(update, schema, "n bigint, total double, top double, above bigint", "update", "NoTimeout")
