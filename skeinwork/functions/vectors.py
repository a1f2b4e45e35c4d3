"""Array arithmetic and scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + eps)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v))


def scaling(df: DataFrame, columns: list[str], method: str = "minmax") -> DataFrame:
    """One row of parameters: ``{c}_low`` and ``{c}_span`` for each column.

    minmax: minimum and range.  zscore: mean and population deviation.  A span of zero becomes one.
    Nulls are left out; a column without values has the parameters null.
    """
    aggs = []
    for c in columns:
        low, span = (F.min(c), F.max(c) - F.min(c)) if method == "minmax" else (F.avg(c), F.stddev_pop(c))
        aggs += [low.cast("double").alias(f"{c}_low"), F.when(span == 0, 1.0).otherwise(span.cast("double")).alias(f"{c}_span")]
    return df.agg(*aggs)


def scale(df: DataFrame, columns: list[str], parameters: DataFrame) -> DataFrame:
    """``df`` with the columns scaled by stored parameters (one row, so a broadcast of fixed size)."""
    joined = df.join(F.broadcast(parameters), how="cross")
    return joined.withColumns({c: (F.col(c) - F.col(f"{c}_low")) / F.col(f"{c}_span") for c in columns}).drop(*parameters.columns)


def standardise_sample(df: DataFrame, columns: list[str], eps: float = 1e-6) -> DataFrame:
    """(x - mean) / (sample deviation + eps) for each column."""
    stats = df.agg(*[e for c in columns for e in (F.avg(c).alias(f"{c}_low"), (F.stddev_samp(c) + eps).alias(f"{c}_span"))])
    return scale(df, columns, stats)


def moments(a: Column) -> dict[str, Column]:
    """Mean, population variance, mean absolute value, norm and skewness (0 without spread) of an array."""
    n = F.size(a)
    total = lambda f: F.aggregate(F.transform(a, lambda v: f(v.cast("double"))), F.lit(0.0), lambda s, v: s + v)
    mean = total(lambda v: v) / n
    variance = total(lambda v: (v - mean) * (v - mean)) / n
    third = total(lambda v: (v - mean) * (v - mean) * (v - mean)) / n
    return {"mean": mean, "variance": variance, "mean_abs": total(F.abs) / n, "norm": norm(a), "skewness": F.when(variance > 0, third / F.pow(variance, 1.5)).otherwise(0.0)}
