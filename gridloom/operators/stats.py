"""Band statistics and overviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def band_stats(pixels: DataFrame, by=()) -> DataFrame:
    """by, minval, maxval, meanval, stddev (of the population), count of the valid values; no row for none."""
    v = F.col("value")
    g = pixels.groupBy(*by).agg(F.min(v).alias("minval"), F.max(v).alias("maxval"), F.avg(v).alias("meanval"), F.stddev_pop(v).alias("stddev"), F.count(v).alias("count"))
    return g.where("count > 0")


def band_stats_by_squares(pixels: DataFrame, by=()) -> DataFrame:
    """The same with stddev from sums and sums of squares, a negative variance counting as 0."""
    v = F.col("value")
    g = pixels.groupBy(*by).agg(F.min(v).alias("minval"), F.max(v).alias("maxval"), F.sum(v).alias("s"), F.sum(v * v).alias("q"), F.count(v).alias("count")).where("count > 0")
    mean = F.col("s") / F.col("count")
    return g.select(*by, "minval", "maxval", mean.alias("meanval"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("count") - mean * mean)).alias("stddev"), "count")


def approximate_stats(pixels: DataFrame, fraction: float = 0.1, by=(), seed: int = 0) -> DataFrame:
    """band_stats of a sample of the pixels."""
    return band_stats(pixels.sample(fraction, seed), by)


def overview(pixels: DataFrame, level: int) -> DataFrame:
    """Every ``level``-th pixel, from the middle of the first step on; nulls are sampled like values.

    The filter uses grouping columns only, so on merged pixels it moves below the merge.
    """
    half = level // 2
    return pixels.where((F.col("row") % level == half) & (F.col("col") % level == half)).withColumn("row", F.floor(F.col("row") / level)).withColumn("col", F.floor(F.col("col") / level))


def gauge(df: DataFrame, value: str, by=()) -> DataFrame:
    """by, low, high."""
    return df.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"))
