"""Benchmark job lists from a tile search, and percentiles of their timings.

tiles_by_date: date, tilename, path, null_pcnt
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.prefix import quantiles


def by_date(tiles: DataFrame) -> DataFrame:
    """date, tiles: the tiles of each date, by name."""
    return tiles.groupBy("date").agg(F.sort_array(F.collect_list(F.struct("tilename", "path", "null_pcnt"))).alias("tiles"))


def dates_with(tiles: DataFrame, n: int = 9) -> DataFrame:
    return tiles.groupBy("date").agg(F.count("*").alias("n")).where(F.col("n") == n)


def search(items: DataFrame, box: tuple[float, float, float, float], year: int) -> DataFrame:
    """Items (datetime, lon_min, lat_min, lon_max, lat_max, tilename, path, null_pcnt) of a year that meet a box, with their date."""
    a, b, c, d = box
    date = F.split("datetime", "T")[0]
    return (items.where((F.col("lon_max") >= a) & (F.col("lon_min") <= c) & (F.col("lat_max") >= b) & (F.col("lat_min") <= d)).withColumn("date", date)
            .where(F.col("date").startswith(f"{year}-")).select("date", "tilename", "path", "null_pcnt"))


def job_list(tiles: DataFrame, bands: list[str], n: int = 9, old: str = "s3:/", new: str = "/vsis3") -> DataFrame:
    """date, band, paths for each date of exactly n tiles and each band: the path below the band, rewritten."""
    spark = tiles.sparkSession
    b = F.broadcast(spark.createDataFrame([(x,) for x in bands], "band string"))  # a handful of names
    full = tiles.join(dates_with(tiles, n).select("date"), "date").crossJoin(b)
    path = F.concat(F.replace(F.col("path"), F.lit(old), F.lit(new)), F.lit("/"), F.col("band"), F.lit(".tif"))
    return full.groupBy("date", "band").agg(F.transform(F.sort_array(F.collect_list(F.struct("tilename", path.alias("p")))), lambda x: x["p"]).alias("paths"))


def first_jobs(jobs: DataFrame, n: int = 40) -> DataFrame:
    return jobs.orderBy("date", "band").limit(n)


def percentiles(timings: DataFrame, value: str, by=()) -> DataFrame:
    """by, p5, p50, p95 with linear interpolation, count. No group is held in one task."""
    return quantiles(timings, value, {"p5": 0.05, "p50": 0.5, "p95": 0.95}, by)
