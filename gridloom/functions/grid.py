"""Column expressions on integer grids: axis splits, overview levels, nodata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: Column) -> Column:
    """Nearest integer, halves to the even one."""
    return F.rint(x).cast("int")


def split_axis(n: Column, block: int) -> Column:
    """Array of (start, size) along one axis. A remainder under a quarter block widens the last block."""
    rest = n % block
    count = F.when(n > 0, F.greatest(F.lit(1), F.floor(n / block) + ((rest > 0) & (rest >= block // 4)).cast("int"))).otherwise(0).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda k: F.struct((k * block).alias("start"), F.when(k < count - 1, F.lit(block)).otherwise(n - (count - 1) * block).cast("int").alias("size")))


def split_axis_plain(n: Column, block: int) -> Column:
    """Array of (start, size) with the remainder as a block of its own."""
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(block))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(F.lit(block), n - s).cast("int").alias("size")))


def overview_levels(width: Column, height: Column, least: int) -> Column:
    """4, 8, 16, ... as long as the longer side divided by the level is at least ``least``."""
    size = F.greatest(width, height)
    return F.filter(F.transform(F.sequence(F.lit(2), F.lit(30)), lambda i: F.call_function("shiftleft", F.lit(1), i)), lambda x: F.floor(size / x) >= least)


def null_if_nodata(value: Column, nodata: float | None) -> Column:
    """NULL for the sentinel; NaN as sentinel means NaN."""
    if nodata is None:
        return value
    if nodata != nodata:
        return F.when(~F.isnan(value), value)
    return F.when(value != F.lit(nodata), value)


def window_clip(start: Column, size: Column, limit: Column) -> Column:
    """The part of [start, start + size) inside [0, limit), and how far it is shifted."""
    low = F.greatest(start, F.lit(0))
    return F.struct(low.alias("start"), F.greatest(F.least(start + size, limit) - low, F.lit(0)).alias("size"), F.greatest(-start, F.lit(0)).alias("shift"))
