"""Merging overlapping scenes, per pixel and per tile.

pixels: band (optional keys), row, col, ord, value, with NULL for nodata. A later scene (greater ord) wins where it has
a value. ``tiles`` hold a dense window: top, left, xsize, ysize, ord, pixels array.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _last(v: Column, o: Column) -> Column:
    return F.max_by(v, F.when(v.isNotNull(), o))


#: Merge strategies: (value, ord) -> aggregate. All are map-side combined; "last" is the mosaicking rule.
MERGES = {
    "last": _last,
    "first": lambda v, o: F.min_by(v, F.when(v.isNotNull(), o)),
    "min": lambda v, o: F.min(v),
    "max": lambda v, o: F.max(v),
    "mean": lambda v, o: F.avg(v),
    "count": lambda v, o: F.count(v),
}


def merge_pixels(pixels: DataFrame, merge: str = "last", keys=("row", "col")) -> DataFrame:
    """keys, value: one row a pixel that any scene covers; NULL if none has a value there."""
    if merge not in MERGES:
        raise ValueError(f"merge must be one of {sorted(MERGES)}")
    return pixels.groupBy(*keys).agg(MERGES[merge](F.col("value"), F.col("ord")).alias("value"))


def merge_by_window(pixels: DataFrame, keys=("row", "col")) -> DataFrame:
    """The last valid value by a window: keeps every scene's row next to the merged value; costs a sort."""
    w = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return pixels.withColumn("merged", F.last("value", ignorenulls=True).over(w))


def dense(merged: DataFrame, nrows: int, ncols: int, fill: float) -> DataFrame:
    """Every pixel of an nrows x ncols grid, ``fill`` where nothing was merged."""
    spark = merged.sparkSession
    grid = spark.range(nrows * ncols).select(F.floor(F.col("id") / ncols).alias("row"), (F.col("id") % ncols).alias("col"))
    return grid.join(merged, ["row", "col"], "left").withColumn("value", F.coalesce("value", F.lit(fill)))


def bounding_box(df: DataFrame, top: int, left: int, bottom: int, right: int) -> DataFrame:
    """Rows of a half-open pixel window. On merged pixels, Spark moves it below the merge to the scan."""
    return df.where((F.col("row") >= top) & (F.col("row") < bottom) & (F.col("col") >= left) & (F.col("col") < right))


def _dense(batches, nodata: float, names: list[str]):
    """Dense tiles of cells (_tile, k, value and ``names``) sorted by tile: every tile of a batch is filled at once."""
    kinds = None

    def filled(t: pa.Table):
        tile, k, v = (t.column(c).to_numpy() for c in ("_tile", "k", "value"))
        start = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
        first = t.select(names).take(pa.array(start))
        size = first.column("xsize").to_numpy().astype(np.int64) * first.column("ysize").to_numpy()
        ends = np.cumsum(size)
        flat = np.full(ends[-1], nodata)
        flat[np.repeat(ends - size, np.diff(np.append(start, len(tile)))) + k] = v
        pixels = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(flat))
        return pa.RecordBatch.from_arrays([*(first.column(c).combine_chunks() for c in names), pixels], names=[*names, "pixels"])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        kinds = kinds or batch.schema
        t = pa.Table.from_batches([batch], kinds)
        held = t if held is None else pa.concat_tables([held, t])
        tile = held.column("_tile").to_numpy()
        last = len(tile) - int(np.argmax(tile[::-1] != tile[-1])) if (tile != tile[-1]).any() else 0
        if last:  # the last tile may go on
            yield filled(held.slice(0, last))
            held = held.slice(last)
    if held is not None:
        yield filled(held)


def to_tiles(pixels: DataFrame, tile: int, nrows: int, ncols: int, nodata: float, keys=("ord",)) -> DataFrame:
    """Dense tiles of side ``tile`` (less at the edges) of each scene, for those it reaches."""
    p = pixels.withColumn("top", (F.floor(F.col("row") / tile) * tile).cast("int")).withColumn("left", (F.floor(F.col("col") / tile) * tile).cast("int"))
    p = p.withColumn("xsize", F.least(F.lit(tile), F.lit(ncols) - F.col("left"))).withColumn("ysize", F.least(F.lit(tile), F.lit(nrows) - F.col("top")))
    at = (F.col("row") - F.col("top")) * F.col("xsize") + F.col("col") - F.col("left")
    names = [*keys, "top", "left", "xsize", "ysize"]
    p = p.where("value IS NOT NULL").select(*names, at.cast("int").alias("k"), F.col("value").cast("double").alias("value")).withColumn("_tile", F.xxhash64(*keys, "top", "left"))
    kinds = {f.name: f.dataType.simpleString() for f in p.schema}
    # Sorted by tile and then streamed: a task holds a batch, not a scene.
    p = p.repartition("_tile").sortWithinPartitions("_tile")
    return p.mapInArrow(partial(_dense, nodata=float(nodata), names=names), ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", pixels array<double>")


def merge_tiles(tiles: DataFrame, nodata: float) -> DataFrame:
    """top, left, xsize, ysize, pixels: tiles of one place overlaid in order, cell by cell, by built-in functions."""
    valid = (lambda b: ~F.isnan(b)) if nodata != nodata else (lambda b: b != nodata)
    over = lambda a, b: F.zip_with(a, b, lambda x, y: F.when(valid(y), y).otherwise(x))
    same = lambda a, b: F.when(F.size(a) == F.size(b), over(a, b)).otherwise(F.raise_error("tiles of one place differ in size").cast("array<double>"))
    # A place has as many tiles as scenes reach it.
    g = tiles.groupBy("top", "left", "xsize", "ysize").agg(F.array_sort(F.collect_list(F.struct("ord", "pixels"))).alias("t"))
    rest = F.slice("t", F.lit(2), F.size("t"))
    return g.select("top", "left", "xsize", "ysize", F.aggregate(rest, F.col("t")[0]["pixels"], lambda a, x: same(a, x["pixels"])).alias("pixels"))


def to_pixels(tiles: DataFrame, nodata: float) -> DataFrame:
    """The tiles' pixels as rows; nodata becomes NULL."""
    from gridloom.functions.grid import null_if_nodata

    x = tiles.select("*", F.posexplode("pixels").alias("_at", "_v"))
    return x.withColumn("row", F.col("top") + F.floor(F.col("_at") / F.col("xsize"))).withColumn("col", F.col("left") + F.col("_at") % F.col("xsize")).withColumn(
        "value", null_if_nodata(F.col("_v"), nodata)).drop("_at", "_v", "pixels", "top", "left", "xsize", "ysize")


def difference(a: DataFrame, b: DataFrame, keys=("row", "col")) -> DataFrame:
    """One row: cells in either raster, and cells that differ, a cell of one side only included."""
    x = a.select(*keys, F.col("value").alias("_a"))
    y = b.select(*keys, F.col("value").alias("_b"))
    return x.join(y, list(keys), "full_outer").agg(F.count("*").alias("cells"), F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("differing"))


class ComparisonError(AssertionError):
    """Two rasters that should be equal are not."""


def assert_equal(a: DataFrame, b: DataFrame) -> None:
    d = difference(a, b).first()
    if d.differing:
        raise ComparisonError(f"{d.differing} of {d.cells} cells differ")
