"""Blocks of the output grid and the scenes that reach into them.

Blocks: ``top, left, xsize, ysize``. Overlaps add a scene and its window in scene pixels, which
is not clipped and may lie partly outside the scene.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.grid import half_even, split_axis, split_axis_plain

#: Scenes up to this many are sent to every task; beyond, blocks and scenes meet in buckets.
BROADCAST_SCENES = 2000


def block_list(grid: DataFrame, block: int, plain: bool = False) -> DataFrame:
    """Blocks of each row (ncols, nrows) of ``grid``, its other columns kept."""
    split = split_axis_plain if plain else split_axis
    rows = grid.withColumn("_y", F.explode(split(F.col("nrows"), block)))
    both = rows.withColumn("_x", F.explode(split(F.col("ncols"), block)))
    return both.select("*", F.col("_y.start").alias("top"), F.col("_x.start").alias("left"), F.col("_x.size").alias("xsize"), F.col("_y.size").alias("ysize")).drop("_x", "_y")


def scene_windows(catalog: DataFrame, grid: DataFrame) -> DataFrame:
    """scene_id, ord, ncols, nrows and the scene's offset x0, y0 in output pixels."""
    g = F.broadcast(grid.select(F.col("x_min").alias("_x"), F.col("y_max").alias("_y"), F.col("x_res").alias("_xr"), F.col("y_res").alias("_yr")))
    return catalog.join(g).select("scene_id", "ord", "ncols", "nrows", half_even((F.col("gt.x0") - F.col("_x")) / F.col("_xr")).alias("x0"), half_even((F.col("_y") - F.col("gt.y0")) / F.col("_yr")).alias("y0"))


def _window(scenes: DataFrame) -> DataFrame:
    """Windows of the blocks in scene pixels, kept if any pixel is shared."""
    w = scenes.withColumn("in_left", F.col("left") - F.col("x0")).withColumn("in_top", F.col("top") - F.col("y0"))
    return w.where((F.col("in_left") + F.col("xsize") > 0) & (F.col("in_top") + F.col("ysize") > 0) & (F.col("in_left") < F.col("ncols")) & (F.col("in_top") < F.col("nrows")))


def _few(scenes: DataFrame) -> bool:
    return scenes.limit(BROADCAST_SCENES + 1).count() <= BROADCAST_SCENES


def overlaps_theta(blocks: DataFrame, scenes: DataFrame) -> DataFrame:
    """Every block against every scene. ValueError for more than ``BROADCAST_SCENES`` scenes, which are not broadcast."""
    if not _few(scenes):
        raise ValueError(f"more than {BROADCAST_SCENES} scenes; use overlaps_bucketed")
    return _window(blocks.join(F.broadcast(scenes)))


def _covered(start: Column, size: Column, block: int, last: Column) -> Column:
    """Block numbers an interval covers; the last block may be wider than the others."""
    clamp = lambda x: F.least(last, F.greatest(F.lit(0), F.floor(x / block).cast("int")))
    return F.sequence(clamp(start), clamp(start + size - 1))


def overlaps_bucketed(blocks: DataFrame, scenes: DataFrame, block: int) -> DataFrame:
    """The same by an equi-join: each scene goes to the block numbers it covers."""
    blocks = blocks.withColumn("_bx", F.floor(F.col("left") / block).cast("int")).withColumn("_by", F.floor(F.col("top") / block).cast("int"))
    last = F.broadcast(blocks.agg(F.max("_bx").alias("_lx"), F.max("_by").alias("_ly")))
    s = scenes.where("ncols > 0 AND nrows > 0").join(last)
    s = s.withColumn("_bx", F.explode(_covered(F.col("x0"), F.col("ncols"), block, F.col("_lx")))).withColumn("_by", F.explode(_covered(F.col("y0"), F.col("nrows"), block, F.col("_ly"))))
    return _window(blocks.join(s.drop("_lx", "_ly"), ["_bx", "_by"])).drop("_bx", "_by")


def overlaps(blocks: DataFrame, scenes: DataFrame, block: int) -> DataFrame:
    """The one of the two whose cost is bounded: the catalog's size is looked at first."""
    return _window(blocks.join(F.broadcast(scenes))) if _few(scenes) else overlaps_bucketed(blocks, scenes, block)


def read_plan(found: DataFrame) -> DataFrame:
    """Read tasks in block order, then scene order."""
    return found.orderBy("top", "left", "ord")


def assign_readers(found: DataFrame, readers: int) -> DataFrame:
    """Reader of each read task, dealt round robin in read order.

    The rank is the count of the row bands above, plus that of rows before within the band: no window holds all rows.
    """
    bands = found.groupBy("top").count()
    above = bands.withColumn("_above", F.coalesce(F.sum("count").over(Window.orderBy("top").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("top", "_above")
    within = F.row_number().over(Window.partitionBy("top").orderBy("left", "ord"))
    return found.join(above, "top").withColumn("reader", ((F.col("_above") + within - 1) % readers).cast("int")).drop("_above")


def empty_blocks(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """Blocks no scene reaches; they are written as nodata."""
    return blocks.join(found.select("top", "left").distinct(), ["top", "left"], "left_anti")


def completeness(expected: DataFrame, arrived: DataFrame) -> DataFrame:
    """top, left, expected, arrived, complete for each block with inputs."""
    e = expected.select("top", "left", "scene_id").distinct()
    a = arrived.select("top", "left", "scene_id").distinct().withColumn("_here", F.lit(1))
    return (e.join(a, ["top", "left", "scene_id"], "left").groupBy("top", "left").agg(F.count("*").alias("expected"), F.count("_here").alias("arrived"))
            .withColumn("complete", F.col("expected") == F.col("arrived")))


def remaining(expected: DataFrame, arrived: DataFrame) -> DataFrame:
    """scene_id, remaining: blocks each scene is still to be read for."""
    left = expected.join(arrived.select("top", "left", "scene_id").distinct(), ["top", "left", "scene_id"], "left_anti")
    return expected.select("scene_id").distinct().join(left.groupBy("scene_id").agg(F.countDistinct("top", "left").alias("remaining")), "scene_id", "left").na.fill(0, ["remaining"])
