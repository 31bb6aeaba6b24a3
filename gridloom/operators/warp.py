"""Reprojection and resampling of scenes to another grid."""

from __future__ import annotations

import warnings
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import geo

NEIGHBOURS = ("near", "bilinear", "cubic", "cubicspline", "lanczos")
#: Offsets of the source pixels, along one axis, that a kernel weighs.
REACH = {"bilinear": (0, 1), "cubic": (-1, 0, 1, 2), "cubicspline": (-1, 0, 1, 2), "lanczos": (-2, -1, 0, 1, 2, 3)}
#: Aggregates of the source pixels whose centres fall into a target pixel.
AREAS = {
    "average": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "med": F.median, "mode": lambda v: F.mode(v, True),
    "q1": lambda v: F.percentile(v, F.lit(0.25)), "q3": lambda v: F.percentile(v, F.lit(0.75)), "rms": lambda v: F.sqrt(F.avg(v * v)),
}


def target_system(epsg=None, wkt_file: str | None = None, wkt: str | None = None, exact: bool = False) -> int | None:
    """The code asked for, None if none was. A number goes before a file, a file before a text, if ``exact`` lets several be given."""
    given = [x for x in (epsg, wkt_file, wkt) if x is not None]
    if len(given) > 1 and not exact:
        raise ValueError("give one of an EPSG code, a WKT file and a WKT text")
    if not given:
        return None
    if epsg is not None:
        return geo.epsg_of(epsg)
    if wkt_file is not None:
        with open(wkt_file) as f:
            return geo.epsg_of(f.read())
    return geo.epsg_of(wkt)


def target_resolution(gt, source: int, target: int, xres: float | None, yres: float | None) -> tuple[float, float]:
    """Pixel size asked for; if either is missing both come from the first scene, whose unit must then be the target's."""
    if xres is not None and yres is not None:
        return float(xres), abs(float(yres))
    if geo.linear_unit(source) != geo.linear_unit(target):
        raise geo.ProjectionError("give both resolutions: the scenes' unit is not that of the output")
    if (xres is None) != (yres is None):
        warnings.warn("one resolution alone is not used; both are those of the first scene", stacklevel=3)
    return abs(gt["xres"]), abs(gt["yres"])


BOX = ("b_x_min", "b_x_max", "b_y_min", "b_y_max")


def _boxes(batches, source, target):
    for batch in batches:
        gt = {n: batch.column("gt").field(n).to_numpy(zero_copy_only=False) for n in ("x0", "xres", "xskew", "y0", "yskew", "yres")}
        w, h = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("ncols", "nrows"))
        x, y = (np.array(a) for a in zip(*(geo.transform(source, target, *geo.apply_affine(gt, c, r), geo.NUMPY) for c in (0 * w, w) for r in (0 * h, h))))
        boxes = [pa.array(a) for a in (x.min(axis=0), x.max(axis=0), y.min(axis=0), y.max(axis=0))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *boxes], names=[*batch.schema.names, *BOX])


def corner_box(catalog: DataFrame, source: int, target: int) -> DataFrame:
    """Catalog with the box (b_x_min, b_x_max, b_y_min, b_y_max) of the four corners in the target system.

    Conic, azimuthal and polar systems are evaluated by numpy: as column expressions, which repeat whatever is used twice, they outgrow the optimizer.
    """
    if source in geo.SYSTEMS or target in geo.SYSTEMS:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in catalog.schema) + "".join(f", {c} double" for c in BOX)
        return catalog.mapInArrow(partial(_boxes, source=source, target=target), schema)
    xs, ys = [], []
    for c in (F.lit(0), F.col("ncols")):
        for r in (F.lit(0), F.col("nrows")):
            x, y = geo.transform(source, target, *geo.apply_affine(F.col("gt"), c, r))
            xs.append(x)
            ys.append(y)
    return (catalog.withColumn("b_x_min", F.least(*xs)).withColumn("b_x_max", F.greatest(*xs)).withColumn("b_y_min", F.least(*ys)).withColumn("b_y_max", F.greatest(*ys)))


def snapped(boxes: DataFrame, xres: float, yres: float) -> DataFrame:
    """Boxes widened to whole pixels of the target grid."""
    out = boxes
    for c, res, f in (("b_x_min", xres, geo.snap_down), ("b_x_max", xres, geo.snap_up), ("b_y_min", yres, geo.snap_down), ("b_y_max", yres, geo.snap_up)):
        out = out.withColumn(c, f(F.col(c), F.lit(abs(res))))
    return out


def reproject_catalog(catalog: DataFrame, source: int, target: int, xres: float, yres: float) -> DataFrame:
    """The catalog as it is after warping each scene to the snapped target grid; ``source_gt`` etc. keep what it was."""
    b = snapped(corner_box(catalog, source, target), xres, yres)
    gt = F.struct(F.col("b_x_min").alias("x0"), F.lit(xres).alias("xres"), F.lit(0.0).alias("xskew"), F.col("b_y_max").alias("y0"), F.lit(0.0).alias("yskew"), F.lit(-yres).alias("yres"))
    size = lambda a, z, r: F.rint((F.col(z) - F.col(a)) / r).cast("int")
    return (b.withColumn("source_gt", F.col("gt")).withColumn("source_ncols", F.col("ncols")).withColumn("source_nrows", F.col("nrows")).withColumn("source_srs", F.col("srs"))
            .withColumn("gt", gt).withColumn("ncols", size("b_x_min", "b_x_max", xres)).withColumn("nrows", size("b_y_min", "b_y_max", yres)).withColumn("srs", F.lit(f"EPSG:{target}"))
            .drop("b_x_min", "b_x_max", "b_y_min", "b_y_max"))


def source_position(gt: Column, row: Column, col: Column, source_gt: Column, source: int, target: int) -> tuple[Column, Column]:
    """Where the centre of a target pixel lies in the source, as (col, row) fractions."""
    x, y = geo.apply_affine(gt, col + 0.5, row + 0.5)
    return geo.invert_affine(source_gt, *geo.transform(target, source, x, y))


def warp_nearest(pixels: DataFrame, targets: DataFrame, source: int, target: int) -> DataFrame:
    """row, col, value of target pixels (gt, source_gt, row, col): the source pixel their centre falls into."""
    c, r = source_position(F.col("gt"), F.col("row"), F.col("col"), F.col("source_gt"), source, target)
    t = targets.withColumn("_r", F.floor(r).cast("long")).withColumn("_c", F.floor(c).cast("long")).select("row", "col", "_r", "_c")
    return t.join(pixels.select(F.col("row").cast("long").alias("_r"), F.col("col").cast("long").alias("_c"), "value"), ["_r", "_c"], "left").select("row", "col", "value")


def kernel(method: str, a, sin, where):
    """Weight at distance a >= 0: linear, Catmull-Rom, cubic B-spline, or Lanczos of three lobes. sin and where are those of Spark or numpy."""
    if method == "bilinear":
        return where(a < 1, 1 - a, 0.0)
    if method == "cubic":
        return where(a <= 1, 1.5 * a * a * a - 2.5 * a * a + 1, where(a < 2, -0.5 * a * a * a + 2.5 * a * a - 4 * a + 2, 0.0))
    if method == "cubicspline":
        return where(a <= 1, 0.5 * a * a * a - a * a + 2 / 3, where(a < 2, (2 - a) * (2 - a) * (2 - a) / 6, 0.0))
    x = where(a < 1e-9, 1.0, a) * geo.PI
    return where(a < 1e-9, 1.0, where(a < 3, 3 * sin(x) * sin(x / 3) / (x * x), 0.0))


def _either(test: Column, yes, no) -> Column:
    return F.when(test, yes).otherwise(no)


def warp_weighted(pixels: DataFrame, targets: DataFrame, source: int, target: int, method: str) -> DataFrame:
    """A kernel of ``REACH``: each target pixel meets its 4, 16 or 36 neighbours; nulls drop out and the rest is reweighted."""
    reach = REACH[method]
    weight = lambda d: kernel(method, F.abs(d), F.sin, _either)
    c, r = source_position(F.col("gt"), F.col("row"), F.col("col"), F.col("source_gt"), source, target)
    t = targets.withColumn("_y", r - 0.5).withColumn("_x", c - 0.5)
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in reach for j in reach])
    t = t.withColumn("_n", F.explode(near)).withColumn("_r", (F.floor("_y") + F.col("_n.i")).cast("long")).withColumn("_c", (F.floor("_x") + F.col("_n.j")).cast("long"))
    t = t.withColumn("_w", weight(F.col("_y") - F.col("_r")) * weight(F.col("_x") - F.col("_c")))
    p = pixels.select(F.col("row").cast("long").alias("_r"), F.col("col").cast("long").alias("_c"), "value").where("value IS NOT NULL")
    s = t.join(p, ["_r", "_c"], "left").groupBy("row", "col").agg(F.sum(F.col("_w") * F.col("value")).alias("s"), F.sum(F.when(F.col("value").isNotNull(), F.col("_w"))).alias("w"))
    return s.select("row", "col", F.when(F.abs(F.col("w")) > 1e-9, F.col("s") / F.col("w")).alias("value"))


def resample_area(pixels: DataFrame, level: int, method: str) -> DataFrame:
    """Blocks of level x level pixels in one, by an aggregate of the valid ones."""
    if method not in AREAS:
        raise ValueError(f"method must be one of {sorted(AREAS)}")
    return pixels.groupBy(F.floor(F.col("row") / level).alias("row"), F.floor(F.col("col") / level).alias("col")).agg(AREAS[method](F.col("value")).alias("value"))


def warp_area(pixels: DataFrame, gt: Column, target_gt: Column, source: int, target: int, method: str) -> DataFrame:
    """Source pixels gathered in the target pixel that holds their centre, then aggregated."""
    x, y = geo.transform(source, target, *geo.apply_affine(gt, F.col("col") + 0.5, F.col("row") + 0.5))
    c, r = geo.invert_affine(target_gt, x, y)
    p = pixels.withColumn("_r", F.floor(r)).withColumn("_c", F.floor(c))
    return p.groupBy(F.col("_r").alias("row"), F.col("_c").alias("col")).agg(AREAS[method](F.col("value")).alias("value"))
