"""The catalog: one row a scene, its extent, and what all scenes must agree on.

catalog: scene_id, ord, ncols, nrows, gt, srs, dtype, num_bands, nodata, layer_type
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.geo import ProjectionError, aligned, same_system
from gridloom.functions.grid import half_even

GT = "struct<x0:double,xres:double,xskew:double,y0:double,yskew:double,yres:double>"
SCHEMA = f"scene_id string, ord int, ncols int, nrows int, gt {GT}, srs string, dtype string, num_bands int, nodata double, layer_type array<string>"


def catalog_of(spark: SparkSession, infos: list[dict]) -> DataFrame:
    """A catalog of scene descriptions in list order."""
    return spark.createDataFrame([(i["scene_id"], k, i["ncols"], i["nrows"], tuple(i["gt"]), i.get("srs"), i.get("dtype"), i.get("num_bands", 1), i.get("nodata"), i.get("layer_type"))
                                  for k, i in enumerate(infos)], SCHEMA)


def with_extent(catalog: DataFrame) -> DataFrame:
    """x_min, x_max, y_min, y_max, x_res, y_res of every scene; rotation does not count."""
    g = F.col("gt")
    return (catalog.withColumn("x_min", g["x0"]).withColumn("x_max", g["x0"] + F.col("ncols") * g["xres"])
            .withColumn("y_max", g["y0"]).withColumn("y_min", g["y0"] + F.col("nrows") * g["yres"])
            .withColumn("x_res", g["xres"]).withColumn("y_res", F.abs(g["yres"])))


def output_grid(catalog: DataFrame, nodata: float | None = None) -> DataFrame:
    """One row: the union of all extents on the grid of the first scene, which also sets system, type and bands."""
    first = lambda c: F.min_by(c, "ord")
    g = with_extent(catalog).agg(F.min("x_min").alias("x_min"), F.max("x_max").alias("x_max"), F.min("y_min").alias("y_min"), F.max("y_max").alias("y_max"),
                                 first("x_res").alias("x_res"), first("y_res").alias("y_res"), first("srs").alias("srs"), first("dtype").alias("dtype"),
                                 first("num_bands").alias("num_bands"), first("layer_type").alias("layer_type"), first("nodata").alias("own_nodata"))
    return (g.withColumn("ncols", half_even((F.col("x_max") - F.col("x_min")) / F.col("x_res")))
            .withColumn("nrows", half_even((F.col("y_max") - F.col("y_min")) / F.col("y_res")))
            .withColumn("nodata", F.lit(nodata).cast("double") if nodata is not None else F.col("own_nodata")).drop("own_nodata"))


def violations(catalog: DataFrame) -> DataFrame:
    """scene_id, ord, problem: the first thing in which a scene departs from the first scene.

    In this order: coordinate system, pixel width, pixel height, alignment in x and in y.
    """
    e = with_extent(catalog)
    first = e.agg(*[F.min_by(c, "ord").alias(f"_{c}") for c in ("srs", "x_res", "y_res", "x_min", "y_max")])
    problem = (F.when(~F.col("srs").eqNullSafe(F.col("_srs")), "system").when(F.col("x_res") != F.col("_x_res"), "x_size").when(F.col("y_res") != F.col("_y_res"), "y_size")
               .when(~aligned(F.col("x_min"), F.col("_x_min"), F.col("_x_res")), "x_alignment").when(~aligned(F.col("y_max"), F.col("_y_max"), F.col("_y_res")), "y_alignment"))
    # One row: what the first scene says.
    return e.join(F.broadcast(first)).withColumn("problem", problem).where("problem IS NOT NULL").select("scene_id", "ord", "problem")


def check(catalog: DataFrame) -> None:
    """Raise ProjectionError for the first scene that does not fit the first; also for too few bands."""
    first = catalog.orderBy("ord").limit(1).select("scene_id", "srs", "num_bands").first()
    if first is None:
        raise ValueError("no scenes")
    # Each name with the first scene that has it, in that order; the first that stands for another system tells which scene departs in it.
    names = catalog.groupBy("srs").agg(F.min("ord").alias("ord")).orderBy("ord").toLocalIterator()
    odd = next((r for r in names if r.srs != first.srs and not same_system(r.srs or "", first.srs or "")), None)
    one = catalog.withColumn("srs", F.when(F.col("ord") == odd.ord, F.col("srs")).otherwise(F.lit(first.srs))) if odd else catalog.withColumn("srs", F.lit(first.srs))
    bad = violations(one).orderBy("ord").first()
    if bad:
        said = {"system": "another coordinate system", "x_size": "another pixel width", "y_size": "another pixel height", "x_alignment": "columns off the grid", "y_alignment": "rows off the grid"}
        raise ProjectionError(f"{bad.scene_id} has {said[bad.problem]} than {first.scene_id}" if "size" in bad.problem or bad.problem == "system" else f"{bad.scene_id} has {said[bad.problem]} of {first.scene_id}")
    few = catalog.where(F.col("num_bands") < first.num_bands).orderBy("ord").first()
    if few:
        raise ValueError(f"{few.scene_id} has {few.num_bands} bands, {first.scene_id} has {first.num_bands}")
