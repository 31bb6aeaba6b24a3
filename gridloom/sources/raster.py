"""Scenes as DataFrames: headers read by tasks, a Python data source of pixels, and a tiled Parquet format."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridloom.plans.catalog import SCHEMA
from gridloom.sources import geotiff

PIXELS = "scene_id string, ord int, band int, row int, col int, value double"
#: Rows of a scene that one partition of the data source reads.
STRIP_ROWS = 512


def _headers(batches):
    for batch in batches:
        rows = []
        for path, k in zip(batch.column("scene_id").to_pylist(), batch.column("ord").to_pylist()):
            h = geotiff.read_header(path)
            rows.append({"scene_id": path, "ord": k, "ncols": h.ncols, "nrows": h.nrows, "gt": dict(zip(("x0", "xres", "xskew", "y0", "yskew", "yres"), h.gt)), "srs": h.srs, "dtype": h.dtype,
                         "num_bands": h.num_bands, "nodata": h.nodata, "layer_type": h.layer_type})
        gt = pa.struct([(n, pa.float64()) for n in ("x0", "xres", "xskew", "y0", "yskew", "yres")])
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), gt, pa.string(), pa.string(), pa.int32(), pa.float64(), pa.list_(pa.string()))
        names = ("scene_id", "ord", "ncols", "nrows", "gt", "srs", "dtype", "num_bands", "nodata", "layer_type")
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names=list(names))


def read_catalog(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The catalog of GeoTIFF files, headers read in parallel; a file listed twice is two scenes."""
    if not paths:
        raise ValueError("no scenes")
    files = spark.createDataFrame(list(enumerate(paths)), "ord int, scene_id string")
    return files.repartition(min(len(paths), 256)).mapInArrow(_headers, SCHEMA)


class _Strip(InputPartition):
    def __init__(self, path, ord_, band, top, rows):
        self.path, self.ord, self.band, self.top, self.rows = path, ord_, band, top, rows


class _PixelReader(DataSourceReader):
    def __init__(self, options):
        self.paths = json.loads(options["paths"])
        self.limits = {}

    def pushFilters(self, filters):
        """Bounds on row and band choose strips; Spark still applies every filter."""
        for f in filters:
            name, value = type(f).__name__, getattr(f, "value", None)
            if getattr(f, "attribute", ()) in (("row",), ("band",)) and isinstance(value, int):
                self.limits.setdefault(f.attribute[0], []).append((name, value))
            yield f

    def _keeps(self, column: str, low: int, high: int) -> bool:
        test = {"EqualTo": lambda v: low <= v <= high, "GreaterThan": lambda v: high > v, "GreaterThanOrEqual": lambda v: high >= v, "LessThan": lambda v: low < v, "LessThanOrEqual": lambda v: low <= v}
        return all(test.get(n, lambda v: True)(v) for n, v in self.limits.get(column, ()))

    def partitions(self):
        out = []
        for k, path in enumerate(self.paths):
            h = geotiff.read_header(path)
            out += [_Strip(path, k, b, t, min(STRIP_ROWS, h.nrows - t)) for b in range(1, h.num_bands + 1) for t in range(0, h.nrows, STRIP_ROWS)
                    if self._keeps("band", b, b) and self._keeps("row", t, t + min(STRIP_ROWS, h.nrows - t) - 1)]
        return out or [_Strip(None, 0, 0, 0, 0)]

    def read(self, p) -> Iterator[pa.RecordBatch]:
        if p.path is None:
            return
        with geotiff.open_input(p.path) as f:
            h = geotiff.read_directories(f)[0]
            for top in range(p.top, p.top + p.rows, 64):
                rows = min(64, p.top + p.rows - top)
                a = geotiff.read_window(f, h, p.band, top, 0, rows, h.ncols).astype(np.float64).ravel()
                null = np.zeros(len(a), bool) if h.nodata is None else np.isnan(a) if np.isnan(h.nodata) else a == h.nodata
                n = len(a)
                yield pa.RecordBatch.from_arrays([pa.array([p.path] * n), pa.array(np.full(n, p.ord, np.int32)), pa.array(np.full(n, p.band, np.int32)), pa.array(np.repeat(np.arange(top, top + rows, dtype=np.int32), h.ncols)),
                                                  pa.array(np.tile(np.arange(h.ncols, dtype=np.int32), rows)), pa.array(a, mask=null)], names=["scene_id", "ord", "band", "row", "col", "value"])


class RasterSource(DataSource):
    """``spark.read.format("raster_pixels").option("paths", json).load()``: pixels of GeoTIFF scenes, nodata as NULL."""

    @classmethod
    def name(cls):
        return "raster_pixels"

    def schema(self):
        return PIXELS

    def reader(self, schema):
        return _PixelReader(self.options)


def read_pixels(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The source above, registered; switches on the session's filter pushdown to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RasterSource)
    return spark.read.format("raster_pixels").option("paths", json.dumps(paths)).load()


def write_tiles(tiles: DataFrame, path: str, grid: dict) -> None:
    """Tiles by band and level in row-major order within files, and what the grid is in a sidecar table."""
    spark = tiles.sparkSession
    (tiles.repartitionByRange("level", "band", "top", "left").sortWithinPartitions("level", "band", "top", "left").write.mode("overwrite").partitionBy("level", "band").parquet(f"{path}/tiles"))
    spark.createDataFrame([(json.dumps(grid),)], "grid string").coalesce(1).write.mode("overwrite").json(f"{path}/grid")


def read_tiles(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/tiles"), json.loads(spark.read.json(f"{path}/grid").first().grid)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Job lists and timings kept as one JSON document a file."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def tiles_by_date(spark: SparkSession, path: str) -> DataFrame:
    """date, tilename, path, null_pcnt of a search result {date: [[tilename, path, null percent], ...]}."""
    text = spark.read.option("wholetext", True).text(path)
    m = text.select(F.explode(F.from_json("value", "map<string,array<array<string>>>")).alias("date", "tiles"))
    return m.select("date", F.explode("tiles").alias("t")).select("date", F.col("t")[0].alias("tilename"), F.col("t")[1].alias("path"), F.col("t")[2].cast("double").alias("null_pcnt"))
