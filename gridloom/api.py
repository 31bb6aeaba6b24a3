"""do_mosaic: many scenes in, one raster out.

The catalog is read by tasks, checked, and turned into an output grid. A job then goes over the tiles of that grid:
each task reads the windows of the scenes that reach its tile, overlays them in order, and returns the tile with its
overview samples and sums. One shuffle groups read tasks by tile; the result is written once and statistics,
overviews and the file are made from what was written.
"""

from __future__ import annotations

import json
import os
import time
import uuid
import warnings
from contextlib import contextmanager
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import geo
from gridloom.functions.grid import overview_levels
from gridloom.operators import warp
from gridloom.plans import blocks as plan, catalog as cat
from gridloom.session import local_session, remove, shared_dir, ship
from gridloom.sources import geotiff, raster

DEFAULTS = {"numthreads": 4, "blocksize": 1024, "driver": "GTiff", "resamplemethod": "near", "minoverviewsize": 1024}
#: Creation options of each driver unless others are given.
CREATION = {"GTiff": ["COMPRESS=DEFLATE", "TILED=YES", "BIGTIFF=YES", "INTERLEAVE=BAND"], "PARQUET": []}


class Monitoring:
    """Parameters, gauges and time spans of a run, as they are reported in JSON."""

    def __init__(self):
        self.params, self.stamps, self.gauges = {}, {}, {}

    def set_param(self, name: str, value) -> None:
        self.params[name] = value

    def gauge(self, name: str, value) -> None:
        low, high = self.gauges.get(name, (value, value))
        self.gauges[name] = (min(low, value), max(high, value))

    @contextmanager
    def span(self, name: str):
        if ":" in name:
            raise ValueError("a span's name has no colon")
        self.stamps[f"{name}:start"] = time.time()
        try:
            yield
        finally:
            self.stamps[f"{name}:end"] = time.time()

    def stamp(self, name: str, phase: str) -> float:
        return self.stamps[f"{name}:{phase}"]

    def report(self) -> dict:
        return {"minMaxBlockCacheSize": self.gauges.get("cache"), "minMaxBlockQueueSize": self.gauges.get("queue"), "timestamps": self.stamps, "params": self.params}

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(*k.split(":"), v) for k, v in self.stamps.items()], "name string, phase string, t double")


def _sample(path, header, f, band, rows, cols, method, nodata):
    """Values of a scene at fractional (row, col) positions of pixel corners; NaN where there is none."""
    def at(r, c):
        ok = (r >= 0) & (c >= 0) & (r < header.nrows) & (c < header.ncols)
        out = np.full(r.shape, np.nan)
        if ok.any():
            r0, c0 = int(r[ok].min()), int(c[ok].min())
            a = geotiff.read_window(f, header, band, r0, c0, int(r[ok].max()) - r0 + 1, int(c[ok].max()) - c0 + 1).astype(np.float64)
            v = a[r[ok].astype(int) - r0, c[ok].astype(int) - c0]
            if nodata is not None:
                v = np.where(np.isnan(v) if np.isnan(nodata) else v == nodata, np.nan, v)
            out[ok] = v
        return out

    if method == "near":
        return at(np.floor(rows), np.floor(cols))
    reach = warp.REACH[method]
    weight = lambda d: warp.kernel(method, np.abs(d), np.sin, np.where)
    y, x = rows - 0.5, cols - 0.5
    total, weights = np.zeros(y.shape), np.zeros(y.shape)
    for i in reach:
        for j in reach:
            r, c = np.floor(y) + i, np.floor(x) + j
            v, w = at(r, c), weight(y - r) * weight(x - c)
            ok = ~np.isnan(v)
            total[ok] += (v * w)[ok]
            weights[ok] += w[ok]
    return np.where(np.abs(weights) > 1e-9, total / np.where(weights == 0, 1, weights), np.nan)


def _grouped(method, at, v, size):
    """Aggregate of the values of each position ``at`` below size; NaN where there is none. As ``warp.AREAS`` has them."""
    order = np.lexsort([v, at])
    at, v = at[order], v[order]
    start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, int)
    n, out = np.diff(np.append(start, len(at))), np.full(size, np.nan)
    if not len(at):
        return out
    if method in ("min", "max"):
        got = v[start] if method == "min" else v[start + n - 1]
    elif method in ("sum", "average", "rms"):
        got = np.add.reduceat(v * v if method == "rms" else v, start)
        got = got if method == "sum" else got / n if method == "average" else np.sqrt(got / n)
    elif method == "mode":
        # Runs of equal values: of the longest of a position the first, which is the least value.
        run = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (v[1:] != v[:-1])]))
        long = np.diff(np.append(run, len(at)))
        best = run[np.lexsort([run, -long, at[run]])]
        got = v[best[np.concatenate([[True], at[best][1:] != at[best][:-1]])]]
    else:
        rank = (n - 1) * {"q1": 0.25, "med": 0.5, "q3": 0.75}[method]
        low = np.floor(rank).astype(int)
        high = np.minimum(low + 1, n - 1)
        got = v[start + low] + (v[start + high] - v[start + low]) * (rank - low)
    out[at[start]] = got
    return out


def _area(path, h, f, band, rows, cols, method, nodata, grid, top, left):
    """Source pixels gathered in the target pixel that holds their centre, then aggregated; pixels finer than the source's take the one they lie in."""
    near = _sample(path, h, f, band, rows, cols, "near", nodata)
    wide = lambda a: 2 + max([0.0, *(float(np.abs(np.diff(a, axis=k)).max()) for k in (0, 1) if a.shape[k] > 1)])
    r0, r1 = max(0, int(rows.min() - wide(rows))), min(h.nrows, int(rows.max() + wide(rows)) + 1)
    c0, c1 = max(0, int(cols.min() - wide(cols))), min(h.ncols, int(cols.max() + wide(cols)) + 1)
    if r0 >= r1 or c0 >= c1:
        return near
    v = geotiff.read_window(f, h, band, r0, c0, r1 - r0, c1 - c0).astype(np.float64).ravel()
    c, r = (a.ravel() + 0.5 for a in np.meshgrid(np.arange(c0, c1), np.arange(r0, r1)))
    x0, xr, xs, y0, ys, yr = h.gt
    x, y = geo.transform(grid["source"], grid["target"], x0 + c * xr + r * xs, y0 + c * ys + r * yr, geo.NUMPY)
    tc, tr = np.floor((x - grid["gt"][0]) / grid["gt"][1]) - left, np.floor((y - grid["gt"][3]) / grid["gt"][5]) - top
    inside = (tr >= 0) & (tc >= 0) & (tr < rows.shape[0]) & (tc < rows.shape[1])
    at = (tr[inside] * rows.shape[1] + tc[inside]).astype(int)
    v = v[inside]
    valid = ~np.isnan(v) if nodata is None or np.isnan(nodata) else (v != nodata) & ~np.isnan(v)
    got = _grouped(method, at[valid], v[valid], rows.size)
    met = np.bincount(at, minlength=rows.size) > 0
    return np.where(met, got, near.ravel()).reshape(rows.shape)


TILE = "level int, band int, top int, left int, ysize int, xsize int, pixels binary"


def _tile(key, table, grid, levels):
    """One tile of the mosaic from its inputs in scene order, and the samples that overviews take of it."""
    band, top, left, ysize, xsize = (k.as_py() for k in key)
    nodata, dtype = grid["nodata"], np.dtype(grid["dtype"])
    merged = np.full((ysize, xsize), np.nan)
    exact = None  # 64-bit integers do not fit doubles
    if dtype.kind in "iu" and dtype.itemsize == 8:
        exact = np.full((ysize, xsize), 0 if nodata is None else int(nodata), dtype)
    for s in sorted(table.to_pylist(), key=lambda s: s["ord"]):
        if s["scene_id"] is None:
            continue
        with geotiff.open_input(s["scene_id"]) as f:
            h = geotiff.read_directories(f)[0]
            null = h.nodata if grid["per_scene_nodata"] else nodata
            if grid["target"]:
                gx, gy = grid["gt"][0] + (left + np.arange(xsize) + 0.5) * grid["gt"][1], grid["gt"][3] + (top + np.arange(ysize) + 0.5) * grid["gt"][5]
                x, y = geo.transform(grid["target"], grid["source"], *np.meshgrid(gx, gy), geo.NUMPY)
                x0, xr, xs, y0, ys, yr = h.gt
                det = xr * yr - xs * ys
                rows, cols = ((y - y0) * xr - (x - x0) * ys) / det, ((x - x0) * yr - (y - y0) * xs) / det
                if grid["resample"] in warp.AREAS:
                    a = _area(s["scene_id"], h, f, band, rows, cols, grid["resample"], null, grid, top, left)
                else:
                    a = _sample(s["scene_id"], h, f, band, rows, cols, grid["resample"], null)
                merged = np.where(np.isnan(a), merged, a)
                continue
            it, il = s["in_top"], s["in_left"]
            t, b, lft, r = max(it, 0), min(it + ysize, h.nrows), max(il, 0), min(il + xsize, h.ncols)
            if t >= b or lft >= r:
                continue
            raw = geotiff.read_window(f, h, band, t, lft, b - t, r - lft)
            a = raw.astype(np.float64)
            valid = ~np.isnan(a) if null is None or np.isnan(null) else raw != null
            at = (slice(t - it, b - it), slice(lft - il, r - il))
            merged[at] = np.where(valid, a, merged[at])
            if exact is not None:
                exact[at] = np.where(valid, raw, exact[at])
    hole = np.isnan(merged)
    if nodata is None and hole.any() and dtype.kind != "f":
        raise geotiff.RasterError("the mosaic has holes; give a nodata value")
    if dtype.kind in "iu":
        low, high = np.iinfo(dtype).min, np.iinfo(dtype).max
        if not hole.all() and (merged[~hole].min() < low or merged[~hole].max() > high):
            raise geotiff.RasterError(f"a value does not fit {dtype}")
        out = np.where(hole, 0, merged if grid["target"] is None else np.rint(merged)).astype(dtype) if exact is None else exact
    else:
        out = merged.astype(dtype)
    if nodata is not None:
        out[hole] = nodata
    rows = [(1, band, top, left, ysize, xsize, out.tobytes())]
    for level in levels:
        half = level // 2
        r, c = (half - top) % level, (half - left) % level
        part = out[r::level, c::level]
        if part.size:
            rows.append((level, band, (top + r) // level, (left + c) // level, *part.shape, np.ascontiguousarray(part).tobytes()))
    cols = list(zip(*rows))
    return pa.table({n: pa.array(v, pa.binary() if n == "pixels" else pa.int32()) for n, v in zip([x.split()[0] for x in TILE.split(", ")], cols)})


def _assembled(key, table, dtype, tile, sizes, fill):
    """Overview samples of one overview tile put together."""
    level, band, tr, tc = (k.as_py() for k in key)
    h, w = sizes[level]
    out = np.full((min(tile, h - tr * tile), min(tile, w - tc * tile)), fill, dtype)
    for s in table.to_pylist():
        a = np.frombuffer(s["pixels"], dtype).reshape(s["ysize"], s["xsize"])
        y, x = s["top"] - tr * tile, s["left"] - tc * tile
        y0, x0 = max(0, -y), max(0, -x)
        a = a[y0:min(a.shape[0], out.shape[0] - y), x0:min(a.shape[1], out.shape[1] - x)]
        out[y + y0:y + y0 + a.shape[0], x + x0:x + x0 + a.shape[1]] = a
    return pa.table({"level": pa.array([level], pa.int32()), "band": pa.array([band], pa.int32()), "top": pa.array([tr * tile], pa.int32()), "left": pa.array([tc * tile], pa.int32()),
                     "ysize": pa.array([out.shape[0]], pa.int32()), "xsize": pa.array([out.shape[1]], pa.int32()), "pixels": pa.array([out.tobytes()], pa.binary())})


def _tile_sums(batches, dtype, nodata):
    for batch in batches:
        rows = []
        for band, p in zip(batch.column("band").to_pylist(), batch.column("pixels").to_pylist()):
            a = np.frombuffer(p, dtype)
            a = a[~np.isnan(a)] if a.dtype.kind == "f" else a
            a = (a[a != nodata] if nodata is not None and not np.isnan(nodata) else a).astype(np.float64)
            if len(a):
                m = a.mean()
                rows.append((band, a.min(), a.max(), len(a), m, ((a - m)**2).sum()))
        kinds = (pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.float64())
        cols = list(zip(*rows)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["band", "lo", "hi", "n", "m", "q"])


def tile_stats(tiles: DataFrame, dtype: str, nodata: float | None) -> DataFrame:
    """band, minval, maxval, meanval, stddev, count from one pass over tiles; tile moments are joined exactly."""
    s = tiles.where("level = 1").mapInArrow(partial(_tile_sums, dtype=np.dtype(dtype), nodata=nodata), "band int, lo double, hi double, n long, m double, q double")
    g = s.groupBy("band").agg(F.min("lo").alias("minval"), F.max("hi").alias("maxval"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum("n").alias("count"), F.sum("q").alias("q"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("mm"))
    mean = F.col("s") / F.col("count")
    return g.select("band", "minval", "maxval", mean.alias("meanval"), F.sqrt(F.greatest(F.lit(0.0), (F.col("q") + F.col("mm")) / F.col("count") - mean * mean)).alias("stddev"), "count")


def do_mosaic(filelist: list[str], outfile: str | None, *, numthreads: int = 4, blocksize: int = 1024, driver: str = "GTiff", nullval: float | None = None, creationoptions: list[str] | None = None,
              outprojepsg=None, outprojwktfile: str | None = None, outprojwkt: str | None = None, outXres: float | None = None, outYres: float | None = None, resamplemethod: str = "near",
              minOverviewSize: int = 1024, compat: str = "contract", per_scene_nodata: bool = False, spark: SparkSession | None = None) -> Monitoring:
    """Mosaic files into one; a later file wins where it has values.

    ``driver`` is GTiff (one file) or PARQUET (a folder of tiles). With ``compat="exact"`` several projection
    options may be given at once. Raises ValueError for no files, no output or an unknown driver, ProjectionError for files that do not fit together.
    """
    if not filelist:
        raise ValueError("no input files")
    if outfile is None:
        raise ValueError("no output file")
    if driver not in CREATION:
        raise ValueError(f"driver {driver} is not supported; use one of {', '.join(CREATION)}")
    if resamplemethod not in (known := (*warp.NEIGHBOURS, *warp.AREAS)):
        raise ValueError(f"resampling {resamplemethod} is not supported; use one of {', '.join(known)}")
    spark = ship(spark or local_session(str(numthreads)))
    m = Monitoring()
    for k, v in (("numthreads", numthreads), ("blocksize", blocksize), ("cpucount", os.cpu_count()), ("numinfiles", len(filelist))):
        m.set_param(k, v)
    with m.span("imginfodict"):
        infos = sorted((r.asDict(recursive=True) for r in raster.read_catalog(spark, filelist).collect()), key=lambda r: r["ord"])
        catalog = spark.createDataFrame([tuple(tuple(v.values()) if k == "gt" else v for k, v in i.items()) for i in infos], cat.SCHEMA)
    first, source = infos[0], None
    with m.span("projection"):
        target = warp.target_system(outprojepsg, outprojwktfile, outprojwkt, exact=compat == "exact")
        if target is None:
            if outXres or outYres or resamplemethod != "near":
                warnings.warn("resolution and resampling are only used with an output projection", stacklevel=2)
            cat.check(catalog)
        else:
            source = geo.epsg_of(first["srs"])
            odd = [i["scene_id"] for i in infos if not geo.same_system(i["srs"], first["srs"])]
            if odd:
                raise geo.ProjectionError(f"{odd[0]} has another coordinate system than {first['scene_id']}")
            xres, yres = warp.target_resolution(first["gt"], source, target, outXres, outYres)
            catalog = warp.reproject_catalog(catalog, source, target, xres, yres)
    with m.span("analysis"):
        frame = cat.output_grid(catalog, nullval)
        g = frame.first()
        levels = list(frame.select(overview_levels(F.col("ncols"), F.col("nrows"), minOverviewSize).alias("x")).first().x)
        tile = max(16, -(-blocksize // 16) * 16)
        grid = {"ncols": g.ncols, "nrows": g.nrows, "gt": [g.x_min, g.x_res, 0.0, g.y_max, 0.0, -g.y_res], "srs": g.srs, "dtype": g.dtype, "num_bands": g.num_bands, "nodata": g.nodata, "tile": tile,
                "levels": levels, "target": target, "source": source, "resample": resamplemethod, "per_scene_nodata": per_scene_nodata}
        blocks = plan.block_list(frame.select("ncols", "nrows"), tile, plain=True).select("top", "left", "ysize", "xsize")
        found = plan.overlaps(blocks, plan.scene_windows(catalog, frame), tile).select("top", "left", "scene_id", "ord", "in_left", "in_top")
        # Blocks without inputs stay, as nodata.
        reads = blocks.join(found, ["top", "left"], "left").withColumn("band", F.explode(F.sequence(F.lit(1), F.lit(g.num_bands))))
    with m.span("domosaic"):
        folder = outfile if driver == "PARQUET" else f"{shared_dir(spark)}/tiles-{uuid.uuid4().hex}"
        make = partial(_tile, grid=grid, levels=levels)
        made = reads.groupBy("band", "top", "left", "ysize", "xsize").applyInArrow(lambda key, t: make(key, t), TILE)
        made.write.mode("overwrite").parquet(f"{folder}/made")
        made = spark.read.parquet(f"{folder}/made")
        sizes = {x: (len(range(x // 2, g.nrows, x)), len(range(x // 2, g.ncols, x))) for x in levels}
        put = partial(_assembled, dtype=np.dtype(g.dtype), tile=tile, sizes=sizes, fill=0 if g.nodata is None else g.nodata)
        # A sample block may lie across several overview tiles.
        over = made.where("level > 1")
        span = lambda a, n: F.sequence(F.floor(F.col(a) / tile).cast("int"), F.floor((F.col(a) + F.col(n) - 1) / tile).cast("int"))
        over = over.withColumn("tr", F.explode(span("top", "ysize"))).withColumn("tc", F.explode(span("left", "xsize")))
        tiles = made.where("level = 1").unionByName(over.groupBy("level", "band", "tr", "tc").applyInArrow(lambda key, t: put(key, t), TILE))
        stats = {r.band: r for r in tile_stats(made, g.dtype, g.nodata).collect()}
        if driver == "PARQUET":
            grid["stats"] = {b: {k: r[k] for k in ("minval", "maxval", "meanval", "stddev", "count")} for b, r in stats.items()}
            raster.write_tiles(tiles, outfile, grid)
        else:
            options = dict(x.split("=", 1) for x in (CREATION[driver] if creationoptions is None else creationoptions))
            if os.path.exists(outfile):
                os.remove(outfile)
            out = geotiff.Writer(outfile, g.ncols, g.nrows, g.num_bands, g.dtype, grid["gt"], f"EPSG:{geo.epsg_of(g.srs)}" if g.srs else "", g.nodata, tile, levels, options.get("COMPRESS", "NONE") != "NONE")
            for r in tiles.orderBy("level", "band", "top", "left").toLocalIterator():
                out.write(r.level, r.band, r.top // tile, r.left // tile, np.frombuffer(r.pixels, g.dtype).reshape(r.ysize, r.xsize))
            out.stats = {b: {"MINIMUM": str(r.minval), "MAXIMUM": str(r.maxval), "MEAN": str(r.meanval), "STDDEV": str(r.stddev)} for b, r in stats.items()}
            out.close()
            remove(spark, folder)
    return m


def write_report(m: Monitoring, path: str) -> None:
    with open(path, "w") as f:
        json.dump(m.report(), f, indent=2)
