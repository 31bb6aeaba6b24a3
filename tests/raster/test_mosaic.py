"""The golden pair, random layouts against numpy, the facade and the formats."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import api, cli
from gridloom.functions import geo
from gridloom.operators import jobs, monitor, mosaic, stats, warp
from gridloom.queries import golden_pair
from gridloom.sources import filelist, geotiff, raster
from gridloom.streaming import mosaic as streaming


def golden(side):
    out = np.zeros((side, 2 * side - 2))
    out[:, :side] = np.arange(side)
    out[:, side - 1:] = np.arange(1, side)
    return out


def grid_of(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.row, r.col] = 0 if r.value is None else r.value
    return out


def test_golden_pair_of_pixels(spark):
    side, want = 50, golden(50)
    merged = mosaic.merge_pixels(golden_pair(spark, side))
    assert (grid_of(merged, want.shape) == want).all()
    tiles = mosaic.merge_tiles(mosaic.to_tiles(golden_pair(spark, side), 16, side, 98, 0.0), 0.0)
    assert (grid_of(mosaic.to_pixels(tiles, 0.0), want.shape) == want).all()
    s = stats.band_stats(merged).first()
    v = want[want != 0]
    assert (s.minval, s.maxval, s["count"]) == (1, 49, v.size) and s.meanval == pytest.approx(v.mean()) and s.stddev == pytest.approx(v.std())
    q = stats.band_stats_by_squares(merged).first()
    assert q.stddev == pytest.approx(v.std())
    for level in (4, 8):
        part = want[level // 2::level, level // 2::level]
        assert (grid_of(stats.overview(merged, level), part.shape) == part).all()


def layout(seed, side=40):
    r = np.random.default_rng(seed)
    rows, want = [], np.zeros((side, side))
    for k in range(6):
        h, w = r.integers(1, side, 2)
        y, x = r.integers(0, side - h + 1), r.integers(0, side - w + 1)
        a = r.integers(0, 4, (h, w))
        part = want[y:y + h, x:x + w]
        part[a != 0] = a[a != 0]
        rows += [(k, int(y + i), int(x + j), float(a[i, j]) if a[i, j] else None) for i in range(h) for j in range(w)]
    return rows, want


@pytest.mark.parametrize("seed", [1, 2])
def test_random_layouts_match_numpy(spark, seed):
    rows, want = layout(seed)
    px = spark.createDataFrame(rows, "ord int, row int, col int, value double").repartition(5)
    merged = mosaic.merge_pixels(px)
    assert (grid_of(merged, want.shape) == want).all()
    tiles = mosaic.to_tiles(px, 16, 40, 40, -1.0)
    assert (grid_of(mosaic.to_pixels(mosaic.merge_tiles(tiles, -1.0), -1.0), want.shape) == want).all()
    by_window = mosaic.merge_by_window(px).select("row", "col", F.col("merged").alias("value")).distinct()
    mosaic.assert_equal(merged, by_window)
    with pytest.raises(mosaic.ComparisonError):
        mosaic.assert_equal(merged, mosaic.merge_pixels(px, "count"))
    assert mosaic.merge_pixels(px.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mosaic.merge_pixels(px, "median")


def scene(path, data, x0=300000.0, y0=7000000.0, nodata=0, res=10.0, srs="EPSG:32756"):
    data = data if data.ndim == 3 else data[None]
    geotiff.write_array(str(path), data, (x0, res, 0.0, y0, 0.0, -res), srs, nodata, 32)
    return str(path)


def test_golden_files_through_the_facade(spark, tmp_path):
    side = 100
    col = np.tile(np.arange(side, dtype=np.uint16), (side, 1))
    files = [scene(tmp_path / "a.tif", col), scene(tmp_path / "b.tif", col, 300000.0 + (side - 2) * 10)]
    out = str(tmp_path / "out.tif")
    m = api.do_mosaic(files, out, blocksize=32, minOverviewSize=16, spark=spark)
    want = golden(side)
    assert (geotiff.read_array(out) == want).all()
    h = geotiff.read_directories(open(out, "rb"))
    assert h[0].gt == (300000.0, 10.0, 0.0, 7000000.0, 0.0, -10.0) and h[0].srs == "EPSG:32756" and h[0].nodata == 0 and h[0].dtype == "uint16"
    assert len(h) == 3
    for k, level in enumerate((4, 8), 1):
        assert (geotiff.read_array(out, 1, k) == want[level // 2::level, level // 2::level]).all()
    v = want[want != 0]
    meta = h[0].tags[42112]
    assert 'name="STATISTICS_MINIMUM" sample="0">1.0<' in meta and f"{v.mean():.6f}"[:8] in meta
    assert set(m.report()["params"]) == {"numthreads", "blocksize", "cpucount", "numinfiles"}
    assert {k.split(":")[0] for k in m.stamps} == {"imginfodict", "projection", "analysis", "domosaic"}
    api.do_mosaic(files, str(tmp_path / "tiles"), driver="PARQUET", blocksize=48, spark=spark, minOverviewSize=10_000)
    tiles, grid = raster.read_tiles(spark, str(tmp_path / "tiles"))
    got = np.zeros(want.shape)
    for r in tiles.where("level = 1").collect():
        got[r.top:r.top + r.ysize, r.left:r.left + r.xsize] = np.frombuffer(r.pixels, np.uint16).reshape(r.ysize, r.xsize)
    assert (got == want).all() and grid["stats"]["1"]["count"] == v.size


def test_bands_holes_and_nodata(spark, tmp_path):
    r = np.random.default_rng(0)
    a, b = (r.integers(0, 5, (2, 20, 20)).astype(np.int16) for _ in range(2))
    files = [scene(tmp_path / "a.tif", a, nodata=-1), scene(tmp_path / "b.tif", b, 300400.0, 7000000.0 - 400, nodata=-1)]
    out = str(tmp_path / "o.tif")
    api.do_mosaic(files, out, blocksize=16, spark=spark)
    for band in (1, 2):
        got = geotiff.read_array(out, band)
        assert (got[:20, :20] == a[band - 1]).all() and (got[40:, 40:] == b[band - 1]).all() and (got[:20, 40:] == -1).all()
    nan = np.array([[1.0, np.nan], [np.nan, 4.0]], np.float32)
    files = [scene(tmp_path / "n1.tif", nan, nodata=float("nan")), scene(tmp_path / "n2.tif", nan.T * 2, nodata=float("nan"))]
    api.do_mosaic(files, out, blocksize=16, spark=spark)
    np.testing.assert_array_equal(geotiff.read_array(out), np.array([[2, np.nan], [np.nan, 8]], np.float32))


def test_facade_errors(spark, tmp_path):
    f = scene(tmp_path / "a.tif", np.ones((4, 4), np.uint8))
    with pytest.raises(ValueError):
        api.do_mosaic([], "x", spark=spark)
    with pytest.raises(ValueError):
        api.do_mosaic([f], None, spark=spark)
    with pytest.raises(ValueError, match="not supported"):
        api.do_mosaic([f], "x", driver="KEA", spark=spark)
    with pytest.raises(geo.ProjectionError):
        api.do_mosaic([f, scene(tmp_path / "b.tif", np.ones((4, 4), np.uint8), srs="EPSG:32755")], "x", spark=spark)
    with pytest.raises(ValueError):
        warp.target_system(4326, None, "EPSG:3857")


def test_reprojection_through_the_facade(spark, tmp_path):
    data = np.arange(1, 1 + 60 * 60, dtype=np.int32).reshape(60, 60)
    f = scene(tmp_path / "a.tif", data, 500000.0, 7000000.0, res=100.0)
    out = str(tmp_path / "o.tif")
    with pytest.raises(geo.ProjectionError, match="resolutions"):
        api.do_mosaic([f], out, outprojepsg=4326, spark=spark)
    api.do_mosaic([f], out, outprojepsg=4326, outXres=0.001, outYres=0.001, blocksize=32, spark=spark)
    h, got = geotiff.read_header(out), geotiff.read_array(out)
    rows, cols = np.nonzero(got)
    assert h.srs == "EPSG:4326" and len(rows) > 2000
    x, y = geo.transform(4326, 32756, h.gt[0] + (cols + 0.5) * h.gt[1], h.gt[3] + (rows + 0.5) * h.gt[5], geo.NUMPY)
    assert (got[rows, cols] == data[((7000000 - y) // 100).astype(int), ((x - 500000) // 100).astype(int)]).all()


def test_command_line(spark, tmp_path):
    files = [scene(tmp_path / f"{k}.tif", np.full((8, 8), k + 1, np.uint8), 300000.0 + 40 * k) for k in range(2)]
    (tmp_path / "list.txt").write_text("\n".join(f" {f} " for f in files) + "\n\n")
    assert filelist.read_filelist(str(tmp_path / "list.txt"))[-1] == ""
    out, report = str(tmp_path / "o.tif"), tmp_path / "m.json"
    assert cli.main(["-i", str(tmp_path / "list.txt"), "-o", out, "--monitorjson", str(report), "-b", "16", "--co", "COMPRESS=NONE"]) == 0
    assert (geotiff.read_array(out)[0] == [1, 1, 1, 1, 2, 2, 2, 2, 2, 2, 2, 2]).all()
    assert json.loads(report.read_text())["params"]["numinfiles"] == 2


def test_pixel_source(spark, tmp_path):
    data = np.random.default_rng(1).integers(0, 3, (1100, 7)).astype(np.uint8)
    px = raster.read_pixels(spark, [scene(tmp_path / "a.tif", data)])
    assert (grid_of(px, data.shape) == data).all()
    assert px.where("row >= 1024 AND value IS NULL").count() == (data[1024:] == 0).sum()


def test_monitoring(spark):
    s = spark.createDataFrame([("a1", 0.0, 4.0), ("a2", 2.0, 6.0), ("a3", 6.0, 7.0), ("a4", 10.0, 11.0)], "name string, started double, ended double")
    assert monitor.time_spent(s).first().spent == 10.0 and monitor.time_elapsed(s).first().elapsed == 8.0
    assert monitor.overlap_percent(s).first().overlap == pytest.approx(100 * 2 / 11) and monitor.time_average(s.limit(0)).first().average is None
    m = api.Monitoring()
    with pytest.raises(RuntimeError), m.span("x"):
        raise RuntimeError
    assert m.stamp("x", "end") >= m.stamp("x", "start")
    assert monitor.spans(m.frame(spark), "x").count() == 1
    with pytest.raises(ValueError), m.span("a:b"):
        pass
    one, two = (spark.createDataFrame([("n", "start", t)], "name string, phase string, t double") for t in (5.0, 3.0))
    assert monitor.merge_stamps(one, two).first().t == 3.0


def test_jobs(spark, tmp_path):
    found = {f"2022-01-{d:02d}": [[f"T{i}", f"s3://b/{d}/{i}", 1.5] for i in range(9 if d < 3 else 8)] for d in range(1, 5)}
    (tmp_path / "s.json").write_text(json.dumps(found))
    t = raster.tiles_by_date(spark, str(tmp_path / "s.json"))
    j = jobs.job_list(t, ["B02", "B03"]).collect()
    assert len(j) == 4 and all(len(r.paths) == 9 for r in j) and j[0].paths[0].startswith("/vsis3/b/")
    p = jobs.percentiles(spark.createDataFrame([(float(i),) for i in range(11)], "x double"), "x").first()
    assert (p.p5, p.p50, p.p95) == (0.5, 5.0, 9.5)
    items = spark.createDataFrame([("2022-05-01T00:00:00Z", 1.0, 1.0, 2.0, 2.0, "T", "p", 0.0), ("2021-05-01T00:00:00Z", 1.0, 1.0, 2.0, 2.0, "T", "p", 0.0)], "datetime string, lon_min double, lat_min double, lon_max double, lat_max double, tilename string, path string, null_pcnt double")
    assert [r.date for r in jobs.search(items, (1.5, 1.5, 3, 3), 2022).collect()] == ["2022-05-01"] and jobs.search(items, (5, 5, 6, 6), 2022).count() == 0


@pytest.mark.parametrize("method", [*warp.NEIGHBOURS[1:], *warp.AREAS])
def test_every_resampling_through_the_facade(spark, tmp_path, method):
    """To an equal-area system and cells four times as wide; every pixel against its definition."""
    r = np.random.default_rng(1)
    data = r.integers(1, 9, (40, 48)).astype(np.float32)
    data[5:9, 5:9] = 0
    f = scene(tmp_path / "a.tif", data, 500000.0, 7000000.0, res=100.0)
    out = str(tmp_path / "o.tif")
    api.do_mosaic([f], out, outprojepsg=3577, outXres=400.0, outYres=400.0, resamplemethod=method, blocksize=16, spark=spark)
    h, got = geotiff.read_header(out), geotiff.read_array(out)
    assert (got != 0).sum() > 80
    c, w = np.meshgrid(np.arange(48) + 0.5, np.arange(40) + 0.5)
    x, y = geo.transform(32756, 3577, 500000 + c * 100, 7000000 - w * 100, geo.NUMPY)
    tc, tr = np.floor((x - h.gt[0]) / 400).astype(int), np.floor((h.gt[3] - y) / 400).astype(int)
    for i, j in zip(*np.nonzero(got)):
        v = data[(tr == i) & (tc == j)].astype(float)
        met, v = len(v), v[v != 0]
        if method in warp.AREAS and met:
            values, n = np.unique(v, return_counts=True)
            want = {"average": np.mean, "min": np.min, "max": np.max, "sum": np.sum, "med": np.median, "mode": lambda v: values[n.argmax()], "q1": lambda v: np.quantile(v, 0.25), "q3": lambda v: np.quantile(v, 0.75),
                    "rms": lambda v: np.sqrt(np.mean(v * v))}[method](v)
            assert got[i, j] == pytest.approx(want, rel=1e-6)
        elif method not in warp.AREAS:
            px, py = geo.transform(3577, 32756, np.array(h.gt[0] + (j + 0.5) * 400), np.array(h.gt[3] - (i + 0.5) * 400), geo.NUMPY)
            u, t = (px - 500000) / 100 - 0.5, (7000000 - py) / 100 - 0.5
            near = [(a, b) for a in range(40) for b in range(48) if abs(a - t) < 4 and abs(b - u) < 4 and data[a, b] and a - np.floor(t) in warp.REACH[method] and b - np.floor(u) in warp.REACH[method]]
            k = [float(warp.kernel(method, abs(a - t), np.sin, np.where) * warp.kernel(method, abs(b - u), np.sin, np.where)) for a, b in near]
            assert got[i, j] == pytest.approx(sum(n * data[p] for n, p in zip(k, near)) / sum(k), rel=1e-4)


def test_weighted_and_area_resampling(spark):
    data = np.arange(100.0).reshape(10, 10)
    px = spark.createDataFrame([(i, j, float(data[i, j])) for i in range(10) for j in range(10)], "row int, col int, value double")
    gt = lambda x, y, r: F.struct(F.lit(x).alias("x0"), F.lit(r).alias("xres"), F.lit(0.0).alias("xskew"), F.lit(y).alias("y0"), F.lit(0.0).alias("yskew"), F.lit(-r).alias("yres"))
    t = spark.range(9).select(F.floor(F.col("id") / 3).alias("row"), (F.col("id") % 3).alias("col"), gt(3.25, -3.5, 1.0).alias("gt"), gt(0.0, 0.0, 1.0).alias("source_gt"))
    flat = px.withColumn("value", F.lit(7.0))
    assert all(r.value == pytest.approx(7) for r in warp.warp_weighted(flat, t, 32756, 32756, "lanczos").collect())
    for method in ("bilinear", "cubic", "cubicspline"):  # all are exact on a plane
        for r in warp.warp_weighted(px, t, 32756, 32756, method).collect():
            assert r.value == pytest.approx(10 * (r.row + 3.5) + r.col + 3.25)
    assert {r.value for r in warp.resample_area(px, 5, "average").collect()} == {data[i:i + 5, j:j + 5].mean() for i in (0, 5) for j in (0, 5)}
    area = warp.warp_area(px, gt(0.0, 0.0, 1.0), gt(0.0, 0.0, 5.0), 32756, 32756, "max").collect()
    assert {(r.row, r.col): r.value for r in area} == {(0, 0): 44, (0, 1): 49, (1, 0): 94, (1, 1): 99}
    with pytest.raises(ValueError):
        warp.resample_area(px, 5, "lanczos")


def test_streams_agree_with_batches(spark, tmp_path):
    rows, _ = layout(7, 20)
    schema = "ord int, row int, col int, value double"
    px = spark.createDataFrame(rows, schema)
    px.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming.latest_valid(stream).writeStream.outputMode("complete").format("memory").queryName("latest").start()
    q.processAllAvailable()
    q.stop()
    mosaic.assert_equal(spark.table("latest"), mosaic.merge_pixels(px))
    arrivals = spark.createDataFrame([(0, 0, "a"), (0, 0, "b"), (0, 0, "b"), (0, 32, "a")], "top int, left int, scene_id string")
    need = spark.createDataFrame([(0, 0, 2), (0, 32, 2)], "top int, left int, expected int")
    assert [(r.top, r.left) for r in streaming.complete_blocks(arrivals, need).collect()] == [(0, 0)]


def test_seeded_sample_statistics(spark):
    random.seed(1)
    px = spark.createDataFrame([(float(i % 100),) for i in range(5000)], "value double")
    a = stats.approximate_stats(px, 0.5).first()
    assert abs(a.meanval - 49.5) < 3
    assert stats.band_stats(px.where("value IS NULL")).count() == 0
