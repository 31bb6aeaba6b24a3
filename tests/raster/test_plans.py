"""Grids, blocks and catalogs in closed form and against loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import geo, grid
from gridloom.plans import blocks, catalog


def by_loop(n, b):
    out, start = [], 0
    while start < n:
        size = b if n - start - b >= b // 4 else n - start
        if n - start <= b or (n - start - b) < b // 4 and n - start - b >= 0:
            size = n - start
        elif n - start - b >= b // 4:
            size = b
        out.append((start, size))
        start += size
    return out


def test_axis_splits_match_the_loop(spark):
    cases = [(n, b) for b in (1, 4, 7, 32, 64) for n in (0, 1, 3, 4, 5, 31, 32, 33, 39, 40, 63, 64, 65, 79, 80, 81, 500)]
    for b in {b for _, b in cases}:
        df = spark.createDataFrame([(n,) for n, x in cases if x == b], "n int")
        for r in df.select("n", grid.split_axis(F.col("n"), b).alias("s"), grid.split_axis_plain(F.col("n"), b).alias("p")).collect():
            # With b // 4 = 0 a remainder always gets a block.
            assert [tuple(x) for x in r.s] == (by_loop(r.n, b) if b >= 4 else [(i, min(b, r.n - i)) for i in range(0, r.n, b)]), (r.n, b)
            assert [tuple(x) for x in r.p] == [(i, min(b, r.n - i)) for i in range(0, r.n, b)]


def test_levels_and_rounding(spark):
    df = spark.createDataFrame([(9998, 5000)], "w int, h int")
    assert df.select(grid.overview_levels(F.col("w"), F.col("h"), 1024).alias("x")).first().x == [4, 8]
    halves = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,)], "x double")
    assert [r[0] for r in halves.select(grid.half_even(F.col("x"))).collect()] == [0, 2, 2, 0]


def scenes(spark, n=25, seed=3):
    r = random.Random(seed)
    return catalog.catalog_of(spark, [{"scene_id": f"s{i}", "ncols": r.randint(1, 90), "nrows": r.randint(1, 90), "gt": (1000 + 10.0 * r.randint(0, 300), 10.0, 0.0, 9000 - 10.0 * r.randint(0, 200), 0.0, -10.0),
                                       "srs": "EPSG:32756", "dtype": "uint16", "nodata": 0.0, "layer_type": ["athematic"]} for i in range(n)])


def test_both_overlap_joins_match_nested_loops(spark):
    c = scenes(spark)
    g = catalog.output_grid(c)
    b = blocks.block_list(g.select("ncols", "nrows"), 32).select("top", "left", "xsize", "ysize")
    s = blocks.scene_windows(c, g)
    want = {(x.top, x.left, y.scene_id, x.left - y.x0, x.top - y.y0) for x in b.collect() for y in s.collect()
            if x.left < y.x0 + y.ncols and y.x0 < x.left + x.xsize and x.top < y.y0 + y.nrows and y.y0 < x.top + x.ysize}
    key = lambda d: {(r.top, r.left, r.scene_id, r.in_left, r.in_top) for r in d.collect()}
    assert key(blocks.overlaps_theta(b, s)) == want == key(blocks.overlaps_bucketed(b, s, 32)) == key(blocks.overlaps(b, s, 32))
    found = blocks.overlaps(b, s, 32)
    plan = [(r.top, r.left, r.ord) for r in blocks.read_plan(found).collect()]
    assert plan == sorted(plan)
    readers = {(r.top, r.left, r.ord): r.reader for r in blocks.assign_readers(found, 3).collect()}
    assert [readers[p] for p in plan] == [i % 3 for i in range(len(plan))]
    covered = {(t, left) for t, left, *_ in want}
    assert {(r.top, r.left) for r in blocks.empty_blocks(b, found).collect()} == {(r.top, r.left) for r in b.collect()} - covered
    assert all(r.complete for r in blocks.completeness(found, found).collect())
    assert all(r.remaining == 0 for r in blocks.remaining(found, found).collect())


def test_the_first_violation_is_raised(spark):
    base = {"ncols": 10, "nrows": 10, "srs": "EPSG:32756", "dtype": "uint8"}
    gt = (0.0, 10.0, 0.0, 100.0, 0.0, -10.0)

    def of(**changes):
        return catalog.catalog_of(spark, [base | {"scene_id": "a", "gt": gt}, base | {"scene_id": "b", "gt": gt} | changes])

    catalog.check(of())
    catalog.check(of(srs=' epsg:32756'))
    for changes, said in (({"srs": "EPSG:32755"}, "b has another coordinate system"), ({"gt": (0.0, 20.0, 0.0, 100.0, 0.0, -10.0)}, "pixel width"), ({"gt": (0.0, 10.0, 0.0, 100.0, 0.0, -5.0)}, "pixel height"),
                          ({"gt": (3.0, 10.0, 0.0, 100.0, 0.0, -10.0)}, "columns off the grid"), ({"gt": (0.0, 10.0, 0.0, 101.0, 0.0, -10.0)}, "rows off the grid")):
        with pytest.raises(geo.ProjectionError, match=said):
            catalog.check(of(**changes))
    with pytest.raises(ValueError):
        catalog.check(catalog.catalog_of(spark, [base | {"scene_id": "a", "gt": gt, "num_bands": 2}, base | {"scene_id": "b", "gt": gt, "num_bands": 1}]))


def test_projections_round_trip_and_match_known_points(spark):
    df = spark.createDataFrame([(152.0, -27.0), (153.0, -27.0), (150.2, -35.5)], "lon double, lat double")
    e, n = geo.utm_forward(F.col("lon"), F.col("lat"), 56, True)
    rows = df.select("lon", "lat", e.alias("e"), n.alias("n")).select("*", *[c.alias(k) for c, k in zip(geo.utm_inverse(F.col("e"), F.col("n"), 56, True), ("lon2", "lat2"))]).collect()
    assert all(abs(r.lon - r.lon2) < 1e-8 and abs(r.lat - r.lat2) < 1e-8 for r in rows)
    assert rows[1].e == pytest.approx(500000) and rows[1].n == pytest.approx(7013564.757, abs=0.01)
    x, y = geo.transform(32756, 3857, rows[0].e, rows[0].n, geo.NUMPY)
    assert geo.transform(3857, 4326, x, y, geo.NUMPY) == pytest.approx((152.0, -27.0))
    assert geo.epsg_of('PROJCS["x",AUTHORITY["EPSG","32756"]]') == 32756 == geo.epsg_of('PROJCS["WGS 84 / UTM zone 56S",GEOGCS["WGS 84"]]')
    with pytest.raises(geo.ProjectionError):
        geo.epsg_of("unknown")


def test_an_odd_system_is_found_behind_many_spellings(spark):
    """More than a thousand spellings of one system, then another one: that scene is named."""
    base = {"ncols": 10, "nrows": 10, "dtype": "uint8", "gt": (0.0, 10.0, 0.0, 100.0, 0.0, -10.0)}
    infos = [base | {"scene_id": f"s{i}", "srs": f'PROJCS["name {i}",AUTHORITY["EPSG","32756"]]'} for i in range(1200)]
    catalog.check(catalog.catalog_of(spark, infos))
    with pytest.raises(geo.ProjectionError, match="odd has another"):
        catalog.check(catalog.catalog_of(spark, [*infos, base | {"scene_id": "odd", "srs": "EPSG:32755"}, *infos[:3]]))


def test_conic_azimuthal_and_polar_systems():
    """A published point; equal areas or equal angles everywhere; and back again."""
    m, r = geo.NUMPY, np.random.default_rng(0)
    x, y = geo.from_degrees(3035, np.array([5.0]), np.array([50.0]), m)
    assert (round(float(x[0]), 2), round(float(y[0]), 2)) == (3962799.45, 2999718.85)
    middle = {3112: (134, -25), 2154: (3, 46), 3577: (132, -25), 5070: (-96, 38), 3005: (-126, 54), 3035: (10, 52), 3031: (20, -75), 3976: (-60, -70), 3413: (-30, 75), 3995: (100, 80)}
    assert set(middle) == set(geo.SYSTEMS)
    for code, (lon, lat) in middle.items():
        lon, lat, h = lon + r.uniform(-15, 15, 200), lat + r.uniform(-8, 8, 200), 1e-5
        a, b = geo.to_degrees(code, *geo.from_degrees(code, lon, lat, m), m)
        assert np.abs((a - lon + 180) % 360 - 180).max() < 1e-7 and np.abs(b - lat).max() < 1e-7
        east, north = ([(p - q) / (2 * h) for p, q in zip(geo.from_degrees(code, lon + i, lat + j, m), geo.from_degrees(code, lon - i, lat - j, m))] for i, j in ((h, 0), (0, h)))
        w = np.sqrt(1 - (geo._E * np.sin(lat * geo.RAD))**2)
        nu, rho = geo.RADIUS / w * np.cos(lat * geo.RAD) * geo.RAD, geo.RADIUS * (1 - geo._E**2) / w**3 * geo.RAD
        if code in geo.CONFORMAL_CONIC or code in geo.POLAR:
            assert np.abs(np.hypot(*east) / nu / (np.hypot(*north) / rho) - 1).max() < 1e-7
        else:
            assert np.abs((east[0] * north[1] - east[1] * north[0]) / (nu * rho) - 1).max() < 1e-7
