"""Registered raster queries over the test tables, each with the SQL that defines its result.

PX reads lineitem as a raster: line numbers are scenes in order, order keys give rows and columns, 0 is nodata.
CAT reads part as a catalog of scenes that overlap in part; events and orders stand for spans and tile searches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import geo, grid as cells
from gridloom.operators import jobs, monitor, mosaic, stats, warp
from gridloom.plans import blocks as plan, catalog as cat
from gridloom.session import ship

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
WIDTH, TILE = 100, 32


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f
    return add


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _px(spark, sf) -> DataFrame:
    raw = _table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("ord"), F.floor(F.col("l_orderkey") / WIDTH).alias("row"), (F.col("l_orderkey") % WIDTH).alias("col"))
    return raw.agg(F.max(F.when(F.col("l_returnflag") == "R", 0.0).otherwise(F.col("l_quantity"))).alias("v")).select("ord", "row", "col", cells.null_if_nodata(F.col("v"), 0).alias("value"))


def _grid_rows(spark, sf) -> int:
    return _table(spark, sf, "lineitem").agg(F.max(F.floor(F.col("l_orderkey") / WIDTH))).first()[0] + 1


PX = """px AS (SELECT l_linenumber AS ord, CAST(floor(l_orderkey / 100) AS BIGINT) AS "row", l_orderkey % 100 AS col,
  nullif(max(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END), 0) AS value FROM lineitem GROUP BY 1, 2, 3)"""
LAST = """m AS (SELECT "row", col, arg_max(value, ord) FILTER (WHERE value IS NOT NULL) AS value FROM px GROUP BY 1, 2)"""


def _merged(spark, sf) -> DataFrame:
    return mosaic.merge_pixels(_px(spark, sf))


# ---- merging ---------------------------------------------------------------

@query(f"""WITH {PX}, {LAST} SELECT "row", col, coalesce(value, 0) AS value FROM m""")
def mosaic_last_valid(spark, sf):
    return _merged(spark, sf).withColumn("value", F.coalesce("value", F.lit(0.0)))


@query(f"""WITH {PX} SELECT ord, "row", col, value, last_value(value IGNORE NULLS) OVER (PARTITION BY "row", col ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS merged FROM px""")
def mosaic_window_last(spark, sf):
    return mosaic.merge_by_window(_px(spark, sf))


def _variant(name: str, sql: str):
    def run(spark, sf):
        return mosaic.merge_pixels(_px(spark, sf), name)
    run.__name__ = f"mosaic_{name}"
    query(f"""WITH {PX} SELECT "row", col, {sql} AS value FROM px GROUP BY 1, 2""")(run)


for _name, _sql in (("first", "arg_min(value, ord) FILTER (WHERE value IS NOT NULL)"), ("min", "min(value)"), ("max", "max(value)"), ("mean", "avg(value)"), ("count", "count(value)")):
    _variant(_name, _sql)

DENSE = f"""WITH {PX}, {LAST}, g AS (SELECT r.i AS "row", c.i AS col FROM range((SELECT max("row") + 1 FROM px)) r(i), range(100) c(i))
SELECT g."row", g.col, coalesce(value, 0) AS value FROM g LEFT JOIN m USING ("row", col)"""


@query(DENSE)
def mosaic_dense(spark, sf):
    return mosaic.dense(_merged(spark, sf), _grid_rows(spark, sf), WIDTH, 0.0)


@query(f"""WITH {PX}, {LAST} SELECT "row", col, value FROM m WHERE "row" >= 20 AND "row" < 90 AND col >= 10 AND col < 60""")
def mosaic_bbox(spark, sf):
    return mosaic.bounding_box(_merged(spark, sf), 20, 10, 90, 60)


@query(f"""WITH {PX}, {LAST}, t AS (SELECT DISTINCT "row" // 32 AS tr, col // 32 AS tc FROM px WHERE value IS NOT NULL),
g AS (SELECT r.i AS "row", c.i AS col FROM range((SELECT max("row") + 1 FROM px)) r(i), range(100) c(i))
SELECT g."row", g.col, value FROM g JOIN t ON tr = g."row" // 32 AND tc = g.col // 32 LEFT JOIN m USING ("row", col)""")
def mosaic_tiles(spark, sf):
    ship(spark)
    tiles = mosaic.to_tiles(_px(spark, sf), TILE, _grid_rows(spark, sf), WIDTH, 0.0)
    return mosaic.to_pixels(mosaic.merge_tiles(tiles, 0.0), 0.0).select("row", "col", "value")


@query(f"""WITH {PX}, {LAST}, f AS (SELECT "row", col, arg_min(value, ord) FILTER (WHERE value IS NOT NULL) AS value FROM px GROUP BY 1, 2)
SELECT count(*) AS cells, count(*) FILTER (WHERE m.value IS DISTINCT FROM f.value) AS differing FROM m FULL JOIN f USING ("row", col)""")
def raster_diff(spark, sf):
    return mosaic.difference(_merged(spark, sf), mosaic.merge_pixels(_px(spark, sf), "first"))


# ---- statistics and overviews -----------------------------------------------

def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("meanval", F.round("meanval", 6)).withColumn("stddev", F.round("stddev", 6))


STATS = "min(value) AS minval, max(value) AS maxval, round(avg(value), 6) AS meanval, round(stddev_pop(value), 6) AS stddev, count(value) AS count"


@query(f"WITH {PX}, {LAST} SELECT {STATS} FROM m")
def band_stats(spark, sf):
    return _rounded(stats.band_stats(_merged(spark, sf)))


@query(f"WITH {PX} SELECT ord, {STATS} FROM px GROUP BY 1 HAVING count(value) > 0")
def band_stats_by_scene(spark, sf):
    return _rounded(stats.band_stats(_px(spark, sf), ["ord"]))


@query(f"""WITH {PX}, {LAST} SELECT min(value) AS minval, max(value) AS maxval, round(sum(value) / count(value), 6) AS meanval,
round(sqrt(greatest(0, sum(value * value) / count(value) - (sum(value) / count(value)) ** 2)), 6) AS stddev, count(value) AS count FROM m""")
def band_stats_ssq(spark, sf):
    return _rounded(stats.band_stats_by_squares(_merged(spark, sf)))


def _overview(level: int):
    def run(spark, sf):
        return stats.overview(_merged(spark, sf), level)
    run.__name__ = f"overview_l{level}"
    query(f"""WITH {PX}, {LAST} SELECT "row" // {level} AS "row", col // {level} AS col, value FROM m WHERE "row" % {level} = {level // 2} AND col % {level} = {level // 2}""")(run)


_overview(4)
_overview(8)

@query("""SELECT p_partkey, (1 << i)::INTEGER AS level FROM part, range(2, 31) r(i) WHERE greatest(p_partkey * 37 % 4000, p_size * 101) // (1 << i) >= 64""")
def overview_levels(spark, sf):
    """Levels of rasters as wide and high as parts say."""
    p = _table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") * 37 % 4000).cast("int").alias("w"), (F.col("p_size") * 101).alias("h"))
    return p.select("p_partkey", F.explode(cells.overview_levels(F.col("w"), F.col("h"), 64)).alias("level"))


@query(f"""WITH {PX}, {LAST} SELECT "row" // 4 AS "row", col // 4 AS col, round(avg(value), 6) AS average, min(value) AS low, max(value) AS high, sum(value) AS total,
median(value) AS med, round(sqrt(avg(value * value)), 6) AS rms, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM m GROUP BY 1, 2""")
def resample_area(spark, sf):
    m, keys = _merged(spark, sf), [F.floor(F.col("row") / 4).alias("row"), F.floor(F.col("col") / 4).alias("col")]
    a = {k: f(F.col("value")) for k, f in warp.AREAS.items()}
    return m.groupBy(*keys).agg(F.round(a["average"], 6).alias("average"), a["min"].alias("low"), a["max"].alias("high"), a["sum"].alias("total"), a["med"].alias("med"),
                                F.round(a["rms"], 6).alias("rms"), a["q1"].alias("q1"), a["q3"].alias("q3"))


# ---- catalog, grid and blocks ------------------------------------------------

def _cat(spark, sf) -> DataFrame:
    """Scenes on a 10 m grid, north up; scene i starts (i * 37) % 4000 columns and (i * 53) % 3000 rows into it."""
    p = _table(spark, sf, "part")
    gt = F.struct((F.lit(300000.0) + (F.col("p_partkey") * 37 % 4000) * 10.0).alias("x0"), F.lit(10.0).alias("xres"), F.lit(0.0).alias("xskew"),
                  (F.lit(7000000.0) - (F.col("p_partkey") * 53 % 3000) * 10.0).alias("y0"), F.lit(0.0).alias("yskew"), F.lit(-10.0).alias("yres"))
    return p.select(F.col("p_partkey").cast("string").alias("scene_id"), F.col("p_partkey").cast("int").alias("ord"), F.col("p_size").alias("ncols"), (F.col("p_size") * 7 % 50 + 1).alias("nrows"),
                    gt.alias("gt"), F.lit("EPSG:32756").alias("srs"), F.lit("uint16").alias("dtype"), F.lit(1).alias("num_bands"), F.lit(0.0).alias("nodata"), F.array(F.lit("athematic")).alias("layer_type"))


CAT = """cat AS (SELECT p_partkey::VARCHAR AS scene_id, p_partkey::INTEGER AS ord, p_size AS ncols, p_size * 7 % 50 + 1 AS nrows,
  (300000 + (p_partkey * 37 % 4000) * 10)::DOUBLE AS gx, (7000000 - (p_partkey * 53 % 3000) * 10)::DOUBLE AS gy FROM part),
g AS (SELECT min(gx) AS x_min, max(gx + ncols * 10) AS x_max, min(gy - nrows * 10) AS y_min, max(gy) AS y_max FROM cat),
s AS (SELECT scene_id, ord, ncols, nrows, round_even((gx - x_min) / 10, 0)::INTEGER AS x0, round_even((y_max - gy) / 10, 0)::INTEGER AS y0 FROM cat, g),
d AS (SELECT round_even((x_max - x_min) / 10, 0)::INTEGER AS w, round_even((y_max - y_min) / 10, 0)::INTEGER AS h FROM g)"""
AXES = """ax AS (SELECT 'x' AS a, w AS n FROM d UNION ALL SELECT 'y', h FROM d),
an AS (SELECT a, n, CASE WHEN n > 0 THEN greatest(1, n // 64 + (n % 64 > 0 AND n % 64 >= 16)::INTEGER) ELSE 0 END AS k FROM ax),
part_ AS (SELECT a, (i * 64)::INTEGER AS start, (CASE WHEN i < k - 1 THEN 64 ELSE n - (k - 1) * 64 END)::INTEGER AS size FROM an, range(1000) r(i) WHERE i < k),
b AS (SELECT y.start AS top, x.start AS "left", x.size AS xsize, y.size AS ysize FROM part_ y, part_ x WHERE y.a = 'y' AND x.a = 'x')"""
OVERLAP = """o AS (SELECT top, "left", xsize, ysize, scene_id, ord, ncols, nrows, x0, y0, "left" - x0 AS in_left, top - y0 AS in_top FROM b, s
  WHERE "left" - x0 + xsize > 0 AND top - y0 + ysize > 0 AND "left" - x0 < ncols AND top - y0 < nrows)"""
BASE = f"WITH {CAT}, {AXES}, {OVERLAP}"


def _blocks(spark, sf):
    g = cat.output_grid(_cat(spark, sf))
    b = plan.block_list(g.select("ncols", "nrows"), 64).select("top", "left", "xsize", "ysize")
    return g, b, plan.scene_windows(_cat(spark, sf), g)


@query(f"WITH {CAT} SELECT scene_id, ord, ncols, nrows, gx AS x_min, gx + ncols * 10 AS x_max, gy - nrows * 10 AS y_min, gy AS y_max, 10.0::DOUBLE AS x_res, 10.0::DOUBLE AS y_res FROM cat")
def scene_catalog(spark, sf):
    return cat.with_extent(_cat(spark, sf)).select("scene_id", "ord", "ncols", "nrows", "x_min", "x_max", "y_min", "y_max", "x_res", "y_res")


@query(f"WITH {CAT} SELECT x_min, x_max, y_min, y_max, 'EPSG:32756' AS srs, w AS ncols, h AS nrows, 0.0::DOUBLE AS nodata FROM g, d")
def output_grid(spark, sf):
    return cat.output_grid(_cat(spark, sf)).select("x_min", "x_max", "y_min", "y_max", "srs", "ncols", "nrows", "nodata")


@query(f"WITH {CAT}, {AXES} SELECT * FROM b")
def block_list(spark, sf):
    return _blocks(spark, sf)[1]


@query("""SELECT p_partkey, (y * 64)::INTEGER AS top, (x * 64)::INTEGER AS "left", least(64, p_size * 9 - x * 64)::INTEGER AS xsize, least(64, p_size * 5 - y * 64)::INTEGER AS ysize
FROM part, range(8) a(y), range(8) c(x) WHERE x * 64 < p_size * 9 AND y * 64 < p_size * 5""")
def block_list_simple(spark, sf):
    """Blocks of a grid for each part."""
    p = _table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 9).alias("ncols"), (F.col("p_size") * 5).alias("nrows"))
    return plan.block_list(p, 64, plain=True).select("p_partkey", "top", "left", "xsize", "ysize")


@query(f"{BASE} SELECT * FROM o")
def block_scene_join(spark, sf):
    _, b, s = _blocks(spark, sf)
    return plan.overlaps(b, s, 64)


@query(f"{BASE} SELECT * FROM o")
def block_scene_join_bucketed(spark, sf):
    _, b, s = _blocks(spark, sf)
    return plan.overlaps_bucketed(b, s, 64)


def _found(spark, sf):
    _, b, s = _blocks(spark, sf)
    return b, plan.overlaps(b, s, 64)


@query(f"""{BASE} SELECT top, "left", xsize, ysize, scene_id, ord, in_left, in_top, greatest(in_left, 0) AS clip_left, greatest(least(in_left + xsize, ncols) - greatest(in_left, 0), 0) AS clip_width, greatest(-in_left, 0) AS pad_left FROM o""")
def read_plan(spark, sf):
    c = cells.window_clip(F.col("in_left"), F.col("xsize"), F.col("ncols"))
    return plan.read_plan(_found(spark, sf)[1]).select("top", "left", "xsize", "ysize", "scene_id", "ord", "in_left", "in_top", c["start"].alias("clip_left"), c["size"].alias("clip_width"), c["shift"].alias("pad_left"))


@query(f"""{BASE} SELECT top, "left", scene_id, ((row_number() OVER (ORDER BY top, "left", ord) - 1) % 4)::INTEGER AS reader FROM o""")
def read_plan_threads(spark, sf):
    return plan.assign_readers(_found(spark, sf)[1], 4).select("top", "left", "scene_id", "reader")


@query(f"""{BASE} SELECT top, "left", xsize, ysize FROM b WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.top = b.top AND o."left" = b."left")""")
def empty_blocks(spark, sf):
    return plan.empty_blocks(*_found(spark, sf)).select("top", "left", "xsize", "ysize")


@query(f"""{BASE} SELECT top, "left", count(*) AS expected, count(*) FILTER (WHERE ncols > 10) AS arrived, count(*) = count(*) FILTER (WHERE ncols > 10) AS complete FROM o GROUP BY 1, 2""")
def blocks_complete(spark, sf):
    """Scenes wider than ten pixels have arrived."""
    found = _found(spark, sf)[1]
    return plan.completeness(found, found.where("ncols > 10"))


@query(f"""{BASE} SELECT scene_id, count(*) FILTER (WHERE top < 128) AS remaining FROM o GROUP BY 1""")
def blocks_remaining(spark, sf):
    found = _found(spark, sf)[1]
    return plan.remaining(found, found.where("top >= 128"))


def _odd(spark, sf) -> DataFrame:
    """CAT with every few scenes off in some way."""
    k = F.col("ord")
    c = _cat(spark, sf).withColumn("srs", F.when(k % 11 == 5, "EPSG:32755").otherwise(F.col("srs")))
    gt = F.col("gt").withField("xres", F.when(k % 7 == 6, 20.0).otherwise(F.col("gt.xres"))).withField("x0", F.when(k % 5 == 4, F.col("gt.x0") + 3).otherwise(F.col("gt.x0"))).withField("y0", F.when(k % 3 == 2, F.col("gt.y0") + 5).otherwise(F.col("gt.y0")))
    return c.withColumn("gt", gt)


@query(f"""WITH {CAT}, odd AS (SELECT scene_id, ord, ord % 11 = 5 AS a, ord % 7 = 6 AS b, gx + CASE WHEN ord % 5 = 4 THEN 3 ELSE 0 END AS x, gy + CASE WHEN ord % 3 = 2 THEN 5 ELSE 0 END AS y FROM cat),
f AS (SELECT x AS fx, y AS fy FROM odd ORDER BY ord LIMIT 1)
SELECT scene_id, ord, CASE WHEN a THEN 'system' WHEN b THEN 'x_size' WHEN abs(round_even(abs(x - fx) / 10, 0) - abs(x - fx) / 10) >= 0.0001 THEN 'x_alignment' ELSE 'y_alignment' END AS problem FROM odd, f
WHERE a OR b OR abs(round_even(abs(x - fx) / 10, 0) - abs(x - fx) / 10) >= 0.0001 OR abs(round_even(abs(y - fy) / 10, 0) - abs(y - fy) / 10) >= 0.0001""")
def projection_violations(spark, sf):
    return cat.violations(_odd(spark, sf))


@query(f"""SELECT p_partkey, abs(round_even(abs(p_retailprice - 900) / 10, 0) - abs(p_retailprice - 900) / 10) < 0.0001 AS aligned FROM part""")
def grid_alignment(spark, sf):
    return _table(spark, sf, "part").select("p_partkey", geo.aligned(F.col("p_retailprice"), F.lit(900.0), F.lit(10.0)).alias("aligned"))


@query("SELECT p_partkey, 30 * floor((p_retailprice - 950) / 30) + 0.0 AS low, 30 * ceil((p_retailprice - 950) / 30) + 0.0 AS high FROM part")
def snap_grid(spark, sf):
    v = F.col("p_retailprice") - 950
    return _table(spark, sf, "part").select("p_partkey", geo.snap_down(v, F.lit(30.0)).alias("low"), geo.snap_up(v, F.lit(30.0)).alias("high"))


# ---- projections -------------------------------------------------------------

def _sql_forward(lon: str, lat: str) -> str:
    """UTM zone 56 south of degree columns, as SQL over a table named ll."""
    phi, dl, e = f"radians({lat})", f"radians({lon} - 153)", geo._E
    terms_e = "".join(f" + {a!r} * cos({2 * j} * xi) * sinh_({2 * j} * eta)" for j, a in enumerate(geo.ALPHA, 1))
    terms_n = "".join(f" + {a!r} * sin({2 * j} * xi) * cosh_({2 * j} * eta)" for j, a in enumerate(geo.ALPHA, 1))
    hyp = lambda x: x.replace("sinh_", "sinh").replace("cosh_", "cosh")
    return hyp(f"""t AS (SELECT *, sinh(atanh(sin({phi})) - {e!r} * atanh({e!r} * sin({phi}))) AS t, {dl} AS dl FROM ll),
x AS (SELECT *, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta FROM t),
f AS (SELECT *, 500000 + {geo.SCALE * geo._A!r} * (eta{terms_e}) AS e, 10000000 + {geo.SCALE * geo._A!r} * (xi{terms_n}) AS n FROM x)""")


LL = "ll AS (SELECT p_partkey, 150.5 + (p_partkey % 97) / 19.4 AS lon, -40.0 + (p_partkey % 89) / 2.5 AS lat FROM part)"


def _ll(spark, sf):
    k = F.col("p_partkey")
    return _table(spark, sf, "part").select(k, (F.lit(150.5) + (k % 97) / 19.4).alias("lon"), (F.lit(-40.0) + (k % 89) / 2.5).alias("lat"))


@query(f"WITH {LL}, {_sql_forward('lon', 'lat')} SELECT p_partkey, round(e, 3) AS e, round(n, 3) AS n FROM f")
def utm_forward(spark, sf):
    e, n = geo.utm_forward(F.col("lon"), F.col("lat"), 56, True)
    return _ll(spark, sf).select("p_partkey", F.round(e, 3).alias("e"), F.round(n, 3).alias("n"))


@query(f"WITH {LL} SELECT p_partkey, round(lon, 7) AS lon, round(lat, 7) AS lat FROM ll")
def utm_inverse(spark, sf):
    e, n = geo.utm_forward(F.col("lon"), F.col("lat"), 56, True)
    lon, lat = geo.utm_inverse(F.col("e"), F.col("n"), 56, True)
    return _ll(spark, sf).select("p_partkey", e.alias("e"), n.alias("n")).select("p_partkey", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


@query(f"WITH {LL} SELECT p_partkey, round(radians(lon) * 6378137, 3) AS x, round(asinh(tan(radians(lat))) * 6378137, 3) AS y FROM ll")
def web_mercator_forward(spark, sf):
    x, y = geo.web_forward(F.col("lon"), F.col("lat"))
    return _ll(spark, sf).select("p_partkey", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


ALBERS = geo.SYSTEMS[3577]


@query(f"""WITH {LL}, q AS (SELECT *, sin(radians(lat)) AS s FROM ll), r AS (SELECT *, {geo.RADIUS / ALBERS.n!r} * sqrt({ALBERS.c!r} - {ALBERS.n!r} * {1 - geo._E**2!r} * (s / (1 - {geo._E**2!r} * s * s) + atanh({geo._E!r} * s) / {geo._E!r})) AS r FROM q)
SELECT p_partkey, round(r * sin({ALBERS.n!r} * radians(lon - 132)), 3) AS x, round({ALBERS.origin!r} - r * cos({ALBERS.n!r} * radians(lon - 132)), 3) AS y FROM r""")
def albers_forward(spark, sf):
    x, y = geo.from_degrees(3577, F.col("lon"), F.col("lat"))
    return _ll(spark, sf).select("p_partkey", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(f"WITH {LL} SELECT p_partkey, round(lon, 7) AS lon, round(lat, 7) AS lat FROM ll")
def conic_inverse(spark, sf):
    x, y = geo.from_degrees(3112, F.col("lon"), F.col("lat"))
    ll = _ll(spark, sf).select("p_partkey", x.alias("x"), y.alias("y"))
    lon, lat = geo.to_degrees(3112, F.col("x"), F.col("y"))
    return ll.select("p_partkey", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


@query(f"""WITH c4 AS (SELECT p_partkey AS scene, 151 + (p_partkey % 40) / 10 + i * 0.02 AS lon, -30 - (p_partkey % 30) / 10 - j * 0.01 AS lat FROM part, range(2) a(i), range(2) b(j)),
ll AS (SELECT scene, lon, lat FROM c4), {_sql_forward('lon', 'lat')}
SELECT scene::VARCHAR AS scene_id, round(10 * floor(min(e) / 10), 3) AS b_x_min, round(10 * ceil(max(e) / 10), 3) AS b_x_max, round(10 * floor(min(n) / 10), 3) AS b_y_min, round(10 * ceil(max(n) / 10), 3) AS b_y_max FROM f GROUP BY 1""")
def reproj_corners(spark, sf):
    k = F.col("p_partkey")
    gt = F.struct((F.lit(151.0) + (k % 40) / 10.0).alias("x0"), F.lit(0.0002).alias("xres"), F.lit(0.0).alias("xskew"), (F.lit(-30.0) - (k % 30) / 10.0).alias("y0"), F.lit(0.0).alias("yskew"), F.lit(-0.0001).alias("yres"))
    c = _table(spark, sf, "part").select(k.cast("string").alias("scene_id"), F.lit(100).alias("ncols"), F.lit(100).alias("nrows"), gt.alias("gt"))
    out = warp.snapped(warp.corner_box(c, 4326, 32756), 10.0, 10.0)
    return out.select("scene_id", *[F.round(x, 3).alias(x) for x in ("b_x_min", "b_x_max", "b_y_min", "b_y_max")])


def _targets(spark, sf):
    """A grid of 2.5-pixel cells over the whole mosaic, 40 across, shifted against its pixels."""
    down = -(-_grid_rows(spark, sf) * 2 // 5)
    gt = lambda x0, y0, r: F.struct(F.lit(x0).alias("x0"), F.lit(r).alias("xres"), F.lit(0.0).alias("xskew"), F.lit(y0).alias("y0"), F.lit(0.0).alias("yskew"), F.lit(-r).alias("yres"))
    return spark.range(40 * down).select(F.floor(F.col("id") / 40).alias("row"), (F.col("id") % 40).alias("col"), gt(0.3, -0.4, 2.5).alias("gt"), gt(0.0, 0.0, 1.0).alias("source_gt"))


@query(f"""WITH {PX}, {LAST}, t AS (SELECT i AS "row", j AS col, floor(0.3 + (j + 0.5) * 2.5)::BIGINT AS c, floor(0.4 + (i + 0.5) * 2.5)::BIGINT AS r FROM range((SELECT (max("row") + 1) * 2 + 4 FROM px) // 5) a(i), range(40) b(j))
SELECT t."row", t.col, value FROM t LEFT JOIN m ON m."row" = t.r AND m.col = t.c""")
def warp_nearest(spark, sf):
    return warp.warp_nearest(_merged(spark, sf), _targets(spark, sf), 32756, 32756)


@query(f"""WITH {PX}, {LAST}, t AS (SELECT i AS "row", j AS col, -0.1 + (i + 0.5) * 2.5 AS y, -0.2 + (j + 0.5) * 2.5 AS x FROM range((SELECT (max("row") + 1) * 2 + 4 FROM px) // 5) a(i), range(40) b(j)),
w AS (SELECT t."row", t.col, value, (1 - abs(y - m."row")) * (1 - abs(x - m.col)) AS w FROM t JOIN m ON m."row" IN (floor(y), floor(y) + 1) AND m.col IN (floor(x), floor(x) + 1) AND value IS NOT NULL),
s AS (SELECT "row", col, sum(w * value) AS s, sum(w) AS w FROM w GROUP BY 1, 2)
SELECT t."row", t.col, round(CASE WHEN abs(w) > 1e-9 THEN s / w END, 6) AS value FROM t LEFT JOIN s USING ("row", col)""")
def warp_bilinear(spark, sf):
    return warp.warp_weighted(_merged(spark, sf), _targets(spark, sf), 32756, 32756, "bilinear").withColumn("value", F.round("value", 6))


@query(f"""WITH {PX}, {LAST}, t AS (SELECT i AS "row", j AS col, -0.1 + (i + 0.5) * 2.5 AS y, -0.2 + (j + 0.5) * 2.5 AS x FROM range((SELECT (max("row") + 1) * 2 + 4 FROM px) // 5) a(i), range(40) b(j)),
w AS (SELECT t."row", t.col, value, abs(y - m."row") AS a, abs(x - m.col) AS b FROM t JOIN m ON m."row" - floor(y) BETWEEN -2 AND 3 AND m.col - floor(x) BETWEEN -2 AND 3 AND value IS NOT NULL),
k AS (SELECT "row", col, value, CASE WHEN a < 1e-9 THEN 1 WHEN a < 3 THEN 3 * sin(pi() * a) * sin(pi() * a / 3) / (pi() * a) ** 2 ELSE 0 END * CASE WHEN b < 1e-9 THEN 1 WHEN b < 3 THEN 3 * sin(pi() * b) * sin(pi() * b / 3) / (pi() * b) ** 2 ELSE 0 END AS w FROM w),
s AS (SELECT "row", col, sum(w * value) AS s, sum(w) AS w FROM k GROUP BY 1, 2)
SELECT t."row", t.col, round(CASE WHEN abs(w) > 1e-9 THEN s / w END, 4) AS value FROM t LEFT JOIN s USING ("row", col)""")
def warp_lanczos(spark, sf):
    return warp.warp_weighted(_merged(spark, sf), _targets(spark, sf), 32756, 32756, "lanczos").withColumn("value", F.round("value", 4))


# ---- monitoring ---------------------------------------------------------------

def _stamps(spark, sf) -> DataFrame:
    """Each event as a span of its value in seconds, in groups of event types."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return _table(spark, sf, "events").select(F.col("event_type").alias("grp"), t.alias("started"), (t + F.abs("value")).alias("ended"))


EV = "ev AS (SELECT event_type AS grp, epoch_us(ts) / 1e6 AS started, epoch_us(ts) / 1e6 + abs(value) AS ended FROM events)"
SWEEP = f"""{EV}, e AS (SELECT grp, started AS t, 1 AS d FROM ev UNION ALL SELECT grp, ended, -1 FROM ev),
s AS (SELECT grp, t, sum(d) OVER w AS k, lead(t) OVER w AS u FROM e WINDOW w AS (PARTITION BY grp ORDER BY t, d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query(f"WITH {EV} SELECT grp, round(sum(ended - started), 2) AS spent FROM ev GROUP BY 1")
def time_spent(spark, sf):
    return monitor.time_spent(_stamps(spark, sf), ["grp"])


@query(f"WITH {EV} SELECT grp, round(avg(ended - started), 3) AS average FROM ev GROUP BY 1")
def time_avg(spark, sf):
    return monitor.time_average(_stamps(spark, sf), ["grp"])


@query(f"WITH {SWEEP} SELECT grp, round(sum(CASE WHEN k > 0 AND u IS NOT NULL THEN u - t ELSE 0 END), 2) AS elapsed FROM s GROUP BY 1")
def time_elapsed_union(spark, sf):
    return monitor.time_elapsed(_stamps(spark, sf), ["grp"])


@query(f"WITH {SWEEP} SELECT grp, round(100 * sum(CASE WHEN k > 1 AND u IS NOT NULL THEN u - t ELSE 0 END) / (max(t) - min(t)), 4) AS overlap FROM s GROUP BY 1")
def overlap_pct(spark, sf):
    return monitor.overlap_percent(_stamps(spark, sf), ["grp"]).withColumn("overlap", F.round("overlap", 4))


def _named(spark, sf, where: str) -> DataFrame:
    e = _table(spark, sf, "events").where(where)
    return monitor.parse_stamps(e.select(F.concat_ws(":", F.concat(F.col("event_type"), F.col("user_id").cast("string")), F.when(F.col("event_id") % 2 == 0, "start").otherwise("end")).alias("key"), F.col("value").alias("t")))


@query("SELECT DISTINCT event_type || user_id AS name FROM events WHERE starts_with(event_type, 'c')")
def names_by_prefix(spark, sf):
    return monitor.names_with_prefix(_named(spark, sf, "true"), "c")


@query("""WITH a AS (SELECT event_type || user_id AS name, CASE WHEN event_id % 2 = 0 THEN 'start' ELSE 'end' END AS phase, value, value >= 35 AS later FROM events)
SELECT name, phase, max(value) FILTER (WHERE later = l) AS t FROM a JOIN (SELECT name, phase, bool_or(later) AS l FROM a GROUP BY 1, 2) USING (name, phase) GROUP BY 1, 2""")
def stamps_merge(spark, sf):
    one = lambda where: _named(spark, sf, where).groupBy("name", "phase").agg(F.max("t").alias("t"))
    return monitor.merge_stamps(one("value < 35"), one("value >= 35"))


@query("SELECT event_type, min(value) AS low, max(value) AS high FROM events GROUP BY 1")
def gauge_minmax(spark, sf):
    return stats.gauge(_table(spark, sf, "events"), "value", ["event_type"])


# ---- job lists ------------------------------------------------------------------

def _search(spark, sf) -> DataFrame:
    return _table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.concat(F.lit("T"), F.col("o_orderkey").cast("string")).alias("tilename"),
                                              F.concat(F.lit("s3://tiles/"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_totalprice").alias("null_pcnt"))


TILES = "q AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, 'T' || o_orderkey AS tilename, 's3://tiles/' || o_orderkey AS path, o_totalprice AS null_pcnt FROM orders)"


@query(f"WITH {TILES} SELECT date, count(*) AS n FROM q GROUP BY 1 HAVING count(*) = 9")
def jobs_having_n(spark, sf):
    return jobs.dates_with(_search(spark, sf), 9)


JOBS = f"""WITH {TILES}, n AS (SELECT date FROM q GROUP BY 1 HAVING count(*) = 9), j AS (SELECT date, b AS band, string_agg(replace(path, 's3:/', '/vsis3') || '/' || b || '.tif', ' ' ORDER BY tilename) AS paths
FROM q JOIN n USING (date), (VALUES ('B02'), ('B03'), ('B04'), ('B08')) v(b) GROUP BY 1, 2)"""


@query(f"{JOBS} SELECT * FROM j")
def job_paths(spark, sf):
    return jobs.job_list(_search(spark, sf), ["B02", "B03", "B04", "B08"]).withColumn("paths", F.array_join("paths", " "))


@query(f"{JOBS} SELECT date, band FROM j ORDER BY date, band LIMIT 40")
def first_jobs(spark, sf):
    return jobs.first_jobs(jobs.job_list(_search(spark, sf), ["B02", "B03", "B04", "B08"]), 40).select("date", "band")


@query(f"WITH {TILES} SELECT date, string_agg(tilename, ' ' ORDER BY tilename) AS tiles FROM q GROUP BY 1")
def tiles_by_date(spark, sf):
    return jobs.by_date(_search(spark, sf)).select("date", F.array_join(F.transform("tiles", lambda x: x["tilename"]), " ").alias("tiles"))


@query("SELECT event_type, round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, count(value) AS count FROM events GROUP BY 1")
def percentiles_by_group(spark, sf):
    p = jobs.percentiles(_table(spark, sf, "events"), "value", ["event_type"])
    return p.select("event_type", *[F.round(c, 6).alias(c) for c in ("p5", "p50", "p95")], "count")


# ---- the golden pair --------------------------------------------------------------

def golden_pair(spark: SparkSession, side: int) -> DataFrame:
    """Two square scenes whose values are their column numbers, 0 being nodata; the second starts two columns before the first ends."""
    n = F.col("id") % (side * side)
    scene = F.floor(F.col("id") / (side * side)).cast("int")
    col = (n % side).cast("int")
    return spark.range(2 * side * side).select(scene.alias("ord"), F.floor(n / side).cast("int").alias("row"), (col + scene * (side - 2)).cast("int").alias("col"), cells.null_if_nodata(col.cast("double"), 0).alias("value"))


@query("""WITH g AS (SELECT CASE WHEN i < 999 THEN i ELSE i - 998 END AS v FROM range(1, 1998) r(i))
SELECT min(v)::DOUBLE AS minval, max(v)::DOUBLE AS maxval, round(avg(v), 6) AS meanval, round(stddev_pop(v), 6) AS stddev, (count(*) * 1000)::BIGINT AS count FROM g""")
def mosaic_golden_pair(spark, sf):
    """Statistics of the golden mosaic at 1000 x 1000 pixels a scene."""
    return _rounded(stats.band_stats(mosaic.merge_pixels(golden_pair(spark, 1000))))
