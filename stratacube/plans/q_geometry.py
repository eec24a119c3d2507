"""Grids, coordinates, projections, resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratacube.functions import geometry as G
from stratacube.operators import resample
from stratacube.plans import adapters as A
from stratacube.plans.base import query

W = A.with_adapters
T = (10.0, 0.0, 746090.0, 0.0, -10.0, 2540440.0)


def _pixels(spark, d):
    return A.cube(spark, d).select("y", "x").distinct()


PIX = ", p AS (SELECT DISTINCT y, x FROM cube)"


@query("pixel_centers", W(PIX + " SELECT y, x, (x + 0.5::DOUBLE) * 10 + 746090 AS px, (y + 0.5::DOUBLE) * -10 + 2540440 AS py FROM p", "cube"))
def pixel_centers(spark, d):
    px, py = G.centre(T, F.col("x"), F.col("y"))
    return _pixels(spark, d).select("y", "x", px.alias("px"), py.alias("py"))


@query("affine_round_trip", W(PIX + " SELECT y, x, x * 10.0::DOUBLE + y * 0.5::DOUBLE + 746090 AS cx, x * 0.25::DOUBLE + y * -10.0::DOUBLE + 2540440 AS cy, x::DOUBLE AS col, y::DOUBLE AS row FROM p", "cube"))
def affine_round_trip(spark, d):
    t = (10.0, 0.5, 746090.0, 0.25, -10.0, 2540440.0)
    p = _pixels(spark, d)
    cx, cy = G.corner(t, F.col("x"), F.col("y"))
    p = p.withColumn("cx", cx).withColumn("cy", cy)
    col, row = G.pixel(t, F.col("cx"), F.col("cy"))
    return p.select("y", "x", "cx", "cy", F.round(col, 6).alias("col"), F.round(row, 6).alias("row"))


@query("transform_scale", "SELECT k::INTEGER AS level, 10.0::DOUBLE * pow(2, k) AS a, -10.0::DOUBLE * pow(2, k) AS e, 746090.0::DOUBLE AS c, 2540440.0::DOUBLE AS f, ceil(37 / pow(2, k))::INTEGER AS height, ceil(29 / pow(2, k))::INTEGER AS width FROM range(0, 4) r(k)")
def transform_scale(spark, d):
    from stratacube.operators.pyramid import shapes

    rows = []
    for k, (h, w) in enumerate(shapes(A.OBS_H, A.OBS_W, 8)):
        t = G.level_transform(T, k)
        rows.append((k, t[0], t[4], t[2], t[5], h, w))
    return spark.createDataFrame(rows, "level int, a double, e double, c double, f double, height int, width int")


@query("mercator", W(PIX + ", l AS (SELECT y, x, x * 12.0::DOUBLE - 170 AS lon, y * 4.0::DOUBLE - 72 AS lat FROM p) SELECT y, x, round((lon + 180) / 360, 12) AS mx, round(0.5 - asinh(tan(radians(lat))) / (2 * pi()), 10) AS my, round(lon, 9) AS lon, round(lat, 9) AS lat FROM l", "cube"))
def mercator(spark, d):
    p = _pixels(spark, d).withColumn("lon", F.col("x") * 12.0 - 170).withColumn("lat", F.col("y") * 4.0 - 72)
    mx, my = G.mercator(F.col("lon"), F.col("lat"))
    p = p.withColumn("mx", mx).withColumn("my", my)
    lon, lat = G.from_mercator(F.col("mx"), F.col("my"))
    return p.select("y", "x", F.round("mx", 12).alias("mx"), F.round("my", 10).alias("my"), F.round(lon, 9).alias("lon"), F.round(lat, 9).alias("lat"))


@query("web_mercator_metres", W(PIX + ", l AS (SELECT y, x, x * 12.0::DOUBLE - 170 AS lon, y * 4.0::DOUBLE - 72 AS lat FROM p) SELECT y, x, round(radians(lon) * 6378137, 4) AS mx, round(6378137 * ln(tan(pi() / 4 + radians(lat) / 2)), 4) AS my FROM l", "cube"))
def web_mercator_metres(spark, d):
    p = _pixels(spark, d).withColumn("p", G.projected("EPSG:3857", F.col("x") * 12.0 - 170, F.col("y") * 4.0 - 72))
    return p.select("y", "x", F.round("p.x", 4).alias("mx"), F.round("p.y", 4).alias("my"))


@query("utm_round_trip", W(PIX + " SELECT y, x, round(746090 + 10.0::DOUBLE * (x + 0.5), 3) AS ex, round(2540440 - 10.0::DOUBLE * (y + 0.5), 3) AS ny FROM p", "cube"))
def utm_round_trip(spark, d):
    """Pixel centres to longitude and latitude and back: to the millimetre."""
    px, py = G.centre(T, F.col("x"), F.col("y"))
    ll = _pixels(spark, d).withColumn("ll", G.lonlat("EPSG:32631", px, py))
    back = ll.withColumn("e", G.projected("EPSG:32631", F.col("ll.lon"), F.col("ll.lat")))
    return back.select("y", "x", F.round("e.x", 3).alias("ex"), F.round("e.y", 3).alias("ny"))


@query("point_query", W("SELECT t, b, v FROM cube WHERE y = 17 AND x = 12", "cube"))
def point_query(spark, d):
    """A longitude and latitude to the pixel below it, by plain arithmetic before the scan; then a filter that prunes."""
    lon, lat = (float(v) for v in G.projection("EPSG:32631")[0](T[2] + 10 * 12.3, T[5] - 10 * 17.8))
    x, y = (float(v) for v in G.projection("EPSG:32631")[1](lon, lat))
    col, row = int((x - T[2]) // T[0]), int((y - T[5]) // T[4])
    return A.cube(spark, d).filter((F.col("y") == row) & (F.col("x") == col)).select("t", "b", "v")


@query("spatial_subset", W(", g AS (SELECT max(v) AS west, min(w) AS east FROM (VALUES (3, 25), (5, 29), (4, 27)) k(v, w)) SELECT t, b, y, x, v FROM cube, g WHERE x >= west AND x < east AND y >= 6 AND y < 30", "cube"))
def spatial_subset(spark, d):
    """The overlap of three grids, in whole pixels."""
    boxes = [(3, 2, 25, 30), (5, 6, 29, 33), (4, 1, 27, 37)]
    x0, y0, x1, y1 = max(b[0] for b in boxes), max(b[1] for b in boxes), min(b[2] for b in boxes), min(b[3] for b in boxes)
    return A.cube(spark, d).filter((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1)).select("t", "b", "y", "x", "v")


@query("level_for_gsd", "WITH l AS (SELECT k, 10.0::DOUBLE * pow(2, k) AS r FROM range(0, 4) s(k)) SELECT g::INTEGER AS gsd, coalesce(max(k) FILTER (WHERE r <= g), 0)::INTEGER AS level FROM l, range(5, 120, 5) q(g) GROUP BY g")
def level_for_gsd(spark, d):
    levels = spark.range(4).select(F.col("id").cast("int").alias("k"), (F.lit(10.0) * F.pow(F.lit(2.0), F.col("id"))).alias("r"))
    asked = spark.range(5, 120, 5).select(F.col("id").cast("int").alias("gsd"))
    return asked.join(levels, F.col("r") <= F.col("gsd"), "left").groupBy("gsd").agg(F.coalesce(F.max_by("k", "r"), F.lit(0)).alias("level"))


@query("footprint_edges", W(", e AS (SELECT i / 32.0::DOUBLE AS f FROM range(0, 33) r(i)), p AS (SELECT f * 29 AS c, 0 AS r FROM e UNION ALL SELECT f * 29, 37 FROM e UNION ALL SELECT 0, f * 37 FROM e UNION ALL SELECT 29, f * 37 FROM e) SELECT min(746090 + 10 * c)::DOUBLE AS west, min(2540440 - 10 * r)::DOUBLE AS south, max(746090 + 10 * c)::DOUBLE AS east, max(2540440 - 10 * r)::DOUBLE AS north FROM p", "cube"))
def footprint_edges(spark, d):
    f = spark.range(33).select((F.col("id") / 32.0).alias("f"))
    w, h = float(A.OBS_W), float(A.OBS_H)
    zero = F.lit(0.0)
    p = f.select(F.explode(F.array(*[F.struct(c.alias("c"), r.alias("r")) for c, r in ((F.col("f") * w, zero), (F.col("f") * w, F.lit(h)), (zero, F.col("f") * h), (F.lit(w), F.col("f") * h))])).alias("p"))
    x, y = G.corner(T, F.col("p.c"), F.col("p.r"))
    return p.select(x.alias("x"), y.alias("y")).agg(F.min("x").alias("west"), F.min("y").alias("south"), F.max("x").alias("east"), F.max("y").alias("north"))


@query("grid_snap", W("SELECT tile, floor(min(price) / 60)::BIGINT * 60 AS west, ceil(max(price) / 60)::BIGINT * 60 AS east, (ceil(max(price) / 60) - floor(min(price) / 60))::BIGINT AS width FROM scenes GROUP BY tile", "scenes"))
def grid_snap(spark, d):
    s = A.scenes(spark, d).groupBy("tile").agg((F.floor(F.min("price") / 60)).alias("a"), (F.ceil(F.max("price") / 60)).alias("b"))
    return s.select("tile", (F.col("a") * 60).alias("west"), (F.col("b") * 60).alias("east"), (F.col("b") - F.col("a")).alias("width"))


@query("transform_from_coords", W("SELECT 10.0::DOUBLE AS dx, -10.0::DOUBLE AS dy, min(746090 + 10.0::DOUBLE * (x + 0.5)) - 5 AS c, max(2540440 - 10.0::DOUBLE * (y + 0.5)) + 5 AS f FROM cube", "cube"))
def transform_from_coords(spark, d):
    px, py = G.centre(T, F.col("x"), F.col("y"))
    c = _pixels(spark, d).agg(F.array_sort(F.collect_set(px)).alias("xs"), F.reverse(F.array_sort(F.collect_set(py))).alias("ys"))  # as many as the grid is wide
    return c.select((F.col("xs")[1] - F.col("xs")[0]).alias("dx"), (F.col("ys")[1] - F.col("ys")[0]).alias("dy"), "xs", "ys").select("dx", "dy", (F.col("xs")[0] - F.col("dx") / 2).alias("c"), (F.col("ys")[0] - F.col("dy") / 2).alias("f"))


WARP = ", s AS (SELECT t, y, x, v FROM cube WHERE b = 0), k AS (SELECT t, (y // 3)::INTEGER AS y, (x // 3)::INTEGER AS x, {agg} FROM s GROUP BY t, y // 3, x // 3) SELECT * FROM k"


@query("warp_reduce", W(WARP.format(agg="floor(avg(v))::INTEGER AS average, min(v) AS least, max(v) AS most, floor(median(v))::INTEGER AS med"), "cube"))
def warp_reduce(spark, d):
    """To a grid three times coarser: the average, least, most and median of the pixels whose centres fall into a target pixel."""
    s = A.cube(spark, d).filter("b = 0").select("t", "y", "x", "v")
    to = (30.0, 0.0, T[2], 0.0, -30.0, T[5])
    out = None
    for name, method in (("average", "average"), ("least", "min"), ("most", "max"), ("med", "med")):
        one = resample.warped(s, T, to, 13, 10, method).withColumnRenamed("v", name)
        out = one if out is None else out.join(one, ["t", "y", "x"])
    return out.select("t", "y", "x", F.floor("average").cast("int").alias("average"), F.col("least").cast("int").alias("least"), F.col("most").cast("int").alias("most"), F.floor("med").cast("int").alias("med"))


@query("warp_mode", W(", s AS (SELECT t, y, x, v % 5 AS v FROM cube WHERE b = 0), c AS (SELECT t, (y // 3)::INTEGER AS y, (x // 3)::INTEGER AS x, v, count(*) AS n FROM s GROUP BY ALL) SELECT t, y, x, arg_max(v, n * 100 - v) AS v FROM c GROUP BY t, y, x", "cube"))
def warp_mode(spark, d):
    s = A.cube(spark, d).filter("b = 0").select("t", "y", "x", (F.col("v") % 5).alias("v"))
    return resample.warped(s, T, (30.0, 0.0, T[2], 0.0, -30.0, T[5]), 13, 10, "mode").select("t", "y", "x", F.col("v").cast("int").alias("v"))


@query("warp_nearest", W("SELECT c.t, j::INTEGER AS y, i::INTEGER AS x, c.v FROM range(0, 18) a(j), range(0, 14) b(i), cube c WHERE c.b = 0 AND c.y = floor(((j + 0.5) * 20 + 3) / 10) AND c.x = floor(((i + 0.5) * 20 + 3) / 10)", "cube"))
def warp_nearest(spark, d):
    """Onto a grid of 20 m that starts 3 m off: each target pixel takes the source pixel that its centre falls into."""
    s = A.cube(spark, d).filter("b = 0").select("t", "y", "x", "v")
    return resample.warped(s, T, (20.0, 0.0, T[2] + 3, 0.0, -20.0, T[5] - 3), 18, 14, "nearest").select("t", "y", "x", F.col("v").cast("int").alias("v"))


@query(
    "warp_bilinear",
    W(
        """, s AS (SELECT t, y, x, v FROM ecube), g AS (SELECT j, i, (j + 0.5::DOUBLE) * 1.5 - 0.5 AS fy, (i + 0.5::DOUBLE) * 1.5 - 0.5 AS fx FROM range(0, 30) a(j), range(0, 40) b(i))
SELECT s.t, j::INTEGER AS y, i::INTEGER AS x, round(sum(s.v::DOUBLE * (1 - abs(s.y - fy)) * (1 - abs(s.x - fx))) / sum((1 - abs(s.y - fy)) * (1 - abs(s.x - fx))), 5) AS v FROM g JOIN s ON abs(s.y - fy) < 1 AND abs(s.x - fx) < 1 GROUP BY s.t, j, i""",
        "ecube",
    ),
)
def warp_bilinear(spark, d):
    s = A.ecube(spark, d)
    return resample.warped(s, (1.0, 0.0, 0.0, 0.0, -1.0, 0.0), (1.5, 0.0, 0.0, 0.0, -1.5, 0.0), 30, 40, "bilinear").select("t", "y", "x", F.round("v", 5).alias("v"))


@query(
    "warp_cubic",
    W(
        """, s AS (SELECT t, y, x, v FROM ecube), g AS (SELECT j, i, (j + 0.5::DOUBLE) * 1.25 - 0.5 AS fy, (i + 0.5::DOUBLE) * 1.25 - 0.5 AS fx FROM range(0, 40) a(j), range(0, 51) b(i)),
d AS (SELECT s.t, j, i, s.v::DOUBLE AS v, abs(s.y - fy) AS dy, abs(s.x - fx) AS dx FROM g JOIN s ON abs(s.y - fy) < 2 AND abs(s.x - fx) < 2),
w AS (SELECT t, j, i, v, (CASE WHEN dy <= 1 THEN 1.5 * dy * dy * dy - 2.5 * dy * dy + 1 ELSE -0.5 * dy * dy * dy + 2.5 * dy * dy - 4 * dy + 2 END) * (CASE WHEN dx <= 1 THEN 1.5 * dx * dx * dx - 2.5 * dx * dx + 1 ELSE -0.5 * dx * dx * dx + 2.5 * dx * dx - 4 * dx + 2 END) AS w FROM d)
SELECT t, j::INTEGER AS y, i::INTEGER AS x, round(sum(v * w) / sum(w), 4) AS v FROM w GROUP BY t, j, i HAVING abs(sum(w)) > 1e-12""",
        "ecube",
    ),
)
def warp_cubic(spark, d):
    s = A.ecube(spark, d)
    return resample.warped(s, (1.0, 0.0, 0.0, 0.0, -1.0, 0.0), (1.25, 0.0, 0.0, 0.0, -1.25, 0.0), 40, 51, "cubic").select("t", "y", "x", F.round("v", 4).alias("v"))
