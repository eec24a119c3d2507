"""Stores: what is written comes back, by step, cell, level, physical value; appends; inventories.

Each query writes a small store below the folder that all executors share and reads it through the data source.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from stratacube import scratch
from stratacube.functions import pixels
from stratacube.operators import inventory
from stratacube.plans import adapters as A
from stratacube.plans.base import query
from stratacube.sources import metadata as M
from stratacube.sources import store

W = A.with_adapters
T0 = (10.0, 0.0, 746090.0, 0.0, -10.0, 2540440.0)
STEPS = 28


def folder(spark: SparkSession) -> str:
    return scratch.path(spark, "store")


def times(n: int, first: int = 0) -> list[str]:
    return [f"{1995 + (first + i) // 4}-{3 * ((first + i) % 4) + 1:02}-01T00:00:00Z" for i in range(n)]


def _cube(n: int = STEPS, **more) -> M.Cube:
    return M.new_cube(times(n), [{"name": "B03", "common_name": "green", "scale": 1e-4}, {"name": "B08", "common_name": "nir", "scale": 1e-4, "offset": 0.05}], "EPSG:32631", T0, A.OBS_H, A.OBS_W, "uint16", 16, **more)


def _pixels(spark, d, n: int = STEPS):
    return A.cube(spark, d).filter(F.col("t") < n).select("t", "b", "y", "x", "v")


def _written(spark, d, **more) -> str:
    path = folder(spark)
    store.write(_pixels(spark, d), path, _cube(**more))
    return path


FULL = f", c AS (SELECT * FROM cube WHERE t < {STEPS}), g AS (SELECT t.t, b.b, y.y, x.x, coalesce(c.v, 0) AS v FROM range(0, {STEPS}) t(t), range(0, 2) b(b), range(0, {A.OBS_H}) y(y), range(0, {A.OBS_W}) x(x) LEFT JOIN c ON c.t = t.t AND c.b = b.b AND c.y = y.y AND c.x = x.x)"
ALL = FULL + " SELECT t::INTEGER AS t, b::INTEGER AS b, y::INTEGER AS y, x::INTEGER AS x, v FROM g"


@query("store_round_trip", W(ALL, "cube"))
def store_round_trip(spark, d):
    """All pixels of the grid come back, those without an observation as nodata."""
    return store.read(spark, _written(spark, d, interval=3)).select("t", "b", "y", "x", "v")


@query("store_sharded", W(ALL + " WHERE t = 5 AND y BETWEEN 10 AND 20", "cube"))
def store_sharded(spark, d):
    df = store.read(spark, _written(spark, d, interval=3, shard_time=4))
    return df.filter("t = 5 AND y BETWEEN 10 AND 20").select("t", "b", "y", "x", "v")


@query("store_read_step", W(FULL + " SELECT b::INTEGER AS b, y::INTEGER AS y, x::INTEGER AS x, v FROM g WHERE t = 4", "cube"))
def store_read_step(spark, d):
    return store.read(spark, _written(spark, d, interval=6)).filter("t = 4").select("b", "y", "x", "v")


@query("store_level_one", W(FULL + " SELECT t::INTEGER AS t, b::INTEGER AS b, (y // 2)::INTEGER AS y, (x // 2)::INTEGER AS x, coalesce(floor(sum(v) FILTER (WHERE v <> 0) / count(*) FILTER (WHERE v <> 0)), 0)::INTEGER AS v FROM g GROUP BY t, b, y // 2, x // 2", "cube"))
def store_level_one(spark, d):
    return store.read(spark, _written(spark, d), lod=1).select("t", "b", "y", "x", "v")


@query("store_physical", W(FULL + " SELECT t::INTEGER AS t, y::INTEGER AS y, x::INTEGER AS x, CASE WHEN v <> 0 THEN CAST(v AS FLOAT) * CAST(0.0001 AS FLOAT) + CAST(0.05 AS FLOAT) END AS p FROM g WHERE b = 1", "cube"))
def store_physical(spark, d):
    df = store.read(spark, _written(spark, d)).filter("b = 1")
    return df.select("t", "y", "x", pixels.physical(F.col("v"), 1e-4, 0.05, pixels.valid(F.col("v"), nodata=0)).alias("p"))


@query("store_raw_residuals", W(FULL + ", a AS (SELECT *, CASE WHEN t % 3 = 2 AND t + 1 < 28 THEN t + 1 ELSE t - t % 3 END AS k FROM g) SELECT a.t::INTEGER AS t, a.b::INTEGER AS b, a.y::INTEGER AS y, a.x::INTEGER AS x, CASE WHEN a.t = a.k THEN a.v ELSE ((a.v - z.v) % 65536 + 65536) % 65536 END AS v FROM a JOIN g z ON z.t = a.k AND z.b = a.b AND z.y = a.y AND z.x = a.x", "cube"))
def store_raw_residuals(spark, d):
    return store.read(spark, _written(spark, d, interval=3), raw=True).select("t", "b", "y", "x", "v")


@query("store_planes", W(", p AS (SELECT t, y, x, max(cov) AS c FROM cube GROUP BY t, y, x), g AS (SELECT t.t, y.y, x.x, coalesce(p.c, 0) AS c FROM range(0, 28) t(t), range(0, 37) y(y), range(0, 29) x(x) LEFT JOIN p ON p.t = t.t AND p.y = y.y AND p.x = x.x) SELECT t::INTEGER AS t, y::INTEGER AS y, x::INTEGER AS x, (c >= 2)::INTEGER AS mask, c::INTEGER AS coverage FROM g", "cube"))
def store_planes(spark, d):
    """Counts as they are: a pixel may have more than 255 observations, which is all that a store's usual coverage holds."""
    pixel = Window.partitionBy("t", "y", "x")  # a row per band
    c = A.cube(spark, d).dropna(subset=["t", "y", "x"]).withColumn("coverage", F.max("cov").over(pixel).cast("int"))
    path = folder(spark)
    whole = c.withColumn("mask", (F.col("coverage") >= 2).cast("int")).drop("cov").persist(StorageLevel.MEMORY_AND_DISK)
    try:  # the composite is made once, not for every level and plane
        store.write(whole, path, _cube(mask="mask", coverage="coverage", coverage_dtype="int32"))
    finally:
        whole.unpersist()
    return store.read(spark, path).filter("b = 0").select("t", "y", "x", "mask", "coverage")


@query("store_append", W(ALL, "cube"))
def store_append(spark, d):
    """Twenty steps written, eight appended."""
    path = folder(spark)
    p = _pixels(spark, d)
    store.write(p.filter("t < 20"), path, _cube(20, interval=4))
    store.append(p.filter("t >= 20"), path, times(8, 20))
    return store.read(spark, path).select("t", "b", "y", "x", "v")


@query("store_copied", W(ALL, "cube"))
def store_copied(spark, d):
    """A store as the input of another one, with another encoding and cell size."""
    first = store.read(spark, _written(spark, d, interval=3))
    path = folder(spark)
    store.write(first.select("t", "b", "y", "x", "v"), path, M.new_cube(times(STEPS), ["a", "b"], "EPSG:32631", T0, A.OBS_H, A.OBS_W, "uint16", 8), "blosc-zstd-shuffle")
    return store.read(spark, path).select("t", "b", "y", "x", "v")


@query("store_detected", "SELECT * FROM (VALUES ('store', true), ('other', false)) v(what, is_store)")
def store_detected(spark, d):
    path = _written(spark, d)
    return spark.createDataFrame([("store", store.is_store(path)), ("other", store.is_store(d if "://" not in d else folder(spark)))], "what string, is_store boolean")


@query("store_volatility", W(FULL + ", k AS (SELECT *, CASE WHEN t % 3 = 2 AND t + 1 < 28 THEN t + 1 ELSE t - t % 3 END AS a FROM g) SELECT (k.y // 16)::INTEGER AS row, (k.x // 16)::INTEGER AS col, CAST(least(sum(abs(k.v - z.v))::DOUBLE / count(*) / 10000, 1) AS FLOAT) AS volatility FROM k JOIN g z ON z.t = k.a AND z.b = k.b AND z.y = k.y AND z.x = k.x WHERE k.t <> k.a GROUP BY 1, 2", "cube"))
def store_volatility(spark, d):
    return inventory.stored_volatility(spark, _written(spark, d, interval=3))


@query("store_objects", W("SELECT k || '/data' AS item, (any_value(n) * ceil(ceil(37 / pow(2, k)) / 16) * ceil(ceil(29 / pow(2, k)) / 16))::BIGINT AS objects FROM (SELECT max(t) + 1 AS n FROM cube), range(0, 3) r(k) GROUP BY k", "cube"))
def store_objects(spark, d):
    """Objects by array: 3 x 2, 2 x 1 and 1 x 1 cells of all steps."""
    rows = inventory.objects(spark, _written(spark, d))
    data = rows.filter(F.col("key").rlike(r"^\d+/data/c/"))
    return data.groupBy(F.regexp_extract("key", r"^(\d+/data)/", 1).alias("item")).agg(F.count("*").alias("objects"))


@query("export_frames", W(FULL + " SELECT t::INTEGER AS t, count(*) AS n, sum(v)::BIGINT AS total FROM g GROUP BY t", "cube"))
def export_frames(spark, d):
    """All steps as GeoTIFF files, read again."""
    from stratacube.sources import geotiff

    df = store.read(spark, _written(spark, d, interval=3))
    out = folder(spark)
    files = geotiff.export(df, out, _cube(interval=3))
    back = geotiff.read(spark, [r["file"] for r in files.collect()])
    return back.groupBy("t").agg(F.count("*").alias("n"), F.sum("v").cast("long").alias("total"))


@query("store_levels", W("SELECT k::INTEGER AS level, 'data' AS variable, (any_value(n) * ceil(ceil(37 / pow(2, k)) / 16) * ceil(ceil(29 / pow(2, k)) / 16))::BIGINT AS objects, true AS packed FROM (SELECT max(t) + 1 AS n FROM cube), range(0, 3) r(k) GROUP BY k", "cube"))
def store_levels(spark, d):
    """Objects and bytes by level: chunks are smaller than their values."""
    rows = inventory.by_level(inventory.objects(spark, _written(spark, d))).filter("variable = 'data'")
    return rows.select("level", "variable", "objects", (F.col("bytes") < F.col("objects") * (2 * 16 * 16 * 2)).alias("packed"))
