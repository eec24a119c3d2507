"""Manifests, consistency of sources, mismatches, mirrors, inventories."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratacube.operators import ingest
from stratacube.plans import adapters as A
from stratacube.plans.base import query
from stratacube.sources import manifest

W = A.with_adapters


@query("manifest_steps", "SELECT 's3://bucket/' || o_orderkey || '.tif' AS uri, (row_number() OVER (ORDER BY o_orderdate) - 1)::INTEGER AS t, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso, ['B03', 'B08'] AS bands FROM (SELECT min(o_orderkey) AS o_orderkey, o_orderdate FROM orders GROUP BY o_orderdate)")
def manifest_steps(spark, d):
    """Rows of a manifest (uri, datetime, bands as text) as a time axis."""
    o = spark.read.parquet(f"{d}/orders.parquet").groupBy("o_orderdate").agg(F.min("o_orderkey").alias("k"))
    rows = o.select(F.concat(F.lit("s3://bucket/"), F.col("k").cast("string"), F.lit(".tif")).alias("uri"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datetime"), F.lit("B03; B08").alias("bands"))
    return manifest.steps(rows, "/base").select("uri", "t", "iso", "bands")


@query("manifest_duplicates", "SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def manifest_duplicates(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("uri"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("datetime"))
    return manifest.duplicate_times(rows).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "n")


@query("grid_consistency", W(", g AS (SELECT item_id, 10 + (item_id % 50 = 7)::INTEGER AS res, 100 + (item_id % 80 = 3)::INTEGER AS width FROM scenes) SELECT lpad(item_id::VARCHAR, 12, '0') AS uri, 'res' AS field, res::VARCHAR AS found, '10' AS expected FROM g WHERE res <> 10 UNION ALL SELECT lpad(item_id::VARCHAR, 12, '0'), 'width', width::VARCHAR, '100' FROM g WHERE width <> 100", "scenes"))
def grid_consistency(spark, d):
    g = A.scenes(spark, d).select(F.lpad(F.col("item_id").cast("string"), 12, "0").alias("uri"), (F.when(F.col("item_id") % 50 == 7, 11).otherwise(10)).alias("res"), F.when(F.col("item_id") % 80 == 3, 101).otherwise(100).alias("width"))
    return ingest.grid_mismatches(g, "uri", ["res", "width"])


@query("append_mismatches", "SELECT * FROM (VALUES (0, 'scale', '0.0001', '0.0002'), (2, 'only in a', NULL, NULL), (3, 'only in b', NULL, NULL), (1, 'name', 'nir', 'B08')) v(band, field, a, b)")
def append_mismatches(spark, d):
    a = spark.createDataFrame([(0, "green", "0.0001"), (1, "nir", "0.0001"), (2, "red", "1")], "band int, name string, scale string")
    b = spark.createDataFrame([(0, "green", "0.0002"), (1, "B08", "0.0001"), (3, "blue", "1")], "band int, name string, scale string")
    return ingest.differing(a, b, "band", ["name", "scale"])


@query("mirror_diff", W(", m AS (SELECT t, count(*) AS n, min(v) AS lo FROM cube GROUP BY t), k AS (SELECT t, n + (t = 5)::INTEGER AS n, lo FROM m WHERE t <> 9) SELECT 5 AS t, 'n' AS field, n::VARCHAR AS a, (n + 1)::VARCHAR AS b FROM m WHERE t = 5 UNION ALL SELECT 9, 'only in a', NULL, NULL", "cube"))
def mirror_diff(spark, d):
    """A table and its mirror, which has one wrong number and lacks one row."""
    m = A.cube(spark, d).groupBy("t").agg(F.count("*").alias("n"), F.min("v").alias("lo"))
    k = m.filter("t <> 9").withColumn("n", F.col("n") + (F.col("t") == 5).cast("int"))
    return ingest.differing(m, k, "t", ["n", "lo"])


@query("coordinate_mirror", W(", p AS (SELECT DISTINCT x FROM cube) SELECT count(*) FILTER (WHERE abs((x + 0.5::DOUBLE) * 10 + 746090 - (746095 + 10.0::DOUBLE * x)) > 1e-6) AS wrong, count(*) AS n FROM p", "cube"))
def coordinate_mirror(spark, d):
    p = A.cube(spark, d).select("x").distinct()
    stored, centre = F.lit(746095.0) + F.col("x") * 10.0, (F.col("x") + 0.5) * 10.0 + 746090
    return p.agg(F.count_if(F.abs(stored - centre) > 1e-6).alias("wrong"), F.count("*").alias("n"))


@query("plan_fingerprint", W("SELECT tile, sha256('{\"tile\":' || tile || ',\"n\":' || count(*) || '}') AS fingerprint FROM scenes GROUP BY tile", "scenes"))
def plan_fingerprint(spark, d):
    s = A.scenes(spark, d).groupBy("tile").agg(F.count("*").alias("n"))
    return s.select("tile", ingest.fingerprint([F.col("tile"), F.col("n")]).alias("fingerprint"))


@query("two_read_paths_agree", W("SELECT 0::BIGINT AS only_cells, 0::BIGINT AS only_whole", "cube"))
def two_read_paths_agree(spark, d):
    """All cells together and the cube as a whole: neither has rows that the other lacks."""
    from stratacube.operators import planning

    c = A.cube(spark, d).select("t", "b", "y", "x", "v")
    parts = planning.all_cells(c, 8, A.OBS_H, A.OBS_W).drop("row", "col")
    return planning.compared(parts, c).select(F.col("only_a").alias("only_cells"), F.col("only_b").alias("only_whole"))


@query("weighted_level_zero_check", W("SELECT t, count(*) AS n, count(*) FILTER (WHERE v > 2500) AS wet FROM cube WHERE b = 0 AND cov >= 2 GROUP BY t", "cube"))
def weighted_level_zero_check(spark, d):
    return A.cube(spark, d).filter("b = 0 AND cov >= 2").groupBy("t").agg(F.count("*").alias("n"), F.count_if(F.col("v") > 2500).alias("wet"))
