"""Composites of scenes, catalogues, water mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratacube.operators import composite, ingest, water
from stratacube.plans import adapters as A
from stratacube.plans.base import query
from stratacube.plans.q_products import PAIR, pairs

W = A.with_adapters
PLANE, KM2 = A.OBS_H * A.OBS_W, 1e-4
FLOOR = 500

#: Dense histograms: one bin per stored value, empty ones included.
OTSU = (
    PAIR
    + """, z AS (SELECT t, y, x, g, n, round_even((g::DOUBLE - n) / (g::DOUBLE + n) * 10000, 0)::INTEGER AS ndwi, g <= 5 AND n <= 5 AS dark FROM q),
h AS (SELECT s.t, i.i AS bin, count(z.ndwi) AS c FROM (SELECT DISTINCT t FROM z) s CROSS JOIN range(-10000, 10001) i(i) LEFT JOIN z ON z.t = s.t AND z.ndwi = i.i AND NOT z.dark GROUP BY s.t, i.i),
m AS (SELECT t, bin, c, sum(c) OVER w AS below, sum(c * bin) OVER w AS bs, sum(c) OVER (PARTITION BY t) AS total, sum(c * bin) OVER (PARTITION BY t) AS ts FROM h WINDOW w AS (PARTITION BY t ORDER BY bin)),
k AS (SELECT t, bin, c, total, ts, CASE WHEN below > 0 AND total > below THEN below::DOUBLE * (total - below)::DOUBLE
      * ((bs::DOUBLE / below::DOUBLE - (ts - bs)::DOUBLE / (total - below)::DOUBLE) * (bs::DOUBLE / below::DOUBLE - (ts - bs)::DOUBLE / (total - below)::DOUBLE)) / (total::DOUBLE * total::DOUBLE) ELSE 0 END AS between_var FROM m),
b AS (SELECT t, max(between_var) AS best, sum(c * (bin - ts::DOUBLE / total) * (bin - ts::DOUBLE / total)) / any_value(total) AS variance FROM k GROUP BY t),
o AS (SELECT k.t, list(k.bin ORDER BY k.bin) AS ties, any_value(b.best) / any_value(b.variance) AS eta FROM k JOIN b ON b.t = k.t AND b.best = k.between_var GROUP BY k.t),
th AS (SELECT t, ties[len(ties) // 2 + 1]::INTEGER AS otsu, eta FROM o)"""
)


@query("otsu_threshold", W(OTSU + " SELECT t, otsu, round(eta, 6) AS eta FROM th", "cube"))
def otsu_threshold(spark, d):
    c = water.classified(pairs(spark, d))
    return water.otsu(c.filter("NOT dark"), ["t"]).select("t", "otsu", F.round("eta", 6).alias("eta"))


@query("otsu_histogram", W(PAIR + ", z AS (SELECT t, round_even((g::DOUBLE - n) / (g::DOUBLE + n) * 10000, 0)::INTEGER AS bin FROM q), c AS (SELECT t, bin, count(*) AS n FROM z GROUP BY ALL) SELECT t, bin, n, (sum(n) OVER (PARTITION BY t ORDER BY bin))::BIGINT AS upto, (sum(n) OVER (PARTITION BY t))::BIGINT AS total FROM c", "cube"))
def otsu_histogram(spark, d):
    return water.histogram(water.classified(pairs(spark, d)), ["t"])


@query(
    "water_by_time",
    W(
        OTSU
        + f""", f AS (SELECT z.*, th.otsu, greatest(th.otsu, {FLOOR}) AS threshold, th.eta FROM z JOIN th USING (t)),
r AS (SELECT t, y, x, row_number() OVER (PARTITION BY t ORDER BY y, x) - 1 AS k, (g + n) // 2 AS blue FROM z),
bl AS (SELECT t, floor(median(blue))::INTEGER AS blue_median FROM r WHERE k % 16 = 0 GROUP BY t)
SELECT t, count(*) AS valid_px, round(count(*)::DOUBLE / {PLANE}, 4) AS valid_frac, round(count(*) FILTER (WHERE dark)::DOUBLE / count(*), 5) AS dark_frac, any_value(otsu) AS otsu, any_value(threshold) AS threshold,
 max(CASE WHEN otsu < {FLOOR} THEN 1 ELSE 0 END)::INTEGER AS floored, round(any_value(eta), 3) AS eta, round(count(*) FILTER (WHERE dark OR ndwi > threshold)::DOUBLE / count(*), 5) AS water_frac,
 round(count(*) FILTER (WHERE dark OR ndwi > otsu)::DOUBLE / count(*), 5) AS water_frac_otsu, round(count(*) FILTER (WHERE dark OR ndwi > threshold) * {KM2}::DOUBLE, 3) AS water_km2, any_value(blue_median) AS blue_median
FROM f JOIN bl USING (t) GROUP BY t""",
        "cube",
    ),
)
def water_by_time(spark, d):
    p = pairs(spark, d).withColumn("blue", F.floor((F.col("g") + F.col("n")) / 2).cast("int"))
    return water.statistics(p, PLANE, FLOOR, KM2, "blue")


@query(
    "water_month_report",
    W(PAIR + ", s AS (SELECT t, count(*) AS valid_px FROM q WHERE t % 4 <> 3 GROUP BY t) SELECT i.t::INTEGER AS t, CASE WHEN s.t IS NULL THEN 'skipped' ELSE 'written' END AS status, coalesce(valid_px, 0) AS valid_px FROM range(0, 28) i(t) LEFT JOIN s ON s.t = i.t", "cube"),
)
def water_month_report(spark, d):
    """One row for every month, also for those that have nothing."""
    done = pairs(spark, d).filter("t % 4 <> 3").groupBy("t").agg(F.count("*").alias("valid_px"))
    months = spark.range(28).select(F.col("id").cast("int").alias("t"))
    return months.join(done, "t", "left").select("t", F.when(F.col("valid_px").isNull(), "skipped").otherwise("written").alias("status"), F.coalesce("valid_px", F.lit(0)).alias("valid_px"))


@query(
    "notable_months",
    W(
        PAIR
        + f""", s AS (SELECT t, round(count(*)::DOUBLE / {PLANE}, 4) AS valid_frac, round(count(*) FILTER (WHERE g <= 100)::DOUBLE / count(*), 5) AS dark_frac, round(count(*) FILTER (WHERE g > n)::DOUBLE / count(*), 5) AS water_frac, round(count(*) FILTER (WHERE g > n + 50)::DOUBLE / count(*), 5) AS water_frac_otsu FROM q GROUP BY t),
o AS (SELECT * FROM s WHERE valid_frac >= 0.9 OR (SELECT count(*) FROM s WHERE valid_frac >= 0.9) = 0),
sp AS (SELECT * FROM s WHERE valid_frac >= 0.01 OR (SELECT count(*) FROM s WHERE valid_frac >= 0.01) = 0),
c AS (SELECT 0 AS place, (SELECT t FROM o ORDER BY water_frac DESC, t LIMIT 1) AS t UNION ALL SELECT 1, (SELECT t FROM o ORDER BY water_frac, t LIMIT 1) UNION ALL SELECT 2, (SELECT t FROM s ORDER BY abs(water_frac - water_frac_otsu) DESC, t LIMIT 1)
 UNION ALL SELECT 3, (SELECT t FROM sp ORDER BY valid_frac, t LIMIT 1) UNION ALL SELECT 4, (SELECT t FROM (SELECT * FROM s ORDER BY dark_frac DESC, t LIMIT 1) WHERE dark_frac >= 0.01))
SELECT t, min(place)::INTEGER AS place FROM c WHERE t IS NOT NULL GROUP BY t""",
        "cube",
    ),
)
def notable_months(spark, d):
    n = F.count("*").cast("double")
    s = pairs(spark, d).groupBy("t").agg(F.round(n / PLANE, 4).alias("valid_frac"), F.round(F.count_if(F.col("g") <= 100) / n, 5).alias("dark_frac"), F.round(F.count_if(F.col("g") > F.col("n")) / n, 5).alias("water_frac"), F.round(F.count_if(F.col("g") > F.col("n") + 50) / n, 5).alias("water_frac_otsu"))
    return water.notable_months(s)


@query("monthly_median", W("SELECT t, b, y, x, floor(median(v))::INTEGER AS v, count(*) AS scenes FROM obs WHERE v % 12 IN (4, 5, 6, 7, 11) AND v > 0 GROUP BY ALL", "obs"))
def monthly_median(spark, d):
    o = A.obs(spark, d)
    return composite.median_composite(o, ingest.clear(F.col("v") % 12, F.col("v") > 0))


@query("coverage_fraction", W("SELECT t, y, x, count(*) AS scenes, count(*) FILTER (WHERE v % 12 IN (4, 5, 6, 7, 11)) AS valid, count(*) FILTER (WHERE v % 12 IN (4, 5, 6, 7, 11))::DOUBLE / count(*) AS fraction, (count(*) FILTER (WHERE v % 12 IN (4, 5, 6, 7, 11)) > 0)::INTEGER AS flag FROM obs GROUP BY t, y, x", "obs"))
def coverage_fraction(spark, d):
    return composite.coverage(A.obs(spark, d), ingest.clear(F.col("v") % 12, F.lit(True)))


@query("scene_search", W("SELECT item_id, tile, cloud_cover FROM scenes WHERE ts::DATE BETWEEN DATE '1996-03-01' AND DATE '1996-05-31' AND cloud_cover < 20", "scenes"))
def scene_search(spark, d):
    return ingest.search(A.scenes(spark, d), "1996-03-01", "1996-05-31", 20).select("item_id", "tile", "cloud_cover")


@query("scenes_by_month", W("SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n, min(item_id) AS first_id, max(cloud_cover) AS cloudiest FROM scenes GROUP BY ALL", "scenes"))
def scenes_by_month(spark, d):
    return A.scenes(spark, d).groupBy(ingest.month_key(F.col("ts")).alias("month")).agg(F.count("*").alias("n"), F.min("item_id").alias("first_id"), F.max("cloud_cover").alias("cloudiest"))


@query("scene_dedupe", W("SELECT max(item_id) AS item_id, tile, strftime(ts, '%Y-%m-%d') AS day FROM scenes GROUP BY tile, strftime(ts, '%Y-%m-%d')", "scenes"))
def scene_dedupe(spark, d):
    return ingest.deduplicated(A.scenes(spark, d)).select("item_id", "tile", F.date_format("ts", "yyyy-MM-dd").alias("day"))


BEST = """, z AS (SELECT tile, strftime(ts, '%Y-%m') AS month, min(cloud_cover) AS c FROM scenes WHERE ts >= TIMESTAMP '1997-01-01' AND ts < TIMESTAMP '1998-01-01' GROUP BY ALL),
k AS (SELECT tile FROM z GROUP BY tile HAVING count(DISTINCT month) = 12)"""


@query("best_tile", W(BEST + " SELECT tile, sum(c)::BIGINT AS cloud FROM z JOIN k USING (tile) GROUP BY tile ORDER BY sum(c), tile LIMIT 1", "scenes"))
def best_tile(spark, d):
    """The tile that has scenes in all twelve months and the least sum of their least clouds."""
    return ingest.best_tile(_year(spark, d), 12)


@query("common_tiles", W(BEST + " SELECT tile FROM k", "scenes"))
def common_tiles(spark, d):
    return ingest.common_tiles(_year(spark, d), 12)


@query("clearest_scene", W(", z AS (SELECT *, strftime(ts, '%Y-%m') AS month FROM scenes) SELECT tile, month, arg_min(item_id, (cloud_cover, ts, item_id)) AS item_id, min(cloud_cover) AS cloud_cover FROM z GROUP BY tile, month", "scenes"))
def clearest_scene(spark, d):
    return ingest.clearest(A.scenes(spark, d).withColumn("month", ingest.month_key(F.col("ts"))), ["tile", "month"])


def _year(spark, d):
    return A.scenes(spark, d).filter("ts >= TIMESTAMP '1997-01-01' AND ts < TIMESTAMP '1998-01-01'")


@query("quality_counts", W("SELECT t, count(*) FILTER (WHERE v % 4 = 0) AS good, count(*) FILTER (WHERE v % 4 = 1) AS suspect, count(*) FILTER (WHERE v % 4 = 2) AS degraded, count(*) FILTER (WHERE v % 4 = 3) AS bad, count(*) AS valid, min(v) AS lo, max(v) AS hi, count(*) FILTER (WHERE v < 1000) AS low FROM obs GROUP BY t", "obs"))
def quality_counts(spark, d):
    q = F.col("v") % 4
    named = [F.count_if(q == i).alias(n) for i, n in enumerate(("good", "suspect", "degraded", "bad"))]
    return A.obs(spark, d).groupBy("t").agg(*named, F.count("*").alias("valid"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count_if(F.col("v") < 1000).alias("low"))


@query("common_valid", W("SELECT y, x FROM cube WHERE cov >= 1 AND t BETWEEN 8 AND 11 GROUP BY y, x HAVING count(DISTINCT t) = 4", "cube"))
def common_valid(spark, d):
    return ingest.common_valid(A.cube(spark, d).filter("t BETWEEN 8 AND 11"), 4, F.col("cov") >= 1)


@query(
    "best_window",
    W(
        f""", j AS (SELECT y, x FROM cube WHERE t IN (8, 9) GROUP BY y, x HAVING count(DISTINCT t) = 2),
w AS (SELECT r * 3 AS row, c * 3 AS col FROM range(0, {(A.OBS_H - 12) // 3 + 1}) a(r), range(0, {(A.OBS_W - 12) // 3 + 1}) b(c)),
n AS (SELECT row, col, count(*) AS n FROM w JOIN j ON j.y >= row AND j.y < row + 12 AND j.x >= col AND j.x < col + 12 GROUP BY row, col)
SELECT row::INTEGER AS row, col::INTEGER AS col, n FROM n ORDER BY n DESC, row DESC, col DESC LIMIT 1""",
        "cube",
    ),
)
def best_window(spark, d):
    both = A.cube(spark, d).filter("t IN (8, 9)").groupBy("y", "x").agg(F.count_distinct("t").alias("k"))
    return ingest.best_window(both.withColumn("joint", F.col("k") == 2), A.OBS_H, A.OBS_W, 12, 3)


@query("grid_overlap", W(", s AS (SELECT item_id % 9 AS g, min(tile * 10) AS l, max(tile * 10 + 400) AS r, min(cloud_cover) AS b, max(cloud_cover + 300) AS u FROM scenes GROUP BY ALL) SELECT max(l)::INTEGER AS l, max(b)::INTEGER AS b, min(r)::INTEGER AS r, min(u)::INTEGER AS u FROM s", "scenes"))
def grid_overlap(spark, d):
    s = A.scenes(spark, d).groupBy(F.col("item_id") % 9).agg(F.min(F.col("tile") * 10).alias("l"), F.max(F.col("tile") * 10 + 400).alias("r"), F.min("cloud_cover").alias("b"), F.max(F.col("cloud_cover") + 300).alias("u"))
    return composite.overlap(s)
