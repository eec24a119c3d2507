"""Series of pixels and windows, order statistics, latency of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratacube.functions import pixels
from stratacube.operators import ranks, series, temporal
from stratacube.plans import adapters as A
from stratacube.plans.base import query
from stratacube.plans.q_products import PAIR, pairs, srgb

W = A.with_adapters


@query(
    "pixel_series_gaps",
    W(
        """, s AS (SELECT y, x, t, CASE WHEN cov >= 2 THEN v END AS v, cov FROM cube WHERE b = 0),
c AS (SELECT *, CASE WHEN v IS NOT NULL AND lag(v) OVER w IS NULL THEN 1 ELSE 0 END AS cut FROM s WINDOW w AS (PARTITION BY y, x ORDER BY t)),
g AS (SELECT *, sum(cut) OVER (PARTITION BY y, x ORDER BY t) - 1 AS segment FROM c)
SELECT y, x, segment::INTEGER AS segment, count(*) AS n, min(t) AS first, max(t) AS last FROM g WHERE v IS NOT NULL GROUP BY y, x, segment""",
        "cube",
    ),
)
def pixel_series_gaps(spark, d):
    s = A.cube(spark, d).filter("b = 0").select("y", "x", "t", F.when(F.col("cov") >= 2, F.col("v")).alias("v"))
    return temporal.segments(s, ["y", "x"], "v").groupBy("y", "x", "segment").agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))


@query("gap_filled_times", W("SELECT t, y, x, v FROM (SELECT t, y, x, v, cov - 1 AS coverage FROM cube WHERE b = 1) WHERE coverage = 0 AND v IS NOT NULL", "cube"))
def gap_filled_times(spark, d):
    c = A.cube(spark, d).filter("b = 1").withColumn("coverage", F.col("cov") - 1)
    return series.gap_filled(c, "v", "coverage").select("t", "y", "x", "v")


@query("window_pixels", f"SELECT c.y AS cy, c.x AS cx, j::INTEGER AS y, i::INTEGER AS x, (row_number() OVER (PARTITION BY c.y, c.x ORDER BY CASE WHEN j = c.y AND i = c.x THEN 0 ELSE 1 END, j, i) - 1)::INTEGER AS place FROM (VALUES (0, 0), (5, 5), (36, 28), (36, 3)) c(y, x), range(0, {A.OBS_H}) r(j), range(0, {A.OBS_W}) s(i) WHERE abs(j - c.y) <= 1 AND abs(i - c.x) <= 1")
def window_pixels(spark, d):
    return series.window_pixels(spark.createDataFrame([(0, 0), (5, 5), (36, 28), (36, 3)], "y int, x int"), A.OBS_H, A.OBS_W)


@query(
    "water_fraction_3x3",
    W(PAIR + " SELECT a.t, a.y, a.x, count(*) AS n, avg(CASE WHEN b.gr > b.nr THEN 1.0::DOUBLE ELSE 0 END) AS share FROM q a JOIN q b ON a.t = b.t AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 WHERE b.gr + b.nr > 0 GROUP BY a.t, a.y, a.x", "cube"),
)
def water_fraction_3x3(spark, d):
    p = pairs(spark, d)
    wet = F.when(F.col("gr") + F.col("nr") > 0, pixels.ndwi(F.col("gr"), F.col("nr")) > 0)
    return series.neighbourhood_share(p, wet)


@query("water_fraction_in_cells", W(PAIR + " SELECT a.t, a.y, a.x, count(*) AS n, avg(CASE WHEN b.gr > b.nr THEN 1.0::DOUBLE ELSE 0 END) AS share FROM q a JOIN q b ON a.t = b.t AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND a.y // 8 = b.y // 8 AND a.x // 8 = b.x // 8 GROUP BY a.t, a.y, a.x", "cube"))
def water_fraction_in_cells(spark, d):
    """Windows that end at the edges of the cells, as a reader that holds one cell sees them."""
    return series.neighbourhood_share(pairs(spark, d), F.col("gr") > F.col("nr"), cell=8)


@query("percentile_range", W(", r AS (SELECT t, b, v, row_number() OVER (PARTITION BY t, b ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY t, b) AS n FROM cube), p AS (SELECT t, b, max(v) FILTER (WHERE k = floor(n * 0.02::DOUBLE)) AS lo, max(v) FILTER (WHERE k = least(n - 1, floor(n * 0.98::DOUBLE))) AS hi FROM r GROUP BY t, b) SELECT t, b, lo, CASE WHEN hi > lo THEN hi ELSE lo + 1 END AS hi FROM p", "cube"))
def percentile_range(spark, d):
    return ranks.percentile_range(A.cube(spark, d), ["t", "b"], F.col("v"))


@query("stretch_lo", W(PAIR + f", s AS (SELECT t, unnest([gr, nr]) AS r FROM q WHERE NOT (g = 0 AND n = 0)), k AS (SELECT t, r, row_number() OVER (PARTITION BY t ORDER BY r) - 1 AS i, count(*) OVER (PARTITION BY t) AS n FROM s) SELECT t, CASE WHEN any_value(n) < 30 THEN 0 ELSE round(max({srgb('((r * 5.0) / (r * 5.0 + 1))')}) FILTER (WHERE i = floor(n * 0.02::DOUBLE)), 9) END AS lo FROM k GROUP BY t", "cube"))
def stretch_lo(spark, d):
    """The tone curve rises with the value, so the value at the place is picked before it is toned."""
    p = pairs(spark, d).filter("NOT (g = 0 AND n = 0)")
    tones = p.select("t", F.explode(F.array("gr", "nr")).alias("r"))
    low = ranks.at_places(tones, ["t"], F.col("r"), {"r": ranks.fraction(0.02)})
    return low.select("t", F.when(F.col("n") < 30, F.lit(0.0)).otherwise(F.round(pixels.reinhard(F.col("r")), 9)).alias("lo"))


@query("stretch_limits", W("SELECT b, quantile_disc(v, 0.02) AS lo, quantile_disc(v, 0.98) AS hi FROM cube GROUP BY b", "cube"))
def stretch_limits(spark, d):
    return ranks.reached(A.cube(spark, d), ["b"], F.col("v"), {"lo": 0.02, "hi": 0.98})


@query("axis_range", W(", r AS (SELECT y, x, min(v) AS a, max(v) AS b FROM cube GROUP BY y, x), p AS (SELECT *, coalesce(nullif((b - a) * 0.08::DOUBLE, 0), nullif(abs(b) * 0.08::DOUBLE, 0), 0.5) AS pad FROM r) SELECT y, x, round(a - pad, 9) AS lo, round(b + pad, 9) AS hi FROM p", "cube"))
def axis_range(spark, d):
    return series.value_range(A.cube(spark, d), ["y", "x"], "v").select("y", "x", F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"))


@query("pixel_history", W("SELECT t, b, v, cov FROM cube WHERE y = 20 AND x = 13", "cube"))
def pixel_history(spark, d):
    return A.cube(spark, d).filter("y = 20 AND x = 13").select("t", "b", "v", "cov")


@query("sample_pixel_bands", W("SELECT t, list(v ORDER BY b) AS vs FROM cube WHERE y = 3 AND x = 3 GROUP BY t", "cube"))
def sample_pixel_bands(spark, d):
    c = A.cube(spark, d).filter("y = 3 AND x = 3")
    return c.groupBy("t").agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "v"))), lambda s: s["v"]).alias("vs"))


LAT = """WITH e AS (SELECT user_id AS u, epoch_us(ts) AS at, event_type, value FROM events),
i AS (SELECT * FROM e WHERE event_type = 'click'), p AS (SELECT * FROM e WHERE event_type = 'view')"""


@query("latency_attribution", LAT + " SELECT i.u, i.at, min(p.at) FILTER (WHERE p.value > 10) AS whole_at, min(p.at) FILTER (WHERE p.value > 60) AS full_at FROM i LEFT JOIN p ON p.u = i.u AND p.at >= i.at GROUP BY i.u, i.at")
def latency_attribution(spark, d):
    return _paints(spark, d).select("u", "at", "whole_at", "full_at")


def _paints(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("u"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_type", "value")
    view = F.col("event_type") == "view"
    return series.first_paints(e, "u", "at", F.col("event_type") == "click", view & (F.col("value") > 10), view & (F.col("value") > 60))


@query(
    "latency_distribution",
    LAT
    + """, d AS (SELECT i.u % 5 AS part, (min(p.at) FILTER (WHERE p.value > 60) - i.at) / 1000.0::DOUBLE AS ms FROM i LEFT JOIN p ON p.u = i.u AND p.at >= i.at GROUP BY i.u, i.at),
k AS (SELECT part, ms, row_number() OVER (PARTITION BY part ORDER BY ms) - 1 AS r, count(*) OVER (PARTITION BY part) AS n FROM d WHERE ms IS NOT NULL)
SELECT part, any_value(n) AS n, floor(max(ms) FILTER (WHERE r = floor(n * 0.5::DOUBLE)) * 10 + 0.5) / 10 AS median, floor(max(ms) FILTER (WHERE r = floor(n * 0.95::DOUBLE)) * 10 + 0.5) / 10 AS p95, floor(max(ms) * 10 + 0.5) / 10 AS max FROM k GROUP BY part""",
)
def latency_distribution(spark, d):
    ms = _paints(spark, d).select((F.col("u") % 5).alias("part"), ((F.col("full_at") - F.col("at")) / F.lit(1000.0)).alias("ms"))
    return ranks.distribution(ms, ["part"], F.col("ms"))


@query("frame_completeness", "SELECT user_id % 3 AS part, count(*) FILTER (WHERE event_type = 'view') AS painted, count(*) FILTER (WHERE event_type = 'view' AND value < 20) AS partial, round(count(*) FILTER (WHERE event_type = 'view' AND value < 20) / count(*) FILTER (WHERE event_type = 'view')::DOUBLE, 9) AS partial_fraction, count(*) FILTER (WHERE event_type = 'view' AND value > 80) AS fallbacks, count(*) FILTER (WHERE event_type = 'error') AS kept FROM events GROUP BY ALL")
def frame_completeness(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("part", F.col("user_id") % 3)
    out = series.frame_completeness(e, ["part"], F.col("event_type") == "view", F.col("value") < 20, F.col("value") > 80, F.col("event_type") == "error")
    return out.withColumn("partial_fraction", F.round("partial_fraction", 9))


@query("sliding_median", "WITH g AS (SELECT user_id AS u, event_id, (event_id * 37 % 101)::DOUBLE AS gap FROM events) SELECT u, event_id, quantile_cont(gap, 0.5) OVER (PARTITION BY u ORDER BY event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS median FROM g")
def sliding_median(spark, d):
    g = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("u"), "event_id", (F.col("event_id") * 37 % 101).cast("double").alias("gap"))
    return series.sliding_median(g, ["u"], "event_id", "gap").select("u", "event_id", "median")
