"""Values of single pixels: validity, physical values, filters, derived units."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratacube.functions import pixels
from stratacube.operators import ingest, temporal
from stratacube.plans import adapters as A
from stratacube.plans.base import query

W = A.with_adapters
SCALE, OFFSET = 0.0001, -0.1


@query("physical_values", W(f"SELECT t, b, y, x, CASE WHEN v <> 0 THEN CAST(v AS FLOAT) * CAST({SCALE} AS FLOAT) + CAST({OFFSET} AS FLOAT) END AS p FROM cube", "cube"))
def physical_values(spark, d):
    c = A.cube(spark, d)
    return c.select("t", "b", "y", "x", pixels.physical(F.col("v"), SCALE, OFFSET, pixels.valid(F.col("v"), nodata=0)).alias("p"))


@query("physical_js_divisor", W("SELECT t, b, y, x, CAST(v AS DOUBLE) / 10000.0::DOUBLE + 0.05::DOUBLE AS p, CAST(v AS DOUBLE) * 0.0003::DOUBLE + 0.05::DOUBLE AS q FROM cube", "cube"))
def physical_js_divisor(spark, d):
    c = A.cube(spark, d)
    return c.select("t", "b", "y", "x", pixels.physical_exact(F.col("v"), 0.0001, 0.05).alias("p"), pixels.physical_exact(F.col("v"), 0.0003, 0.05).alias("q"))


@query("validity_by_mask", W("SELECT t, b, y, x, (CASE WHEN cov >= 2 THEN 1 ELSE 0 END) = 1 AS valid FROM cube", "cube"))
def validity_by_mask(spark, d):
    return A.cube(spark, d).select("t", "b", "y", "x", pixels.valid(F.col("v"), (F.col("cov") >= 2).cast("int"), 0).alias("valid"))


@query("validity_by_nodata", W("SELECT t, b, y, x, v <> 100 AS valid FROM cube", "cube"))
def validity_by_nodata(spark, d):
    return A.cube(spark, d).select("t", "b", "y", "x", pixels.valid(F.col("v"), nodata=100).alias("valid"))


@query("validity_none", W("SELECT t, b, count(*) AS n, count(*) AS n_valid FROM cube GROUP BY t, b", "cube"))
def validity_none(spark, d):
    return A.cube(spark, d).groupBy("t", "b").agg(F.count("*").alias("n"), F.count_if(pixels.valid(F.col("v"))).alias("n_valid"))


@query("stored_validity_shared", W("SELECT t, y, x, bool_and(v <> 2500 AND v <> 0) AS valid FROM cube GROUP BY t, y, x", "cube"))
def stored_validity_shared(spark, d):
    return ingest.shared_validity(A.cube(spark, d), ["t", "y", "x"], "v", [2500, 0])


@query(
    "nan_settled",
    W(
        """, f AS (SELECT t, y, x, CASE WHEN x % 9 = 4 THEN CAST('NaN' AS FLOAT) ELSE v END AS v, x % 3 <> 1 AS ok FROM ecube)
SELECT t, count(*) FILTER (WHERE isnan(v) AND NOT ok) AS filled, count(*) FILTER (WHERE isnan(v) AND ok) AS refused, count(*) FILTER (WHERE NOT (isnan(v) AND ok)) AS stored FROM f GROUP BY t""",
        "ecube",
    ),
)
def nan_settled(spark, d):
    e = A.ecube(spark, d).withColumn("v", F.when(F.col("x") % 9 == 4, F.lit(float("nan")).cast("float")).otherwise(F.col("v"))).withColumn("ok", F.col("x") % 3 != 1)
    return ingest.nan_report(e, ["t"], "v", F.col("ok"))


@query("declared_validity", W(", p AS (SELECT t, y, x, b, v % 256 AS alpha, CASE WHEN cov > 1 THEN 1 ELSE 0 END AS internal FROM cube) SELECT t, y, x, bool_and(CASE WHEN t % 3 = 0 THEN alpha <> 0 WHEN t % 3 = 1 THEN internal <> 0 ELSE true END) AS valid FROM p GROUP BY t, y, x", "cube"))
def declared_validity(spark, d):
    c = A.cube(spark, d).select("t", "y", "x", "b", F.when(F.col("t") % 3 == 0, F.col("v") % 256).alias("alpha"), F.when(F.col("t") % 3 == 1, (F.col("cov") > 1).cast("int")).alias("internal"))
    return ingest.declared_validity(c, ["t", "y", "x"], alpha="alpha", internal="internal")


@query("scl_filter", W("SELECT t, y, x, max(v) % 12 IN (4, 5, 6, 7, 11) AND min(v) > 0 AS clear, count(*) AS n FROM obs GROUP BY t, y, x", "obs"))
def scl_filter(spark, d):
    o = A.obs(spark, d)
    return o.groupBy("t", "y", "x").agg(ingest.clear(F.max("v") % 12, F.min("v") > 0).alias("clear"), F.count("*").alias("n"))


@query("quality_filter", W("SELECT t, 'all' AS level, count(*) AS n FROM obs GROUP BY t UNION ALL SELECT t, 'good', count(*) FILTER (WHERE v % 4 = 0) FROM obs GROUP BY t UNION ALL SELECT t, 'usable', count(*) FILTER (WHERE v % 4 <= 1) FROM obs GROUP BY t", "obs"))
def quality_filter(spark, d):
    o = A.obs(spark, d).withColumn("q", F.col("v") % 4)
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), ingest.quality_ok(F.col("q"), k).alias("ok")) for k in ingest.QUALITY_LIMITS]))
    return o.select("t", levels.alias("k")).groupBy("t", F.col("k.level").alias("level")).agg(F.count_if("k.ok").alias("n"))


@query("db_units", W("SELECT t, b, y, x, CASE WHEN v > 0 THEN round(10 * log10(CAST(v AS DOUBLE) * v), 8) END AS amplitude_db, CASE WHEN v - 2500 > 0 THEN round(10 * log10(CAST(v - 2500 AS DOUBLE)), 8) END AS power_db FROM cube", "cube"))
def db_units(spark, d):
    c = A.cube(spark, d)
    return c.select("t", "b", "y", "x", F.round(pixels.decibel(F.col("v")), 8).alias("amplitude_db"), F.round(pixels.decibel(F.col("v") - 2500, amplitude=False), 8).alias("power_db"))


@query("boa_offset", W("SELECT item_id, CASE WHEN baseline < '04.00' THEN v WHEN v > 0 THEN greatest(least(v - 1000, 65535), 1) ELSE 0 END AS v FROM scenes", "scenes"))
def boa_offset(spark, d):
    return A.scenes(spark, d).select("item_id", pixels.without_offset(F.col("v"), F.col("baseline")).alias("v"))


@query("modular_residual", W("SELECT t, b, y, x, ((v - 4000) % 65536 + 65536) % 65536 AS r, (((v - 4000) % 65536 + 65536) % 65536 + 4000) % 65536 AS back, ((v - 77) % 256 + 256) % 256 AS r8 FROM cube", "cube"))
def modular_residual(spark, d):
    c = A.cube(spark, d)
    r = pixels.residual(F.col("v"), F.lit(4000))
    return c.select("t", "b", "y", "x", r.alias("r"), pixels.restored(r, F.lit(4000)).alias("back"), pixels.residual(F.col("v"), F.lit(77), 8).alias("r8"))


@query("stride_sample", W("SELECT t, b, y, x, v FROM cube WHERE (y * 29 + x) % 3 = 0", "cube"))
def stride_sample(spark, d):
    return ingest.strided(A.cube(spark, d), A.OBS_H, A.OBS_W, 300)


@query("nodata_tag", W("SELECT t, bool_or(cov >= 2 AND v = 2500) AS collides, CASE WHEN bool_or(cov >= 2 AND v = 2500) THEN NULL ELSE 2500 END AS nodata FROM cube GROUP BY t", "cube"))
def nodata_tag(spark, d):
    return ingest.nodata_tag(A.cube(spark, d), 2500, F.col("cov") >= 2)


@query("declared_nodata", W("SELECT t, list_sort(list(DISTINCT CAST(v % 5 AS VARCHAR))) AS tokens, count(DISTINCT v % 5) = 1 AS agreed FROM cube GROUP BY t", "cube"))
def declared_nodata(spark, d):
    return ingest.declared_nodata(A.cube(spark, d), ["t"], F.col("v") % 5)


@query("physical_nan_exactly_at_gaps", W("SELECT t, count(*) FILTER (WHERE (cov >= 2) = (cov < 2)) AS wrong, count(*) FILTER (WHERE cov < 2) AS gaps FROM cube GROUP BY t", "cube"))
def physical_nan_exactly_at_gaps(spark, d):
    c = A.cube(spark, d)
    ok = pixels.valid(F.col("v"), (F.col("cov") >= 2).cast("int"))
    p = c.select("t", ok.alias("ok"), pixels.physical(F.col("v"), SCALE, OFFSET, ok).alias("p"))
    return p.groupBy("t").agg(F.count_if(F.col("p").isNull() == F.col("ok")).alias("wrong"), F.count_if(F.col("p").isNull()).alias("gaps"))


@query("mask_coverage_planes", W("SELECT t, y, x, max(CASE WHEN cov >= 2 THEN 1 ELSE 0 END) AS mask, least(sum(cov), 255)::BIGINT AS coverage FROM cube GROUP BY t, y, x", "cube"))
def mask_coverage_planes(spark, d):
    return A.cube(spark, d).groupBy("t", "y", "x").agg(F.max((F.col("cov") >= 2).cast("int")).alias("mask"), F.least(F.sum("cov"), F.lit(255)).cast("long").alias("coverage"))


@query("plane_attached", W(", m AS (SELECT t, y, x, max(cov) >= 2 AS valid FROM cube GROUP BY t, y, x) SELECT c.t, c.b, c.y, c.x, CASE WHEN m.valid THEN c.v END AS v FROM cube c JOIN m USING (t, y, x)", "cube"))
def plane_attached(spark, d):
    c = A.cube(spark, d)
    m = c.groupBy("t", "y", "x").agg((F.max("cov") >= 2).cast("int").alias("mask"))
    return ingest.attach_plane(c, m).select("t", "b", "y", "x", F.when(pixels.valid(F.col("v"), F.col("mask")), F.col("v")).alias("v"))


@query("band_metadata_attached", W(", k(b, name, scale, off) AS (VALUES (0, 'B03', 0.0001::DOUBLE, 0.0::DOUBLE), (1, 'B08', 0.0002::DOUBLE, -0.1::DOUBLE)) SELECT t, y, x, name, CAST(v AS DOUBLE) * scale + off AS p FROM cube JOIN k USING (b)", "cube"))
def band_metadata_attached(spark, d):
    bands = spark.createDataFrame([(0, "B03", 0.0001, 0.0), (1, "B08", 0.0002, -0.1)], "b int, name string, scale double, offset double")
    return ingest.attach_bands(A.cube(spark, d), bands).select("t", "y", "x", "name", (F.col("v").cast("double") * F.col("scale") + F.col("offset")).alias("p"))


@query("adjacent_change", W(", c AS (SELECT b, y, x, t, abs(v - lag(v) OVER (PARTITION BY b, y, x ORDER BY t)) AS change FROM cube) SELECT b, count(*) AS n, max(change) AS most, quantile_disc(change, 0.9) AS p90 FROM c WHERE change IS NOT NULL GROUP BY b", "cube"))
def adjacent_change(spark, d):
    ch = temporal.adjacent_change(A.cube(spark, d), ["b", "y", "x"])
    return ch.groupBy("b").agg(F.count("*").alias("n"), F.max("change").alias("most"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY change)").cast("int").alias("p90"))


@query(
    "change_stability",
    W(
        ", s AS (SELECT t, b, count(*) FILTER (WHERE v > 2500)::DOUBLE / count(*) AS share FROM cube GROUP BY t, b), c AS (SELECT b, share, abs(share - lag(share) OVER (PARTITION BY b ORDER BY t)) AS change FROM s) SELECT b, round(stddev_samp(share) / avg(share), 8) AS spread, round(quantile_cont(change, 0.9), 8) AS p90 FROM c GROUP BY b",
        "cube",
    ),
)
def change_stability(spark, d):
    """How steady a share is over time: standard deviation over mean, and the 90th percentile of the change from step to step."""
    s = A.cube(spark, d).groupBy("t", "b").agg((F.count_if(F.col("v") > 2500).cast("double") / F.count("*")).alias("share"))
    spread = s.groupBy("b").agg((F.stddev_samp("share") / F.avg("share")).alias("s"))
    change = temporal.adjacent_change(s, ["b"], "share").groupBy("b").agg(F.percentile("change", F.lit(0.9)).alias("p"))
    return spread.join(change, "b").select("b", F.round("s", 8).alias("spread"), F.round("p", 8).alias("p90"))


@query("unit_checks", W("SELECT t, bool_and(v = floor(v)) AS whole, min(v) >= 0 AND max(v) <= 65535 AS fits, count(*) - count(v) AS nulls FROM cube GROUP BY t", "cube"))
def unit_checks(spark, d):
    """Input checks before a cube is written: whole numbers within the type, no nulls."""
    return ingest.input_checks(A.cube(spark, d), "uint16")
