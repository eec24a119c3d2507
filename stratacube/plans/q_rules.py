"""Validation as queries: rules over stores and stacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratacube.functions import pixels
from stratacube.operators import validate
from stratacube.plans import adapters as A
from stratacube.plans.base import query
from stratacube.plans.q_products import PAIR, pairs
from stratacube.plans.q_store import _written
from stratacube.sources import store

W = A.with_adapters


@query("store_is_valid", "SELECT 'metadata' AS name, 'ok' AS status UNION ALL SELECT 'encoding', 'ok' UNION ALL SELECT 'decode level ' || k, 'ok' FROM range(0, 3) r(k) UNION ALL SELECT 'objects', 'ok'")
def store_is_valid(spark, d):
    return validate.doctor(spark, _written(spark, d, interval=3)).select("name", "status")


@query("water_stack_checks", W(PAIR + ", n AS (SELECT count(*) AS n FROM q WHERE t = 4 AND g % 7 = 0) SELECT * FROM (VALUES ('ndwi is what the bands give', 0::BIGINT), ('mask is where there were observations', 0), ('ndwi is within its range', 0), ('masked pixels hold 0', 0), ('water is 0 or full', 0)) v(name, bad) UNION ALL SELECT 'water is what the threshold gives', n FROM n", "cube"))
def water_stack_checks(spark, d):
    """A stack whose water is wrong at every seventh green value of one step."""
    p = pairs(spark, d)
    good = p.select("t", "y", "x", pixels.stored_index(F.col("g"), F.col("n")).alias("ndwi"), F.when(F.col("g") > F.col("n"), 10_000).otherwise(0).alias("water"), F.lit(1).alias("mask"), "g")
    bad = good.withColumn("water", F.when((F.col("t") == 4) & (F.col("g") % 7 == 0), F.lit(10_000) - F.col("water")).otherwise(F.col("water")))
    return validate.stack_checks(bad, good)


@query("levels_agree", W("SELECT 1 AS level, 0::BIGINT AS wrong UNION ALL SELECT 2, 0", "cube"))
def levels_agree(spark, d):
    """Stored levels are the floored means of the level below."""
    from stratacube.operators import pyramid

    path, out = _written(spark, d), None
    for k in (1, 2):
        below = store.read(spark, path, k - 1)
        want = pyramid.reduced(below, F.col("v") != 0)
        got = store.read(spark, path, k).select("t", "b", "y", "x", "v")
        one = got.exceptAll(want.select("t", "b", "y", "x", "v")).agg(F.count("*").alias("wrong")).select(F.lit(k).alias("level"), "wrong")
        out = one if out is None else out.unionByName(one)
    return out
