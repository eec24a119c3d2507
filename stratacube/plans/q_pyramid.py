"""Pyramids: means, masks and coverage of coarser levels, and what statistics on them say."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratacube.operators import pyramid as P
from stratacube.plans import adapters as A
from stratacube.plans.base import query

W = A.with_adapters


def _levels(first: str, n: int, valid: str, empty: int | str = 0) -> str:
    """DuckDB: l0 .. ln, each from the one before."""
    out = f", l0 AS ({first})"
    for k in range(1, n + 1):
        out += f""", l{k} AS (SELECT t, b, y // 2 AS y, x // 2 AS x, CASE WHEN count(*) FILTER (WHERE {valid}) > 0
 THEN floor(sum(v) FILTER (WHERE {valid}) / count(*) FILTER (WHERE {valid}))::INTEGER ELSE {empty} END AS v FROM l{k - 1} GROUP BY ALL)"""
    return out


PLAIN = "SELECT t, b, y, x, v FROM cube"


def _reduce(df, times: int, ok, **options):
    for _ in range(times):
        df = P.reduced(df, ok(df), **options)
    return df


NODATA_0 = lambda df: F.col("v") != 0

for _n in (1, 2, 3):
    query(f"block_mean_l{_n}", W(_levels(PLAIN, _n, "v <> 0") + f" SELECT t, b, y::INTEGER AS y, x::INTEGER AS x, v FROM l{_n}", "cube"))(lambda spark, d, n=_n: _reduce(A.cube(spark, d).drop("cov"), n, NODATA_0))


@query("block_mean_masked", W(", m AS (SELECT t, b, y, x, v, cov >= 2 AS ok FROM cube) SELECT t, b, (y // 2)::INTEGER AS y, (x // 2)::INTEGER AS x, CASE WHEN bool_or(ok) THEN floor(sum(v) FILTER (WHERE ok) / count(*) FILTER (WHERE ok))::INTEGER ELSE 0 END AS v FROM m GROUP BY ALL", "cube"))
def block_mean_masked(spark, d):
    return P.reduced(A.cube(spark, d), F.col("cov") >= 2)


@query("block_mean_int16", W(_levels("SELECT t, b, y, x, v - 2500 AS v FROM cube", 2, "true") + " SELECT t, b, y::INTEGER AS y, x::INTEGER AS x, v FROM l2", "cube"))
def block_mean_int16(spark, d):
    """Signed values without a nodata value: means are floored, also below zero."""
    return _reduce(A.cube(spark, d).select("t", "b", "y", "x", (F.col("v") - 2500).alias("v")), 2, lambda df: F.lit(True))


@query("block_mean_nodata_kept", W(_levels("SELECT t, b, y, x, CASE WHEN v > 3000 THEN -9999 ELSE v END AS v FROM cube", 2, "v <> -9999", -9999) + " SELECT t, b, y::INTEGER AS y, x::INTEGER AS x, v FROM l2", "cube"))
def block_mean_nodata_kept(spark, d):
    low = A.cube(spark, d).select("t", "b", "y", "x", F.when(F.col("v") > 3000, -9999).otherwise(F.col("v")).alias("v"))
    return _reduce(low, 2, lambda df: F.col("v") != -9999, empty=-9999)


@query(
    "block_mean_float",
    W(
        """, r AS (SELECT t, y // 2 AS y, x // 2 AS x, count(*) AS n, sum(CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN v::DOUBLE END) AS v00, sum(CASE WHEN y % 2 = 0 AND x % 2 = 1 THEN v::DOUBLE END) AS v01,
 sum(CASE WHEN y % 2 = 1 AND x % 2 = 0 THEN v::DOUBLE END) AS v10, sum(CASE WHEN y % 2 = 1 AND x % 2 = 1 THEN v::DOUBLE END) AS v11 FROM ecube GROUP BY ALL)
SELECT t, y::INTEGER AS y, x::INTEGER AS x, n, round((coalesce(v00, 0) + coalesce(v01, 0) + coalesce(v10, 0) + coalesce(v11, 0)) / n, 5) AS mean FROM r""",
        "ecube",
    ),
)
def block_mean_float(spark, d):
    e = A.ecube(spark, d)
    n = e.groupBy(*P.parents(["t"])).agg(F.count("*").alias("n"), (F.sum(F.col("v").cast("double")) / F.count("*")).alias("m"))
    return n.select("t", "y", "x", "n", F.round("m", 5).alias("mean"))


@query("mask_reduce", W(", m AS (SELECT t, y, x, max(CASE WHEN cov >= 3 THEN 1 ELSE 0 END) AS mask FROM cube GROUP BY t, y, x) SELECT t, (y // 2)::INTEGER AS y, (x // 2)::INTEGER AS x, max(mask)::INTEGER AS mask FROM m GROUP BY ALL", "cube"))
def mask_reduce(spark, d):
    m = A.cube(spark, d).groupBy("t", "y", "x").agg(F.max((F.col("cov") >= 3).cast("int")).alias("mask"))
    return P.reduced_mask(m)


def _dense(spark, d):
    """Coverage as a dense plane: 0 where nothing was observed."""
    c = A.cube(spark, d).groupBy("t", "y", "x").agg(F.sum("cov").alias("c"))
    grid = spark.range(28).select(F.col("id").cast("int").alias("t"), F.explode(F.sequence(F.lit(0), F.lit(A.OBS_H - 1))).alias("y")).select("t", "y", F.explode(F.sequence(F.lit(0), F.lit(A.OBS_W - 1))).alias("x"))
    return grid.join(c, ["t", "y", "x"], "left").select("t", "y", "x", F.coalesce("c", F.lit(0)).cast("int").alias("coverage"))


DENSE = f", c AS (SELECT t, y, x, sum(cov)::INTEGER AS c FROM cube GROUP BY t, y, x), g AS (SELECT t.t, y.y, x.x, coalesce(c.c, 0) AS v FROM range(0, 28) t(t), range(0, {A.OBS_H}) y(y), range(0, {A.OBS_W}) x(x) LEFT JOIN c ON c.t = t.t AND c.y = y.y AND c.x = x.x)"


@query("coverage_reduce", W(DENSE + f", p AS (SELECT t, y, x, v FROM g UNION ALL SELECT t, {A.OBS_H}, x, v FROM g WHERE y = {A.OBS_H - 1}), q AS (SELECT * FROM p UNION ALL SELECT t, y, {A.OBS_W}, v FROM p WHERE x = {A.OBS_W - 1}) SELECT t::INTEGER AS t, (y // 2)::INTEGER AS y, (x // 2)::INTEGER AS x, ((sum(v) + 2) // 4)::INTEGER AS coverage FROM q GROUP BY ALL", "cube"))
def coverage_reduce(spark, d):
    """Here the padding of odd edges is left out; the SQL beside it pads, and both agree."""
    return P.reduced_coverage(_dense(spark, d))


@query(
    "pyramid_levels",
    W(_levels(PLAIN, 3, "v <> 0") + " SELECT 0 AS level, t, b, y, x, v FROM l0 UNION ALL SELECT 1, t, b, y::INTEGER, x::INTEGER, v FROM l1 UNION ALL SELECT 2, t, b, y::INTEGER, x::INTEGER, v FROM l2 UNION ALL SELECT 3, t, b, y::INTEGER, x::INTEGER, v FROM l3", "cube"),
)
def pyramid_levels(spark, d):
    return P.pyramid(A.cube(spark, d), 4, lambda df: F.col("v") != 0)


@query("block_mean_factor4", W(f"SELECT t, b, (y // 4)::INTEGER AS y, (x // 4)::INTEGER AS x, coalesce(sum(v) FILTER (WHERE cov >= 2), 0)::DOUBLE / greatest(count(*) FILTER (WHERE cov >= 2), 1) AS mean, count(*) FILTER (WHERE cov >= 2) AS n FROM cube WHERE y < {A.OBS_H // 4 * 4} AND x < {A.OBS_W // 4 * 4} GROUP BY ALL", "cube"))
def block_mean_factor4(spark, d):
    return P.whole_blocks(A.cube(spark, d), 4, A.OBS_H, A.OBS_W, F.col("cov") >= 2)


@query(
    "weighted_share",
    W(
        f""", w AS (SELECT t, y, x, CASE WHEN v > 2500 THEN 10000 ELSE 0 END AS v, cov >= 2 AS ok FROM cube WHERE b = 0),
s AS (SELECT t, sum(v) FILTER (WHERE ok) AS a, count(*) FILTER (WHERE ok) AS n FROM w GROUP BY t),
k AS (SELECT t, y // 2 AS y, x // 2 AS x, floor(sum(v) FILTER (WHERE ok) / count(*) FILTER (WHERE ok)) AS f, count(*) FILTER (WHERE ok) AS n FROM w WHERE y < {A.OBS_H // 2 * 2} AND x < {A.OBS_W // 2 * 2} GROUP BY ALL HAVING bool_or(ok))
SELECT s.t, round(any_value(s.a)::DOUBLE / any_value(s.n) / 10000, 9) AS share, round(sum(f) / count(*) / 10000, 9) AS over_blocks, round(sum(f * k.n) / sum(k.n) / 10000, 9) AS weighted FROM s JOIN k USING (t) GROUP BY s.t""",
        "cube",
    ),
)
def weighted_share(spark, d):
    """The share of level 0, the mean over valid blocks of level 1, and that mean weighted by the blocks' valid pixels."""
    w = A.cube(spark, d).filter("b = 0").select("t", "y", "x", F.when(F.col("v") > 2500, 10000).otherwise(0).alias("v"), (F.col("cov") >= 2).alias("ok"))
    share = w.filter("ok").groupBy("t").agg((F.sum("v").cast("double") / F.count("*") / 10000).alias("share"))
    inside = w.filter((F.col("y") < A.OBS_H // 2 * 2) & (F.col("x") < A.OBS_W // 2 * 2) & F.col("ok"))
    k = inside.groupBy(*P.parents(["t"])).agg(F.floor(F.sum("v") / F.count("*")).alias("f"), F.count("*").alias("n"))
    per = k.groupBy("t").agg((F.sum("f") / F.count("*") / 10000).alias("o"), (F.sum(F.col("f") * F.col("n")) / F.sum("n") / 10000).alias("w"))
    return share.join(per, "t").select("t", F.round("share", 9).alias("share"), F.round("o", 9).alias("over_blocks"), F.round("w", 9).alias("weighted"))


@query("cell_grid", W("SELECT y // 8 AS row, x // 8 AS col, least(8, 37 - (y // 8) * 8)::INTEGER AS h, least(8, 29 - (x // 8) * 8)::INTEGER AS w, count(*) AS n FROM cube GROUP BY ALL", "cube"))
def cell_grid(spark, d):
    row, col = F.floor(F.col("y") / 8).cast("int"), F.floor(F.col("x") / 8).cast("int")
    return A.cube(spark, d).groupBy(row.alias("row"), col.alias("col")).agg(F.count("*").alias("n")).select("row", "col", F.least(F.lit(8), A.OBS_H - F.col("row") * 8).alias("h"), F.least(F.lit(8), A.OBS_W - F.col("col") * 8).alias("w"), "n")


@query("edge_clip", W("SELECT t, b, y, x, v FROM cube WHERE t = 3 AND y // 8 = 4 AND x // 8 = 3", "cube"))
def edge_clip(spark, d):
    """The cell in the lower right corner: 5 x 5 of its 8 x 8 pixels are in the grid."""
    return A.cube(spark, d).filter((F.col("t") == 3) & (F.floor(F.col("y") / 8) == 4) & (F.floor(F.col("x") / 8) == 3)).select("t", "b", "y", "x", "v")


@query("ancestor_cells", W("SELECT DISTINCT k AS level, (y // 8) >> k AS row, (x // 8) >> k AS col FROM cube, range(1, 3) r(k)", "cube"))
def ancestor_cells(spark, d):
    cells = A.cube(spark, d).select(F.floor(F.col("y") / 8).alias("row"), F.floor(F.col("x") / 8).alias("col")).distinct()
    up = cells.select(F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("level"), "row", "col")
    return up.select("level", F.expr("shiftright(row, cast(level AS INT))").alias("row"), F.expr("shiftright(col, cast(level AS INT))").alias("col")).distinct()


@query("coarse_footprint", W("SELECT DISTINCT (y // 8)::BIGINT AS row, (x // 8)::BIGINT AS col, (y // 16)::BIGINT AS parent_row, (x // 16)::BIGINT AS parent_col, (y // 8) % 2 = 1 AS lower, (x // 8) % 2 = 1 AS right_half FROM cube", "cube"))
def coarse_footprint(spark, d):
    """Which quarter of its parent each cell covers."""
    cells = A.cube(spark, d).select(F.floor(F.col("y") / 8).alias("row"), F.floor(F.col("x") / 8).alias("col")).distinct()
    return cells.select("row", "col", F.shiftright("row", 1).alias("parent_row"), F.shiftright("col", 1).alias("parent_col"), (F.col("row") % 2 == 1).alias("lower"), (F.col("col") % 2 == 1).alias("right_half"))


@query("coarse_frame", W(_levels(PLAIN, 1, "v <> 0") + " SELECT b, y::INTEGER AS y, x::INTEGER AS x, v FROM l1 WHERE t = 9 AND (y // 8, x // 8) IN ((0, 0), (1, 1))", "cube"))
def coarse_frame(spark, d):
    """All pixels of some cells of a coarser level at one step; the step is pruned before the reduction."""
    cells = spark.createDataFrame([(0, 0), (1, 1)], "row int, col int")
    one = P.reduced(A.cube(spark, d).filter("t = 9"), F.col("v") != 0)
    keyed = one.withColumn("row", F.floor(F.col("y") / 8).cast("int")).withColumn("col", F.floor(F.col("x") / 8).cast("int"))
    return keyed.join(cells, ["row", "col"], "left_semi").select("b", "y", "x", "v")


@query("spill_by_cell", W("SELECT (y // 8)::BIGINT AS row, (x // 8)::BIGINT AS col, count(*) AS n, count(DISTINCT t) AS steps, min(t) AS first, max(t) AS last FROM cube GROUP BY ALL", "cube"))
def spill_by_cell(spark, d):
    """Time-major rows dealt to cells: one shuffle by cell serves everything that follows."""
    c = A.cube(spark, d).withColumn("row", F.floor(F.col("y") / 8)).withColumn("col", F.floor(F.col("x") / 8)).repartition("row", "col")
    return c.groupBy("row", "col").agg(F.count("*").alias("n"), F.count_distinct("t").alias("steps"), F.min("t").alias("first"), F.max("t").alias("last"))


@query("level_report", W(_levels(PLAIN, 2, "v <> 0") + " SELECT 0 AS level, count(DISTINCT (y // 8, x // 8)) AS cells, count(*) AS n FROM l0 UNION ALL SELECT 1, count(DISTINCT (y // 8, x // 8)), count(*) FROM l1 UNION ALL SELECT 2, count(DISTINCT (y // 8, x // 8)), count(*) FROM l2", "cube"))
def level_report(spark, d):
    p = P.pyramid(A.cube(spark, d), 3, lambda df: F.col("v") != 0)
    return p.groupBy("level").agg(F.count_distinct(F.floor(F.col("y") / 8), F.floor(F.col("x") / 8)).alias("cells"), F.count("*").alias("n"))
