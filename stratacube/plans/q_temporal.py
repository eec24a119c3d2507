"""Star deltas, volatility, carry-forward, as-of choice, orders of fetching, appends."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratacube.operators import ingest, temporal
from stratacube.plans import adapters as A
from stratacube.plans.base import query
from stratacube.streaming import append

W = A.with_adapters
#: Steps of the line-item cubes, and the interval of anchors in these queries.
N_TIME, INTERVAL = 28, 6
ANCHOR = f"CASE WHEN 2 * (t % {INTERVAL}) > {INTERVAL} AND t - t % {INTERVAL} + {INTERVAL} < {N_TIME} THEN t - t % {INTERVAL} + {INTERVAL} ELSE t - t % {INTERVAL} END"
ENC = f""", s AS (SELECT *, {ANCHOR} AS a FROM cube),
e AS (SELECT s.t, s.b, s.y, s.x, s.v, s.a, CASE WHEN s.t = s.a THEN s.v ELSE ((s.v - coalesce(k.v, 0)) % 65536 + 65536) % 65536 END AS r, abs(s.v - coalesce(k.v, 0)) AS change
      FROM s LEFT JOIN cube k ON k.t = s.a AND k.b = s.b AND k.y = s.y AND k.x = s.x)"""


def _anchor():
    return temporal.anchor_of(F.col("t"), N_TIME, INTERVAL)


@query("star_delta_encode", W(ENC + " SELECT t, b, y, x, r::INTEGER AS r FROM e", "cube"))
def star_delta_encode(spark, d):
    return temporal.star_delta_encode(A.cube(spark, d), _anchor()).select("t", "b", "y", "x", "r")


@query("star_delta_decode", W("SELECT t, b, y, x, v FROM cube WHERE t BETWEEN 6 AND 11", "cube"))
def star_delta_decode(spark, d):
    """Decodes a few steps: the steps and their anchors are read, then the anchors that weren't asked for go again."""
    asked, refs = list(range(6, 12)), temporal.anchor_schedule(N_TIME, INTERVAL)[1]
    closure = sorted({*asked, *(refs.get(t, t) for t in asked)})
    stored = temporal.star_delta_encode(A.cube(spark, d), _anchor()).drop("v").filter(F.col("t").isin(closure))
    return temporal.star_delta_decode(stored, _anchor()).filter(F.col("t").isin(asked)).select("t", "b", "y", "x", "v")


@query("star_delta_identity", W("SELECT count(*) AS n, 0::BIGINT AS wrong FROM cube", "cube"))
def star_delta_identity(spark, d):
    coded = temporal.star_delta_encode(A.cube(spark, d), _anchor())
    back = temporal.star_delta_decode(coded, _anchor(), out="back")
    return back.agg(F.count("*").alias("n"), F.count_if(F.col("back") != F.col("v")).alias("wrong"))


@query("star_delta_uint8", W(ENC.replace("65536", "256").replace("FROM cube)", "FROM c8)").replace("LEFT JOIN cube k", "LEFT JOIN c8 k").replace(", s AS", ", c8 AS (SELECT t, b, y, x, v % 256 AS v FROM cube), s AS") + " SELECT b, t, sum(r)::BIGINT AS total, count(DISTINCT r) AS kinds FROM e GROUP BY b, t", "cube"))
def star_delta_uint8(spark, d):
    c8 = A.cube(spark, d).withColumn("v", F.col("v") % 256)
    return temporal.star_delta_encode(c8, _anchor(), bits=8).groupBy("b", "t").agg(F.sum("r").alias("total"), F.count_distinct("r").alias("kinds"))


@query("raw_residuals", W(ENC + " SELECT t, count(*) AS n, sum(r)::BIGINT AS stored, bool_and(r = v) AS plain FROM e GROUP BY t", "cube"))
def raw_residuals(spark, d):
    """What a reader that doesn't know the encoding sees: anchors as they are, residuals elsewhere."""
    coded = temporal.star_delta_encode(A.cube(spark, d), _anchor())
    return coded.groupBy("t").agg(F.count("*").alias("n"), F.sum("r").alias("stored"), F.bool_and(F.col("r") == F.col("v")).alias("plain"))


@query("anchor_schedule", f"SELECT t::INTEGER AS t, ({ANCHOR})::INTEGER AS anchor_t FROM range(0, {N_TIME}) r(t) WHERE t % {INTERVAL} <> 0")
def anchor_schedule(spark, d):
    return temporal.references(spark, N_TIME, INTERVAL)


@query("reference_violations", "SELECT * FROM (VALUES (2, 'missing'), (9, 'missing'), (8, 'unexpected'), (99, 'unexpected'), (3, 'not an anchor'), (5, 'too far'), (7, 'too far')) v(t, problem)")
def reference_violations(spark, d):
    """Twelve steps by four, with seven faults."""
    good = temporal.references(spark, 12, 4).filter("t NOT IN (2, 9, 3, 5, 7)")
    return temporal.reference_violations(good.unionByName(spark.createDataFrame([(8, 4), (99, 96), (3, 1), (5, 0), (7, 0)], "t int, anchor_t int")), 12, 4)


@query("volatility", W(ENC + " SELECT (y // 8)::INTEGER AS row, (x // 8)::INTEGER AS col, CAST(least(greatest(sum(change)::DOUBLE / count(*) / 10000, 0), 1) AS FLOAT) AS volatility FROM e WHERE t <> a GROUP BY ALL", "cube"))
def volatility(spark, d):
    return temporal.volatility(temporal.volatility_state(temporal.abs_deltas(A.cube(spark, d), _anchor()), 8))


@query("volatility_incremental", W(ENC + " SELECT (y // 8)::INTEGER AS row, (x // 8)::INTEGER AS col, CAST(least(greatest(sum(change)::DOUBLE / count(*) / 10000, 0), 1) AS FLOAT) AS volatility FROM e WHERE t <> a GROUP BY ALL", "cube"))
def volatility_incremental(spark, d):
    """The state of an earlier part and of what came later add up to the whole."""
    changes = temporal.abs_deltas(A.cube(spark, d), _anchor())
    early, late = temporal.volatility_state(changes.filter("t < 13"), 8), temporal.volatility_state(changes.filter("t >= 13"), 8)
    return temporal.volatility(temporal.merged_state(early, late))


@query(
    "locf_fill",
    W("SELECT t, b, y, x, coalesce(last_value(CASE WHEN cov >= 2 THEN v END IGNORE NULLS) OVER (PARTITION BY b, y, x ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS v, cov < 2 AS filled FROM cube", "cube"),
)
def locf_fill(spark, d):
    return temporal.carry_forward(A.cube(spark, d), ["b", "y", "x"], F.col("cov") < 2, ["v"]).select("t", "b", "y", "x", "v", "filled")


@query(
    "locf_all_bands",
    W(
        """, p AS (SELECT t, y, x, coalesce(max(CASE WHEN b = 0 THEN v END), 0) AS g, coalesce(max(CASE WHEN b = 1 THEN v END), 0) AS n FROM cube GROUP BY t, y, x),
q AS (SELECT t, y, x, CASE WHEN g % 3 = 0 THEN 0 ELSE g END AS g, CASE WHEN g % 3 = 0 THEN 0 ELSE n END AS n FROM p)
SELECT t, y, x, g = 0 AND n = 0 AS filled, coalesce(last_value(CASE WHEN g > 0 OR n > 0 THEN g END IGNORE NULLS) OVER w, 0) AS g, coalesce(last_value(CASE WHEN g > 0 OR n > 0 THEN n END IGNORE NULLS) OVER w, 0) AS n
FROM q WINDOW w AS (PARTITION BY y, x ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
        "cube",
    ),
)
def locf_all_bands(spark, d):
    """A gap is a pixel whose bands are all 0; all bands are carried together."""
    p = A.cube(spark, d).groupBy("t", "y", "x").agg(F.coalesce(F.max(F.when(F.col("b") == 0, F.col("v"))), F.lit(0)).alias("g"), F.coalesce(F.max(F.when(F.col("b") == 1, F.col("v"))), F.lit(0)).alias("n"))
    gone = F.col("g") % 3 == 0
    q = p.select("t", "y", "x", F.when(gone, 0).otherwise(F.col("g")).alias("g"), F.when(gone, 0).otherwise(F.col("n")).alias("n"))
    return temporal.carry_forward(q, ["y", "x"], (F.col("g") == 0) & (F.col("n") == 0), ["g", "n"])


@query(
    "nearest_time",
    W(
        """, k AS (SELECT t, min(ts) AS ts FROM (SELECT CAST(floor(epoch(ts) / 86400) * 24 + floor(epoch(ts) / 3600) % 24 AS INT) AS t, ts FROM evt WHERE b = 2) GROUP BY t),
a AS (SELECT DISTINCT ts AS at FROM evt WHERE b = 4)
SELECT epoch_us(a.at) AS at_us, arg_min(k.t, {'d': abs(epoch_us(k.ts) - epoch_us(a.at)), 'ts': k.ts}) AS t FROM a JOIN k ON abs(epoch_us(k.ts) - epoch_us(a.at)) < 3456000000000 GROUP BY a.at""",
        "evt",
    ),
)
def nearest_time(spark, d):
    e = A.evt(spark, d)
    hour = (F.floor(F.unix_timestamp("ts") / 86400) * 24 + F.floor(F.unix_timestamp("ts") / 3600) % 24).cast("int")
    times = e.filter("b = 2").withColumn("t", hour).groupBy("t").agg(F.min("ts").alias("ts"))
    asked = e.filter("b = 4").select(F.col("ts").alias("at")).distinct()
    return temporal.nearest(asked, times).select(F.unix_micros(F.col("at").cast("timestamp")).alias("at_us"), "t")


@query("scrub_order", f"SELECT t::INTEGER AS t, (row_number() OVER (ORDER BY CASE WHEN t >= 10 THEN (t - 10)::DOUBLE ELSE (10 - t) * 2.0::DOUBLE END, abs(t - 10), t) - 1)::INTEGER AS rank FROM range(0, {N_TIME}) r(t)")
def scrub_order(spark, d):
    return temporal.scrub_order(spark.range(N_TIME).select(F.col("id").cast("int").alias("t")), 10).select("t", F.col("rank").cast("int"))


@query("scrub_order_loop", f"SELECT t::INTEGER AS t, (row_number() OVER (ORDER BY least((((t - 20) % {N_TIME} + {N_TIME}) % {N_TIME})::DOUBLE, 2.0 * ({N_TIME} - ((t - 20) % {N_TIME} + {N_TIME}) % {N_TIME})), abs(t - 20), t) - 1)::INTEGER AS rank FROM range(0, {N_TIME}) r(t)")
def scrub_order_loop(spark, d):
    return temporal.scrub_order(spark.range(N_TIME).select(F.col("id").cast("int").alias("t")), 20, loop=N_TIME).select("t", F.col("rank").cast("int"))


@query(
    "prefetch_plan",
    W(
        f""", o AS (SELECT t, row_number() OVER (ORDER BY CASE WHEN t >= 10 THEN (t - 10)::DOUBLE ELSE (10 - t) * 2.0 END, abs(t - 10), t) AS rank FROM range(0, {N_TIME}) r(t)),
h AS (SELECT * FROM o WHERE abs(t - 10) <= 8),
w AS (SELECT ({ANCHOR}) AS t, rank * 2 AS k FROM h UNION ALL SELECT t, rank * 2 + 1 FROM h),
p AS (SELECT t, row_number() OVER (ORDER BY min(k)) - 1 AS place FROM w GROUP BY t)
SELECT DISTINCT y // 8 AS row, x // 8 AS col, p.t::INTEGER AS t, p.place::INTEGER AS place FROM p, cube WHERE place < 12""",
        "cube",
    ),
)
def prefetch_plan(spark, d):
    cells = A.cube(spark, d).select(F.floor(F.col("y") / 8).cast("int").alias("row"), F.floor(F.col("x") / 8).cast("int").alias("col")).distinct()
    steps = spark.range(N_TIME).select(F.col("id").cast("int").alias("t"))
    return temporal.prefetch_plan(steps, cells, 10, N_TIME, INTERVAL, horizon=8, per_cell=12).select("row", "col", "t", F.col("place").cast("int"))


@query("times_monotone", W(", k AS (SELECT t, min(v) AS ts FROM obs GROUP BY t), z AS (SELECT t, ts, lag(ts) OVER (ORDER BY t) AS p FROM k) SELECT t, ts FROM z WHERE ts <= p", "obs"))
def times_monotone(spark, d):
    return temporal.monotone_violations(A.obs(spark, d).groupBy("t").agg(F.min("v").alias("ts")))


@query("duplicate_times", W("SELECT CAST(floor(epoch(ts) / 600) AS BIGINT) AS ts, count(*) AS n FROM evt GROUP BY 1 HAVING count(*) > 1", "evt"))
def duplicate_times(spark, d):
    return temporal.duplicates(A.evt(spark, d).select(F.floor(F.unix_timestamp("ts") / 600).alias("ts")))


@query(
    "regular_spacing",
    W(", x AS (SELECT 'x' AS axis, x AS i, x * 10.0::DOUBLE + 746095 AS m FROM cube UNION SELECT 'y', y, y * -10.0::DOUBLE + 2540435 FROM cube), d AS (SELECT axis, i, lead(m) OVER (PARTITION BY axis ORDER BY i) - m AS d FROM x) SELECT axis, max(d) - first(d ORDER BY i) <= 1e-8 + 1e-5 * abs(first(d ORDER BY i)) AND first(d ORDER BY i) - min(d) <= 1e-8 + 1e-5 * abs(first(d ORDER BY i)) AS regular FROM d WHERE d IS NOT NULL GROUP BY axis UNION ALL SELECT 't', (SELECT max(d) - min(d) <= 1e-8 + 1e-5 * first(d ORDER BY t) FROM (SELECT t, lead(m) OVER (ORDER BY t) - m AS d FROM (SELECT t, CAST(min(item_id) AS DOUBLE) AS m FROM (SELECT tile AS t, item_id FROM scenes) GROUP BY t)) WHERE d IS NOT NULL)", "cube", "scenes"),
)
def regular_spacing(spark, d):
    c = A.cube(spark, d)
    axis = lambda name, step, first: c.select(F.lit(name).alias("axis"), F.col(name).cast("long").alias("id"), (F.col(name) * step + first).alias("c")).distinct()
    xs, ys = axis("x", 10.0, 746095.0), axis("y", -10.0, 2540435.0)
    ts = A.scenes(spark, d).groupBy(F.col("tile").cast("long").alias("id")).agg(F.min("item_id").cast("double").alias("c")).select(F.lit("t").alias("axis"), "id", "c")
    return temporal.regular_spacing(xs.unionByName(ys).unionByName(ts), "axis", "id", "c")


@query("append_union", W("SELECT t, b, y, x, v FROM cube", "cube"))
def append_union(spark, d):
    c = A.cube(spark, d).select("t", "b", "y", "x", "v")
    return append.appended(c.filter("t < 16"), c.filter("t >= 16"))


@query("append_late_rows", W("SELECT t, count(*) AS n FROM obs WHERE t BETWEEN 10 AND 13 GROUP BY t", "obs"))
def append_late_rows(spark, d):
    """A batch of steps 10 to 20 comes when steps up to 13 are stored: its first four are late."""
    o = A.obs(spark, d)
    return append.late(o.filter("t >= 10 AND t <= 20"), 13).groupBy("t").agg(F.count("*").alias("n"))


@query(
    "append_frozen_refs",
    f"""WITH f AS (SELECT t, CASE WHEN 2 * (t % {INTERVAL}) > {INTERVAL} AND t - t % {INTERVAL} + {INTERVAL} < 10 THEN t - t % {INTERVAL} + {INTERVAL} ELSE t - t % {INTERVAL} END AS a FROM range(0, 10) r(t) WHERE t % {INTERVAL} <> 0),
n AS (SELECT t, CASE WHEN 2 * (t % {INTERVAL}) > {INTERVAL} AND t - t % {INTERVAL} + {INTERVAL} < 16 THEN t - t % {INTERVAL} + {INTERVAL} ELSE t - t % {INTERVAL} END AS a FROM range(10, 16) r(t) WHERE t % {INTERVAL} <> 0)
SELECT t::INTEGER AS t, a::INTEGER AS anchor_t FROM f UNION ALL SELECT t::INTEGER, a::INTEGER FROM n""",
)
def append_frozen_refs(spark, d):
    """Ten steps, then six more: references that are recorded stay, new steps refer to the nearest anchor after the append."""
    return append.extended_references(temporal.references(spark, 10, INTERVAL), 10, 16, INTERVAL)


@query("append_decode", W("SELECT t, b, y, x, v FROM cube", "cube"))
def append_decode(spark, d):
    """Encoded in two batches with frozen references, decoded through the recorded map."""
    c = A.cube(spark, d).select("t", "b", "y", "x", "v")
    refs = append.extended_references(temporal.references(spark, 10, INTERVAL), 10, N_TIME, INTERVAL)
    coded = append.encoded_batch(c.filter("t < 10"), c.filter("t < 10"), refs).unionByName(append.encoded_batch(c.filter("t >= 10"), c, refs))
    return append.decoded(coded, refs).select("t", "b", "y", "x", "v")


@query("resume_missing", W("SELECT DISTINCT t FROM obs WHERE t % 5 <> 2", "obs"))
def resume_missing(spark, d):
    o = A.obs(spark, d).select("t").distinct()
    return ingest.missing(o, o.filter("t % 5 = 2"), ["t"])


@query("yearly_extremes", "SELECT y AS year, arg_min(m, {'n': n, 'm': m}) AS least_month, min(n) AS least, arg_max(m, {'n': n, 'm': -m}) AS most_month, max(n) AS most FROM (SELECT year(l_shipdate)::INTEGER AS y, month(l_shipdate)::INTEGER AS m, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY y")
def yearly_extremes(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    per = li.groupBy(F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("m")).agg(F.count("*").alias("n"))
    low, high = F.min(F.struct("n", "m")), F.max(F.struct("n", (-F.col("m")).alias("neg")))
    return per.groupBy("year").agg(low.alias("lo"), high.alias("hi")).select("year", F.col("lo.m").alias("least_month"), F.col("lo.n").alias("least"), (-F.col("hi.neg")).alias("most_month"), F.col("hi.n").alias("most"))


@query("month_windows", "SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS month, count(*) AS n, sum(o_custkey)::BIGINT AS total FROM orders GROUP BY ALL")
def month_windows(spark, d):
    return append.monthly(spark.read.parquet(f"{d}/orders.parquet"), "o_orderdate", F.count("*").alias("n"), F.sum("o_custkey").alias("total"))
