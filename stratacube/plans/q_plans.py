"""Plans and messages as tables: rates, orders, samples, speeds, ranges, commands, references, mismatches."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratacube.functions import labels
from stratacube.operators import commands, ingest, planning, series, temporal
from stratacube.plans import adapters as A
from stratacube.plans.base import query

W = A.with_adapters
SPEEDS = [1.0, 10.0, 25.0, 40.0, 80.0]


def _events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


@query("decayed_rates", "WITH s AS (SELECT user_id AS u, event_id / 10.0::DOUBLE AS e, 0.1::DOUBLE + value / 100 AS s, (event_id % 977)::DOUBLE AS b FROM events), m AS (SELECT u, max(e) AS now FROM s GROUP BY u) SELECT u, round(sum(exp((e - now) / 40) * b) / sum(exp((e - now) / 40) * s), 6) AS rate FROM s JOIN m USING (u) GROUP BY u")
def decayed_rates(spark, d):
    s = _events(spark, d).select(F.col("user_id").alias("u"), (F.col("event_id") / 10.0).alias("at"), (F.col("value") / 100 + 0.1).alias("s"), (F.col("event_id") % 977).cast("double").alias("b"))
    return planning.decayed_rates(s, ["u"], "at", "s", "b", 40.0).select("u", F.round("rate", 6).alias("rate"))


@query("cells_from_the_centre", W(", c AS (SELECT DISTINCT t, y // 8 AS row, x // 8 AS col FROM cube) SELECT t, row, col, (row_number() OVER (PARTITION BY t ORDER BY pow(row + 0.5 - 2.25, 2) + pow(col + 0.5 - 1.5, 2), row, col) - 1)::INTEGER AS place FROM c", "cube"))
def cells_from_the_centre(spark, d):
    cell = lambda c: F.floor(F.col(c) / 8).cast("int")
    c = A.cube(spark, d).select("t", cell("y").alias("row"), cell("x").alias("col")).distinct()
    return planning.centre_order(c, ["t"], 2.25, 1.5).select("t", "row", "col", F.col("place").cast("int"))


@query("spread_steps", W(", n AS (SELECT tile, (count(DISTINCT ts::DATE) % 60 + 1)::INTEGER AS n FROM scenes GROUP BY tile) SELECT DISTINCT tile, n, CASE WHEN n <= 9 THEN i ELSE round_even(i * (n - 1) / 8.0::DOUBLE, 0)::INTEGER END::INTEGER AS step FROM n, range(0, 9) r(i) WHERE n > 9 OR i < n", "scenes"))
def spread_steps(spark, d):
    n = A.scenes(spark, d).groupBy("tile").agg((F.count_distinct(F.to_date("ts")) % 60 + 1).cast("int").alias("n"))
    return planning.spread_steps(n, "n", 9)


@query("nearest_speeds", f"SELECT event_id, arg_min(s, {{'far': abs(value - s), 's': s}})::DOUBLE AS speed, least(400, greatest(60, value * 4))::DOUBLE AS lead FROM events, (SELECT unnest({SPEEDS}) AS s) GROUP BY event_id, value")
def nearest_speeds(spark, d):
    """The nearest selectable speed, and how far ahead to load at a round trip of twice the value."""
    return _events(spark, d).select("event_id", planning.nearest_speeds(F.col("value"), SPEEDS).alias("speed"), planning.stage_leads(F.col("value") * 2).alias("lead"))


@query("movie_settings", "SELECT event_id, greatest(20, floor(1000.0::DOUBLE / (1 + event_id % 60) / 10 + 0.5) * 10)::BIGINT AS gif_ms, floor(least(24e6, greatest(2e6, (event_id % 2000) * 1080.0::DOUBLE * (1 + event_id % 60) * 0.15)) + 0.5)::BIGINT AS bitrate, round(CASE WHEN user_id > 0 THEN value / user_id END, 9) AS wire FROM events")
def movie_settings(spark, d):
    e = _events(spark, d).select("event_id", (F.col("event_id") % 60 + 1).cast("double").alias("rate"), (F.col("event_id") % 2000).alias("w"), F.lit(1080.0).alias("h"), "value", "user_id")
    return series.movie_settings(e, "rate", "w", "h", "value", "user_id").select("event_id", "gif_ms", "bitrate", F.round("wire", 9).alias("wire"))


@query(
    "byte_ranges",
    """WITH h AS (SELECT event_id, event_id % 50 AS size, event_id % 70 AS a, event_id % 90 AS b, event_id % 4 AS k FROM events),
r AS (SELECT event_id, size, CASE k WHEN 1 THEN greatest(size - b, 0) WHEN 3 THEN NULL ELSE a END AS first, CASE k WHEN 0 THEN least(b, size - 1) WHEN 3 THEN NULL ELSE size - 1 END AS last, k = 1 AND b = 0 AS nothing FROM h)
SELECT event_id, CASE WHEN first <= last AND first < size AND NOT nothing THEN first END::BIGINT AS first, CASE WHEN first <= last AND first < size AND NOT nothing THEN last END::BIGINT AS last FROM r""",
)
def byte_ranges(spark, d):
    """Headers of four forms: from a to b, the last b, from a on, and another unit."""
    e = _events(spark, d).select("event_id", (F.col("event_id") % 50).alias("size"), (F.col("event_id") % 70).cast("string").alias("a"), (F.col("event_id") % 90).cast("string").alias("b"), (F.col("event_id") % 4).alias("k"))
    header = F.when(F.col("k") == 0, F.concat(F.lit("bytes="), "a", F.lit("-"), "b")).when(F.col("k") == 1, F.concat(F.lit("bytes=-"), "b")).when(F.col("k") == 2, F.concat(F.lit("bytes="), "a", F.lit("-"))).otherwise(F.concat(F.lit("rows="), "a", F.lit("-"), "b"))
    r = labels.byte_ranges(header, F.col("size"))
    return e.select("event_id", r["first"].alias("first"), r["last"].alias("last"))


@query(
    "command_log",
    """WITH m AS (SELECT event_id, event_type AS e, event_id % 40 AS t, value - 20 AS zoom FROM events)
SELECT event_id, CASE WHEN e = 'error' THEN 'ignore' WHEN e = 'signup' THEN 'get' WHEN zoom <= 0 THEN 'error' ELSE 'set' END AS kind, CASE WHEN e NOT IN ('error', 'signup') AND zoom > 0 THEN t END::BIGINT AS step, CASE WHEN e NOT IN ('error', 'signup') AND zoom > 0 THEN round(zoom, 6) END AS zoom FROM m""",
)
def command_log(spark, d):
    """Events as commands: errors are of another kind, sign-ups ask, the others set a step and a zoom, which may not be valid."""
    e = _events(spark, d)
    kind = F.when(F.col("event_type") == "error", "other:set").when(F.col("event_type") == "signup", "cube:get").otherwise("cube:set")
    m = e.select("event_id", F.to_json(F.struct(kind.alias("type"), (F.col("event_id") % 40).alias("t"), (F.col("value") - 20).alias("zoom"))).alias("message"))
    return commands.parsed(m).select("event_id", "kind", "step", F.round("zoom", 6).alias("zoom"))


@query(
    "recorded_references",
    W(
        """, r AS (SELECT DISTINCT (item_id % 97)::INTEGER AS t, ((item_id % 97) // 6 * 6 + CASE (item_id % 97) % 11 WHEN 3 THEN 1 WHEN 5 THEN 12 ELSE 0 END)::INTEGER AS a FROM scenes WHERE item_id % 97 NOT IN (7, 20, 33)),
o AS (SELECT t::INTEGER AS t FROM range(0, 90) x(t) WHERE t % 6 <> 0),
f AS (SELECT t, 'missing' AS problem FROM o WHERE t NOT IN (SELECT t FROM r) UNION ALL SELECT t, 'unexpected' FROM r WHERE t NOT IN (SELECT t FROM o)
 UNION ALL SELECT t, CASE WHEN a % 6 <> 0 OR a >= 90 THEN 'not an anchor' ELSE 'too far' END FROM r WHERE t IN (SELECT t FROM o) AND (a % 6 <> 0 OR a >= 90 OR abs(a - t) >= 6))
SELECT t, problem FROM f""",
        "scenes",
    ),
)
def recorded_references(spark, d):
    """References of 90 steps by six as scenes give them: some lacking, some to no anchor, some too far."""
    t = (F.col("item_id") % 97).cast("int")
    r = A.scenes(spark, d).filter("item_id % 97 NOT IN (7, 20, 33)").select(t.alias("t")).distinct()
    wrong = F.when(F.col("t") % 11 == 3, 1).when(F.col("t") % 11 == 5, 12).otherwise(0)
    return temporal.reference_violations(r.withColumn("anchor_t", (F.floor(F.col("t") / 6) * 6 + wrong).cast("int")), 90, 6)


@query(
    "mismatches",
    """WITH a AS (SELECT s_suppkey AS k, s_name AS name, s_nationkey::VARCHAR AS nation FROM supplier WHERE s_suppkey % 7 <> 1),
b AS (SELECT s_suppkey AS k, s_name AS name, (s_nationkey + (s_suppkey % 5 = 2)::INTEGER)::VARCHAR AS nation FROM supplier WHERE s_suppkey % 7 <> 3)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'only in a' WHEN a.k IS NULL THEN 'only in b' ELSE 'nation' END AS field, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN a.nation END AS a, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN b.nation END AS b
FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.nation <> b.nation""",
)
def mismatches(spark, d):
    """A table against one that lacks rows, has others and differs in a field."""
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    other = s.filter("k % 7 <> 3").withColumn("nation", F.col("nation") + (F.col("k") % 5 == 2).cast("int"))
    return ingest.differing(s.filter("k % 7 <> 1"), other, "k", ["name", "nation"])


@query("lacking_assets", "SELECT l_orderkey AS item, list_sort(list_filter(['A', 'N', 'R', 'X'], lambda m: NOT list_contains(list(l_returnflag), m))) AS missing FROM lineitem GROUP BY l_orderkey")
def lacking_assets(spark, d):
    """Items and the wanted assets that none of their files is."""
    li = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("item")).agg(F.collect_set("l_returnflag").alias("assets"))
    return li.select("item", F.array_sort(F.array_except(F.array(*map(F.lit, "ANRX")), "assets")).alias("missing"))
