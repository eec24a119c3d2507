"""Cubes over the driver's tables: each has the same definition as Spark SQL and as DuckDB SQL.

obs   t, b, y, x, v        scenes: one row per line item; uint16 range, several rows per pixel
cube  t, b, y, x, v, cov   composite of obs: median value and number of observations; sparse
ecube t, y, x, v           embeddings as a dense float32 plane per 50 vectors
evt   t, ts, b, y, x, v    events as timed observations
scenes item_id, ts, cloud_cover, tile, baseline, v   orders as a catalogue of scenes
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Height and width of obs and cube, of ecube, and of evt.
OBS_H, OBS_W = 37, 29
E_H, E_W = 50, 64

OBS_SQL = f"""SELECT CAST(floor(((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1) / 3) AS INT) AS t, CAST(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS INT) AS b,
 CAST(l_partkey % {OBS_H} AS INT) AS y, CAST(l_suppkey % {OBS_W} AS INT) AS x, CAST(floor(l_quantity * 100) AS INT) AS v FROM lineitem"""
CUBE_SQL = "SELECT t, b, y, x, CAST(floor(median(v)) AS INT) AS v, count(*) AS cov FROM obs GROUP BY t, b, y, x"
ECUBE_DUCK = f"SELECT CAST(floor(vec_id / {E_H}) AS INT) AS t, CAST(vec_id % {E_H} AS INT) AS y, CAST(i - 1 AS INT) AS x, CAST(embedding[i] AS FLOAT) AS v FROM embeddings, range(1, {E_W + 1}) r(i)"
TYPES = "CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END"
EVT_SQL = f"SELECT CAST(day(ts) AS INT) AS t, ts, CAST({TYPES} AS INT) AS b, CAST(floor(user_id / 15) AS INT) AS y, CAST(user_id % 15 AS INT) AS x, value AS v FROM events"
SCENES_SQL = """SELECT o_orderkey AS item_id, o_orderdate AS ts, CAST(o_totalprice AS DOUBLE) AS price, CAST(o_custkey % 7 AS INT) AS tile,
 CAST(o_orderkey % 100 AS INT) AS cloud_cover, CASE WHEN o_orderstatus = 'F' THEN '03.01' ELSE '05.10' END AS baseline, CAST(floor(o_totalprice) % 70000 AS INT) AS v FROM orders"""

#: Common table expressions for DuckDB.
DUCK = {"obs": OBS_SQL, "cube": CUBE_SQL, "ecube": ECUBE_DUCK, "evt": EVT_SQL, "scenes": SCENES_SQL}
NEEDS = {"cube": ["obs"]}


def with_adapters(sql: str, *names: str, recursive: bool = False) -> str:
    """DuckDB SQL with the named cubes in front of it. sql may begin with ``, name AS (...)`` for more expressions."""
    order: list[str] = []
    for n in names:
        for m in [*NEEDS.get(n, []), n]:
            if m not in order:
                order.append(m)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(f"{n} AS ({DUCK[n]})" for n in order) + f"\n{sql}"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(OBS_SQL.replace("FROM lineitem", "FROM {lineitem}"), lineitem=_table(spark, sf_dir, "lineitem"))


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CUBE_SQL.replace("FROM obs", "FROM {obs}"), obs=obs(spark, sf_dir))


def ecube(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings")
    rows = e.select(F.floor(F.col("vec_id") / E_H).cast("int").alias("t"), (F.col("vec_id") % E_H).cast("int").alias("y"), F.posexplode("embedding").alias("x", "v"))
    return rows.select("t", "y", F.col("x").cast("int"), F.col("v").cast("float").alias("v"))


def evt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(EVT_SQL.replace("FROM events", "FROM {events}"), events=_table(spark, sf_dir, "events"))


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SCENES_SQL.replace("FROM orders", "FROM {orders}"), orders=_table(spark, sf_dir, "orders"))
