"""Manifests: lists of files with times, as CSV or JSON."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from stratacube.functions import labels
from stratacube.functions.geometry import checked_bounds


def parsed_time(text):
    """ISO text, with or without an offset, as a time; raises for anything else."""
    return F.to_timestamp(F.trim(text))


def steps(rows: DataFrame, base: str) -> DataFrame:
    """uri, ts, iso, t, bands from rows of uri, datetime and (optionally) bands, in time order.

    Relative URIs are put below base. A manifest has a row per step of the axis, so one window spans it.
    """
    absolute = F.col("uri").contains("://") | F.col("uri").startswith("/")
    bands = labels.split_names(F.col("bands")) if "bands" in rows.columns else F.lit(None).cast("array<string>")
    out = rows.select(F.when(absolute, F.col("uri")).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.col("uri"))).alias("uri"), parsed_time(F.col("datetime")).alias("ts"), bands.alias("bands"))
    millis = F.bool_or(F.unix_millis("ts") % 1000 != 0).over(W.Window.partitionBy())
    return out.withColumn("iso", labels.iso(F.col("ts"), millis)).withColumn("t", (F.row_number().over(W.Window.orderBy("ts", "uri")) - 1).cast("int"))


def duplicate_times(rows: DataFrame) -> DataFrame:
    """ts, n of times with several rows."""
    return rows.groupBy(parsed_time(F.col("datetime")).alias("ts")).agg(F.count("*").alias("n")).filter("n > 1")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, list[str] | None, tuple[float, ...] | None]:
    """steps(), band names and bounds of a manifest file; raises on what is missing, differs or occurs twice."""
    low, base = path.lower(), posixpath.dirname(path)
    names, bounds = None, None
    if low.endswith(".csv"):
        rows = spark.read.option("header", True).option("multiLine", True).csv(path)
    elif low.endswith(".json"):
        rows = spark.read.option("multiLine", True).json(path)
        if "items" in rows.columns:
            top = rows.first().asDict()
            names, bounds = top.get("bands"), top.get("bounds")
            rows = rows.select(F.explode("items").alias("i")).select("i.*")
        if "bands" in rows.columns and rows.schema["bands"].dataType.typeName() == "array":
            rows = rows.withColumn("bands", F.array_join("bands", ";"))
    else:
        raise ValueError(f"{path}: a manifest ends in .csv or .json")
    lacking = {"uri", "datetime"} - set(rows.columns)
    if lacking:
        raise ValueError(f"{path}: there is no {' and no '.join(sorted(lacking))}")
    bad = rows.agg(F.count("*").alias("n"), F.count_if(F.col("uri").isNull() | (F.col("uri") == "") | F.col("datetime").isNull() | (F.col("datetime") == "")).alias("bad")).first()
    if not bad["n"] or bad["bad"]:
        raise ValueError(f"{path}: " + ("it has no rows" if not bad["n"] else f"{bad['bad']} rows lack uri or datetime"))
    twice = duplicate_times(rows).limit(5).collect()
    if twice:
        raise ValueError(f"{path}: several rows share the times {[str(r['ts']) for r in twice]}; a cube has one step per time")
    out = steps(rows, base)
    kinds = [r["bands"] for r in out.select("bands").filter("bands IS NOT NULL").distinct().limit(3).collect()]
    if names:
        kinds = [list(names)] + [k for k in kinds if k != list(names)]
    if len(kinds) > 1:
        raise ValueError(f"{path}: rows name different bands: {kinds[0]} and {kinds[1]}")
    return out, (kinds[0] if kinds else None), (checked_bounds(bounds) if bounds else None)
