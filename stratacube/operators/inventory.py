"""Objects of a folder: keys, sizes, digests, differences; volatility as it is stored."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacube.sources import codecs
from stratacube.sources.files import files


def objects(spark: SparkSession, path: str, digests: bool = False) -> DataFrame:
    """key, size[, sha256] of all files below a path, listed and read by Spark."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = path.split("://", 1)[-1].rstrip("/")
    key = F.substring_index("path", root + "/", -1)
    extra = [F.sha2("content", 256).alias("sha256")] if digests else []
    return found.select(key.alias("key"), F.col("length").alias("size"), *extra)


def summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("objects"), F.sum("size").alias("bytes"))


def by_level(rows: DataFrame) -> DataFrame:
    """level, variable, objects, bytes of the chunks (or shards) in an inventory."""
    part = lambda k: F.regexp_extract("key", r"^(\d+)/([^/]+)/c/", k)
    return rows.filter(part(1) != "").groupBy(part(1).cast("int").alias("level"), part(2).alias("variable")).agg(F.count("*").alias("objects"), F.sum("size").alias("bytes"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """key, change (new, gone, changed) between two inventories with digests."""
    both = before.select("key", F.col("sha256").alias("a")).join(after.select("key", F.col("sha256").alias("b")), "key", "full")
    what = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "gone").when(F.col("a") != F.col("b"), "changed")
    return both.select("key", what.alias("change")).filter("change IS NOT NULL")


def stored_volatility(spark: SparkSession, path: str) -> DataFrame:
    """row, col, volatility of a store's level-0 cells."""
    import json

    f = files(path)
    meta = json.loads(f.get("volatility/zarr.json"))
    rows, cols = meta["shape"]
    grid = codecs.decode(f.get("volatility/c/0/0"), meta["codecs"], "float32", rows * cols).reshape(rows, cols)
    return spark.createDataFrame([(r, c, float(grid[r, c])) for r, c in np.ndindex(rows, cols)], "row int, col int, volatility float")
