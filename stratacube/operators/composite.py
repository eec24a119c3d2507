"""Composites: one value per pixel and period from several scenes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def median_composite(scenes: DataFrame, ok: Column, by: Sequence[str] = ("t", "b"), value: str = "v") -> DataFrame:
    """by, y, x, value, scenes: the median of the valid scenes, cut to a whole number. A pixel has few scenes in a period."""
    return scenes.filter(ok).groupBy(*by, "y", "x").agg(F.floor(F.median(value)).cast("int").alias(value), F.count("*").alias("scenes"))


def coverage(scenes: DataFrame, ok: Column, by: Sequence[str] = ("t",)) -> DataFrame:
    """by, y, x, scenes, valid, fraction, flag (1 if any scene is valid)."""
    valid = F.count_if(ok)
    return scenes.groupBy(*by, "y", "x").agg(F.count("*").alias("scenes"), valid.alias("valid"), (valid.cast("double") / F.count("*")).alias("fraction"), (valid > 0).cast("int").alias("flag"))


def overlap(grids: DataFrame) -> DataFrame:
    """l, b, r, u of what all grids (columns l, b, r, u) share; no row if they share nothing."""
    return grids.agg(F.max("l").alias("l"), F.max("b").alias("b"), F.min("r").alias("r"), F.min("u").alias("u")).filter("l < r AND b < u")
