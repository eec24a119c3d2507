"""Series of single pixels and small windows, and what a viewer's events say about latency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def window_pixels(centres: DataFrame, height: int, width: int, radius: int = 1) -> DataFrame:
    """cy, cx, y, x, place: the window around each centre (columns y, x), clipped to the grid, the centre first.

    Clamping and dropping doubles leaves the pixels inside the grid, in row order.
    """
    lo = lambda c: F.greatest(F.col(c) - radius, F.lit(0))
    hi = lambda c, n: F.least(F.col(c) + radius, F.lit(n - 1))
    c = centres.select(F.col("y").alias("cy"), F.col("x").alias("cx"), F.sequence(lo("y"), hi("y", height)).alias("_ys"), F.sequence(lo("x"), hi("x", width)).alias("_xs"))
    grid = F.flatten(F.transform("_ys", lambda y: F.transform("_xs", lambda x: F.struct(((y != F.col("cy")) | (x != F.col("cx"))).alias("other"), y.alias("y"), x.alias("x")))))
    rows = c.select("cy", "cx", F.posexplode(F.array_sort(grid)).alias("place", "p"))
    return rows.select("cy", "cx", F.col("p.y").alias("y"), F.col("p.x").alias("x"), "place")


def neighbourhood_share(df: DataFrame, wet: Column, keys: Sequence[str] = ("t",), radius: int = 1, cell: int | None = None) -> DataFrame:
    """keys, y, x, n, share for each pixel with data near it: the share of wet pixels among those with data in its window.

    Sums go along rows first and then along columns, so each pixel is repeated 2 (2 r + 1) times, not (2 r + 1)^2. With a
    cell size, windows end at the cells' edges. Windows are given for pixels that are there themselves.
    """
    base = df.select(*keys, "y", "x", wet.cast("int").alias("_w")).filter("_w IS NOT NULL")
    steps = F.sequence(F.lit(-radius), F.lit(radius))

    def spread(rows: DataFrame, axis: str, other: str) -> DataFrame:
        moved = rows.withColumn("_to", F.explode(F.transform(steps, lambda s: F.col(axis) + s)))
        if cell:
            moved = moved.filter(F.floor(F.col("_to") / cell) == F.floor(F.col(axis) / cell))
        return moved.groupBy(*keys, F.col("_to").alias(axis), other).agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))

    sums = spread(spread(base.select(*keys, "y", "x", F.col("_w").alias("_s"), F.lit(1).alias("_n")), "x", "y"), "y", "x")
    centres = df.select(*keys, "y", "x").distinct()
    return sums.join(centres, [*keys, "y", "x"], "left_semi").select(*keys, "y", "x", F.col("_n").alias("n"), (F.col("_s") / F.col("_n")).alias("share"))


def gap_filled(df: DataFrame, value: str, coverage: str) -> DataFrame:
    """Rows with a value though nothing was observed."""
    return df.filter((F.col(coverage) == 0) & F.col(value).isNotNull())


def value_range(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """by, lo, hi of an axis: the range of the data and 8 % on both sides (of the value itself, or 0.5, if there is no range)."""
    out = df.groupBy(*by).agg(F.min(value).alias("a"), F.max(value).alias("b"))
    pad = F.coalesce(F.nullif((F.col("b") - F.col("a")) * 0.08, F.lit(0.0)), F.nullif(F.abs("b") * 0.08, F.lit(0.0)), F.lit(0.5))
    return out.select(*by, (F.col("a") - pad).alias("lo"), (F.col("b") + pad).alias("hi"))


def movie_settings(rows: DataFrame, rate: str, width: str, height: str, sent: str, raw: str) -> DataFrame:
    """rows with gif_ms, bitrate and wire: settings of films of a rate (steps a second).

    gif_ms: the delay of a frame in whole hundredths of a second, two at least (below that, viewers slow down). bitrate: 0.15
    bits a pixel, from 2 to 24 million a second. wire: bytes sent over raw bytes, null without any.
    """
    halves_up = lambda x: F.floor(x + 0.5)
    bits = F.least(F.lit(24e6), F.greatest(F.lit(2e6), F.col(width) * F.col(height) * F.col(rate) * 0.15))
    return rows.withColumns({
        "gif_ms": F.greatest(F.lit(20), halves_up(F.lit(1000.0) / F.col(rate) / 10) * 10).cast("long"),
        "bitrate": halves_up(bits).cast("long"),
        "wire": F.when(F.col(raw) > 0, F.col(sent) / F.col(raw)),
    })


def first_paints(events: DataFrame, session: str, at: str, is_input: Column, is_whole: Column, is_full: Column) -> DataFrame:
    """session, at of each input, and the times of the first whole and of the first full paint at or after it.

    One sorted pass per session, from its end: a frame up to the current row grows by that row, while one from it on would
    be gone through anew for each. At equal times the input comes first.
    """
    w = W.Window.partitionBy(session).orderBy(F.desc(at), F.when(is_input, 1).otherwise(0)).rowsBetween(W.Window.unboundedPreceding, 0)
    rows = events.withColumn("_in", is_input).withColumn("whole_at", F.last(F.when(is_whole, F.col(at)), True).over(w)).withColumn("full_at", F.last(F.when(is_full, F.col(at)), True).over(w))
    return rows.filter("_in").select(session, at, "whole_at", "full_at")


def frame_completeness(events: DataFrame, by: Sequence[str], paint: Column, partial: Column, fallback: Column, kept: Column) -> DataFrame:
    """by, painted, partial, partial_fraction, fallbacks, kept."""
    painted = F.count_if(paint)
    return events.groupBy(*by).agg(painted.alias("painted"), F.count_if(paint & partial).alias("partial"), F.coalesce(F.count_if(paint & partial) / F.nullif(painted, F.lit(0)), F.lit(0.0)).alias("partial_fraction"), F.count_if(paint & fallback).alias("fallbacks"), F.count_if(kept).alias("kept"))


def sliding_median(df: DataFrame, keys: Sequence[str], order: str, value: str, width: int = 30) -> DataFrame:
    """df with median: over the last ``width`` values, this one included."""
    w = W.Window.partitionBy(*keys).orderBy(order).rowsBetween(-(width - 1), 0)
    held = F.array_sort(F.collect_list(F.col(value)).over(w))
    n = F.size("_held")
    middle = (F.element_at("_held", F.floor((n + 1) / 2).cast("int")) + F.element_at("_held", F.floor(n / 2).cast("int") + 1)) / 2
    return df.withColumn("_held", held).withColumn("median", F.when(n > 0, middle)).drop("_held")
