"""Resampling onto another north-up grid of the same reference system, as a join on pixel arithmetic and a group-by.

Each source pixel is sent to the target pixels that it has weight in, so there is no join of grids: one explode of a few
rows per pixel and one aggregation that combines before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratacube.functions.geometry import Transform, north_up

METHODS = ("nearest", "bilinear", "cubic", "average", "mode", "min", "max", "med")


def _cubic(d: Column) -> Column:
    """The cubic convolution kernel with a = -1/2."""
    a = -0.5
    near = d * d * d * (a + 2) - d * d * (a + 3) + 1
    far = d * d * d * a - d * d * (5 * a) + d * (8 * a) - 4 * a
    return F.when(d <= 1, near).when(d < 2, far).otherwise(F.lit(0.0))


def _targets(scale: float, shift: float, at: Column, radius: float, n: int) -> Column:
    """Target pixels k within the grid whose centre, in source pixels scale * (k + 1/2) + shift - 1/2, is nearer than radius."""
    lo = F.floor((at - radius + 0.5 - shift) / scale - 0.5).cast("int") - 1
    hi = F.ceil((at + radius + 0.5 - shift) / scale - 0.5).cast("int") + 1
    near = lambda k: F.abs((k + 0.5) * scale + shift - 0.5 - at) < radius
    return F.filter(F.sequence(F.greatest(lo, F.lit(0)), F.greatest(F.least(hi, F.lit(n - 1)), F.lit(0))), near)


def warped(df: DataFrame, source: Transform, target: Transform, height: int, width: int, method: str = "nearest", keys: Sequence[str] = ("t",), value: str = "v") -> DataFrame:
    """keys, y, x, value (double) of the target's pixels that any valid source pixel has weight in; null values have none.

    average, mode, min, max and med take the source pixels whose centres fall into the target pixel; mode takes the
    smallest value on ties.
    """
    if method not in METHODS:
        raise ValueError(f"no resampling method {method!r}; there are {', '.join(METHODS)}")
    s, t = north_up(source), north_up(target)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col("y").alias("_y"), F.col("x").alias("_x"), F.col(value).cast("double").alias("_v"))
    if method in ("average", "mode", "min", "max", "med"):
        y = F.floor(((F.col("_y") + 0.5) * s[4] + s[5] - t[5]) / t[4]).cast("int")
        x = F.floor(((F.col("_x") + 0.5) * s[0] + s[2] - t[2]) / t[0]).cast("int")
        rows = rows.withColumn("y", y).withColumn("x", x).filter(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))
        if method == "mode":
            n = rows.groupBy(*keys, "y", "x", "_v").agg(F.count("*").alias("_n"))
            return n.groupBy(*keys, "y", "x").agg(F.max(F.struct("_n", (-F.col("_v")).alias("_neg"))).alias("_m")).select(*keys, "y", "x", (-F.col("_m._neg")).alias(value))
        return rows.groupBy(*keys, "y", "x").agg({"average": F.avg, "min": F.min, "max": F.max, "med": F.median}[method]("_v").alias(value))
    sy, sx = t[4] / s[4], t[0] / s[0]
    oy, ox = (t[5] - s[5]) / s[4], (t[2] - s[2]) / s[0]
    if method == "nearest":
        fy, fx = (lambda k: F.floor((k + 0.5) * sy + oy)), (lambda k: F.floor((k + 0.5) * sx + ox))
        ys = F.filter(_targets(sy, oy, F.col("_y"), 1.0, height), lambda k: fy(k) == F.col("_y"))
        xs = F.filter(_targets(sx, ox, F.col("_x"), 1.0, width), lambda k: fx(k) == F.col("_x"))
        return rows.withColumn("y", F.explode(ys)).withColumn("x", F.explode(xs)).select(*keys, "y", "x", F.col("_v").alias(value))
    radius = 1.0 if method == "bilinear" else 2.0
    kernel = (lambda d: F.lit(1.0) - d) if method == "bilinear" else _cubic
    rows = rows.withColumn("y", F.explode(_targets(sy, oy, F.col("_y"), radius, height))).withColumn("x", F.explode(_targets(sx, ox, F.col("_x"), radius, width)))
    dy, dx = F.abs((F.col("y") + 0.5) * sy + oy - 0.5 - F.col("_y")), F.abs((F.col("x") + 0.5) * sx + ox - 0.5 - F.col("_x"))
    w = kernel(dy) * kernel(dx)
    total = F.sum(w)
    return rows.groupBy(*keys, "y", "x").agg(F.when(F.abs(total) > 1e-12, F.sum(w * F.col("_v")) / F.nullif(total, F.lit(0.0))).alias(value)).filter(F.col(value).isNotNull())
