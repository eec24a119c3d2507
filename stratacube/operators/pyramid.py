"""Resolution pyramids: 2 x 2 block reduction of values, masks and coverage, level by level.

A level comes from the one below it, never from level 0, as the mean is floored at each level. Replicating an odd edge
changes neither the mean over valid pixels nor the mask, so the long form needs no padding; coverage divides by the
number of pixels that there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parents(by: Sequence[str], factor: int = 2) -> list[Column]:
    up = [F.floor(F.col(c) / factor).cast("int").alias(c) for c in ("y", "x")]
    return [*[F.col(c) for c in by], *up]


def reduced(df: DataFrame, ok: Column, by: Sequence[str] = ("t", "b"), value: str = "v", floats: bool = False, empty: int | float | None = 0) -> DataFrame:
    """by, y, x, value of the next level: the mean of valid pixels (whole numbers: floored); ``empty`` where none is valid."""
    v = F.when(ok, F.col(value).cast("double" if floats else "bigint"))
    mean = F.sum(v) / F.greatest(F.count(v), F.lit(1))
    out = F.when(F.count(v) > 0, mean if floats else F.floor(mean))
    return df.groupBy(*parents(by)).agg(F.coalesce(out, F.lit(empty)).cast("float" if floats else "int").alias(value))


def reduced_mask(df: DataFrame, by: Sequence[str] = ("t",), mask: str = "mask") -> DataFrame:
    """1 where any pixel of the block is valid."""
    return df.groupBy(*parents(by)).agg(F.max(mask).cast("int").alias(mask))


def reduced_coverage(df: DataFrame, by: Sequence[str] = ("t",), coverage: str = "coverage") -> DataFrame:
    """The rounded mean of the block, halves up. The planes must be dense: n counts the pixels of the block."""
    total, n = F.sum(F.col(coverage).cast("bigint")), F.count("*")
    return df.groupBy(*parents(by)).agg(F.floor((2 * total + n) / (2 * n)).cast("int").alias(coverage))


def shapes(height: int, width: int, cell: int, levels: int | None = None) -> list[tuple[int, int]]:
    """Heights and widths of the levels: halved and rounded up until one cell holds the level, or as many as asked for."""
    out = [(height, width)]
    while len(out) != levels if levels is not None else max(out[-1]) > cell:
        if out[-1] == (1, 1):
            raise ValueError(f"{levels} levels are too many: level {len(out) - 1} is a single pixel")
        out.append(((out[-1][0] + 1) // 2, (out[-1][1] + 1) // 2))
    return out


def pyramid(df: DataFrame, levels: int, ok, by: Sequence[str] = ("t", "b"), value: str = "v", floats: bool = False, empty: int | float | None = 0) -> DataFrame:
    """All levels with a column level. ok is a function of a frame that gives its condition of validity.

    All levels share one shuffle: pixels are partitioned by the ancestor that holds their whole block at the top, so
    each level's groups are inside a partition already.
    """
    top = 1 << (levels - 1)
    keys = [*by, "_py", "_px"]
    base = df.select(*by, "y", "x", value, F.floor(F.col("y") / top).cast("int").alias("_py"), F.floor(F.col("x") / top).cast("int").alias("_px")).repartition(*keys)
    out, at = base.select(F.lit(0).alias("level"), *by, "y", "x", value), base
    for k in range(1, levels):
        at = reduced(at, ok(at), [*keys], value, floats, empty)
        out = out.unionByName(at.select(F.lit(k).alias("level"), *by, "y", "x", value))
    return out


def whole_blocks(df: DataFrame, factor: int, height: int, width: int, ok: Column, by: Sequence[str] = ("t", "b"), value: str = "v") -> DataFrame:
    """by, y, x, mean, n over factor x factor blocks that lie in the grid as a whole."""
    inside = df.filter((F.col("y") < height // factor * factor) & (F.col("x") < width // factor * factor))
    v = F.when(ok, F.col(value).cast("double"))
    return inside.groupBy(*parents(by, factor)).agg((F.coalesce(F.sum(v), F.lit(0.0)) / F.greatest(F.count(v), F.lit(1))).alias("mean"), F.count(v).alias("n"))
