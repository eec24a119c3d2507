"""Exact order statistics by counting values: counts combine before they are shuffled, so groups of any size work."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


#: Ranges that the distinct values of a group are cut into.
PARTS = 64


def counted(df: DataFrame, by: Sequence[str], value: Column) -> DataFrame:
    """by, value, n, upto (values so far, this one included), total.

    A group's distinct values are cut into ranges at approximate percentiles; each range is summed up by itself and the
    ranges before it added, so no task sorts a whole group, however many distinct values it has.
    """
    n = df.select(*by, value.alias("value")).filter("value IS NOT NULL").groupBy(*by, "value").agg(F.count("*").alias("n"))
    group = [F.coalesce(F.struct(*by).cast("string"), F.lit("")) if by else F.lit("")]  # nulls are a group too
    n = n.withColumn("_by", group[0])
    cuts = n.groupBy("_by").agg(F.percentile_approx("value", F.array(*[F.lit(k / PARTS) for k in range(1, PARTS)]), F.lit(1000)).alias("_cuts"))
    rows = n.join(cuts, "_by").withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col("value")))).drop("_cuts")
    sums = rows.groupBy("_by", "_part").agg(F.sum("n").alias("_n"))
    w = W.Window.partitionBy("_by")
    before = F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("_by", "_part", before.alias("_before"), F.sum("_n").over(w).alias("total"))
    inner = rows.withColumn("upto", F.sum("n").over(W.Window.partitionBy("_by", "_part").orderBy("value")))
    return inner.join(sums, ["_by", "_part"]).withColumn("upto", F.col("upto") + F.col("_before")).drop("_by", "_part", "_before")


def at_places(df: DataFrame, by: Sequence[str], value: Column, places: Mapping[str, Column]) -> DataFrame:
    """by, n and, by name, the value at a 0-based place in sorted order; places are expressions of total."""
    c = counted(df, by, value)
    picks = [F.min(F.when(F.col("upto") > place, F.col("value"))).alias(name) for name, place in places.items()]
    grouped = c.groupBy(*by) if by else c.groupBy()
    return grouped.agg(F.sum("n").alias("n"), *picks)


def fraction(q: float) -> Column:
    """The place floor(q * n), at most the last."""
    return F.least(F.floor(F.col("total") * q), F.col("total") - 1)


def percentile_range(df: DataFrame, by: Sequence[str], value: Column, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """by, lo, hi: values at floor(low * n) and floor(high * n); equal ends are spread by 1."""
    out = at_places(df, by, value, {"lo": fraction(low), "hi": fraction(high)})
    return out.select(*by, "lo", F.when(F.col("hi") > F.col("lo"), F.col("hi")).otherwise(F.col("lo") + 1).alias("hi"))


def reached(df: DataFrame, by: Sequence[str], value: Column, shares: Mapping[str, float]) -> DataFrame:
    """by and, by name, the first value at which the cumulative count reaches a share of the total."""
    c = counted(df, by, value)
    picks = [F.min(F.when(F.col("upto") >= F.col("total") * q, F.col("value"))).alias(name) for name, q in shares.items()]
    return (c.groupBy(*by) if by else c.groupBy()).agg(*picks)


def distribution(df: DataFrame, by: Sequence[str], value: Column) -> DataFrame:
    """by, n, median, p95, max, rounded to tenths (halves up)."""
    out = at_places(df, by, value, {"median": fraction(0.5), "p95": fraction(0.95), "max": fraction(1.0)})
    tenth = lambda c: (F.floor(F.col(c) * 10 + 0.5) / 10).alias(c)
    return out.select(*by, "n", tenth("median"), tenth("p95"), tenth("max"))


def row_major_rank(df: DataFrame, by: Sequence[str] = ("t",)) -> DataFrame:
    """df with rank 0, 1, ... of each row's place in (y, x) order within its plane.

    Rows of pixels are ranked each for itself and the sizes of the rows before them added, so no window spans a plane.
    """
    sizes = df.groupBy(*by, "y").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.Window.partitionBy(*by).orderBy("y").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*by, "y", before.alias("_before"))
    inner = df.withColumn("_k", F.row_number().over(W.Window.partitionBy(*by, "y").orderBy("x")))
    return inner.join(starts, [*by, "y"]).withColumn("rank", F.col("_before") + F.col("_k") - 1).drop("_before", "_k")
