"""Water from a green and a near-infrared band: automatic thresholds and statistics per step."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from stratacube.functions import pixels
from stratacube.operators import ranks

LIMIT = pixels.INDEX_LIMIT


def classified(pairs: DataFrame, green: str = "g", nir: str = "n") -> DataFrame:
    """pairs with ndwi (stored index) and dark (deep water, which has no usable index)."""
    return pairs.withColumn("ndwi", pixels.stored_index(F.col(green), F.col(nir))).withColumn("dark", pixels.dark(F.col(green), F.col(nir)))


def histogram(df: DataFrame, by: Sequence[str], value: str = "ndwi") -> DataFrame:
    """by, bin, n, upto, total: counts of whole values and their running sums."""
    return ranks.counted(df, by, F.col(value)).withColumnRenamed("value", "bin")


def otsu(df: DataFrame, by: Sequence[str], value: str = "ndwi", limit: int = LIMIT) -> DataFrame:
    """by, otsu, eta: the threshold with the largest variance between the classes below and above it, and its separability.

    One bin per whole value from -limit to limit. Between two values that occur the variance doesn't change, so only
    these are looked at, each standing for the run of bins up to the next. Of several best thresholds the middle one is
    taken, empty bins included.
    """
    h = df.groupBy(*by, F.col(value).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))
    part = W.Window.partitionBy(*by)
    run = part.orderBy("bin").rowsBetween(W.Window.unboundedPreceding, 0)
    h = h.withColumn("below", F.sum("n").over(run).cast("double")).withColumn("below_sum", F.sum(F.col("n") * F.col("bin")).over(run).cast("double"))
    h = h.withColumn("total", F.sum("n").over(part).cast("double")).withColumn("total_sum", F.sum(F.col("n") * F.col("bin")).over(part).cast("double"))
    h = h.withColumn("next", F.lead("bin", 1).over(part.orderBy("bin")))
    above = F.col("total") - F.col("below")
    gap = F.col("below_sum") / F.col("below") - (F.col("total_sum") - F.col("below_sum")) / F.nullif(above, F.lit(0.0))
    between = F.coalesce(F.col("below") * above * (gap * gap) / (F.col("total") * F.col("total")), F.lit(0.0))
    deviation = F.col("bin") - F.col("total_sum") / F.col("total")
    h = h.withColumn("between", between).withColumn("spread", F.col("n") * (deviation * deviation))
    # Bins below the first value have no class below them: their variance counts as 0.
    first = h.groupBy(*by).agg(F.min("bin").alias("bin")).select(*by, F.lit(-limit).cast("bigint").alias("bin"), F.col("bin").alias("next"), F.lit(0.0).alias("between"), F.lit(0.0).alias("spread"), F.lit(None).cast("double").alias("total"))
    runs = h.select(*by, "bin", F.coalesce("next", F.lit(limit + 1)).alias("next"), "between", "spread", "total").unionByName(first.filter("next > bin"))
    best = F.max("between").over(part)
    runs = runs.withColumn("best", best).withColumn("variance", F.sum("spread").over(part) / F.max("total").over(part))
    ties = runs.filter(F.col("between") == F.col("best")).withColumn("len", F.col("next") - F.col("bin"))
    ties = ties.withColumn("upto", F.sum("len").over(run)).withColumn("all", F.sum("len").over(part))
    middle = F.floor(F.col("all") / 2)
    hit = ties.filter((F.col("upto") > middle) & (F.col("upto") - F.col("len") <= middle))
    eta = F.when(F.col("variance") > 0, F.col("best") / F.col("variance")).otherwise(F.lit(0.0))
    return hit.select(*by, (F.col("bin") + middle - (F.col("upto") - F.col("len"))).cast("int").alias("otsu"), eta.alias("eta"))


def statistics(pairs: DataFrame, plane_pixels: int, floor: int, pixel_km2: float, blue: str | None = None) -> DataFrame:
    """Per step t: valid_px, valid_frac, dark_frac, otsu, threshold, floored, eta, water_frac, water_frac_otsu, water_km2[, blue_median].

    pairs has a row per valid pixel. Dark pixels are water and don't take part in the threshold, which is at least floor.
    """
    c = classified(pairs)
    t = otsu(c.filter(~F.col("dark")), ["t"])
    limits = t.select("t", "otsu", "eta", F.greatest("otsu", F.lit(floor)).alias("threshold"))
    rows = c.join(limits, "t", "left")
    wet = F.col("dark") | F.coalesce(F.col("ndwi") > F.col("threshold"), F.lit(False))
    wet_otsu = F.col("dark") | F.coalesce(F.col("ndwi") > F.col("otsu"), F.lit(False))
    n = F.count("*").cast("double")
    share = lambda k, digits: F.round(k / n, digits)
    out = rows.groupBy("t").agg(
        F.count("*").alias("valid_px"),
        F.round(n / plane_pixels, 4).alias("valid_frac"),
        share(F.count_if("dark"), 5).alias("dark_frac"),
        F.max("otsu").alias("otsu"),
        F.max("threshold").alias("threshold"),
        F.max((F.col("otsu") < floor).cast("int")).alias("floored"),
        F.round(F.max("eta"), 3).alias("eta"),
        share(F.count_if(wet), 5).alias("water_frac"),
        share(F.count_if(wet_otsu), 5).alias("water_frac_otsu"),
        F.round(F.count_if(wet) * F.lit(pixel_km2), 3).alias("water_km2"),
    )
    if blue is None:
        return out
    every = ranks.row_major_rank(pairs.select("t", "y", "x", blue)).filter("rank % 16 = 0")
    total = F.col("total")
    middle = ranks.at_places(every, ["t"], F.col(blue), {"lo": F.floor((total - 1) / 2), "hi": F.floor(total / 2)})
    return out.join(middle.select("t", F.floor((F.col("lo") + F.col("hi")) / 2).cast("int").alias("blue_median")), "t")


def notable_months(rows: DataFrame) -> DataFrame:
    """place, t: months worth a look, each once: wettest, driest (of those observed to 90 %), most changed by the floor,
    least observed (from 1 % on), darkest (if 1 % is dark). rows: one per step, with statistics()' columns; earlier steps win ties."""
    some = rows.agg(F.count_if(F.col("valid_frac") >= 0.9).alias("_seen"), F.count_if(F.col("valid_frac") >= 0.01).alias("_sparse"))
    r = rows.crossJoin(F.broadcast(some))  # one row
    seen, sparse = (F.col("_seen") == 0) | (F.col("valid_frac") >= 0.9), (F.col("_sparse") == 0) | (F.col("valid_frac") >= 0.01)
    early = -F.col("t")
    pick = lambda ok, key: F.max(F.when(ok, F.struct(key.alias("k"), early.alias("e"))))
    floor_change = F.abs(F.col("water_frac") - F.col("water_frac_otsu"))
    best = r.agg(pick(seen, F.col("water_frac")).alias("a"), pick(seen, -F.col("water_frac")).alias("b"), pick(F.lit(True), floor_change).alias("c"), pick(sparse, -F.col("valid_frac")).alias("d"), pick(F.lit(True), F.col("dark_frac")).alias("e"))
    dark = F.when(F.col("e.k") >= 0.01, F.col("e"))
    rows = best.select(F.posexplode(F.array("a", "b", "c", "d", dark)).alias("place", "m")).filter("m IS NOT NULL")
    return rows.groupBy((-F.col("m.e")).alias("t")).agg(F.min("place").alias("place"))
