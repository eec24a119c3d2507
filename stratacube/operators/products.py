"""Products of bands: wide rows, which band answers to which name, what a product needs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacube.functions import pixels

#: Products by the common names of their inputs, in the order that the colour functions take; the single band needs none.
PRODUCTS: dict[str, list[str]] = {
    "true_color": ["red", "green", "blue"],
    "false_color": ["nir", "red", "green"],
    "ndvi": ["nir", "red"],
    "ndwi": ["green", "nir"],
    "water": ["green", "nir"],
    "band": [],
}
#: Sentinel-2's names for the common ones.
SENTINEL2 = {"blue": "B02", "green": "B03", "red": "B04", "nir": "B08", "swir16": "B11", "swir22": "B12"}


def wide(df: DataFrame, bands: Mapping[str, int], keys: Sequence[str] = ("t", "y", "x"), value: str = "v") -> DataFrame:
    """One row per pixel with a column per band; null where a band is missing."""
    rows = df.filter(F.col("b").isin(*bands.values()))
    return rows.groupBy(*keys).agg(*[F.max(F.when(F.col("b") == b, F.col(value))).alias(n) for n, b in bands.items()])


def common_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SENTINEL2.items()), "common_name string, alias string")


def find_bands(bands: DataFrame, names: DataFrame) -> DataFrame:
    """common_name, band of names: by a band's common name, else (for bands without one) by its name or Sentinel-2's."""
    unnamed = F.col("common").isNull()
    rank = F.when(F.col("common") == F.col("common_name"), 0).when(unnamed & (F.lower("name") == F.col("common_name")), 1).when(unnamed & (F.col("name") == F.col("alias")), 2)
    pairs = names.join(F.broadcast(bands), (F.col("common") == F.col("common_name")) | unnamed & ((F.lower("name") == F.col("common_name")) | (F.col("name") == F.col("alias"))), "left")
    return pairs.groupBy("common_name").agg(F.min_by("band", F.struct(rank.alias("rank"), "band")).alias("band"))


def availability(found: DataFrame, products: Mapping[str, Sequence[str]]) -> DataFrame:
    """product, available, missing (names no band answers to), indices (of the bands, in the order needed)."""
    spark = found.sparkSession
    needs = spark.createDataFrame([(p, i, n) for p, names in products.items() for i, n in enumerate(names)], "product string, place int, common_name string")
    everything = spark.createDataFrame([(p,) for p in products], "product string")
    rows = needs.join(found, "common_name", "left")
    lacking = F.sort_array(F.collect_list(F.when(F.col("band").isNull(), F.struct("place", "common_name"))))
    per = rows.groupBy("product").agg(lacking.alias("_l"), F.sort_array(F.collect_list(F.struct("place", F.coalesce("band", F.lit(-1)).alias("band")))).alias("_i"))
    out = everything.join(per, "product", "left")
    missing = F.coalesce(F.transform("_l", lambda s: s["common_name"]), F.array().cast("array<string>"))
    return out.select("product", (F.size(missing) == 0).alias("available"), missing.alias("missing"), F.coalesce(F.transform("_i", lambda s: s["band"]), F.array().cast("array<int>")).alias("indices"))


def describe(df: DataFrame, green: str, nir: str, green_value: str, nir_value: str, nodata: int | None = None, mask: str | None = None) -> DataFrame:
    """t, y, x, stored and physical values, valid, ndwi, is_water of each pixel; a mask decides alone where there is one."""
    g, n = F.col(green), F.col(nir)
    if mask is not None:
        shown = F.col(mask) != 0
        ok = shown
        have = [shown, shown]
    else:
        shown = F.lit(True)
        have = [F.lit(True) if nodata is None else c != nodata for c in (g, n)]
        ok = F.lit(True) if nodata is None else (g != nodata) | (n != nodata)
    index = pixels.ndwi(F.when(have[0], F.col(green_value)), F.when(have[1], F.col(nir_value)))
    return df.select(
        "t", "y", "x", F.when(shown, g).alias("stored_g"), F.when(shown, n).alias("stored_n"), F.when(shown, F.col(green_value)).alias("value_g"), F.when(shown, F.col(nir_value)).alias("value_n"),
        ok.alias("valid"), F.round(index, 12).alias("ndwi"), F.coalesce(index > 0, F.lit(False)).alias("is_water"),
    )


#: A physical value up to which data may be reflectance.
REFLECTANCE_MOST = 10.0
#: How values reach the screen.
TONED = {"mode": "reflectance", "fixed": True, "range": None}
BYTES = {"mode": "linear", "fixed": True, "range": (0, 255)}
CHOSEN = {"mode": "linear", "fixed": False, "range": None}


def display_mode(product: str, scales: Sequence[float], offsets: Sequence[float], dtype: str) -> dict:
    """One product's display: colours of bytes as they are, other products of several bands toned, a single band by its range."""
    most = {"uint8": 255.0, "uint16": 65535.0}.get(dtype, float("inf"))
    if product == "band":
        return TONED if most * scales[0] + offsets[0] <= REFLECTANCE_MOST else CHOSEN
    colours = len(PRODUCTS[product]) == 3
    return BYTES if colours and dtype == "uint8" and {*scales} <= {1} and {*offsets} <= {0} else TONED
