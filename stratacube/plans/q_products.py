"""Products of bands: indices, colours, availability."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratacube.functions import pixels
from stratacube.operators import products
from stratacube.plans import adapters as A
from stratacube.plans.base import query

W = A.with_adapters
#: Both bands of a pixel: g = green (b 0), n = near infrared (b 1), as stored and as reflectance.
PAIR = ", p AS (SELECT t, y, x, max(CASE WHEN b = 0 THEN v END) AS g, max(CASE WHEN b = 1 THEN v END) AS n FROM cube GROUP BY t, y, x), q AS (SELECT t, y, x, g, n, g / 10000.0::DOUBLE AS gr, n / 10000.0::DOUBLE AS nr FROM p WHERE g IS NOT NULL AND n IS NOT NULL)"


def pairs(spark, d):
    c = A.cube(spark, d)
    p = products.wide(c, {"g": 0, "n": 1}).filter("g IS NOT NULL AND n IS NOT NULL")
    return p.withColumn("gr", pixels.physical_exact(F.col("g"), 0.0001, 0.0)).withColumn("nr", pixels.physical_exact(F.col("n"), 0.0001, 0.0))


def srgb(x: str) -> str:
    return f"(CASE WHEN {x} <= 0.0031308 THEN 12.92 * {x} ELSE 1.055 * pow({x}, 1 / 2.4::DOUBLE) - 0.055 END)"


def tone(x: str) -> str:
    return srgb(f"(({x} * 5.0) / ({x} * 5.0 + 1))")


@query("pixel_series_ndvi", W(PAIR + " SELECT t, y, x, round(CASE WHEN nr + gr > 0 THEN (nr - gr) / (nr + gr) END, 12) AS ndvi, round(CASE WHEN nr + gr > 0 THEN (gr - nr) / (gr + nr) END, 12) AS ndwi FROM q WHERE y = 11 AND x = 7", "cube"))
def pixel_series_ndvi(spark, d):
    """The history of one pixel: the filter on y and x goes below the aggregation."""
    p = pairs(spark, d).filter("y = 11 AND x = 7")
    return p.select("t", "y", "x", F.round(pixels.ndvi(F.col("nr"), F.col("gr")), 12).alias("ndvi"), F.round(pixels.ndwi(F.col("gr"), F.col("nr")), 12).alias("ndwi"))


@query("ndvi_shader", W(PAIR + " SELECT t, y, x, round(CASE WHEN (n - 2000) + (g - 2500) > 0 THEN ((n - 2000) - (g - 2500))::DOUBLE / ((n - 2000) + (g - 2500)) ELSE 0 END, 12) AS ndvi, CASE WHEN (n - 2000) + (g - 2500) > 0 THEN round(((n - 2000) - (g - 2500))::DOUBLE / ((n - 2000) + (g - 2500)), 12) END AS scalar FROM q", "cube"))
def ndvi_shader(spark, d):
    """Where the sum isn't positive a shader gives 0 and the scalar function null."""
    p = pairs(spark, d)
    a, b = F.col("n") - 2000, F.col("g") - 2500
    return p.select("t", "y", "x", F.round(pixels.normalized_difference(a, b, 0.0), 12).alias("ndvi"), F.round(pixels.ndvi(a, b), 12).alias("scalar"))


@query("ndwi_stored", W(PAIR + " SELECT t, y, x, CASE WHEN g + n > 0 THEN round_even((g::DOUBLE - n) / (g::DOUBLE + n) * 10000, 0)::INTEGER END AS ndwi FROM q", "cube"))
def ndwi_stored(spark, d):
    return pairs(spark, d).select("t", "y", "x", pixels.stored_index(F.col("g"), F.col("n")).alias("ndwi"))


@query("dark_water", W(PAIR + " SELECT t, count(*) FILTER (WHERE g % 40 <= 5 AND n % 40 <= 5) AS dark, count(*) AS n FROM q GROUP BY t", "cube"))
def dark_water(spark, d):
    return pairs(spark, d).groupBy("t").agg(F.count_if(pixels.dark(F.col("g") % 40, F.col("n") % 40)).alias("dark"), F.count("*").alias("n"))


@query("tone_map", W(PAIR + f" SELECT t, y, x, round({tone('gr')}, 9) AS g, round({tone('nr')}, 9) AS n FROM q", "cube"))
def tone_map(spark, d):
    return pairs(spark, d).select("t", "y", "x", F.round(pixels.reinhard(F.col("gr")), 9).alias("g"), F.round(pixels.reinhard(F.col("nr")), 9).alias("n"))


@query(
    "true_color",
    W(
        PAIR
        + f""", s AS (SELECT t, y, x, {tone('gr')} AS a, {tone('nr')} AS b, {tone('((gr + nr) / 2)')} AS c FROM q),
u AS (SELECT t, y, x, greatest(least((a - 0.1) / 0.9, 1), 0) AS a, greatest(least((b - 0.1) / 0.9, 1), 0) AS b, greatest(least((c - 0.1) / 0.9, 1), 0) AS c FROM s),
l AS (SELECT *, a * 0.2126 + b * 0.7152 + c * 0.0722 AS lum FROM u)
SELECT t, y, x, round(greatest(least(lum * (1 - 1.4) + a * 1.4, 1), 0), 8) AS r, round(greatest(least(lum * (1 - 1.4) + b * 1.4, 1), 0), 8) AS g, round(greatest(least(lum * (1 - 1.4) + c * 1.4, 1), 0), 8) AS b FROM l""",
        "cube",
    ),
)
def true_color(spark, d):
    p = pairs(spark, d)
    r, g, b = pixels.true_color(F.col("gr"), F.col("nr"), (F.col("gr") + F.col("nr")) / 2, 0.1)
    return p.select("t", "y", "x", F.round(r, 8).alias("r"), F.round(g, 8).alias("g"), F.round(b, 8).alias("b"))


def _ramp_sql(v: str, pieces, channel: int) -> str:
    out = ""
    for i, (lo, hi, a, b) in enumerate(pieces):
        mix = f"({a[channel]}::DOUBLE + greatest(least(({v} - {lo}::DOUBLE) / {hi - lo!r}::DOUBLE, 1.0::DOUBLE), 0.0::DOUBLE) * {b[channel] - a[channel]!r}::DOUBLE)"
        out += f" WHEN {v} < {hi} THEN {mix}" if i < len(pieces) - 1 else f" ELSE {mix} END"
    return f"round((CASE{out})::DOUBLE + 1e-9, 6)"


for _name, _pieces in (("ndvi_ramp", pixels.NDVI_RAMP), ("ndwi_ramp", pixels.NDWI_RAMP)):

    def _ramp(spark, d, pieces=_pieces):
        p = pairs(spark, d).select("t", "y", "x", pixels.normalized_difference(F.col("nr"), F.col("gr"), 0.0).alias("v"))
        r, g, b = pixels.ramp(F.col("v"), pieces)
        return p.select("t", "y", "x", *[F.round(c + 1e-9, 6).alias(n) for c, n in ((r, "r"), (g, "g"), (b, "b"))])

    _sql = PAIR + ", w AS (SELECT t, y, x, CASE WHEN nr + gr > 0 THEN (nr - gr) / (nr + gr) ELSE 0 END AS v FROM q) SELECT t, y, x, " + ", ".join(f"{_ramp_sql('v', _pieces, k)} AS {c}" for k, c in enumerate("rgb")) + " FROM w"
    query(_name, W(_sql, "cube"))(_ramp)


@query("water_shade", W(PAIR + f" SELECT t, y, x, CASE WHEN gr > nr THEN 0.18 ELSE round({tone('gr')} * 0.65 + 0.06, 8) END::DOUBLE AS r, CASE WHEN gr > nr THEN 0.84 ELSE round({tone('gr')} * 0.65 + 0.06, 8) END::DOUBLE AS b FROM q WHERE gr + nr > 0", "cube"))
def water_shade(spark, d):
    p = pairs(spark, d).filter("gr + nr > 0")
    r, _, b = pixels.water_colour(F.col("gr"), F.col("nr"))
    return p.select("t", "y", "x", F.round(r, 8).alias("r"), F.round(b, 8).alias("b"))


@query("linear_stretch", W("SELECT t, b, y, x, round(greatest(least((v - 500.0::DOUBLE) / 3500, 1), 0), 9) AS s FROM cube", "cube"))
def linear_stretch(spark, d):
    return A.cube(spark, d).select("t", "b", "y", "x", F.round(pixels.linear(F.col("v").cast("double"), 500.0, 4000.0), 9).alias("s"))


@query("render_8bit", W("SELECT t, b, y, x, round_even(greatest(least((v::DOUBLE - 500) / 3500, 1), 0) * 255, 0)::INTEGER AS p FROM cube", "cube"))
def render_8bit(spark, d):
    return A.cube(spark, d).select("t", "b", "y", "x", pixels.rendered_8bit(F.col("v"), 500.0, 4000.0).alias("p"))


@query("describe_pixel", W(PAIR + " SELECT t, y, x, g AS stored_g, n AS stored_n, gr AS value_g, nr AS value_n, g <> 0 OR n <> 0 AS valid, round(CASE WHEN gr + nr > 0 THEN (gr - nr) / (gr + nr) END, 12) AS ndwi, coalesce(gr + nr > 0 AND gr > nr, false) AS is_water FROM q", "cube"))
def describe_pixel(spark, d):
    return products.describe(pairs(spark, d), "g", "n", "gr", "nr", nodata=0)


_BANDS = "(VALUES (0, 'B02', NULL), (1, 'green', NULL), (2, 'B04', 'red'), (3, 'B08', NULL), (4, 'B08', 'swir16')) k(band, name, common)"


def _bands(spark):
    return spark.createDataFrame([(0, "B02", None), (1, "green", None), (2, "B04", "red"), (3, "B08", None), (4, "B08", "swir16")], "band int, name string, common string")


@query(
    "band_by_common_name",
    f"""WITH k AS (SELECT * FROM {_BANDS}), w(common_name, alias) AS (VALUES ('blue', 'B02'), ('green', 'B03'), ('red', 'B04'), ('nir', 'B08'), ('swir16', 'B11'), ('swir22', 'B12'))
SELECT w.common_name, arg_min(k.band, {{'p': CASE WHEN k.common = w.common_name THEN 0 WHEN lower(k.name) = w.common_name THEN 1 ELSE 2 END, 'b': k.band}}) AS band
FROM w LEFT JOIN k ON k.common = w.common_name OR k.common IS NULL AND (lower(k.name) = w.common_name OR k.name = w.alias) GROUP BY w.common_name""",
)
def band_by_common_name(spark, d):
    return products.find_bands(_bands(spark), products.common_names(spark))


@query("product_availability", "SELECT * FROM (VALUES ('true_color', true, []::VARCHAR[]), ('false_color', true, []), ('ndvi', true, []), ('ndwi', true, []), ('water', true, []), ('band', true, []), ('moisture', false, ['swir22'])) v(product, available, missing)")
def product_availability(spark, d):
    found = products.find_bands(_bands(spark), products.common_names(spark))
    return products.availability(found, {**products.PRODUCTS, "moisture": ["nir", "swir22"]}).select("product", "available", "missing")


@query("false_color", W(PAIR + f" SELECT t, y, x, round({tone('nr')}, 8) AS r, round({tone('gr')}, 8) AS g, round({tone('gr')}, 8) AS b FROM q", "cube"))
def false_color(spark, d):
    p = pairs(spark, d)
    rgb = pixels.shade("false_color", [F.col("nr"), F.col("gr"), F.col("gr")])
    return p.select("t", "y", "x", *[F.round(c, 8).alias(n) for c, n in zip(rgb, "rgb", strict=True)])


@query("band_linear", W("SELECT t, y, x, round(greatest(least((v::DOUBLE - 500) / 3500, 1), 0), 8) AS r FROM cube WHERE b = 0", "cube"))
def band_linear(spark, d):
    r, g, b = pixels.shade("band", [F.col("v").cast("double")], span=(500.0, 4000.0))
    return A.cube(spark, d).filter("b = 0").select("t", "y", "x", F.round(r, 8).alias("r"))
