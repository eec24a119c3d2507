"""Operators for taking data in: validity decisions, filters of scenes and quality, manifests, consistency, resuming."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from stratacube.functions import pixels

#: Highest quality class that each setting lets pass.
QUALITY_LIMITS: dict[str, int | None] = {"all": None, "good": 0, "usable": 1}


def clear(scene_class: Column, all_positive: Column) -> Column:
    return scene_class.isin(*pixels.CLEAR_CLASSES) & all_positive


def quality_ok(quality: Column, setting: str) -> Column:
    limit = QUALITY_LIMITS[setting]
    return F.lit(True) if limit is None else quality <= limit


def shared_validity(df: DataFrame, keys: Sequence[str], value: str, sentinels: Sequence[float | int]) -> DataFrame:
    """keys, valid: no band of the pixel is a sentinel or NaN."""
    v = F.col(value)
    ok = ~v.isin(*sentinels) if sentinels else F.lit(True)
    if dict(df.dtypes)[value] in ("float", "double"):
        ok = ok & ~F.isnan(v)
    return df.groupBy(*keys).agg(F.bool_and(ok).alias("valid"))


def declared_validity(df: DataFrame, keys: Sequence[str], alpha: str | None = None, internal: str | None = None, dataset: str | None = None) -> DataFrame:
    """keys, valid: by alpha where there is one, else the internal mask, else the data set's; all bands must agree."""
    planes = [F.when(F.col(c).isNotNull(), F.col(c) != 0) for c in (alpha, internal, dataset) if c]
    return df.groupBy(*keys).agg(F.bool_and(F.coalesce(*planes, F.lit(True))).alias("valid"))


def nan_report(df: DataFrame, by: Sequence[str], value: str, ok: Column) -> DataFrame:
    """by, filled (NaN under the mask, which may be replaced), refused (NaN in valid pixels: an error), stored."""
    bad = F.isnan(value)
    return df.groupBy(*by).agg(F.count_if(bad & ~ok).alias("filled"), F.count_if(bad & ok).alias("refused"), F.count_if(~(bad & ok)).alias("stored"))


def without_nan(df: DataFrame, value: str, ok: Column, fill: float = 0.0) -> DataFrame:
    """NaN outside valid pixels becomes fill; in a valid pixel it stops the query with an error."""
    bad = F.isnan(value)
    return df.withColumn(value, F.when(bad & ok, F.raise_error(F.lit("NaN in a valid pixel: declare a mask or a nodata value")).cast("float")).otherwise(F.when(bad, F.lit(fill).cast("float")).otherwise(F.col(value))))


def declared_nodata(df: DataFrame, by: Sequence[str], nodata: Column) -> DataFrame:
    """by, tokens (the distinct values declared, sorted, as text), agreed (there is just one)."""
    tokens = F.sort_array(F.collect_set(F.coalesce(nodata.cast("string"), F.lit("none"))))
    return df.groupBy(*by).agg(tokens.alias("tokens")).withColumn("agreed", F.size("tokens") == 1)


#: Types of stored data.
STORED_TYPES = {"uint8": np.uint8, "uint16": np.uint16, "int16": np.int16, "float32": np.float32}


def stored_token(value: float | None, dtype: str) -> float | int | str | None:
    """What comes back of a declared nodata value that is put into data of this type; None if it doesn't survive; "nan" for NaN."""
    if value is None:
        return None
    kind = STORED_TYPES[dtype]
    with np.errstate(all="ignore"):
        back = np.float64(value).astype(kind)
    if issubclass(kind, np.floating):
        kept = np.isfinite(back) or not np.isfinite(value)
        return ("nan" if np.isnan(back) else float(back)) if kept else None
    inside = np.isfinite(value) and np.iinfo(kind).min <= value <= np.iinfo(kind).max
    return int(back) if inside and float(back) == float(value) else None


@dataclass(frozen=True)
class Declarations:
    """What sources say about validity, summed up: distinct tokens, masks of their own, whether warping leaves gaps."""

    dtype: str
    tokens: frozenset
    asked: float | str | None
    masks: tuple[str, ...]
    gaps: bool

    @property
    def asked_token(self) -> float | int | str | None:
        return None if isinstance(self.asked, str) else stored_token(self.asked, self.dtype)

    @property
    def automatic(self) -> bool:
        return self.asked == "auto"

    @property
    def value(self) -> float | int | None:
        """The one nodata value that data can be stored with, whatever else there is."""
        token = next(iter(self.tokens)) if self.automatic and len(self.tokens) == 1 else self.asked_token
        return token if isinstance(token, (int, float)) and math.isfinite(token) else None


#: Why a request can't be met.
REFUSED: tuple[tuple[Callable[[Declarations], bool], str], ...] = (
    (lambda d: isinstance(d.asked, str) and not d.automatic, "nodata is a number, None or 'auto', but not {asked!r}"),
    (lambda d: d.asked_token == "nan" and d.dtype != "float32", "NaN as nodata is for float data, and this is {dtype}"),
    (lambda d: isinstance(d.asked, (int, float)) and d.value is None and d.asked_token != "nan", "{dtype} data can't hold nodata {asked!r}"),
)
#: Why validity becomes a mask. Where none of these holds, a nodata value (or nothing) says it all.
MASKED: tuple[tuple[Callable[[Declarations], bool], str], ...] = (
    (lambda d: d.automatic and len(d.tokens) > 1, "sources declare different nodata values"),
    (lambda d: d.automatic and len(d.tokens) == 1 and d.value is None and d.tokens != {None}, "the declared nodata value isn't a finite number"),
    (lambda d: d.asked_token == "nan", "NaN is what marks invalid pixels"),
    (lambda d: d.gaps and d.value is None, "warping leaves pixels that no source covers"),
)


def decide_validity(dtype: str, declared: Sequence[float | int | str | None], override: float | str | None = "auto", masks: Sequence[str] = (), footprint: bool = False) -> dict:
    """{mask, nodata, why}: whether validity is stored as a mask or as a nodata value that all sources share.

    declared: the tokens of all sources and bands (stored_token()), as declared_nodata() collects them. override: "auto",
    None (no value means nodata) or the value to use; NaN asks for a mask. masks: the sources' own masks. footprint:
    warped steps leave pixels without a source.
    """
    d = Declarations(dtype, frozenset(declared), override, tuple(masks), footprint)
    if refused := [why for holds, why in REFUSED if holds(d)]:
        raise ValueError(refused[0].format(asked=override, dtype=dtype))
    reasons = [*d.masks, *(why for holds, why in MASKED if holds(d))]
    if reasons:
        return {"mask": True, "nodata": None if d.automatic else d.value, "why": "; ".join(reasons)}
    return {"mask": False, "nodata": d.value, "why": "every pixel is valid" if d.value is None else f"nodata {d.value}"}


def strided(df: DataFrame, height: int, width: int, wanted: int) -> DataFrame:
    """Every n-th pixel in row-major order, about ``wanted`` per plane: a sampling operator."""
    stride = max(1, height * width // wanted)
    return df.filter((F.col("y") * width + F.col("x")) % stride == 0).select("t", "b", "y", "x", "v")


def nodata_tag(df: DataFrame, nodata: int, ok: Column) -> DataFrame:
    """t, collides, nodata: a step's nodata tag, left out where a valid pixel holds that very value."""
    hit = F.bool_or(ok & (F.col("v") == nodata))
    return df.groupBy("t").agg(hit.alias("collides")).withColumn("nodata", F.when(~F.col("collides"), F.lit(nodata)))


def attach_plane(df: DataFrame, plane: DataFrame, keys: Sequence[str] = ("t", "y", "x")) -> DataFrame:
    return df.join(plane, list(keys), "left")


def attach_bands(df: DataFrame, bands: DataFrame) -> DataFrame:
    """bands (b, name, scale, ...) has as many rows as the cube has bands; Spark sees that and broadcasts it."""
    return df.join(bands, "b")


# --- scenes ---------------------------------------------------------------------------------------------------------


def search(scenes: DataFrame, start: str, end: str, max_cloud: float, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Scenes within whole days start..end and below the cloud limit; with a box (west, south, east, north) those that meet it."""
    out = scenes.filter((F.to_date("ts") >= F.lit(start).cast("date")) & (F.to_date("ts") <= F.lit(end).cast("date")) & (F.col("cloud_cover") < max_cloud))
    if box:
        west, south, east, north = box
        out = out.filter((F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south))
    return out


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def deduplicated(scenes: DataFrame) -> DataFrame:
    """Of scenes with one date and tile, that with the largest item_id."""
    rest = [c for c in scenes.columns if c != "item_id"]
    best = scenes.groupBy(F.to_date("ts").alias("_day"), F.col("tile").alias("_tile")).agg(F.max(F.struct("item_id", *rest)).alias("_s"))
    return best.select(*[F.col(f"_s.{c}").alias(c) for c in scenes.columns])


def common_tiles(scenes: DataFrame, months: int) -> DataFrame:
    """Tiles with a scene in each of so many months."""
    return scenes.groupBy("tile").agg(F.count_distinct(month_key(F.col("ts"))).alias("m")).filter(F.col("m") == months).select("tile")


def best_tile(scenes: DataFrame, months: int) -> DataFrame:
    """tile, cloud: of the common tiles, that with the least sum over the months of the least cloud; the smaller tile on ties."""
    least = scenes.join(common_tiles(scenes, months), "tile").groupBy("tile", month_key(F.col("ts")).alias("month")).agg(F.min("cloud_cover").alias("c"))
    return least.groupBy("tile").agg(F.sum("c").alias("cloud")).agg(F.min(F.struct("cloud", "tile")).alias("m")).select("m.tile", "m.cloud")


def clearest(scenes: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, item_id, cloud_cover: the scene with the least cloud, the earliest on ties, then the smallest id."""
    return scenes.groupBy(*by).agg(F.min(F.struct("cloud_cover", "ts", "item_id")).alias("m")).select(*by, "m.item_id", "m.cloud_cover")


# --- consistency, differences ---------------------------------------------------------------------------------------


def grid_mismatches(grids: DataFrame, first: str, columns: Sequence[str], tolerance: float = 0.0) -> DataFrame:
    """uri, field, found, expected (as text): where a source differs from the first one (the least of column ``first``)."""
    ref = grids.groupBy().agg(F.min(F.struct(first, *columns)).alias("_r"))
    pairs = [F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("found"), F.col(f"_r.{c}").cast("string").alias("expected"), (F.abs(F.col(c) - F.col(f"_r.{c}")) > tolerance if tolerance else ~F.col(c).eqNullSafe(F.col(f"_r.{c}"))).alias("bad")) for c in columns]
    return grids.join(F.broadcast(ref)).select(F.col(first).alias("uri"), F.explode(F.array(*pairs)).alias("p")).filter("p.bad").select("uri", "p.field", "p.found", "p.expected")


def differing(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """key, field, a, b (as text): all differences of two keyed tables, missing rows included."""
    left = a.select(F.col(key), *[F.col(c).cast("string").alias(f"a_{c}") for c in columns], F.lit(True).alias("_a"))
    right = b.select(F.col(key), *[F.col(c).cast("string").alias(f"b_{c}") for c in columns], F.lit(True).alias("_b"))
    both = left.join(right, key, "full")
    whole = F.when(F.col("_a").isNull(), F.lit("only in b")).when(F.col("_b").isNull(), F.lit("only in a"))
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"a_{c}").alias("a"), F.col(f"b_{c}").alias("b")) for c in columns])
    return both.select(key, F.explode(F.when(whole.isNotNull(), F.array(F.struct(whole.alias("field"), F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b")))).otherwise(fields)).alias("f")).filter(F.col("f.field").startswith("only in") | ~F.col("f.a").eqNullSafe(F.col("f.b"))).select(key, "f.field", "f.a", "f.b")


def missing(wanted: DataFrame, staged: DataFrame, keys: Sequence[str]) -> DataFrame:
    return wanted.join(staged.select(*keys), list(keys), "left_anti")


def fingerprint(columns: Sequence[Column]) -> Column:
    """A digest of a plan's settings: staged files of another plan aren't used again."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


# --- windows over the grid ------------------------------------------------------------------------------------------


def best_window(df: DataFrame, height: int, width: int, size: int, stride: int, joint: str = "joint") -> DataFrame:
    """row, col, n: the window with most jointly valid pixels; the larger row, then column, on ties."""
    first = lambda at: F.greatest(F.ceil((F.col(at) - size + 1) / stride), F.lit(0))
    last = lambda at, n: F.least(F.floor(F.col(at) / stride), F.lit((n - size) // stride))
    spans = df.filter(joint).withColumn("_r0", first("y")).withColumn("_r1", last("y", height)).withColumn("_c0", first("x")).withColumn("_c1", last("x", width)).filter("_r0 <= _r1 AND _c0 <= _c1")
    rows = spans.withColumn("_r", F.explode(F.sequence("_r0", "_r1"))).withColumn("_c", F.explode(F.sequence("_c0", "_c1")))
    counts = rows.groupBy("_r", "_c").agg(F.count("*").alias("n"))
    best = counts.agg(F.max(F.struct("n", (F.col("_r") * stride).cast("int").alias("row"), (F.col("_c") * stride).cast("int").alias("col"))).alias("m"))
    return best.select("m.row", "m.col", "m.n")


def common_valid(df: DataFrame, n_times: int, ok: Column, keys: Sequence[str] = ("y", "x")) -> DataFrame:
    """Pixels that are there and valid at every one of n_times steps."""
    return df.groupBy(*keys).agg(F.count_distinct(F.when(ok, F.col("t"))).alias("_n")).filter(F.col("_n") == n_times).select(*keys)


def time_order(df: DataFrame, ts: str = "ts", tie: str = "uri", by: Sequence[str] = ()) -> DataFrame:
    """df with t = 0, 1, ... in time order, in each series for itself. A series has as many rows as its time axis, so one window spans it."""
    return df.withColumn("t", F.row_number().over((W.Window.partitionBy(*by) if by else W.Window).orderBy(ts, tie)) - 1)


def input_checks(df: DataFrame, dtype: str, value: str = "v", by: Sequence[str] = ("t",)) -> DataFrame:
    """by, whole, fits, nulls: whether values are of a type, before anything is written."""
    v = F.col(value)
    if dtype == "float32":
        whole, fits = F.lit(True), F.bool_and(F.abs(v.cast("double")) <= 3.4028234663852886e38)
    else:
        lo, hi = (int(x) for x in (np.iinfo(STORED_TYPES[dtype]).min, np.iinfo(STORED_TYPES[dtype]).max))
        whole, fits = F.bool_and(v == F.floor(v)), (F.min(v) >= lo) & (F.max(v) <= hi)
    return df.groupBy(*by).agg(whole.alias("whole"), fits.alias("fits"), (F.count("*") - F.count(v)).alias("nulls"))
