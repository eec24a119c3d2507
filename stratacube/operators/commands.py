"""Tables of commands to viewers, as JSON texts: which are valid, what each sets, and what that is for a store.

A command is taken as a whole: one bad field, and nothing of it is used. All is column work on variants, so a log of any
size is checked without Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratacube.operators import temporal

VERSION = 1
NUMBER = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"


def _at(path: str, kind: str) -> Column:
    return F.try_variant_get(F.col("_v"), path, kind)


def _is(path: str, pattern: str) -> Column:
    """Whether a part is there and of a JSON type."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get(F.col("_v"), path, "variant")).rlike(pattern), F.lit(False))


def _pair(x: str, y: str, most_x: float | None = None, most_y: float | None = None) -> Column:
    inside = F.lit(True)
    for name, most in ((x, most_x), (y, most_y)):
        inside = inside & _is(f"$.center.{name}", NUMBER) & (F.abs(_at(f"$.center.{name}", "double")) <= (most if most is not None else float("inf")))
    return inside


def _rules() -> dict[str, Column]:
    """By field, whether its value is valid in itself."""
    moment = F.try_to_timestamp(_at("$.t", "string"))
    increasing = _is("$.range[0]", NUMBER) & _is("$.range[1]", NUMBER) & (F.size(_at("$.range", "array<double>")) == 2) & (_at("$.range[0]", "double") < _at("$.range[1]", "double"))
    return {
        "product": _is("$.product", "^STRING$") & (_at("$.product", "string") != ""),
        "band": _is("$.band", "^STRING$") & (_at("$.band", "string") != ""),
        "range": _is("$.range", "^VOID$") | increasing,
        "zoom": _is("$.zoom", NUMBER) & (_at("$.zoom", "double") > 0),
        "playing": _is("$.playing", "^BOOLEAN$"),
        "speed": _is("$.speed", NUMBER) & (_at("$.speed", "double") > 0),
        "t": _is("$.t", "^(TINYINT|SMALLINT|INT|BIGINT)$") & (_at("$.t", "long") >= 0) | _is("$.t", "^STRING$") & moment.isNotNull(),
        "center": _pair("x", "y") | _pair("lon", "lat", 180.0, 90.0),
    }


def parsed(messages: DataFrame, text: str = "message", prefix: str = "cube:") -> DataFrame:
    """messages with kind (ignore, get, set or error), wrong (fields that aren't valid) and, of sets, the fields that were given.

    A text that is no JSON object, or of another type of message, is ignored; so are unknown fields. A null text is ignored.
    """
    rows = messages.withColumn("_v", F.try_parse_json(text))
    kind = _at("$.type", "string")
    version = F.coalesce(_at("$.v", "string"), F.lit(str(VERSION))) == str(VERSION)
    given = F.coalesce(F.json_object_keys(F.to_json("_v")), F.array().cast("array<string>"))
    rules = _rules()
    wrong = F.filter(F.array(*[F.when(F.array_contains("_keys", name) & ~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    rows = rows.withColumn("_keys", given).withColumn("_type", kind)
    known = F.when(~F.coalesce(F.col("_type").startswith(prefix), F.lit(False)), "ignore").when(~version, "error").when(F.col("_type") == f"{prefix}get", "get").when(F.col("_type") == f"{prefix}set", "set").otherwise("error")
    rows = rows.withColumn("_kind", known).withColumn("wrong", F.when(F.col("_kind") == "set", wrong).otherwise(F.array().cast("array<string>")))
    whole = F.col("_kind") == "set"
    columns = {
        "step": _at("$.t", "long"), "at": F.when(_is("$.t", "^STRING$"), F.try_to_timestamp(_at("$.t", "string"))), "product": _at("$.product", "string"), "band": _at("$.band", "string"),
        "range": _at("$.range", "array<double>"), "zoom": _at("$.zoom", "double"), "playing": _at("$.playing", "boolean"), "speed": _at("$.speed", "double"),
        "x": _at("$.center.x", "double"), "y": _at("$.center.y", "double"), "lon": _at("$.center.lon", "double"), "lat": _at("$.center.lat", "double"),
    }
    rows = rows.withColumn("kind", F.when(whole & (F.size("wrong") > 0), "error").otherwise(F.col("_kind")))
    good = F.col("kind") == "set"
    return rows.select(*[f"`{c}`" for c in messages.columns], "kind", "wrong", *[F.when(good, c).alias(name) for name, c in columns.items()])


def resolved(commands: DataFrame, times: DataFrame, products: Sequence[str], bands: Sequence[str]) -> DataFrame:
    """The sets among parsed() commands with step (of the time axis times: t, ts; the nearest one to ``at``) and absent: what the store lacks."""
    sets = commands.filter("kind = 'set'")
    n = times.agg(F.max("t")).first()[0]
    dated = temporal.nearest(sets.filter("at IS NOT NULL").select("at").distinct(), times).select("at", F.col("t").alias("_near"))
    rows = sets.join(dated, "at", "left").withColumn("step", F.coalesce("step", F.col("_near").cast("long"))).drop("_near")
    lacks = {"t": F.col("step") > (-1 if n is None else n), "product": ~F.col("product").isin(*products), "band": ~F.col("band").isin(*bands)}
    absent = F.filter(F.array(*[F.when(lack, F.lit(name)) for name, lack in lacks.items()]), lambda x: x.isNotNull())
    return rows.withColumn("absent", absent)
