"""Operators along time: star deltas, volatility, carry-forward, as-of choice, gaps, orders of fetching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from stratacube.functions import pixels

#: Mean absolute change that counts as full volatility.
FULL_CHANGE = 10_000


def anchor_schedule(n_time: int, interval: int) -> tuple[list[int], dict[int, int]]:
    """Anchors (every interval-th step) and the nearest anchor of each other step, the earlier one on ties."""
    anchors = list(range(0, n_time, interval))
    return anchors, {t: min(anchors, key=lambda a: (abs(a - t), a)) for t in range(n_time) if t % interval}


def anchor_of(t: Column, n_time: int, interval: int) -> Column:
    """The step that t refers to (itself if it is an anchor), in closed form."""
    past = t % interval
    later = t - past + interval
    return F.when((past * 2 > interval) & (later < n_time), later).otherwise(t - past).cast("int")


def with_reference(df: DataFrame, refs: DataFrame, t: str = "t", out: str = "anchor_t") -> DataFrame:
    """Adds each row's recorded reference (refs: t, anchor_t; anchors aren't in it). refs is as long as the time axis."""
    side = refs.select(F.col("t").alias("_rt"), F.col("anchor_t").alias("_ra"))
    return df.join(side, F.col(t) == F.col("_rt"), "left").withColumn(out, F.coalesce("_ra", t)).drop("_rt", "_ra")


def _anchor_value(df: DataFrame, keys: Sequence[str], value: str, anchor: Column, t: str) -> DataFrame:
    """Adds _anchor: the value at the anchor among the rows of the same keys and anchor. One shuffle, groups of an interval."""
    star = W.Window.partitionBy(*keys, "_star")
    return df.withColumn("_star", anchor).withColumn("_anchor", F.max(F.when(F.col(t) == F.col("_star"), F.col(value))).over(star))


def star_delta_encode(df: DataFrame, anchor: Column, keys: Sequence[str] = ("b", "y", "x"), value: str = "v", t: str = "t", bits: int = 16, out: str = "r") -> DataFrame:
    """Adds out: the value of anchors, and of other steps the difference to their anchor modulo 2^bits.

    Where a sparse cube lacks the anchor's pixel, the anchor counts as 0, as a dense store's fill value would.
    """
    rows = _anchor_value(df, keys, value, anchor, t)
    base = F.when(F.col(t) == F.col("_star"), F.lit(0)).otherwise(F.coalesce("_anchor", F.lit(0)))
    return rows.withColumn(out, pixels.residual(F.col(value), base, bits)).drop("_star", "_anchor")


def star_delta_decode(df: DataFrame, anchor: Column, keys: Sequence[str] = ("b", "y", "x"), residual: str = "r", t: str = "t", bits: int = 16, out: str = "v") -> DataFrame:
    """The inverse of star_delta_encode()."""
    rows = _anchor_value(df, keys, residual, anchor, t)
    base = F.when(F.col(t) == F.col("_star"), F.lit(0)).otherwise(F.coalesce("_anchor", F.lit(0)))
    return rows.withColumn(out, pixels.restored(F.col(residual), base, bits)).drop("_star", "_anchor")


def abs_deltas(df: DataFrame, anchor: Column, keys: Sequence[str] = ("b", "y", "x"), value: str = "v", t: str = "t") -> DataFrame:
    """Rows of steps other than anchors with _change: the true (not modular) distance to the anchor's value."""
    rows = _anchor_value(df, keys, value, anchor, t).filter(F.col(t) != F.col("_star"))
    return rows.withColumn("_change", F.abs(F.col(value) - F.coalesce("_anchor", F.lit(0)))).drop("_star", "_anchor")


def volatility_state(changes: DataFrame, cell: int) -> DataFrame:
    """row, col, total, n: what the volatility of a cell is made of; states of several batches add up."""
    keys = [F.floor(F.col("y") / cell).cast("int").alias("row"), F.floor(F.col("x") / cell).cast("int").alias("col")]
    return changes.groupBy(*keys).agg(F.sum(F.col("_change").cast("double")).alias("total"), F.count("*").alias("n"))


def merged_state(*states: DataFrame) -> DataFrame:
    both = states[0]
    for s in states[1:]:
        both = both.unionByName(s)
    return both.groupBy("row", "col").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def volatility(state: DataFrame) -> DataFrame:
    """row, col, volatility (float): the mean change over FULL_CHANGE, within 0 to 1; 0 without changes."""
    mean = F.when(F.col("n") > 0, F.col("total") / F.col("n") / FULL_CHANGE).otherwise(F.lit(0.0))
    return state.select("row", "col", pixels.clamp(mean).cast("float").alias("volatility"))


def carry_forward(df: DataFrame, keys: Sequence[str], gap: Column, values: Sequence[str], t: str = "t", fill: int = 0) -> DataFrame:
    """Values of gaps become the last ones seen before (fill if none); adds filled: whether the row was a gap."""
    w = W.Window.partitionBy(*keys).orderBy(t).rowsBetween(W.Window.unboundedPreceding, 0)
    rows = df.withColumn("filled", gap)
    last = {v: F.coalesce(F.last(F.when(~F.col("filled"), F.col(v)), ignorenulls=True).over(w), F.lit(fill)).alias(v) for v in values}
    return rows.select(*[last.get(c, F.col(c)) for c in rows.columns])


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def nearest(asked: DataFrame, times: DataFrame, at: str = "at", ts: str = "ts", t: str = "t") -> DataFrame:
    """asked with t of the nearest time, the earlier one on ties: two as-of passes over one sorted stream per bucket.

    Times and questions are sorted together; the last time before and the first after each question are its candidates.
    """
    marks = times.select(F.col(ts).alias("_at"), F.col(t).alias("_t"), F.lit(0).alias("_q"), F.lit(None).cast(asked.schema[at].dataType).alias("_id"))
    quests = asked.select(F.col(at).alias("_at"), F.lit(None).cast(times.schema[t].dataType).alias("_t"), F.lit(1).alias("_q"), F.col(at).alias("_id")).distinct()
    both = marks.unionByName(quests)
    # Ends of hourly buckets carry over, so no window spans the whole axis but that over buckets.
    both = both.withColumn("_bucket", F.floor(_micros(F.col("_at")) / 3_600_000_000))
    hit = F.when(F.col("_q") == 0, F.struct(F.col("_at"), F.col("_t")))
    edges = both.groupBy("_bucket").agg(F.max(hit).alias("_last"), F.min(hit).alias("_first"))
    # Frames end at the current row, in either direction, so each grows row by row.
    past = lambda w, to: w.rowsBetween(W.Window.unboundedPreceding, to)
    edges = edges.select("_bucket", F.last("_last", True).over(past(W.Window.orderBy("_bucket"), -1)).alias("_before"), F.last("_first", True).over(past(W.Window.orderBy(F.desc("_bucket")), -1)).alias("_after"))
    here = W.Window.partitionBy("_bucket")
    rows = both.withColumn("_lo", F.last(hit, True).over(past(here.orderBy("_at", "_q", "_t"), 0))).withColumn("_hi", F.last(hit, True).over(past(here.orderBy(F.desc("_at"), F.desc("_q"), F.desc("_t")), 0)))
    rows = rows.filter("_q = 1").join(edges, "_bucket", "left").select(F.col("_id").alias(at), F.coalesce("_lo", "_before").alias("_lo"), F.coalesce("_hi", "_after").alias("_hi"))
    far = lambda c: F.abs(_micros(c["_at"]) - _micros(F.col(at)))
    lo, hi = F.col("_lo"), F.col("_hi")
    best = F.when(lo.isNull() | (far(hi) < far(lo)), hi["_t"]).otherwise(lo["_t"])
    return asked.join(rows.select(at, best.alias(t)), at)


def segments(df: DataFrame, keys: Sequence[str], value: str, t: str = "t") -> DataFrame:
    """Rows with a value, and segment: 0, 1, ... as gaps (null values) cut the series."""
    w = W.Window.partitionBy(*keys).orderBy(t)
    cut = F.col(value).isNotNull() & (F.lag(value).over(w).isNull())
    return df.withColumn("_cut", cut.cast("int")).withColumn("segment", (F.sum("_cut").over(w) - 1).cast("int")).filter(F.col(value).isNotNull()).drop("_cut")


def scrub_cost(step: Column, at: int, direction: int = 1, behind: float = 2.0, period: int | None = None) -> Column:
    """How dear a step is when the viewer stands at one and moves on: steps behind count ``behind`` times; time may be a circle."""
    d = step - at
    if period is None:
        return F.when(d * direction >= 0, F.abs(d)).otherwise(F.abs(d) * behind).cast("double")
    ahead = F.pmod(d * direction, F.lit(period))
    return F.least(ahead.cast("double"), (F.lit(period) - ahead) * behind)


def scrub_order(steps: DataFrame, at: int, direction: int = 1, behind: float = 2.0, loop: int | None = None, t: str = "t") -> DataFrame:
    """steps with rank 0, 1, ... from the cheapest; steps of equal cost by distance, then by time. As many rows as steps."""
    cost = scrub_cost(F.col(t), at, direction, behind, loop)
    return steps.withColumn("cost", cost).withColumn("rank", F.row_number().over(W.Window.orderBy("cost", F.abs(F.col(t) - at), t)) - 1)


def prefetch_plan(steps: DataFrame, cells: DataFrame, at: int, n_time: int, interval: int, direction: int = 1, behind: float = 2.0, horizon: int | None = None, per_cell: int | None = None) -> DataFrame:
    """row, col, t, place: chunks in the order of fetching: by scrub order, anchors before what needs them, all cells of a step together."""
    ranked = scrub_order(steps, at, direction, behind)
    if horizon is not None:
        ranked = ranked.filter(F.abs(F.col("t") - at) <= horizon)
    wanted = ranked.select("rank", F.posexplode(F.array(anchor_of(F.col("t"), n_time, interval), F.col("t"))).alias("second", "t"))
    first = wanted.groupBy("t").agg(F.min(F.struct("rank", "second")).alias("at"))
    order = first.select("t", (F.row_number().over(W.Window.orderBy("at")) - 1).alias("place"))
    if per_cell is not None:
        order = order.filter(F.col("place") < per_cell)
    return order.crossJoin(cells)


def references(spark: SparkSession, n_time: int, interval: int) -> DataFrame:
    """t, anchor_t of the steps that aren't anchors."""
    t = spark.range(n_time).select(F.col("id").cast("int").alias("t"))
    return t.select("t", anchor_of(F.col("t"), n_time, interval).alias("anchor_t")).filter("t <> anchor_t")


def reference_violations(refs: DataFrame, n_time: int, interval: int) -> DataFrame:
    """t, problem: what is wrong in a table of recorded references (t, anchor_t)."""
    spark = refs.sparkSession
    axis = spark.range(n_time).select(F.col("id").cast("int").alias("t"))
    others = axis.filter(F.col("t") % interval != 0)
    missing = others.join(refs.select("t"), "t", "left_anti").select("t", F.lit("missing").alias("problem"))
    strange = refs.select("t").join(others, "t", "left_anti").select("t", F.lit("unexpected").alias("problem"))
    known = refs.join(others, "t", "left_semi")
    no_anchor = (F.col("anchor_t") % interval != 0) | (F.col("anchor_t") < 0) | (F.col("anchor_t") >= n_time)
    wrong = known.filter(no_anchor).select("t", F.lit("not an anchor").alias("problem"))
    far = known.filter(~no_anchor & (F.abs(F.col("anchor_t") - F.col("t")) >= interval)).select("t", F.lit("too far").alias("problem"))
    return missing.unionByName(strange).unionByName(wrong).unionByName(far)


def monotone_violations(times: DataFrame, t: str = "t", ts: str = "ts", series: Sequence[str] = ()) -> DataFrame:
    """Rows whose time isn't after that of the row before."""
    w = (W.Window.partitionBy(*series) if series else W.Window).orderBy(t)
    return times.withColumn("_before", F.lag(ts).over(w)).filter(F.col(ts) <= F.col("_before")).drop("_before")


def duplicates(times: DataFrame, ts: str = "ts") -> DataFrame:
    """ts, n of times that occur more than once."""
    return times.groupBy(ts).agg(F.count("*").alias("n")).filter("n > 1")


def regular_spacing(coords: DataFrame, axis: str, at: str, value: str, rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """axis, regular: whether all steps are close to the first one."""
    w = W.Window.partitionBy(axis).orderBy(at)
    steps = coords.withColumn("_d", F.lead(value).over(w) - F.col(value)).filter("_d is not null")
    spread = steps.groupBy(axis).agg(F.min_by("_d", at).alias("d"), F.min("_d").alias("lo"), F.max("_d").alias("hi"))
    bound = F.lit(atol) + F.abs("d") * rtol
    return spread.select(axis, ((F.abs(F.col("lo") - F.col("d")) <= bound) & (F.abs(F.col("hi") - F.col("d")) <= bound)).alias("regular"))


def adjacent_change(df: DataFrame, keys: Sequence[str], value: str = "v", t: str = "t") -> DataFrame:
    """Rows with change: the absolute difference to the series' row before; the first row of a series has none."""
    w = W.Window.partitionBy(*keys).orderBy(t)
    return df.withColumn("change", F.abs(F.col(value) - F.lag(value).over(w))).filter("change is not null")
