"""Plans a driver makes before it reads: cells, samples, stages, levels, delivery."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from stratacube.functions.geometry import cells

#: The share of plain bytes that star deltas may take to be worth it.
DELTA_LIMIT = 0.85
#: Cells that are sampled at least, and the share of all.
SAMPLE_LEAST, SAMPLE_SHARE = 3, 0.1


def cell(df: DataFrame, row: int, col: int, size: int, height: int, width: int) -> DataFrame:
    """The pixels of one cell; ranges on y and x, so a source can prune by them."""
    rows, cols = cells(height, width, size)
    if not (0 <= row < rows and 0 <= col < cols):
        raise IndexError(f"cell ({row}, {col}) is not in the grid of {rows} x {cols}")
    y0, x0 = row * size, col * size
    return df.filter((F.col("y") >= y0) & (F.col("y") < min(y0 + size, height)) & (F.col("x") >= x0) & (F.col("x") < min(x0 + size, width)))


def all_cells(df: DataFrame, size: int, height: int, width: int) -> DataFrame:
    """row, col and the pixels of each cell of the grid: cell() of all cells, in one pass."""
    rows, cols = cells(height, width, size)
    cell_of = lambda c: F.floor(F.col(c) / size).cast("int")
    inside = F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)
    return df.filter(inside).withColumns({"row": cell_of("y"), "col": cell_of("x")}).filter(F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1))


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """only_a, only_b: how many rows each has that the other lacks, repeated ones counted, in one aggregation."""
    both = a.withColumn("_side", F.lit(1)).unionByName(b.withColumn("_side", F.lit(-1)))
    more = both.groupBy(*a.columns).agg(F.sum("_side").alias("_more"))
    return more.agg(F.coalesce(F.sum(F.greatest("_more", F.lit(0))), F.lit(0)).alias("only_a"), F.coalesce(F.sum(F.greatest(-F.col("_more"), F.lit(0))), F.lit(0)).alias("only_b"))


def outer(df: DataFrame, **axes: int | slice | Sequence[int]) -> DataFrame:
    """Outer indexing: a number, a slice (with start and stop) or a list for each axis."""
    for name, at in axes.items():
        c = F.col(name)
        if isinstance(at, slice):
            lo, hi, step = at.start or 0, at.stop, at.step or 1
            cond = c >= lo
            if hi is not None:
                cond = cond & (c < hi)
            if step != 1:
                cond = cond & ((c - lo) % step == 0)
        elif isinstance(at, int):
            cond = c == at
        else:
            cond = c.isin(list(at))
        df = df.filter(cond)
    return df


def sample_cells(rows: int, cols: int) -> list[tuple[int, int]]:
    """Evenly spread cells: a tenth, three at least; places rounded half to even."""
    n = rows * cols
    wanted = min(n, max(SAMPLE_LEAST, math.ceil(SAMPLE_SHARE * n)))
    places = sorted({round(i * (n - 1) / (wanted - 1)) for i in range(wanted)}) if wanted > 1 else [0]
    return [divmod(p, cols) for p in places]


def sample_steps(n: int) -> list[int]:
    return sorted({0, n // 2, n - 1})


def keep_deltas(delta_bytes: int, plain_bytes: int) -> tuple[bool, float]:
    """Whether star deltas are worth it, by the ratio rounded to four digits."""
    ratio = round(delta_bytes / plain_bytes, 4) if plain_bytes else 1.0
    return ratio <= DELTA_LIMIT, ratio


@dataclass(frozen=True)
class Loading:
    """What loading levels one after the other is weighed by: bytes a second, the share of raw bytes that travels, raw bytes
    of a first frame, bytes of all coarse frames over those of the target, and the wait that needs no coarse frame at all."""

    bandwidth: float = 2e6
    wire: float = 0.6
    first_frame: float = 3e6
    overhead: float = 0.35
    short_wait_ms: float = 150.0


def coarse_stages(target: int, coarsest: int, frame_bytes: Callable[[int], float], by: Loading = Loading()) -> list[int]:
    """Levels to show before the target, coarsest first.

    The first is the finest that is small enough (the coarsest, if none is); finer ones follow as long as all together
    stay within the overhead. A target that arrives soon by itself has none before it.
    """
    size = {k: frame_bytes(k) for k in range(target, max(target, coarsest) + 1)}
    if size[target] * by.wire / by.bandwidth * 1000 < by.short_wait_ms:
        return []
    coarser = [k for k in size if k > target]
    start = next((k for k in coarser if size[k] <= by.first_frame), coarsest)
    shown = sorted((k for k in coarser if k <= start), reverse=True)
    within = np.cumsum([size[k] for k in shown]) <= by.overhead * size[target]
    return shown[: int(within.sum())]


def movie_level(levels: Sequence[int], bytes_of: Callable[[int], float], memory: float, link: float, rate: float, wire: float = 0.6, headroom: float = 1.0, cold: float = 1.0) -> dict:
    """{level, memory, link, why}: the finest level whose frames fit the memory and arrive at the rate (frames a second).

    headroom is the share of the link that frames may take, cold the share of frames that have to come over it. memory
    and link say whether each rule holds for the level that was chosen; if none satisfies both it is the coarsest.
    """
    rules = [(k, bytes_of(k) <= memory, bytes_of(k) * wire * rate * cold <= link * headroom) for k in sorted(levels)]
    level, fits, arrives = next((r for r in rules if r[1] and r[2]), rules[-1])
    finer = [r for r in rules if r[0] < level]
    why = "the finest" if not finer else "memory" if not all(r[1] for r in finer) else "link"
    return {"level": level, "memory": fits, "link": arrives, "why": why}


def loop_fits(frames: int, frame_bytes: float, cache: float, kept: float = 0.0) -> bool:
    """Whether all frames of a loop can stay in a cache beside what it keeps anyway, so that nothing is fetched twice."""
    return frames * frame_bytes <= cache - kept


def centre_first(cells: Sequence[tuple[int, int]], centre: tuple[float, float]) -> list[tuple[int, int]]:
    """Cells by the distance of their middles to a point (row, col), then in row order."""
    return sorted(cells, key=lambda c: ((c[0] + 0.5 - centre[0]) ** 2 + (c[1] + 0.5 - centre[1]) ** 2, c))


def spread_times(n: int, wanted: int) -> list[int]:
    """Evenly spread steps, both ends included."""
    if wanted >= n:
        return list(range(n))
    return sorted({round(i * (n - 1) / max(1, wanted - 1)) for i in range(wanted)})


def nearest_speed(asked: float, speeds: Sequence[float]) -> float:
    """The nearest of the speeds, the slower one on ties."""
    return min(speeds, key=lambda s: (abs(s - asked), s))


def stage_lead(round_trip_ms: float, least: float = 60.0, most: float = 400.0, trips: float = 2.0) -> float:
    return min(most, max(least, trips * round_trip_ms))


def decayed_rate(samples: Sequence[tuple[float, float, float]], tau: float = 4.0) -> float | None:
    """Bytes per busy second over (end, seconds, bytes) samples, older ones fading with time constant tau."""
    if not samples:
        return None
    now = max(s[0] for s in samples)
    weights = [math.exp(-(now - end) / tau) for end, _, _ in samples]
    busy = sum(w * s for w, (_, s, _) in zip(weights, samples, strict=True))
    return sum(w * b for w, (_, _, b) in zip(weights, samples, strict=True)) / busy if busy > 0 else None


def decayed_rates(samples: DataFrame, by: Sequence[str], end: str, seconds: str, size: str, tau: float = 4.0) -> DataFrame:
    """by, rate: decayed_rate() of each group of samples, in two aggregations; null where nothing was busy."""
    newest = samples.groupBy(*by).agg(F.max(end).alias("_now"))
    weight = F.exp((F.col(end) - F.col("_now")) / tau)
    sums = samples.join(newest, list(by)).groupBy(*by).agg(F.sum(weight * F.col(size)).alias("_b"), F.sum(weight * F.col(seconds)).alias("_s"))
    return sums.select(*by, F.when(F.col("_s") > 0, F.col("_b") / F.col("_s")).alias("rate"))


def centre_order(cells: DataFrame, by: Sequence[str], row: float, col: float) -> DataFrame:
    """cells (row, col) with place: centre_first() in each group."""
    far = F.pow(F.col("row") + 0.5 - row, F.lit(2)) + F.pow(F.col("col") + 0.5 - col, F.lit(2))
    return cells.withColumn("place", F.row_number().over(W.Window.partitionBy(*by).orderBy(far, "row", "col")) - 1)


def spread_steps(axes: DataFrame, n: str, wanted: int) -> DataFrame:
    """axes with step: a row for each of spread_times() of an axis of n steps."""
    places = F.transform(F.sequence(F.lit(0), F.lit(wanted - 1)), lambda i: F.bround(i * (F.col(n) - 1) / max(1, wanted - 1), 0).cast("int"))
    steps = F.when(F.col(n) <= wanted, F.sequence(F.lit(0), F.col(n).cast("int") - 1)).otherwise(F.array_distinct(places))
    return axes.withColumn("step", F.explode(steps))


def nearest_speeds(asked: Column, speeds: Sequence[float]) -> Column:
    """nearest_speed() as a column."""
    near = F.array_min(F.array(*[F.struct(F.abs(asked - s).alias("far"), F.lit(float(s)).alias("speed")) for s in speeds]))
    return near["speed"]


def stage_leads(round_trip_ms: Column, least: float = 60.0, most: float = 400.0, trips: float = 2.0) -> Column:
    """stage_lead() as a column."""
    return F.least(F.lit(most), F.greatest(F.lit(least), round_trip_ms * trips))


def delivery_phases(phases: Sequence[Mapping[str, tuple[float, Sequence[str]]]], rtt_ms: float, mbps: float, parallel: int, in_turn: bool) -> dict:
    """{total, phases}: delivery() of several phases, in ms; in turn, a phase waits for all of the one before it.

    A phase's time is from when it could start to its last request; ids are those of a phase each, so phases may use the same.
    """
    named = [{(i, name): size_and_needs for name, size_and_needs in phase.items()} for i, phase in enumerate(phases)]
    requests = {}
    for i, phase in enumerate(named):
        before = [*named[i - 1]] if in_turn and i else []
        requests |= {one: (size, [*((i, n) for n in needs), *before]) for one, (size, needs) in phase.items()}
    done = delivery(requests, rtt_ms, mbps, parallel)
    ends = [max((done[one] for one in phase), default=0.0) for phase in named]
    starts = [0.0, *ends][: len(ends)] if in_turn else [0.0] * len(ends)
    return {"total": max(done.values(), default=0.0), "phases": [end - start for start, end in zip(starts, ends, strict=True)]}


def delivery(requests: Mapping[str, tuple[float, Sequence[str]]], rtt_ms: float, mbps: float, parallel: int) -> dict[str, float]:
    """When each request ({id: (bytes, ids it waits for)}) is done, in ms, over one shared link.

    At most ``parallel`` requests are open; an open one waits a round trip and then shares the link evenly with the
    others that move bytes. Requests start in their order as soon as what they wait for is done and a place is free.
    """
    speed = mbps * 1e6 / 8 / 1000
    waiting = list(requests)
    done: dict[str, float] = {}
    latent: list[tuple[float, int, str]] = []
    moving: dict[str, float] = {}
    now = 0.0
    while waiting or latent or moving:
        for name in list(waiting):
            if len(latent) + len(moving) >= parallel:
                break
            if all(w in done for w in requests[name][1]):
                waiting.remove(name)
                heapq.heappush(latent, (now + rtt_ms, len(done) + len(latent), name))
        if not latent and not moving:
            raise ValueError(f"requests {waiting} wait for each other or for none that there is")
        first = latent[0][0] if latent else math.inf
        share = speed / len(moving) if moving else 0.0
        finish = now + min(moving.values()) / share if moving else math.inf
        after = min(first, finish)
        for name in moving:
            moving[name] -= (after - now) * share
        now = after
        for name in [k for k, rest in moving.items() if rest <= 1e-9]:
            del moving[name]
            done[name] = now
        while latent and latent[0][0] <= now:
            _, _, name = heapq.heappop(latent)
            if requests[name][0] > 0:
                moving[name] = requests[name][0]
            else:
                done[name] = now
    return done
