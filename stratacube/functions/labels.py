"""Times, names and keys as text: parsing, rendering, selecting."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce
from operator import and_, or_
from typing import Any
from urllib.parse import parse_qs, quote, urlsplit

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_PREFIX = re.compile(r"\d{4}-\d{2}(-\d{2}([T ][\d:.]*Z?)?)?")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def parse_time(text: str) -> datetime:
    """An ISO date or time; an offset is taken into account, none means UTC."""
    try:
        at = datetime.fromisoformat(text.strip())
    except ValueError:
        raise ValueError(f"{text!r} is no ISO date or time, like 2024-03-01 or 2024-03-01T10:30:00Z") from None
    return at.replace(tzinfo=UTC) if at.tzinfo is None else at.astimezone(UTC)


def iso(ts: Column, millis: Column) -> Column:
    """ISO text with Z; with milliseconds if millis (for all times of an axis alike)."""
    return F.concat(F.when(millis, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")), F.lit("Z"))


def name_date(name: Column) -> Column:
    """The first of YYYY-MM, YYYY-MM-DD, YYYYMM or YYYYMMDD in a file's name, as a date; null if there is none."""
    stem = F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1), r"\.[^.]*$", "")
    found = lambda k: F.regexp_extract(stem, r"(?<!\d)(\d{4})-?(\d{2})(?:-?(\d{2}))?(?!\d)", k)
    day = F.when(found(3) == "", F.lit("01")).otherwise(found(3))
    return F.when(found(1) != "", F.to_date(F.concat_ws("-", found(1), found(2), day)))


def file_stem(text: Column) -> Column:
    """The date of an ISO time; with the time of day, without colons, unless that is midnight."""
    date, clock = F.split_part(text, F.lit("T"), F.lit(1)), F.regexp_replace(F.split_part(text, F.lit("T"), F.lit(2)), "Z$", "")
    midnight = F.regexp_replace(clock, "[:0.]", "") == ""
    return F.when(midnight, date).otherwise(F.concat(date, F.lit("T"), F.replace(clock, F.lit(":"), F.lit("")), F.lit("Z")))


def time_label(text: Column, monthly: Column) -> Column:
    """"Mar 2024" if all times are firsts of months, else the date."""
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.substring(text, 6, 2).cast("int"))
    return F.when(monthly, F.concat(month, F.lit(" "), F.substring(text, 1, 4))).otherwise(F.substring(text, 1, 10))


def slug(text: Column, empty: str = "store") -> Column:
    out = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9_.-]+", "-"), "^-+|-+$", "")
    return F.when(out == "", F.lit(empty)).otherwise(out)


def default_id(source: str) -> str:
    """The last two parts of a path or URL as one name."""
    parts = [p for p in urlsplit(source).path.split("/") if p]
    return re.sub(r"[^A-Za-z0-9_.-]+", "-", "-".join(parts[-2:])).strip("-") or "store"


def chunk_key(level: Column, variable: str, t: Column, row: Column, col: Column) -> Column:
    parts = ("c", t, F.lit(0), row, col) if variable == "data" else ("c", t, row, col)
    return F.concat_ws("/", level.cast("string"), F.lit(variable), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def split_names(text: Column) -> Column:
    """Names separated by ; without spaces around them; null if there are none."""
    names = F.filter(F.transform(F.split(text, ";"), lambda n: F.trim(n)), lambda n: n != "")
    return F.when(F.size(names) > 0, names)


def epsg(text: Column) -> Column:
    """The number of EPSG:<number>; null for anything else."""
    return F.nullif(F.regexp_extract(text, r"^EPSG:(\d+)$", 1), F.lit("")).cast("int")


@dataclass(frozen=True)
class Term:
    """One selector of steps as two closed ranges, of step numbers (with a stride) and of the beginnings of ISO texts.

    Either range may be open. Both a Spark condition and a test on the driver are made from it.
    """

    first: int | None = None
    last: int | None = None
    stride: int = 1
    since: str | None = None
    until: str | None = None

    def condition(self, step: Column, text: Column) -> Column:
        parts = [F.lit(True)]
        if self.first is not None:
            parts += [step.between(self.first, self.last), (step - self.first) % self.stride == 0]
        for mark, after in ((self.since, True), (self.until, False)):
            if mark is not None:
                start = F.substring(text, 1, len(mark))
                parts.append(start >= mark if after else start <= mark)
        return reduce(and_, parts)

    def holds(self, step: int, text: str) -> bool:
        near = self.first is None or step in range(self.first, self.last + 1, self.stride)
        return near and (self.since is None or text[: len(self.since)] >= self.since) and (self.until is None or text[: len(self.until)] <= self.until)


_WHOLE = r"-?\d+"
#: How a selector is written, by what it is. The first that fits is meant.
_SELECTORS = {
    "all": re.compile("all"),
    "between": re.compile(r"(?P<since>[^.]+)\.\.(?P<until>.+)"),
    "prefix": _PREFIX,
    "slice": re.compile(rf"(?P<start>{_WHOLE})?:(?P<stop>{_WHOLE})?(:(?P<stride>{_WHOLE})?)?"),
    "step": re.compile(_WHOLE),
}


def _beginning(text: str) -> str:
    if not _PREFIX.fullmatch(text):
        raise ValueError(f"{text!r} is not the beginning of an ISO time: at least a year and a month, as in 2024-03")
    return text.replace(" ", "T")


def term(token: str, n_time: int) -> Term | None:
    """A selector's term; None if it selects nothing whatever the times are."""
    for kind, form in _SELECTORS.items():
        if m := form.fullmatch(token):
            break
    else:
        raise ValueError(f"{token!r} selects no times; selectors are all, a step, start:stop:stride, the beginning of an ISO time, or two of these with .. between")
    if kind == "all":
        return Term()
    if kind in ("between", "prefix"):
        ends = m.groupdict() if kind == "between" else {"since": token, "until": token}
        return Term(**{k: _beginning(v) for k, v in ends.items()})
    if kind == "step":
        if int(token) not in range(-n_time, n_time):
            raise ValueError(f"of {n_time} steps none is number {token}")
        return Term(int(token) % n_time, int(token) % n_time)
    steps = range(n_time)[slice(*(int(v) if (v := m[g]) else None for g in ("start", "stop", "stride")))]
    return Term(min(steps), max(steps), abs(steps.step)) if steps else None


def terms(spec: Sequence[str], n_time: int) -> dict[str, Term | None]:
    """The selectors of a specification, each an item of its own or between commas; all if there is none."""
    tokens = [t for t in map(str.strip, ",".join(spec).split(",")) if t]
    return {t: term(t, n_time) for t in tokens or ["all"]}


def time_condition(spec: Sequence[str], n_time: int, text: str = "iso", t: str = "t") -> Column:
    """A condition on rows of a time axis (t from 0, ISO text) that holds for the chosen steps.

    Selectors: ``all``; a step (negative: from the end); ``start:stop[:stride]`` as Python's slices; the beginning of an
    ISO time from year and month on; ``A..B``, two of these, both included. Several choose what any of them chooses.
    """
    return reduce(or_, (x.condition(F.col(t), F.col(text)) for x in terms(spec, n_time).values() if x), F.lit(False))


def select_times(spec: Sequence[str], times: Sequence[str]) -> list[int]:
    """The same on the driver, for an axis that is at hand; a time that no step has, or no step at all, is an error."""
    found = {token: {i for i, text in enumerate(times) if x and x.holds(i, text)} for token, x in terms(spec, len(times)).items()}
    if absent := [token for token, steps in found.items() if not steps and _PREFIX.fullmatch(token)]:
        raise ValueError(f"no step is at {', '.join(absent)}; the axis is from {times[0]} to {times[-1]}")
    if not any(found.values()):
        raise ValueError(f"no step is chosen by {', '.join(found)}")
    return sorted(set().union(*found.values()))


def byte_range(header: str, size: int) -> tuple[int, int] | None:
    """(first, last) byte of a Range header for an object of a size; None if it can't be met or read."""
    m = re.fullmatch(r"bytes=(\d*)-(\d*)", header.strip())
    if not m or not (m[1] or m[2]):
        return None
    if not m[1]:
        n = min(int(m[2]), size)
        return (size - n, size - 1) if n else None
    first, last = int(m[1]), min(int(m[2]), size - 1) if m[2] else size - 1
    return (first, last) if first <= last and first < size else None


def byte_ranges(header: Column, size: Column) -> Column:
    """byte_range() as a column: struct(first, last), or null."""
    part = lambda k: F.nullif(F.regexp_extract(F.trim(header), r"^bytes=(\d*)-(\d*)$", k), F.lit("")).cast("long")
    a, b = part(1), part(2)
    first = F.when(a.isNull(), F.greatest(size - b, F.lit(0))).otherwise(a)
    last = F.when(a.isNull() | b.isNull(), size - 1).otherwise(F.least(b, size - 1))
    met = (a.isNotNull() | (b > 0)) & (first <= last) & (first < size)
    return F.when(met, F.struct(first.cast("long").alias("first"), last.cast("long").alias("last")))


_DECIMAL = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")


@dataclass(frozen=True)
class Field:
    """A part of a view in a query string: its key, how it is written, and how it is read (None: not valid here)."""

    key: str
    write: Callable[[Any, Sequence[float] | None], str]
    read: Callable[[str, Mapping], Any]


def _decimal(text: str) -> float | None:
    return float(text) if _DECIMAL.fullmatch(text.strip()) else None


def _trimmed(x: float, digits: int) -> str:
    return f"{x:.{digits}f}".rstrip("0").rstrip(".") if digits else f"{round(x)}"


def _write_point(at: Sequence[float], transform: Sequence[float] | None) -> str:
    """A pixel's column and row to a tenth, or its coordinates in whole units (thousandths if a pixel is smaller than one)."""
    if transform is None:
        return ",".join(_trimmed(v, 1) for v in at)
    grid = np.array(transform).reshape(2, 3)
    return ",".join(_trimmed(v, 0 if abs(transform[0]) >= 1 else 3) for v in grid @ [*at, 1.0])


def _read_point(text: str, there: Mapping) -> tuple[float, float] | None:
    at = [_decimal(v) for v in text.split(",")]
    if len(at) != 2 or None in at:
        return None
    if there["transform"] is None:
        return at[0], at[1]
    grid = np.array(there["transform"]).reshape(2, 3)
    x, y = np.linalg.solve(grid[:, :2], np.array(at) - grid[:, 2])
    return float(x), float(y)


def _listed(names: str) -> Callable[[str, Mapping], str | None]:
    return lambda text, there: text if text in there[names] else None


#: The view's parts in the order in which they are written.
VIEW = {
    "t": Field("t", lambda v, _: str(v), lambda text, there: int(text) if text.isdecimal() and int(text) < there["n_time"] else None),
    "product": Field("p", lambda v, _: quote(v), _listed("products")),
    "band": Field("b", lambda v, _: quote(v), _listed("bands")),
    "zoom": Field("z", lambda v, _: f"{float(f'{v:.3g}'):g}", lambda text, _: z if (z := _decimal(text)) and z > 0 else None),
    "center": Field("c", _write_point, _read_point),
}


def encode_view(view: Mapping, transform: Sequence[float] | None = None) -> str:
    """A view (t, product, band, zoom, center as col and row) as a query string; with a transform, center in coordinates."""
    return "&".join(f"{f.key}={f.write(view[name], transform)}" for name, f in VIEW.items() if view.get(name) is not None)


def decode_view(text: str, n_time: int, products: Sequence[str], bands: Sequence[str], transform: Sequence[float] | None = None) -> dict:
    """The parts of a query string that are valid for a store."""
    given = parse_qs(text.lstrip("?"), keep_blank_values=True)
    there = {"n_time": n_time, "products": products, "bands": bands, "transform": transform}
    read = {name: f.read(given[f.key][0], there) for name, f in VIEW.items() if f.key in given}
    return {name: value for name, value in read.items() if value is not None}
