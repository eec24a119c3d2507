"""The description of a store: parsing, strictly, and writing.

A store is a Zarr v3 group with one subgroup per pyramid level. A block of the root's attributes describes the cube; its
key may be any (option ``block``): on reading, the one object with the fields below is it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np

from stratacube.functions import labels
from stratacube.functions.geometry import Transform, cells, level_transform, north_up
from stratacube.operators.pyramid import shapes
from stratacube.operators.temporal import anchor_schedule

# Fixed values of the format: the version written, the field names below, gap_fill's values, the encodings.
VERSION = "0.2.0"
ENCODINGS = ("none", "star-delta")
GAP_FILLS = ("carry-forward", "none")
#: Key of the block in stores that are written here.
BLOCK = "raster_series"
#: Types of data, and those that star deltas are defined for.
DATA_TYPES = ("uint8", "uint16", "int16", "float32")
DELTA_BITS = {"uint8": 8, "uint16": 16}
#: Coverage as the format has it, saturating at 255, and whole counts beyond the format.
COVERAGE_TYPES = ("uint8", "int32")
#: Anchors of stores that have no deltas, for volatility alone.
NOMINAL_INTERVAL = 6


class SchemaError(ValueError):
    """Metadata that isn't what the format asks for."""


@dataclass(frozen=True)
class Band:
    name: str
    common_name: str | None = None
    scale: float = 1.0
    offset: float = 0.0
    units: str | None = None


@dataclass(frozen=True)
class Level:
    path: str
    height: int
    width: int
    transform: Transform

    @property
    def resolution(self) -> float:
        return abs(self.transform[0])


@dataclass(frozen=True)
class Cube:
    """Everything about a store but its bytes."""

    times: tuple[str, ...]
    bands: tuple[Band, ...]
    crs: str
    dtype: str
    cell: int
    levels: tuple[Level, ...]
    variable: str = "data"
    nodata: float | int | None = None
    interval: int | None = None
    references: Mapping[int, int] = field(default_factory=dict)
    mask: str | None = None
    coverage: str | None = None
    shard_time: int | None = None
    provenance: Mapping[str, Any] | None = None
    selection: Mapping[str, Any] | None = None
    version: str = VERSION
    coverage_dtype: str = "uint8"

    @property
    def encoding(self) -> str:
        return "none" if self.interval is None else "star-delta"

    @property
    def fill(self) -> float | int:
        return 0 if self.nodata is None else self.nodata

    @property
    def bits(self) -> int:
        return DELTA_BITS[self.dtype]

    def plane_dtype(self, plane: str) -> str:
        return self.coverage_dtype if plane == "coverage" else "uint8"

    def anchor(self, t: int) -> int:
        return self.references.get(t, t)


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise SchemaError(message)


def _number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)


def parse_band(raw: Any, where: str = "band") -> Band:
    """A band from its object, or from a name alone (scale 1)."""
    if isinstance(raw, str):
        raw = {"name": raw}
    _need(isinstance(raw, Mapping), f"{where}: a band is a name or an object")
    _need(isinstance(raw.get("name"), str) and raw["name"] != "", f"{where}: it has no name")
    for k in ("common_name", "units"):
        _need(raw.get(k) is None or isinstance(raw[k], str), f"{where}: {k} is no text")
    for k in ("scale", "offset"):
        _need(raw.get(k) is None or _number(raw[k]), f"{where}: {k} is no finite number")
    _need(raw.get("scale") != 0, f"{where}: the scale is 0")
    return Band(raw["name"], raw.get("common_name"), float(raw.get("scale", 1) or 1), float(raw.get("offset") or 0), raw.get("units"))


def checked_nodata(value: Any, dtype: str) -> float | int | None:
    if value is None:
        return None
    _need(_number(value), f"nodata is {value!r}, not a finite number or null")
    from stratacube.operators.ingest import stored_token

    token = stored_token(value, dtype)
    _need(token is not None and not isinstance(token, str), f"{dtype} data can't hold nodata {value!r}")
    return token


def default_nodata(dtype: str, has_mask: bool) -> int | None:
    """0 for unsigned data without a mask, else none."""
    return 0 if dtype in DELTA_BITS and not has_mask else None


def reference_faults(references: Mapping[int, int], n_time: int, interval: int) -> dict[str, list[int]]:
    """By fault, the steps that have it; the faults are those of temporal.reference_violations()."""
    steps = np.array(sorted({*range(n_time), *references}), np.int64)
    listed = np.isin(steps, list(references))
    to = np.array([references.get(int(t), 0) for t in steps], np.int64)
    due = (steps >= 0) & (steps < n_time) & (steps % interval != 0)
    anchored = (to % interval == 0) & (to >= 0) & (to < n_time)
    faults = {"missing": due & ~listed, "unexpected": listed & ~due, "not an anchor": due & listed & ~anchored, "too far": due & listed & anchored & (np.abs(to - steps) >= interval)}
    return {fault: steps[at].tolist() for fault, at in faults.items() if at.any()}


def parse_temporal(raw: Any, n_time: int) -> tuple[int | None, dict[int, int], Mapping | None]:
    """interval (None without deltas), references, how the encoding was chosen."""
    _need(isinstance(raw, Mapping) and raw.get("encoding") in ENCODINGS, f"temporal.encoding must be one of {ENCODINGS}")
    selection = raw.get("selection")
    _need(selection is None or isinstance(selection, Mapping), "temporal.selection is no object")
    if raw["encoding"] == "none":
        return None, {}, selection
    k = raw.get("anchor_interval")
    _need(isinstance(k, int) and not isinstance(k, bool) and k >= 1, "temporal.anchor_interval must be a whole number from 1 on")
    _need(raw.get("anchor_indices") == list(range(0, n_time, k)), "temporal.anchor_indices aren't 0, k, 2k, ...")
    refs = raw.get("delta_reference", {})
    _need(isinstance(refs, Mapping) and all(re.fullmatch(r"\d+", str(t)) and isinstance(a, int) for t, a in refs.items()), "temporal.delta_reference must map steps to anchors")
    refs = {int(t): a for t, a in refs.items()}
    faults = reference_faults(refs, n_time, k)
    _need(not faults, "temporal.delta_reference: " + "; ".join(f"{fault}: {len(steps)} steps from {steps[0]} on" for fault, steps in faults.items()))
    return k, refs, selection


def parse_provenance(raw: Any) -> Mapping | None:
    if raw is None:
        return None
    _need(isinstance(raw, Mapping), "provenance is no object")
    _need(isinstance(raw.get("sources"), list) and all(isinstance(s, str) for s in raw["sources"]), "provenance.sources must be a list of texts")
    _need(isinstance(raw.get("composite"), str), "provenance.composite must be a text")
    _need(raw.get("gap_fill") in GAP_FILLS, f"provenance.gap_fill must be one of {GAP_FILLS}")
    _need(raw.get("notes") is None or isinstance(raw["notes"], str), "provenance.notes must be a text")
    return raw


def find_block(attributes: Mapping[str, Any], block: str | None = None) -> Mapping[str, Any]:
    """The object that describes the cube."""
    found = [v for k, v in attributes.items() if isinstance(v, Mapping) and (k == block if block else {"spec_version", "times", "temporal"} <= v.keys())]
    _need(len(found) == 1, "the root's attributes describe no cube")
    return found[0]


def parse_root(attributes: Mapping[str, Any], arrays: Mapping[str, Mapping], groups: Mapping[str, Mapping], block: str | None = None) -> Cube:
    """A cube from the root's attributes, the arrays' metadata by path and the level groups' attributes by path."""
    b = find_block(attributes, block)
    version = b.get("spec_version")
    _need(isinstance(version, str) and re.match(r"0\.[12]\.", version) is not None, f"version {version!r} isn't supported; there are 0.1 and 0.2")
    times = b.get("times")
    _need(isinstance(times, list) and len(times) > 0 and all(isinstance(s, str) for s in times), "times must be a list of texts")
    try:
        moments = [labels.parse_time(s) for s in times]
    except ValueError as e:
        raise SchemaError(f"times: {e}") from None
    _need(all(p < q for p, q in zip(moments, moments[1:], strict=False)), "times must increase strictly")
    raw = b.get("bands")
    _need(isinstance(raw, list) and len(raw) > 0, "bands must be a list")
    bands = tuple(parse_band(x, f"bands[{i}]") for i, x in enumerate(raw))
    names = [x.name for x in bands]
    _need(len(set(names)) == len(names), "band names must differ")
    _need(b.get("band_names") in (None, names), "band_names aren't the bands' names")
    _need(isinstance(b.get("crs"), str) and b["crs"] != "", "crs must be a text")
    interval, references, selection = parse_temporal(b.get("temporal"), len(times))
    variable = b.get("variable", "data")
    scales = attributes.get("multiscales")
    _need(isinstance(scales, list) and len(scales) == 1, "multiscales must have one entry")
    paths = [d.get("path") for d in scales[0].get("datasets", [])]
    _need(paths == [str(k) for k in range(len(paths))] and bool(paths), "levels must be 0, 1, ... in order")
    first = arrays.get(f"0/{variable}")
    _need(first is not None, f"there is no array 0/{variable}")
    dtype = first.get("data_type")
    _need(dtype in DATA_TYPES, f"data type {dtype!r} isn't one of {DATA_TYPES}")
    _need(interval is None or dtype in DELTA_BITS, f"star deltas aren't defined for {dtype}")
    inner, shard = layout(first)
    counts = (arrays.get(f"0/{b.get('coverage_variable')}") or {}).get("data_type", "uint8")
    _need(counts in COVERAGE_TYPES, f"coverage of type {counts!r} isn't one of {COVERAGE_TYPES}")
    levels = []
    for p in paths:
        a = arrays.get(f"{p}/{variable}")
        _need(a is not None, f"there is no array {p}/{variable}")
        shape = a["shape"]
        _need(len(shape) == 4 and shape[:2] == [len(times), len(bands)], f"{p}/{variable} has shape {shape}")
        t = (groups.get(p) or {}).get("transform")
        _need(isinstance(t, list) and len(t) >= 6 and all(map(_number, t[:6])), f"level {p} has no transform")
        levels.append(Level(p, shape[2], shape[3], north_up(t[:6])))
    return Cube(
        tuple(times), bands, b["crs"], dtype, inner[2], tuple(levels), variable, checked_nodata(b.get("nodata"), dtype), interval, references,
        b.get("mask_variable"), b.get("coverage_variable"), shard, parse_provenance(b.get("provenance")), selection, version, counts,
    )


def layout(array: Mapping) -> tuple[list[int], int | None]:
    """The inner chunk's shape, and how many steps a shard holds (None if there are no shards)."""
    outer = list(array["chunk_grid"]["configuration"]["chunk_shape"])
    codec = array["codecs"][0]
    if codec["name"] != "sharding_indexed":
        return outer, None
    return list(codec["configuration"]["chunk_shape"]), outer[0]


def key_of(array: Mapping, index: Sequence[int]) -> str:
    """The key of a chunk below its array, by the array's key encoding."""
    enc = array.get("chunk_key_encoding", {"name": "default"})
    sep = (enc.get("configuration") or {}).get("separator", "." if enc["name"] == "v2" else "/")
    text = sep.join(map(str, index))
    return text if enc["name"] == "v2" else f"c{sep}{text}"


def new_cube(times: Sequence[str], bands: Sequence[Band | Mapping | str], crs: str, transform: Sequence[float], height: int, width: int, dtype: str, cell: int = 512, **more) -> Cube:
    """A cube for writing: levels until one cell holds the whole (or n_levels), references if an interval is given.

    Coverage saturates at 255, as the format asks, unless ``coverage_dtype="int32"`` keeps whole counts; validate then names that type.
    """
    n_levels = more.pop("n_levels", None)
    parsed = tuple(x if isinstance(x, Band) else parse_band(x) for x in bands)
    _need(len({x.name for x in parsed}) == len(parsed), "band names must differ")
    _need(dtype in DATA_TYPES, f"data type {dtype!r} isn't one of {DATA_TYPES}")
    _need(cell % 2 == 0 and cell > 0, f"the cell size {cell} isn't even")
    _need(more.get("coverage_dtype", "uint8") in COVERAGE_TYPES, f"coverage of type {more.get('coverage_dtype')!r} isn't one of {COVERAGE_TYPES}")
    t = north_up(transform)
    moments = [labels.parse_time(s) for s in times]
    _need(len(times) > 0 and all(p < q for p, q in zip(moments, moments[1:], strict=False)), "times must increase strictly")
    levels = tuple(Level(str(k), h, w, level_transform(t, k)) for k, (h, w) in enumerate(shapes(height, width, cell, n_levels)))
    interval = more.get("interval")
    _need(interval is None or dtype in DELTA_BITS, f"star deltas aren't defined for {dtype}")
    if "nodata" not in more:
        more["nodata"] = default_nodata(dtype, more.get("mask") is not None)
    more["nodata"] = checked_nodata(more["nodata"], dtype)
    references = anchor_schedule(len(times), interval)[1] if interval else {}
    return Cube(tuple(times), parsed, crs, dtype, cell, levels, references=references, provenance=parse_provenance(more.pop("provenance", None)), **more)


def extended(cube: Cube, times: Sequence[str]) -> Cube:
    """The cube after an append: recorded references stay, new steps refer to the nearest anchor."""
    both = (*cube.times, *times)
    if cube.interval is None:
        return replace(cube, times=both)
    new = anchor_schedule(len(both), cube.interval)[1]
    return replace(cube, times=both, references={**{t: a for t, a in new.items() if t >= len(cube.times)}, **cube.references})


def band_object(b: Band) -> dict:
    out: dict[str, Any] = {"name": b.name}
    if b.common_name is not None:
        out["common_name"] = b.common_name
    out |= {"scale": b.scale, "offset": b.offset}
    if b.units is not None:
        out["units"] = b.units
    return out


def root_attributes(c: Cube, block: str = BLOCK, shard_bytes: Mapping | None = None) -> dict:
    temporal: dict[str, Any] = {"encoding": c.encoding}
    if c.interval is not None:
        temporal |= {"anchor_interval": c.interval, "anchor_indices": list(range(0, len(c.times), c.interval)), "delta_reference": {str(t): a for t, a in sorted(c.references.items())}}
    if c.selection is not None:
        temporal["selection"] = dict(c.selection)
    levels = [{"path": k.path, "resolution": k.resolution, "transform": list(k.transform), "shape": [len(c.times), len(c.bands), k.height, k.width], "grid": list(cells(k.height, k.width, c.cell))} for k in c.levels]
    b: dict[str, Any] = {"spec_version": VERSION, "variable": c.variable, "times": list(c.times), "bands": [band_object(x) for x in c.bands], "band_names": [x.name for x in c.bands], "nodata": c.nodata, "crs": c.crs, "temporal": temporal, "volatility_path": "volatility", "levels": levels}
    for k, v in (("mask_variable", c.mask), ("coverage_variable", c.coverage), ("provenance", c.provenance and dict(c.provenance)), ("shard_bytes", shard_bytes)):
        if v:
            b[k] = v
    scales = {"datasets": [{"path": k.path, "crs": c.crs} for k in c.levels], "type": "reduce", "metadata": {"method": "block_mean", "version": f"{block} {VERSION}", "args": []}}
    return {"multiscales": [scales], block: b}


def array_metadata(shape: Sequence[int], chunk: Sequence[int], dtype: str, fill: Any, codecs: Sequence[Mapping], dims: Sequence[str], attributes: Mapping | None = None, shard: Sequence[int] | None = None) -> dict:
    outer, chain = list(chunk), list(codecs)
    if shard is not None:
        index = [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "crc32c"}]
        outer, chain = list(shard), [{"name": "sharding_indexed", "configuration": {"chunk_shape": list(chunk), "codecs": list(codecs), "index_codecs": index, "index_location": "end"}}]
    return {
        "zarr_format": 3, "node_type": "array", "shape": list(shape), "data_type": dtype, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": outer}},
        "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": fill, "codecs": chain, "dimension_names": list(dims),
        "attributes": {"_ARRAY_DIMENSIONS": list(dims), **(attributes or {})},
    }


def level_attributes(c: Cube, k: Level) -> dict:
    return {"crs": c.crs, "transform": list(k.transform), "resolution": k.resolution}


def cube_arrays(c: Cube, codecs: Sequence[Mapping], plane_codecs: Sequence[Mapping], coverage_codecs: Sequence[Mapping] | None = None) -> dict[str, dict]:
    """Metadata of the data, mask and coverage arrays of all levels, by path. Coverage has the mask's codecs unless it has its own."""
    n, m, cs, st = len(c.times), len(c.bands), c.cell, c.shard_time
    out = {}
    for k in c.levels:
        extra = {"nodata": c.nodata} if c.nodata is not None else {}
        box = [k.transform[2], k.transform[5] + k.transform[4] * k.height, k.transform[2] + k.transform[0] * k.width, k.transform[5]]
        extra |= {"proj:code": c.crs, "spatial:dimensions": ["y", "x"], "spatial:shape": [k.height, k.width], "spatial:transform": list(k.transform), "spatial:bbox": box}
        out[f"{k.path}/{c.variable}"] = array_metadata([n, m, k.height, k.width], [1, m, cs, cs], c.dtype, c.fill, codecs, ["time", "band", "y", "x"], extra, [st, m, cs, cs] if st else None)
        for kind, plane, chain in (("mask", c.mask, plane_codecs), ("coverage", c.coverage, coverage_codecs or plane_codecs)):
            if plane:
                out[f"{k.path}/{plane}"] = array_metadata([n, k.height, k.width], [1, cs, cs], c.plane_dtype(kind), 0, chain, ["time", "y", "x"], None, [st, cs, cs] if st else None)
    return out
