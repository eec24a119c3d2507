"""One variable of a Zarr v2 or v3 group, with CF attributes, as pixels.

Dimensions are found by their usual names or named; times come in any order and are sorted; y may increase, rows are then
counted from the north all the same. Reads go chunk by chunk, a task per few chunks.
"""

from __future__ import annotations

import itertools
import json
import math
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from stratacube.functions.geometry import Transform
from stratacube.operators.ingest import decide_validity, stored_token
from stratacube.shipping import ship
from stratacube.sources import codecs
from stratacube.sources import metadata as M
from stratacube.sources.files import HttpFiles, files

#: What tells a dimension's role, best first: CF's axis attribute, standard name and units of its coordinates, then its name.
ROLES = ("time", "band", "y", "x")
AXIS = {"T": "time", "Y": "y", "X": "x"}
STANDARD_NAMES = {"time": "time", "projection_x_coordinate": "x", "longitude": "x", "projection_y_coordinate": "y", "latitude": "y"}
UNITS = ((r".+ since .+", "time"), (r"degrees?_?(n|north)", "y"), (r"degrees?_?(e|east)", "x"))
NAMES = {"time": "t|time|datetime|valid_time", "band": "bands?|channel|variable", "y": "y|lat|latitude|northing", "x": "x|lon|longitude|easting"}
_UNITS = {"microsecond": 1e-6, "millisecond": 1e-3, "second": 1.0, "minute": 60.0, "hour": 3600.0, "day": 86400.0}


def parse_dims(text: str | None) -> dict[str, str]:
    """time=NAME,y=NAME,x=NAME[,band=NAME]."""
    out = {}
    for part in filter(None, (text or "").split(",")):
        role, _, name = (p.strip() for p in part.partition("="))
        if role not in ROLES or not name:
            raise ValueError(f"{part!r} isn't of the form time=NAME, with one of {', '.join(ROLES)}")
        out[role] = name
    return out


@dataclass(frozen=True)
class Array:
    """A Zarr array of either version."""

    path: str
    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: str
    fill: float | int | None
    codecs: tuple[dict, ...]
    dims: tuple[str, ...]
    attributes: Mapping
    version: int
    separator: str
    prefix: str

    def key(self, index: Sequence[int]) -> str:
        return f"{self.path}/{self.prefix}{self.separator.join(map(str, index))}"

    def chunk(self, f, index: Sequence[int]) -> np.ndarray:
        raw = f.get(self.key(index))
        if raw is None:
            return np.full(self.chunks, self.fill or 0, codecs.DTYPES[self.dtype])
        return codecs.decode(raw, self.codecs, self.dtype, int(np.prod(self.chunks))).reshape(self.chunks)

    def all(self, f) -> np.ndarray:
        """The whole array: for coordinates."""
        out = np.zeros(self.shape, codecs.DTYPES[self.dtype])
        for index in itertools.product(*(range(-(-n // c)) for n, c in zip(self.shape, self.chunks, strict=True))):
            part = tuple(slice(i * c, min((i + 1) * c, n)) for i, c, n in zip(index, self.chunks, self.shape, strict=True))
            out[part] = self.chunk(f, index)[tuple(slice(0, s.stop - s.start) for s in part)]
        return out


def _v3(path: str, meta: Mapping) -> Array:
    if meta["codecs"][0]["name"] == "sharding_indexed":
        raise ValueError(f"{path} has shards; open it as a store")
    enc = meta.get("chunk_key_encoding", {"name": "default"})
    sep = (enc.get("configuration") or {}).get("separator", "." if enc["name"] == "v2" else "/")
    prefix = "" if enc["name"] == "v2" else f"c{sep}"
    dims = tuple(meta.get("dimension_names") or (meta.get("attributes") or {}).get("_ARRAY_DIMENSIONS") or ())
    return Array(path, tuple(meta["shape"]), tuple(meta["chunk_grid"]["configuration"]["chunk_shape"]), meta["data_type"], meta.get("fill_value"), tuple(meta["codecs"]), dims, meta.get("attributes") or {}, 3, sep, prefix)


def _v2(path: str, meta: Mapping, attributes: Mapping) -> Array:
    kind = {"u1": "uint8", "u2": "uint16", "i2": "int16", "i4": "int32", "i8": "int64", "f4": "float32", "f8": "float64", "b1": "uint8"}
    code = meta["dtype"]
    if code[0] == ">" and code[2:] != "1" or code[1:] not in kind or meta.get("filters"):
        raise ValueError(f"{path}: data of type {code} with filters {meta.get('filters')} isn't supported")
    chain: list[dict] = [{"name": "bytes"}]
    if meta.get("compressor"):
        chain.append({"name": meta["compressor"]["id"]})
    fill = meta.get("fill_value")
    return Array(path, tuple(meta["shape"]), tuple(meta["chunks"]), kind[code[1:]], None if fill in ("NaN", None) else fill, tuple(chain), tuple(attributes.get("_ARRAY_DIMENSIONS", ())), attributes, 2, meta.get("dimension_separator", "."), "")


def group(root: str) -> tuple[dict[str, Array], dict]:
    """The arrays right below a group, and the group's attributes. Over HTTP, metadata must be consolidated."""
    f = files(root)
    raw3 = f.get("zarr.json")
    if raw3 is not None:
        doc = json.loads(raw3)
        nodes = (doc.get("consolidated_metadata") or {}).get("metadata")
        if nodes is None:
            if isinstance(f, HttpFiles):
                raise ValueError(f"{root}: over HTTP a group needs consolidated metadata")
            nodes = {k.rsplit("/", 1)[0]: json.loads(f.get(k)) for k, _ in f.inventory() if k.count("/") == 1 and k.endswith("/zarr.json")}
        return {k: _v3(k, v) for k, v in nodes.items() if v.get("node_type") == "array" and v.get("data_type") in codecs.DTYPES}, doc.get("attributes") or {}
    raw2 = f.get(".zmetadata")
    if raw2 is not None:
        meta = json.loads(raw2)["metadata"]
    elif isinstance(f, HttpFiles):
        raise ValueError(f"{root}: over HTTP a group needs consolidated metadata")
    else:
        meta = {k: json.loads(f.get(k)) for k, _ in f.inventory() if k.endswith((".zarray", ".zattrs", ".zgroup"))}
    if not meta:
        raise FileNotFoundError(f"{root} is no Zarr group")
    out = {}
    for k, v in meta.items():
        if k.endswith("/.zarray"):
            path = k.removesuffix("/.zarray")
            if v["dtype"][1:] in ("u1", "u2", "i2", "i4", "i8", "f4", "f8", "b1"):
                out[path] = _v2(path, v, meta.get(f"{path}/.zattrs", {}))
    return out, meta.get(".zattrs", {})


def moments(values: np.ndarray, units: str) -> list[datetime]:
    """CF times as UTC."""
    m = re.fullmatch(r"\s*(\w+?)s?\s+since\s+(.+?)\s*", units)
    if not m or m[1] not in _UNITS:
        raise ValueError(f"times in {units!r} can't be read")
    start = datetime.fromisoformat(m[2].replace("Z", "+00:00"))
    start = start.replace(tzinfo=UTC) if start.tzinfo is None else start
    return [start + timedelta(seconds=float(v) * _UNITS[m[1]]) for v in values.tolist()]


@dataclass(frozen=True)
class Variable:
    root: str
    array: Array
    mask: Array | None
    axes: dict[str, int]
    order: tuple[int, ...]  # stored time index of each step
    times: tuple[str, ...]
    flip: bool
    transform: Transform
    crs: str | None
    bands: tuple[M.Band, ...]
    validity: dict
    sentinels: tuple[float, ...]

    @property
    def size(self) -> tuple[int, int]:
        return self.array.shape[self.axes["y"]], self.array.shape[self.axes["x"]]

    def cube(self, crs: str | None = None, cell: int = 512) -> M.Cube:
        """For a store of this variable."""
        name = crs or self.crs
        if name is None:
            raise ValueError(f"{self.root} names no reference system; give one")
        more = {"mask": "mask"} if self.validity["mask"] else {}
        return M.new_cube(self.times, self.bands, name, self.transform, *self.size, self.array.dtype, cell, nodata=self.validity["nodata"], **more)


class Dataset:
    """A group as CF sees it: variables, the coordinates of their dimensions, what attributes say."""

    def __init__(self, root: str):
        self.root, self.files = root, files(root)
        self.arrays, self.attributes = group(root)

    def variable(self, name: str | None, mask: str | None) -> str:
        """The name of the variable that holds pixels: the one asked for, or the only one of three dimensions at least."""
        there = sorted(k for k, a in self.arrays.items() if len(a.shape) >= 3 and k != mask)
        if (chosen := there if name is None else [name] if name in self.arrays else []) and len(chosen) == 1:
            if (kind := self.arrays[chosen[0]].dtype) not in M.DATA_TYPES:
                raise ValueError(f"{chosen[0]} holds {kind}, and a cube one of {', '.join(M.DATA_TYPES)}")
            return chosen[0]
        raise ValueError(f"{self.root}: {'no variable ' + repr(name) if name else 'choose one'} of {there}")

    def role(self, dimension: str) -> str | None:
        """A dimension's role, by its coordinates' attributes before its name."""
        about = self.arrays[dimension].attributes if dimension in self.arrays else {}
        units = str(about.get("units", "")).lower()
        found = (
            AXIS.get(str(about.get("axis", "")).upper()),
            STANDARD_NAMES.get(about.get("standard_name")),
            next((role for form, role in UNITS if re.fullmatch(form, units)), None),
            next((role for role, form in NAMES.items() if re.fullmatch(form, dimension.lower())), None),
        )
        return next(filter(None, found), None)

    def axes(self, array: Array, given: Mapping[str, str]) -> dict[str, int]:
        """The place of each role's dimension. Each dimension has one role, time, y and x are there."""
        said = {dim: role for role, dim in given.items()}
        if strange := said.keys() - set(array.dims):
            raise ValueError(f"no dimension of {array.path} is called {' or '.join(sorted(strange))}; there are {list(array.dims)}")
        roles = [said.get(d) or (None if (r := self.role(d)) in given else r) for d in array.dims]
        out = {role: i for i, role in enumerate(roles) if role}
        if len(out) != len(array.dims) or not {"time", "y", "x"} <= out.keys():
            raise ValueError(f"of the dimensions {list(array.dims)} of {array.path} the roles {roles} are known; say which are {', '.join(ROLES)}")
        return out

    def values(self, name: str) -> np.ndarray:
        return self.arrays[name].all(self.files)

    def axis_of_time(self, name: str) -> tuple[tuple[int, ...], list[datetime]]:
        """Stored places in the order of time, and the times; no time twice."""
        at = moments(self.values(name), self.arrays[name].attributes.get("units", ""))
        order = sorted(range(len(at)), key=at.__getitem__)
        if len(set(at)) < len(at):
            raise ValueError(f"{name} holds a time twice")
        return tuple(order), [at[i] for i in order]

    def spacing(self, name: str) -> tuple[float, float, float]:
        """First and last coordinate and the step between two, which is the same all along."""
        c = self.values(name).astype(float)
        steps = np.diff(c)
        if not len(steps) or not np.allclose(steps, steps[0]) or steps[0] == 0:
            raise ValueError(f"{name} isn't a regular axis of two pixels or more")
        return float(c[0]), float(c[-1]), float(steps[0])

    def crs(self, array: Array) -> str | None:
        """The reference system: of the grid mapping that the variable names, of the variable, of the group."""
        mapping = self.arrays.get(array.attributes.get("grid_mapping", ""))
        holders = ([mapping.attributes] if mapping else []) + [array.attributes, self.attributes]
        return next((str(h[k]) for h in holders for k in ("crs", "spatial_ref") if h.get(k)), None)

    def bands(self, array: Array, axes: Mapping[str, int]) -> tuple[M.Band, ...]:
        """Packing (scale_factor, add_offset) and units are the variable's; names are the band axis's."""
        packing = {}
        for key, plain in (("scale_factor", 1.0), ("add_offset", 0.0)):
            v = np.atleast_1d(array.attributes.get(key, plain))
            if v.size != 1 or v.dtype.kind not in "iuf" or not np.isfinite(v).all() or (key == "scale_factor" and v[0] == 0):
                raise ValueError(f"{array.path}: {key} {array.attributes.get(key)!r} isn't a number that values can be packed by")
            packing[key] = float(v[0])
        names: Sequence[str] = [array.path]
        if "band" in axes:
            n, dim = array.shape[axes["band"]], array.dims[axes["band"]]
            names = [str(x) for x in self.values(dim).tolist()] if dim in self.arrays else [f"band{i}" for i in range(1, n + 1)]
        return tuple(M.Band(n, None, packing["scale_factor"], packing["add_offset"], array.attributes.get("units") or None) for n in names)

    def plane(self, name: str | None, array: Array, axes: Mapping[str, int]) -> Array | None:
        """A mask: whole numbers over the variable's time, y and x, in any order."""
        if name is None:
            return None
        m = self.arrays.get(name)
        over = {array.dims[axes[r]] for r in ("time", "y", "x")}
        if m is None or m is array or len(m.dims) != 3 or {*m.dims} != over or m.dtype.startswith("float"):
            raise ValueError(f"{name!r} can't be the mask of {array.path}: that is another variable of whole numbers over {sorted(over)}")
        return m


def iso_times(at: Sequence[datetime]) -> tuple[str, ...]:
    """Seconds, or milliseconds in all if one has any."""
    parts = "milliseconds" if any(t.microsecond for t in at) else "seconds"
    return tuple(t.astimezone(UTC).replace(tzinfo=None).isoformat(timespec=parts) + "Z" for t in at)


def open_variable(root: str, name: str | None = None, dims: Mapping[str, str] | None = None, nodata: float | str | None = "auto", mask: str | None = None) -> Variable:
    """A variable with its axes, grid, times, bands and validity; raises where anything is missing or unclear."""
    data = Dataset(root)
    a = data.arrays[data.variable(name, mask)]
    axes = data.axes(a, dims or {})
    order, at = data.axis_of_time(a.dims[axes["time"]])
    (west, _, dx), (y0, y1, dy) = (data.spacing(a.dims[axes[r]]) for r in ("x", "y"))
    if dx < 0:
        raise ValueError(f"{a.dims[axes['x']]} runs westwards")
    transform = (dx, 0.0, west - dx / 2, 0.0, -abs(dy), max(y0, y1) + abs(dy) / 2)
    declared = [v for key in ("_FillValue", "missing_value") for v in np.atleast_1d(a.attributes.get(key, [])).tolist()]
    tokens = {token for v in declared if (token := stored_token(v, a.dtype)) is not None}
    validity = decide_validity(a.dtype, sorted(tokens, key=str), nodata, [f"mask {mask}"] if mask else [], False)
    invalid = [t for t in tokens if t != "nan"] if nodata == "auto" else [validity["nodata"]]
    sentinels = tuple(float(t) for t in invalid if t is not None)
    return Variable(root, a, data.plane(mask, a, axes), axes, order, iso_times(at), dy > 0, transform, data.crs(a), data.bands(a, axes), validity, sentinels)


def read(spark: SparkSession, v: Variable) -> DataFrame:
    """t, b, y, x, v and, where validity is a mask, mask. NaN in a valid pixel of a cube without a mask stops the query."""
    a = v.array
    counts = [-(-n // c) for n, c in zip(a.shape, a.chunks, strict=True)]
    total = math.prod(counts)
    step = {stored: t for t, stored in enumerate(v.order)}
    masked = v.validity["mask"]
    floats = a.dtype == "float32"

    def pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = files(v.root)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                index = np.unravel_index(k, counts)
                first = [i * c for i, c in zip(index, a.chunks, strict=True)]
                part = tuple(slice(0, min(c, n - s)) for c, n, s in zip(a.chunks, a.shape, first, strict=True))
                data = a.chunk(f, index)[part]
                places = np.indices(data.shape)
                at = {r: (places[i] + first[i]).ravel() for r, i in v.axes.items()}
                values = data.ravel()
                y = v.size[0] - 1 - at["y"] if v.flip else at["y"]
                ok = np.ones(len(values), bool)
                for s in v.sentinels:
                    ok &= values != np.asarray(s, values.dtype)
                nan = np.isnan(values) if floats else np.zeros(len(values), bool)
                ok &= ~nan
                if nan.any():
                    if not masked:
                        raise ValueError(f"{int(nan.sum())} values are NaN, but the cube has no mask; ask for one with nodata NaN")
                    values = np.where(nan, values.dtype.type(v.validity["nodata"] or 0), values)
                if v.mask is not None:
                    ok &= _plane(f, v, at) != 0
                t = np.array([step[int(i)] for i in np.unique(at["time"])])[np.unique(at["time"], return_inverse=True)[1]]
                out = [pa.array(z.astype(np.int32)) for z in (t, at.get("band", np.zeros(len(values), int)), y, at["x"])]
                out.append(pa.array(values.astype(np.float32 if floats else np.int32)))
                yield pa.RecordBatch.from_arrays([*out, *([pa.array(ok.astype(np.int32))] if masked else [])], ["t", "b", "y", "x", "v", *(["mask"] if masked else [])])

    ship(spark)
    chunks = spark.range(0, total, 1, min(total, 4 * spark.sparkContext.defaultParallelism))
    return chunks.mapInArrow(pixels, f"t int, b int, y int, x int, v {'float' if floats else 'int'}" + (", mask int" if masked else ""))


def _plane(f, v: Variable, at: Mapping[str, np.ndarray]) -> np.ndarray:
    """Mask values at stored positions."""
    m = v.mask
    own = np.stack([at[r] for d in m.dims for r, i in v.axes.items() if v.array.dims[i] == d])
    chunk = own // np.array(m.chunks)[:, None]
    out = np.zeros(own.shape[1], np.int64)
    for index in np.unique(chunk, axis=1).T:
        here = (chunk == index[:, None]).all(axis=0)
        out[here] = m.chunk(f, index.tolist())[tuple(own[:, here] % np.array(m.chunks)[:, None])]
    return out
