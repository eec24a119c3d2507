"""Zarr v3 stores of cubes as a Spark data source: ``spark.read.format("stratacube")`` and writing.

Rows are pixels: t, b, y, x, v, mask, coverage. Filters on t, b, y and x choose the chunks that are read. A step that is
stored as a difference takes its anchor's chunk along, so a step of a cell costs two chunk reads at most; the anchor is
kept while its steps are read.

Writing puts all pixels of a cell into one task, ordered so that each anchor comes before the steps that refer to it: a
task holds one anchor and one step. The root's metadata is written last, when all tasks are done; a failed job removes
what it wrote.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from stratacube.functions.geometry import cells
from stratacube.operators import pyramid, temporal
from stratacube.shipping import ship
from stratacube.sources import codecs
from stratacube.sources import metadata as M
from stratacube.sources.files import Files, files

FORMAT = "stratacube"
#: Pixels (of all bands) that one read partition gives, about.
PARTITION_PIXELS = 4_000_000


def load(root: str, block: str | None = None) -> tuple[M.Cube, dict[str, dict], dict]:
    """A store's cube, its arrays' metadata by path and the root's attributes. One read where metadata is consolidated."""
    f = files(root)
    raw = f.get("zarr.json")
    if raw is None:
        raise M.SchemaError(f"{root} is no Zarr v3 group: there is no zarr.json")
    doc = json.loads(raw)
    if doc.get("zarr_format") != 3 or doc.get("node_type") != "group":
        raise M.SchemaError(f"{root} is no Zarr v3 group")
    attributes = doc.get("attributes") or {}
    nodes = dict(((doc.get("consolidated_metadata") or {}).get("metadata")) or {})
    b = M.find_block(attributes, block)
    if not nodes:
        for d in (attributes.get("multiscales") or [{}])[0].get("datasets", []):
            for path in (d["path"], *(f"{d['path']}/{v}" for v in (b.get("variable", "data"), b.get("mask_variable"), b.get("coverage_variable")) if v)):
                if (one := f.get(f"{path}/zarr.json")) is not None:
                    nodes[path] = json.loads(one)
    arrays = {k: v for k, v in nodes.items() if v.get("node_type") == "array"}
    groups = {k: v.get("attributes") or {} for k, v in nodes.items() if v.get("node_type") == "group"}
    for mirror in b.get("levels") or []:
        groups.setdefault(mirror["path"], {"transform": mirror["transform"], "resolution": mirror["resolution"]})
    return M.parse_root(attributes, arrays, groups, block), arrays, attributes


def is_store(root: str) -> bool:
    """Whether a folder's root describes a cube."""
    try:
        raw = files(root).get("zarr.json")
        M.find_block(json.loads(raw or b"{}").get("attributes") or {})
    except (M.SchemaError, ValueError, OSError):
        return False
    return True


class Chunks:
    """Reads chunks of one array, sharded or not; counts the reads."""

    def __init__(self, f, path: str, array: Mapping, dtype: str):
        self.f, self.path, self.array, self.dtype = f, path, array, dtype
        self.inner, self.shard = M.layout(array)
        first = array["codecs"][0]
        conf = first.get("configuration") or {}
        self.codecs = conf["codecs"] if self.shard else array["codecs"]
        self.checked = bool(self.shard) and any(c["name"] == "crc32c" for c in conf.get("index_codecs", []))
        self.at_start = bool(self.shard) and conf.get("index_location", "end") == "start"
        self.indexes: dict[str, list | None] = {}
        self.reads = 0

    def raw(self, t: int, row: int, col: int) -> bytes | None:
        middle = (0,) if len(self.inner) == 4 else ()
        if not self.shard:
            self.reads += 1
            return self.f.get(f"{self.path}/{M.key_of(self.array, (t, *middle, row, col))}")
        key = f"{self.path}/{M.key_of(self.array, (t // self.shard, *middle, row, col))}"
        if key not in self.indexes:
            offset, length = codecs.index_range(self.shard, self.checked, self.at_start, None)
            got = self.f.part(key, offset, length)
            self.indexes = {key: None if got is None else codecs.read_index(got, self.shard, self.checked, self.f.size(key))}
        index = self.indexes[key]
        entry = index[t % self.shard] if index else None
        if entry is None:
            return None
        self.reads += 1
        return self.f.part(key, *entry)

    def values(self, t: int, row: int, col: int) -> np.ndarray | None:
        """The chunk [bands,] cell, cell; None where there is no object (all fill)."""
        got = self.raw(t, row, col)
        return None if got is None else codecs.decode(got, self.codecs, self.dtype, int(np.prod(self.inner))).reshape(self.inner[1:])


class CellReader:
    """True (or raw) values and planes of a level's cells."""

    def __init__(self, root: str, cube: M.Cube, arrays: Mapping[str, Mapping], level: int, raw: bool = False):
        f = files(root)
        self.cube, self.level, self.raw = cube, cube.levels[level], raw
        path = self.level.path
        self.data = Chunks(f, f"{path}/{cube.variable}", arrays[f"{path}/{cube.variable}"], cube.dtype)
        self.planes = {k: Chunks(f, f"{path}/{v}", arrays[f"{path}/{v}"], cube.plane_dtype(k)) for k, v in (("mask", cube.mask), ("coverage", cube.coverage)) if v}
        self.held: tuple[tuple[int, int, int], np.ndarray] | None = None

    def stored(self, t: int, row: int, col: int) -> np.ndarray:
        got = self.data.values(t, row, col)
        return np.full(self.data.inner[1:], self.cube.fill, codecs.DTYPES[self.cube.dtype]) if got is None else got

    def anchor(self, t: int, row: int, col: int) -> np.ndarray:
        if self.held is None or self.held[0] != (t, row, col):
            self.held = (t, row, col), self.stored(t, row, col)
        return self.held[1]

    def values(self, t: int, row: int, col: int) -> np.ndarray:
        a = self.cube.anchor(t)
        if self.raw or a == t:
            return self.anchor(t, row, col) if a == t else self.stored(t, row, col)
        return self.anchor(a, row, col) + self.stored(t, row, col)  # unsigned arrays wrap

    def plane(self, name: str, t: int, row: int, col: int) -> np.ndarray | None:
        if name not in self.planes:
            return None
        got = self.planes[name].values(t, row, col)
        return np.zeros(self.planes[name].inner[1:], codecs.DTYPES[self.cube.plane_dtype(name)]) if got is None else got


class Piece(InputPartition):
    """Some steps of one cell, and the bands and ranges of rows and columns that are wanted."""

    def __init__(self, row: int, col: int, steps: tuple[int, ...], bands: tuple[int, ...], y: tuple[int, int], x: tuple[int, int]):
        super().__init__((row, col, steps))
        self.row, self.col, self.steps, self.bands, self.y, self.x = row, col, steps, bands, y, x


def _span(filters: Iterable[Filter], name: str, n: int) -> list[int]:
    """The indexes 0..n-1 that pass the filters on a column."""
    chosen = np.ones(n, bool)
    at = np.arange(n)
    for f in filters:
        if f.attribute != (name,):
            continue
        match f:
            case EqualTo():
                chosen &= at == f.value
            case In():
                chosen &= np.isin(at, [v for v in f.value if v is not None])
            case GreaterThan():
                chosen &= at > f.value
            case GreaterThanOrEqual():
                chosen &= at >= f.value
            case LessThan():
                chosen &= at < f.value
            case LessThanOrEqual():
                chosen &= at <= f.value
    return np.flatnonzero(chosen).tolist()


class StoreReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str], schema: T.StructType):
        self.root, self.raw = options["path"], options.get("raw", "false").lower() == "true"
        self.cube, self.arrays, _ = load(self.root, options.get("block"))
        self.level = int(options.get("lod", 0))
        if not 0 <= self.level < len(self.cube.levels):
            raise M.SchemaError(f"there is no level {self.level}; levels are 0 to {len(self.cube.levels) - 1}")
        self.names = schema.fieldNames()
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute in (("t",), ("b",), ("y",), ("x",)):
                self.filters.append(f)
            yield f  # Spark looks at them as well: here they only choose chunks

    def partitions(self) -> Sequence[Piece]:
        c, k = self.cube, self.cube.levels[self.level]
        steps, bands = _span(self.filters, "t", len(c.times)), _span(self.filters, "b", len(c.bands))
        ys, xs = _span(self.filters, "y", k.height), _span(self.filters, "x", k.width)
        if not (steps and bands and ys and xs):
            return []
        # Steps of one anchor stay together, so it is read once.
        steps.sort(key=lambda t: (c.anchor(t), t))
        many = max(1, PARTITION_PIXELS // (c.cell * c.cell * len(bands)))
        groups = [tuple(steps[i : i + many]) for i in range(0, len(steps), many)]
        rows, cols = sorted({y // c.cell for y in ys}), sorted({x // c.cell for x in xs})
        box = (ys[0], ys[-1] + 1), (xs[0], xs[-1] + 1)
        return [Piece(r, q, g, tuple(bands), *box) for r in rows for q in cols for g in groups]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        reader = CellReader(self.root, self.cube, self.arrays, self.level, self.raw)
        c, k = self.cube, reader.level
        y0, x0 = partition.row * c.cell, partition.col * c.cell
        top, left = max(y0, partition.y[0]), max(x0, partition.x[0])
        bottom, right = min(y0 + c.cell, k.height, partition.y[1]), min(x0 + c.cell, k.width, partition.x[1])
        ys, xs = np.meshgrid(np.arange(top, bottom, dtype=np.int32), np.arange(left, right, dtype=np.int32), indexing="ij")
        part = (slice(top - y0, bottom - y0), slice(left - x0, right - x0))
        n = ys.size
        kind = pa.float32() if c.dtype == "float32" else pa.int32()
        for t in partition.steps:
            data = reader.values(t, partition.row, partition.col)
            planes = {p: None if (v := reader.plane(p, t, partition.row, partition.col)) is None else v[part].ravel() for p in ("mask", "coverage") if p in self.names}
            for b in partition.bands:
                columns = {
                    "t": pa.array(np.full(n, t, np.int32)),
                    "b": pa.array(np.full(n, b, np.int32)),
                    "y": pa.array(ys.ravel()),
                    "x": pa.array(xs.ravel()),
                    "v": pa.array(data[b][part].ravel()).cast(kind),
                    **{p: pa.nulls(n, pa.int32()) if v is None else pa.array(v.astype(np.int32)) for p, v in planes.items()},
                }
                yield pa.RecordBatch.from_arrays([columns[name] for name in self.names], self.names)


class StoreSource(DataSource):
    """Options: path, lod (pyramid level), raw (stored residuals as they are), block (key of the describing object)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        cube, *_ = load(self.options["path"], self.options.get("block"))
        v = T.FloatType() if cube.dtype == "float32" else T.IntegerType()
        return T.StructType([*[T.StructField(n, T.IntegerType()) for n in "tbyx"], T.StructField("v", v), T.StructField("mask", T.IntegerType()), T.StructField("coverage", T.IntegerType())])

    def reader(self, schema: T.StructType) -> StoreReader:
        return StoreReader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> StoreWriter:
        return StoreWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StoreSource)


def read(spark: SparkSession, path: str, lod: int = 0, raw: bool = False) -> DataFrame:
    register(spark)
    return spark.read.format(FORMAT).option("lod", str(lod)).option("raw", str(raw).lower()).load(path)


# --- writing --------------------------------------------------------------------------------------------------------

#: Kinds of rows that a writer gets.
CELL, DATA, MASK, COVERAGE = 0, 1, 2, 3


def _dtype(c: M.Cube, kind: int) -> str:
    return c.dtype if kind == DATA else c.plane_dtype("mask" if kind == MASK else "coverage")


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: objects by array, and the sums of volatility by cell."""

    objects: list[tuple[str, str, int]]
    changes: list[tuple[int, int, float, int]]
    levels: dict[int, tuple[int, int]]


class StoreWriter(DataSourceArrowWriter):
    """Gets rows (level, row, col, part, kind, star, late, t, b, y, x, v) sorted by their first columns.

    A part of a cell is in one task: an anchor and the steps that refer to it, or all steps where shards hold several.
    """

    def __init__(self, options: Mapping[str, str], overwrite: bool):
        self.root, self.block = options["path"], options.get("block", M.BLOCK)
        self.cube, self.since = _unpacked(options["cube"])
        self.codec, self.codec_level = options.get("codec", "zstd"), int(options["level"]) if "level" in options else None
        self.overwrite = overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        f, out = Files(self.root), Written([], [], {})
        task = None
        for batch in iterator:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if task is None or task.key != tuple(keys[lo]):
                    if task is not None:
                        task.close(out)
                    task = _CellTask(self, f, tuple(int(k) for k in keys[lo]))
                task.add(batch.slice(lo, hi - lo))
        if task is not None:
            task.close(out)
        return out

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None]
        if self.since:
            _commit_append(self, done)
        else:
            _commit_new(self, done)

    def abort(self, messages: list[Written | None]) -> None:
        if not self.since:
            Files(self.root).delete()


class _CellTask:
    """Writes one part of a cell of one level: steps come in the order (kind, anchor, anchors first, step).

    A chunk that isn't in a shard is written as soon as it is packed; only the anchor is held.
    """

    def __init__(self, writer: StoreWriter, f: Files, key: tuple[int, int, int, int]):
        self.w, self.f, self.key, self.cube = writer, f, key, writer.cube
        self.level = self.cube.levels[key[0]]
        self.current: tuple[int, int] | None = None
        self.parts: list[pa.RecordBatch] = []
        self.packed: dict[tuple[int, int], bytes] = {}
        self.anchor: tuple[int, np.ndarray] | None = None
        self.total, self.n = 0.0, 0
        c, (_, r, q, _) = self.cube, key
        self.schedule = c.references if c.interval is not None else temporal.anchor_schedule(len(c.times), M.NOMINAL_INTERVAL)[1]
        self.size = self.objects = 0
        self.h, self.wd = min(c.cell, self.level.height - r * c.cell), min(c.cell, self.level.width - q * c.cell)
        self.seen: set[tuple[int, int]] = set()
        self.reader: CellReader | None = None

    def add(self, batch: pa.RecordBatch) -> None:
        kind, t = batch.column(4).to_numpy(), batch.column(7).to_numpy()
        both = np.stack([kind, t], 1)
        cuts = [0, *(np.flatnonzero((both[1:] != both[:-1]).any(axis=1)) + 1).tolist(), len(both)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            at = (int(both[lo][0]), int(both[lo][1]))
            if at != self.current:
                self.flush()
                self.current = at
            self.parts.append(batch.slice(lo, hi - lo))

    def flush(self) -> None:
        if self.current is not None and self.current[0] != CELL:
            kind, t = self.current
            table = pa.Table.from_batches(self.parts)
            y, x, v = (table.column(n).to_numpy() for n in ("y", "x", "v"))
            c = self.cube
            y, x = y - self.key[1] * c.cell, x - self.key[2] * c.cell
            if kind == DATA:
                plane = np.full((len(c.bands), c.cell, c.cell), c.fill, codecs.DTYPES[c.dtype])
                plane[table.column("b").to_numpy(), y, x] = v
            else:
                plane = np.zeros((c.cell, c.cell), codecs.DTYPES[_dtype(c, kind)])
                plane[y, x] = v
            self.put(kind, t, plane)
        self.current, self.parts = None, []

    def put(self, kind: int, t: int, values: np.ndarray) -> None:
        c = self.cube
        self.seen.add((kind, t))
        dtype = _dtype(c, kind)
        if kind == DATA:
            star = self.schedule.get(t, t)
            if star == t:
                self.anchor = t, values
            else:
                base = self.base(star, values)
                if self.key[0] == 0:
                    part = (slice(None), slice(0, self.h), slice(0, self.wd))
                    diff = values[part].astype(np.float64) - base[part].astype(np.float64)
                    self.total += float(np.abs(diff).sum())
                    self.n += diff.size
                if c.interval is not None:
                    values = values - base  # unsigned arrays wrap; padding becomes 0
        raw = codecs.encode(values, codecs.chain(self.w.codec, dtype, self.w.codec_level), dtype)
        if c.shard_time is not None or kind == DATA and self.schedule.get(t, t) == t:
            self.packed[kind, t] = raw
        if c.shard_time is None:
            self.send(kind, t, raw)

    def send(self, kind: int, at: int, raw: bytes) -> None:
        """Write the object of a step, or of a shard."""
        c, (_, r, q, _) = self.cube, self.key
        name = {DATA: c.variable, MASK: c.mask, COVERAGE: c.coverage}[kind]
        middle = (0,) if kind == DATA else ()
        self.f.put(f"{self.level.path}/{name}/c/{'/'.join(map(str, (at, *middle, r, q)))}", raw)
        self.size, self.objects = self.size + len(raw), self.objects + 1

    def base(self, star: int, like: np.ndarray) -> np.ndarray:
        """The anchor's values: of this write, else from the store (an append), else fill."""
        if self.anchor is not None and self.anchor[0] == star:
            return self.anchor[1]
        if star < self.w.since:
            if self.reader is None:
                old = replace(self.cube, times=self.cube.times[: self.w.since])
                _, arrays, _ = load(self.w.root, self.w.block)
                self.reader = CellReader(self.w.root, old, arrays, self.key[0])
            return self.reader.values(star, self.key[1], self.key[2])
        base = np.full(like.shape, self.cube.fill, like.dtype)
        self.put(DATA, star, base)
        return base

    def close(self, out: Written) -> None:
        self.flush()
        c, (k, r, q, part) = self.cube, self.key
        kinds = [DATA, *([MASK] if c.mask else []), *([COVERAGE] if c.coverage else [])]
        mine = [t for t in range(self.w.since, len(c.times)) if c.shard_time is not None or self.schedule.get(t, t) == part]
        steps = sorted(mine, key=lambda t: (c.anchor(t), c.anchor(t) != t, t))
        for kind in kinds:
            for t in steps:
                if (kind, t) not in self.seen:
                    shape = (len(c.bands), c.cell, c.cell) if kind == DATA else (c.cell, c.cell)
                    if kind == DATA and self.anchor is not None and c.anchor(t) != t and self.anchor[0] != c.anchor(t):
                        self.anchor = None
                    self.restore(kind, t)
                    self.put(kind, t, np.full(shape, c.fill if kind == DATA else 0, codecs.DTYPES[_dtype(c, kind)]))
        for kind in kinds if c.shard_time is not None else ():
            path = f"{self.level.path}/{ {DATA: c.variable, MASK: c.mask, COVERAGE: c.coverage}[kind]}"
            packed = {t: raw for (m, t), raw in self.packed.items() if m == kind}
            for shard in sorted({t // c.shard_time for t in packed}):
                old = self.old_chunks(path, shard, (0,) if kind == DATA else ()) if shard * c.shard_time < self.w.since else {}
                raw = codecs.write_shard([packed.get(t, old.get(t)) for t in range(shard * c.shard_time, (shard + 1) * c.shard_time)])
                self.send(kind, shard, raw)
                if kind == DATA:
                    out.objects.append((self.level.path, f"{shard}/{r}/{q}", len(raw)))
        if k == 0:
            out.changes.append((r, q, self.total, self.n))
        a, b = out.levels.get(k, (0, 0))
        out.levels[k] = (a + self.objects, b + self.size)

    def restore(self, kind: int, t: int) -> None:
        """Have the right anchor at hand for a step without rows: decode it from what was packed."""
        c = self.cube
        star = c.anchor(t)
        if kind != DATA or star == t or (self.anchor is not None and self.anchor[0] == star):
            return
        raw = self.packed.get((DATA, star))
        if raw is not None:
            n = len(c.bands) * c.cell * c.cell
            self.anchor = star, codecs.decode(raw, codecs.chain(self.w.codec, c.dtype, self.w.codec_level), c.dtype, n).reshape(len(c.bands), c.cell, c.cell)

    def old_chunks(self, path: str, shard: int, middle: tuple[int, ...]) -> dict[int, bytes]:
        """Chunks of a shard that an append goes on with, as they are."""
        c = self.cube
        key = f"{path}/c/{'/'.join(map(str, (shard, *middle, self.key[1], self.key[2])))}"
        raw = self.f.get(key)
        if raw is None:
            return {}
        index = codecs.read_index(raw[-codecs.index_bytes(c.shard_time, True) :], c.shard_time, True, len(raw))
        return {shard * c.shard_time + i: raw[e[0] : e[0] + e[1]] for i, e in enumerate(index) if e is not None}


def _packed(cube: M.Cube, since: int) -> str:
    doc = {k: v for k, v in cube.__dict__.items()}
    doc |= {"bands": [b.__dict__ for b in cube.bands], "levels": [k.__dict__ for k in cube.levels], "references": list(cube.references.items())}
    return json.dumps([doc, since])


def _unpacked(text: str) -> tuple[M.Cube, int]:
    doc, since = json.loads(text)
    levels = tuple(M.Level(**{**k, "transform": tuple(k["transform"])}) for k in doc["levels"])
    doc |= {"times": tuple(doc["times"]), "bands": tuple(M.Band(**b) for b in doc["bands"]), "levels": levels, "references": {int(a): b for a, b in doc["references"]}}
    return M.Cube(**doc), since


def _coordinates(c: M.Cube, k: M.Level) -> list[tuple[str, dict, bytes]]:
    """path, metadata and chunk of the coordinate arrays of a level."""
    from stratacube.functions import labels

    t = k.transform
    millis = [round(labels.parse_time(s).timestamp() * 1000) for s in c.times]
    plain = codecs.chain("zstd", "int64")
    strings = [{"name": "vlen-utf8"}, plain[1]]
    names = [b.name for b in c.bands]
    ys, xs = t[5] + (np.arange(k.height) + 0.5) * t[4], t[2] + (np.arange(k.width) + 0.5) * t[0]
    clock = {"units": "milliseconds since 1970-01-01T00:00:00", "calendar": "proleptic_gregorian"}
    out = []
    for dim, values, dtype, extra in (("time", np.array(millis), "int64", clock), ("y", ys, "float64", None), ("x", xs, "float64", None)):
        out.append((f"{k.path}/{dim}", M.array_metadata([len(values)], [len(values)], dtype, 0, plain, [dim], extra), codecs.encode(values, plain, dtype)))
    raw = pa.Codec("zstd", compression_level=5).compress(codecs.vlen_encode(names)).to_pybytes()
    out.append((f"{k.path}/band", M.array_metadata([len(names)], [len(names)], "string", "", strings, ["band"]), raw))
    return out


def _publish(w: StoreWriter, c: M.Cube, changes: Mapping[tuple[int, int], tuple[float, int]], shard_bytes: Mapping | None) -> None:
    """All metadata; the root last."""
    f = Files(w.root)
    nodes: dict[str, dict] = {}
    for k in c.levels:
        nodes[k.path] = {"zarr_format": 3, "node_type": "group", "attributes": M.level_attributes(c, k)}
        for path, meta, raw in _coordinates(c, k):
            nodes[path] = meta
            f.put(f"{path}/c/0", raw)
    chain = lambda dtype: codecs.chain(w.codec, dtype, w.codec_level)
    nodes |= M.cube_arrays(c, chain(c.dtype), chain("uint8"), chain(c.coverage_dtype))
    rows, cols = cells(c.levels[0].height, c.levels[0].width, c.cell)
    grid = np.zeros((rows, cols), "<f4")
    for (r, q), (total, n) in changes.items():
        grid[r, q] = min(1.0, max(0.0, total / n / temporal.FULL_CHANGE)) if n else 0.0
    state = {"totals": [[changes.get((r, q), (0.0, 0))[0] for q in range(cols)] for r in range(rows)], "counts": [[changes.get((r, q), (0.0, 0))[1] for q in range(cols)] for r in range(rows)]}
    plain = codecs.chain("zstd", "float32")
    nodes["volatility"] = M.array_metadata([rows, cols], [rows, cols], "float32", 0.0, plain, ["row", "col"], {"state": state})
    f.put("volatility/c/0/0", codecs.encode(grid, plain, "float32"))
    for path, meta in nodes.items():
        f.put(f"{path}/zarr.json", json.dumps(meta).encode())
    root = {"zarr_format": 3, "node_type": "group", "attributes": M.root_attributes(c, w.block, shard_bytes), "consolidated_metadata": {"kind": "inline", "must_understand": False, "metadata": nodes}}
    f.put("zarr.json", json.dumps(root).encode())


def _shard_bytes(messages: Sequence[Written], old: Mapping | None = None) -> dict | None:
    out: dict[str, dict[str, int]] = {k: dict(v) for k, v in (old or {}).items()}
    for m in messages:
        for path, key, size in m.objects:
            out.setdefault(path, {})[key] = size
    return out or None


def _commit_new(w: StoreWriter, messages: Sequence[Written]) -> None:
    _publish(w, w.cube, _added({}, messages), _shard_bytes(messages))


def _added(changes: dict[tuple[int, int], tuple[float, int]], messages: Sequence[Written]) -> dict[tuple[int, int], tuple[float, int]]:
    """Volatility's sums by cell, with those of all tasks."""
    for m in messages:
        for r, q, total, n in m.changes:
            a, b = changes.get((r, q), (0.0, 0))
            changes[r, q] = (a + total, b + n)
    return changes


def _commit_append(w: StoreWriter, messages: Sequence[Written]) -> None:
    f = Files(w.root)
    state = json.loads(f.get("volatility/zarr.json"))["attributes"]["state"]
    changes = {(r, q): (state["totals"][r][q], state["counts"][r][q]) for r in range(len(state["totals"])) for q in range(len(state["totals"][0]))}
    _added(changes, messages)
    old = M.find_block(json.loads(f.get("zarr.json"))["attributes"]).get("shard_bytes")
    _publish(w, w.cube, changes, _shard_bytes(messages, old))


def _rows(df: DataFrame, cube: M.Cube, since: int = 0) -> tuple[DataFrame, list[DataFrame]]:
    """All levels of df (t, b, y, x, v[, mask, coverage]) as rows for the writer, each part of a cell in one task; and what is kept
    meanwhile: the levels above 0, so that none is computed again for the next one."""
    kept: list[DataFrame] = []

    def keep(one: DataFrame) -> DataFrame:
        kept.append(one.persist(StorageLevel.MEMORY_AND_DISK))
        return one

    floats = cube.dtype == "float32"
    n = len(cube.levels)
    has_mask = cube.mask is not None
    base = df.select("t", "b", "y", "x", "v", *(["mask"] if has_mask else []))
    out = [base.select(F.lit(0).alias("level"), F.lit(DATA).alias("kind"), "t", "b", "y", "x", F.col("v").cast("double").alias("v"))]
    planes: dict[int, DataFrame] = {}
    if has_mask:
        planes[MASK] = df.groupBy("t", "y", "x").agg(F.max("mask").cast("int").alias("mask"))
    if cube.coverage is not None:
        counts = F.coalesce(F.max("coverage"), F.lit(0))
        if cube.coverage_dtype == "uint8":  # before levels are made, which are means of what is stored
            counts = F.least(counts, F.lit(255))
        planes[COVERAGE] = df.groupBy("t", "y", "x").agg(counts.cast("int").alias("coverage"))
    for kind, p in planes.items():
        name = "mask" if kind == MASK else "coverage"
        out.append(p.select(F.lit(0).alias("level"), F.lit(kind).alias("kind"), "t", F.lit(-1).alias("b"), "y", "x", F.col(name).cast("double").alias("v")))
    at, ats = base, dict(planes)
    for k in range(1, n):
        ok = F.col("mask") == 1 if has_mask else F.lit(True) if cube.nodata is None else F.col("v") != F.lit(cube.nodata)
        at = pyramid.reduced(at, ok, value="v", floats=floats, empty=cube.fill)
        if has_mask:
            ats[MASK] = keep(pyramid.reduced_mask(ats[MASK]))
            at = at.join(ats[MASK], ["t", "y", "x"])
        at = keep(at)
        out.append(at.select(F.lit(k).alias("level"), F.lit(DATA).alias("kind"), "t", "b", "y", "x", F.col("v").cast("double").alias("v")))
        if has_mask:
            out.append(ats[MASK].select(F.lit(k).alias("level"), F.lit(MASK).alias("kind"), "t", F.lit(-1).alias("b"), "y", "x", F.col("mask").cast("double").alias("v")))
        if COVERAGE in ats:
            ats[COVERAGE] = keep(pyramid.reduced_coverage(ats[COVERAGE]))
            out.append(ats[COVERAGE].select(F.lit(k).alias("level"), F.lit(COVERAGE).alias("kind"), "t", F.lit(-1).alias("b"), "y", "x", F.col("coverage").cast("double").alias("v")))
    rows = out[0]
    for o in out[1:]:
        rows = rows.unionByName(o)
    rows = rows.withColumn("row", F.floor(F.col("y") / cube.cell).cast("int")).withColumn("col", F.floor(F.col("x") / cube.cell).cast("int"))
    spark = df.sparkSession
    if cube.interval is None:
        rows = rows.withColumn("star", temporal.anchor_of(F.col("t"), len(cube.times), M.NOMINAL_INTERVAL))
    else:
        refs = spark.createDataFrame([(t, a) for t, a in cube.references.items()] or [(-1, -1)], "t int, anchor_t int")
        rows = temporal.with_reference(rows, refs, out="star")
    rows = rows.withColumn("late", (F.col("t") != F.col("star")).cast("int")).withColumn("part", F.col("star") if cube.shard_time is None else F.lit(0))
    keys = ["level", "row", "col", "part"]
    columns = [*keys, "kind", "star", "late", "t", "b", "y", "x", "v"]
    rows = rows.select(*columns).unionByName(_parts(spark, cube, since).select(*columns))
    return rows.repartition(*keys).sortWithinPartitions(*keys, "kind", "star", "late", "t"), kept


def _parts(spark: SparkSession, cube: M.Cube, since: int) -> DataFrame:
    """A row for each part of each cell, so that those without pixels are written as well."""
    schedule = cube.references if cube.interval is not None else temporal.anchor_schedule(len(cube.times), M.NOMINAL_INTERVAL)[1]
    parts = sorted({schedule.get(t, t) for t in range(since, len(cube.times))}) if cube.shard_time is None else [0]
    out = None
    for k, level in enumerate(cube.levels):
        rows, cols = cells(level.height, level.width, cube.cell)
        at = spark.range(rows * cols).select(F.lit(k).alias("level"), F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"), F.explode(F.lit(parts)).alias("part"))
        out = at if out is None else out.unionByName(at)
    nothing = {"kind": CELL, "star": 0, "late": 0, "t": -1, "b": -1, "y": 0, "x": 0}
    return out.select("*", *[F.lit(v).alias(c) for c, v in nothing.items()], F.lit(0.0).alias("v"))


def write(df: DataFrame, path: str, cube: M.Cube, codec: str = "zstd", level: int | None = None, block: str = M.BLOCK) -> None:
    """A new store of df (t, b, y, x, v and, where the cube has them, mask and coverage); pixels that lack are fill.

    Refuses a folder that isn't empty. If the job fails, what it wrote goes.
    """
    if not Files(path).empty():
        raise FileExistsError(f"{path} isn't empty")
    codecs.chain(codec, cube.dtype, level)
    _write(df, path, cube, 0, codec, level, block)


def append(df: DataFrame, path: str, times: Sequence[str], codec: str = "zstd", level: int | None = None) -> M.Cube:
    """Steps len(old).. of df (t counts on from the stored ones) go after those of a store; stored chunks stay as they are.

    Raises, listing all that differs, if df doesn't fit the store.
    """
    cube, _, attributes = load(path)
    block = next(k for k, v in attributes.items() if isinstance(v, Mapping) and "spec_version" in v)
    n = len(cube.times)
    problems = append_problems(df, cube, times)
    if problems:
        raise ValueError("; ".join(problems))
    grown = M.extended(cube, times)
    _write(df, path, grown, n, codec, level, block)
    return grown


def append_problems(df: DataFrame, cube: M.Cube, times: Sequence[str]) -> list[str]:
    """Every way in which df can't go on with a cube; nothing has been written then."""
    from stratacube.functions import labels

    out = []
    for name, there in (("mask", cube.mask), ("coverage", cube.coverage)):
        if (name in df.columns) != (there is not None):
            out.append(f"{name}: the store has {'one, the input none' if there else 'none, the input one'}")
    if not times or labels.parse_time(times[0]) <= labels.parse_time(cube.times[-1]):
        out.append(f"times: the input starts at {times[0] if times else 'nothing'}, which is not after {cube.times[-1]}")
    lo, hi, bands, h, w = df.agg(F.min("t"), F.max("t"), F.max("b"), F.max("y"), F.max("x")).first()
    n = len(cube.times)
    if lo is None or lo < n or hi >= n + len(times):
        out.append(f"steps: the input has {lo} to {hi}, expected within {n} to {n + len(times) - 1}")
    if bands is not None and bands >= len(cube.bands):
        out.append(f"bands: the input has band {bands}, the store {len(cube.bands)} bands")
    if h is not None and (h >= cube.levels[0].height or w >= cube.levels[0].width):
        out.append(f"grid: the input reaches row {h}, column {w} of {cube.levels[0].height} x {cube.levels[0].width}")
    return out


def _write(df: DataFrame, path: str, cube: M.Cube, since: int, codec: str, level: int | None, block: str) -> None:
    register(df.sparkSession)
    rows, kept = _rows(df, cube, since)
    try:
        w = rows.write.format(FORMAT).mode("append").option("path", path).option("cube", _packed(cube, since)).option("codec", codec).option("block", block)
        (w.option("level", str(level)) if level is not None else w).save()
    finally:
        for one in kept:
            one.unpersist()
