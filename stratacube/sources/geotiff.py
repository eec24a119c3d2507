"""GeoTIFF files without a package: tiled or striped, stored or compressed (deflate, LZW, PackBits, Zstandard), one file per step.

Covers what exports need and what simple sources have: 8- and 16-bit whole numbers and 32-bit floats, chunky or planar,
predictors 1 to 3, pixel scale and tie point, EPSG code, nodata, band names, scales and offsets. Other compressions and
rotated grids are refused by name.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from xml.sax.saxutils import escape, unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacube.functions import labels
from stratacube.functions.geometry import Transform
from stratacube.operators.ingest import nodata_tag
from stratacube.shipping import ship
from stratacube.sources.files import Files
from stratacube.sources.metadata import Cube

#: Type codes of TIFF's fields: struct format and bytes.
_TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8)}
# Fixed values of the format: tags.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_W, TILE_H, TILE_AT, TILE_BYTES, EXTRA, FORMAT = 322, 323, 324, 325, 338, 339
PIXEL_SCALE, TIE_POINT, GEO_KEYS, GDAL_META, GDAL_NODATA = 33550, 33922, 34735, 42112, 42113
STORED, LZW, DEFLATE, PACK_BITS, OLD_DEFLATE, ZSTD = 1, 5, 8, 32773, 32946, 50000
TILE = 256


@dataclass(frozen=True)
class Image:
    values: np.ndarray  # [band, y, x]
    transform: Transform | None
    epsg: int | None
    nodata: float | None
    names: tuple[str, ...]
    scales: tuple[float, ...]
    offsets: tuple[float, ...]
    tags: dict[str, str]


def encode(values: np.ndarray, transform: Transform, crs: str, nodata: float | None = None, names: Sequence[str] = (), scales: Sequence[float] = (), offsets: Sequence[float] = (), tags: dict[str, str] | None = None) -> bytes:
    """One file: planar, tiled, deflate with horizontal differences for whole numbers."""
    m, h, w = values.shape
    size = values.dtype.itemsize
    whole = values.dtype.kind in "ui"
    tiles = []
    for b in range(m):
        for y in range(0, h, TILE):
            for x in range(0, w, TILE):
                tile = np.zeros((TILE, TILE), values.dtype)
                part = values[b, y : y + TILE, x : x + TILE]
                tile[: part.shape[0], : part.shape[1]] = part
                if whole:
                    tile = np.diff(tile, axis=1, prepend=np.zeros((TILE, 1), values.dtype))
                tiles.append(zlib.compress(tile.astype(values.dtype.newbyteorder("<")).tobytes(), 6))
    items = [f'<Item name="{escape(k)}">{escape(v)}</Item>' for k, v in (tags or {}).items()]
    for role, column in (("description", names), ("scale", scales), ("offset", offsets)):
        items += [f'<Item name="{role.upper()}" sample="{i}" role="{role}">{escape(str(v))}</Item>' for i, v in enumerate(column)]
    code = int(crs.split(":")[1]) if re.fullmatch(r"EPSG:\d+", crs) else 0
    geographic = 4000 <= code < 5000
    keys = [1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, code]
    kind = {"u": 1, "i": 2, "f": 3}[values.dtype.kind]
    fields: list[tuple[int, int, Sequence | bytes]] = [
        (WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [8 * size] * m), (COMPRESSION, 3, [DEFLATE]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [m]), (PLANAR, 3, [2]), (PREDICTOR, 3, [2 if whole else 1]),
        (TILE_W, 3, [TILE]), (TILE_H, 3, [TILE]), (TILE_AT, 4, [0] * len(tiles)), (TILE_BYTES, 4, [len(t) for t in tiles]), (FORMAT, 3, [kind] * m),
        (PIXEL_SCALE, 12, [transform[0], -transform[4], 0.0]), (TIE_POINT, 12, [0.0, 0.0, 0.0, transform[2], transform[5], 0.0]), (GEO_KEYS, 3, keys),
    ]
    if m > 1:
        fields.append((EXTRA, 3, [0] * (m - 1)))
    if items:
        fields.append((GDAL_META, 2, ("<GDALMetadata>" + "".join(items) + "</GDALMetadata>\0").encode()))
    if nodata is not None:
        fields.append((GDAL_NODATA, 2, f"{nodata:.17g}\0".encode()))
    fields.sort(key=lambda f: f[0])
    head = 8 + 2 + 12 * len(fields) + 4
    packed = {tag: (v if isinstance(v, bytes) else struct.pack(f"<{len(v)}{_TYPES[k][0]}", *v)) for tag, k, v in fields}
    place, at = {}, head
    for tag, raw in packed.items():
        if len(raw) > 4:
            place[tag] = at
            at += len(raw) + len(raw) % 2
    starts = [at + s for s in np.cumsum([0, *map(len, tiles)])[:-1].tolist()]
    packed[TILE_AT] = struct.pack(f"<{len(starts)}I", *starts)
    out = [b"II*\0", struct.pack("<I", 8), struct.pack("<H", len(fields))]
    for tag, k, v in fields:
        raw = packed[tag]
        n = len(raw) // _TYPES[k][1]
        out.append(struct.pack("<HHI", tag, k, n) + (struct.pack("<I", place[tag]) if tag in place else raw.ljust(4, b"\0")))
    out.append(b"\0\0\0\0")
    out += [raw + b"\0" * (len(raw) % 2) for tag, raw in packed.items() if tag in place]
    return b"".join(out + tiles)


def unpack_bits(raw: bytes) -> bytes:
    """Runs: a count up to 127 and one byte more than that as they are, or 257 less a count of one byte."""
    out, at = [], 0
    while at < len(raw):
        n, at = raw[at], at + 1
        if n < 128:
            out.append(raw[at : at + n + 1])
            at += n + 1
        elif n > 128:
            out.append(raw[at : at + 1] * (257 - n))
            at += 1
    return b"".join(out)


def unpack_lzw(raw: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first; the width grows one entry before the table needs it."""
    clear, end = 256, 257
    plain = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out, last = list(plain), [], b""
    held = bits = 0
    for byte in raw:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        width = min(12, max(9, (len(table) + (1 if last else 0)).bit_length()))
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == end:
            break
        if code == clear:
            table, last = list(plain), b""
            continue
        if code > len(table) or code == len(table) and not last:
            raise ValueError("the LZW data are damaged")
        entry = table[code] if code < len(table) else last + last[:1]
        if last:
            table.append(last + entry[:1])
        out.append(entry)
        last = entry
    return b"".join(out)


#: Decompression by the code of the compression.
UNPACK = {STORED: bytes, LZW: unpack_lzw, DEFLATE: zlib.decompress, PACK_BITS: unpack_bits, OLD_DEFLATE: zlib.decompress, ZSTD: lambda raw: pa.input_stream(pa.BufferReader(raw), compression="zstd").read()}


def decode(raw: bytes) -> Image:
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or struct.unpack(order + "H", raw[2:4])[0] != 42:
        raise ValueError("no classic TIFF file")
    (at,) = struct.unpack(order + "I", raw[4:8])
    (n,) = struct.unpack(order + "H", raw[at : at + 2])
    f: dict[int, tuple] = {}
    for i in range(n):
        tag, kind, count = struct.unpack(order + "HHI", raw[at + 2 + 12 * i : at + 10 + 12 * i])
        if kind not in _TYPES:
            continue
        code, size = _TYPES[kind]
        where = at + 10 + 12 * i
        if size * count > 4:
            (where,) = struct.unpack(order + "I", raw[where : where + 4])
        data = raw[where : where + size * count]
        f[tag] = (data.rstrip(b"\0").decode("utf-8", "replace"),) if kind == 2 else struct.unpack(f"{order}{count}{code}", data)
    w, h, m = f[WIDTH][0], f[HEIGHT][0], f.get(SAMPLES, (1,))[0]
    compression, planar, predictor = f.get(COMPRESSION, (1,))[0], f.get(PLANAR, (1,))[0] == 2, f.get(PREDICTOR, (1,))[0]
    if compression not in UNPACK:
        raise ValueError(f"TIFF compression {compression} isn't supported; {', '.join(map(str, UNPACK))} are")
    bits, form = set(f.get(BITS, (1,))), set(f.get(FORMAT, (1,)))
    if len(bits) != 1 or len(form) != 1 or (key := f"{ {1: 'u', 2: 'i', 3: 'f'}.get(next(iter(form)))}{next(iter(bits)) // 8}") not in ("u1", "u2", "i2", "f4"):
        raise ValueError(f"samples of {sorted(bits)} bits in format {sorted(form)} aren't supported")
    if predictor not in (1, 2, 3) or predictor == 3 and not key.startswith("f"):
        raise ValueError(f"TIFF predictor {predictor} isn't supported")
    dtype = np.dtype(order + key)
    tiled = TILE_AT in f
    bw, bh = (f[TILE_W][0], f[TILE_H][0]) if tiled else (w, f.get(STRIP_ROWS, (h,))[0])
    starts, sizes = (f[TILE_AT], f[TILE_BYTES]) if tiled else (f[STRIP_AT], f[STRIP_BYTES])
    across, down = -(-w // bw), -(-h // bh)
    out = np.zeros((m, h, w), dtype.newbyteorder("="))
    per = 1 if planar else m
    for k, (start, size) in enumerate(zip(starts, sizes, strict=True)):
        if not size:
            continue
        block = raw[start : start + size]
        block = UNPACK[compression](block)
        band, rest = divmod(k, across * down)
        y, x = rest // across * bh, rest % across * bw
        rows = bh if tiled else min(bh, h - y)
        if predictor == 3:  # bytes of a row by significance, the highest first, as differences
            planes = np.cumsum(np.frombuffer(block, np.uint8, rows * bw * per * dtype.itemsize).reshape(rows, -1, per), axis=1, dtype=np.uint8).reshape(rows, dtype.itemsize, -1)
            block = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(dtype.newbyteorder(">")).astype(dtype).tobytes()
        a = np.frombuffer(block, dtype, rows * bw * per).reshape(rows, bw, per).astype(dtype.newbyteorder("="))
        if predictor == 2:
            a = np.cumsum(a, axis=1, dtype=a.dtype)
        a = a[: h - y, : w - x]
        if planar:
            out[band, y : y + a.shape[0], x : x + a.shape[1]] = a[:, :, 0]
        else:
            out[:, y : y + a.shape[0], x : x + a.shape[1]] = a.transpose(2, 0, 1)
    transform = epsg = None
    if PIXEL_SCALE in f and TIE_POINT in f:
        sx, sy, (i, j, _, x, y, _) = f[PIXEL_SCALE][0], f[PIXEL_SCALE][1], f[TIE_POINT][:6]
        transform = (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
    keys = f.get(GEO_KEYS, ())
    for i in range(4, len(keys), 4):
        if keys[i] in (2048, 3072) and keys[i + 1] == 0 and keys[i + 3] < 32767:
            epsg = keys[i + 3]
    text = f.get(GDAL_META, ("",))[0]
    found = [(m[1], m[2], unescape(m[3])) for m in re.finditer(r'<Item name="([^"]*)"([^>]*)>(.*?)</Item>', text, re.S)]
    by_role = lambda role: {int(re.search(r'sample="(\d+)"', a)[1]): v for _, a, v in found if f'role="{role}"' in a and "sample=" in a}
    names, scales, offsets = by_role("description"), by_role("scale"), by_role("offset")
    nodata = f.get(GDAL_NODATA, (None,))[0]
    return Image(
        out, transform, epsg or None, float(nodata) if nodata not in (None, "") else None, tuple(names.get(i, f"band{i + 1}") for i in range(m)),
        tuple(float(scales.get(i, 1)) for i in range(m)), tuple(float(offsets.get(i, 0)) for i in range(m)), {n: v for n, a, v in found if "sample=" not in a},
    )


def export(df: DataFrame, folder: str, cube: Cube, level: int = 0, physical: bool = False) -> DataFrame:
    """t, file: one GeoTIFF per step of df (t, b, y, x, v[, mask]) in a folder; a step's pixels meet in one task.

    The nodata tag is left out where the mask calls a pixel valid that holds that value. With physical, values are scaled
    32-bit floats and invalid pixels NaN.
    """
    spark = df.sparkSession
    k = cube.levels[level]
    names, scales, offsets = ([getattr(b, a) for b in cube.bands] for a in ("name", "scale", "offset"))
    masked = cube.mask is not None
    dtype = {"uint8": "u1", "uint16": "u2", "int16": "i2", "float32": "f4"}[cube.dtype]
    rows = df.select("t", "b", "y", "x", F.col("v").cast("double").alias("v"), (F.col("mask") if masked else F.lit(1)).alias("mask"))
    if masked and cube.nodata is not None:
        tags = nodata_tag(rows, int(cube.nodata), F.col("mask") == 1).select("t", F.col("collides").alias("clash"))
        rows = rows.join(tags, "t")
    else:
        rows = rows.withColumn("clash", F.lit(False))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["t"].iloc[0])
        plane = np.full((len(names), k.height, k.width), np.nan if physical else cube.fill, "f4" if physical else dtype)
        b, y, x, v = (pdf[c].to_numpy() for c in ("b", "y", "x", "v"))
        if physical:
            ok = pdf["mask"].to_numpy() == 1 if masked else np.ones(len(v), bool) if cube.nodata is None else v != cube.nodata
            plane[b[ok], y[ok], x[ok]] = v[ok].astype("f4") * np.asarray(scales, "f4")[b[ok]] + np.asarray(offsets, "f4")[b[ok]]
        else:
            plane[b, y, x] = v
        tag = float("nan") if physical else None if cube.nodata is None or bool(pdf["clash"].iloc[0]) else float(cube.nodata)
        stem = cube.times[t][:10] if re.fullmatch(r"T?[0:.]*Z?", cube.times[t][10:]) else cube.times[t].replace(":", "")
        raw = encode(plane, k.transform, cube.crs, tag, names, () if physical else scales, () if physical else offsets, {"TIME": cube.times[t], "LEVEL": str(level), "TIMESTEP": str(t)})
        Files(folder).put(f"L{level}_{stem}.tif", raw)
        return pd.DataFrame({"t": [t], "file": [f"{folder}/L{level}_{stem}.tif"]})

    ship(spark)
    files = rows.groupBy("t").applyInPandas(one, "t int, file string")
    done = files.collect()  # a row per file; also so that files are written once
    return spark.createDataFrame(done, "t int, file string")


def read(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """t, b, y, x, v (double), file of GeoTIFF files; t counts the files in the order of the dates in their names."""
    found = spark.read.format("binaryFile").load(list(paths) if not isinstance(paths, str) else paths).select("path", "content")
    order = sorted((r["day"] or "", r["path"]) for r in found.select("path", labels.name_date(F.col("path")).cast("string").alias("day")).collect())  # a row per step
    steps = spark.createDataFrame([(p, i) for i, (_, p) in enumerate(order)], "path string, step int")

    def pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw, step in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                image = decode(raw)
                tagged = image.tags.get("TIMESTEP")
                m, h, w = image.values.shape
                y, x = np.meshgrid(np.arange(h, dtype=np.int32), np.arange(w, dtype=np.int32), indexing="ij")
                for b in range(m):
                    n = h * w
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, int(tagged) if tagged else step, np.int32)), pa.array(np.full(n, b, np.int32)), pa.array(y.ravel()), pa.array(x.ravel()), pa.array(image.values[b].ravel().astype(np.float64)), pa.array([path] * n)], ["t", "b", "y", "x", "v", "file"])

    ship(spark)
    return found.join(steps, "path").select("path", "content", "step").mapInArrow(pixels, "t int, b int, y int, x int, v double, file string")
