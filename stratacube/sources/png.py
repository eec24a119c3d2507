"""PNG frames without a package: 8-bit grey, grey with alpha, RGB and RGBA; georeference from a sidecar or bounds."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from stratacube.functions.geometry import Transform, bounds_transform, north_up
from stratacube.shipping import ship
from stratacube.sources.files import files

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples per pixel by colour type.
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def decode(raw: bytes) -> np.ndarray:
    """[channel, y, x] uint8."""
    if raw[:8] != SIGNATURE:
        raise ValueError("no PNG file")
    at, head, body = 8, None, []
    while at < len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        chunk = raw[at + 8 : at + 8 + size]
        if struct.unpack(">I", raw[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + chunk):
            raise ValueError(f"the chunk {kind.decode('ascii', 'replace')} is damaged")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"IDAT":
            body.append(chunk)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None:
        raise ValueError("the PNG file has no header")
    w, h, depth, colour, _, _, interlace = head
    if colour == 3:
        raise ValueError("PNG files with a palette aren't supported: colours aren't measurements; convert to grey or RGB")
    if depth != 8 or colour not in CHANNELS or interlace:
        raise ValueError(f"PNG files of {depth} bits, colour type {colour}, interlacing {interlace} aren't supported")
    n = CHANNELS[colour]
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, 1 + w * n)
    out = np.zeros((h, w * n), np.uint8)
    before = np.zeros(w * n, np.uint8)
    for y in range(h):
        before = out[y] = _unfiltered(int(lines[y, 0]), lines[y, 1:], before, n)
    return out.reshape(h, w, n).transpose(2, 0, 1)


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, n: int) -> np.ndarray:
    if kind == 0:
        return line.copy()
    if kind == 2:
        return line + above
    if kind == 1:
        return np.cumsum(line.reshape(-1, n), axis=0, dtype=np.uint8).ravel()
    out, up = line.astype(int).tolist(), above.tolist()
    for i in range(len(out)):
        left = out[i - n] if i >= n else 0
        if kind == 3:
            guess = (left + up[i]) // 2
        elif kind == 4:
            corner = up[i - n] if i >= n else 0
            p = left + up[i] - corner
            a, b, c = abs(p - left), abs(p - up[i]), abs(p - corner)
            guess = left if a <= b and a <= c else up[i] if b <= c else corner
        else:
            raise ValueError(f"PNG filter {kind}")
        out[i] = (out[i] + guess) & 255
    return np.array(out, np.uint8)


def world_file(text: str) -> Transform:
    """The transform of a world file: A, D, B, E, then the centre of the upper left pixel."""
    a, d, b, e, x, y = (float(v) for v in text.split())
    return north_up((a, b, x - a / 2 - b / 2, d, e, y - d / 2 - e / 2))


def aux_transform(text: str) -> Transform | None:
    """The transform of a .aux.xml sidecar, None if it has none."""
    m = re.search(r"<GeoTransform>\s*([^<]+?)\s*</GeoTransform>", text)
    if m is None:
        return None
    c, a, b, f, d, e = (float(v) for v in m[1].split(","))
    return north_up((a, b, c, d, e, f))


def georeference(path: str, height: int, width: int, bounds: Sequence[float] | None = None) -> Transform | None:
    """From path.aux.xml, a world file beside it (.pgw, .pngw, .wld), or bounds."""
    folder, name = path.rsplit("/", 1)
    f = files(folder)
    if (aux := f.get(f"{name}.aux.xml")) is not None and (t := aux_transform(aux.decode())) is not None:
        return t
    stem = name.rsplit(".", 1)[0]
    for side in (f"{stem}.pgw", f"{stem}.pngw", f"{stem}.wld"):
        if (raw := f.get(side)) is not None:
            return world_file(raw.decode())
    return bounds_transform(bounds, height, width) if bounds else None


def read(spark: SparkSession, steps: DataFrame) -> DataFrame:
    """t, b, y, x, v, mask of frames (steps: t, uri): alpha other than 0 is valid, and isn't a band."""

    def pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, uri in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folder, name = uri.rsplit("/", 1)
                a = decode(files(folder).get(name))
                bands, mask = (a[:-1], a[-1] != 0) if len(a) in (2, 4) else (a, np.ones(a.shape[1:], bool))
                y, x = np.meshgrid(np.arange(a.shape[1], dtype=np.int32), np.arange(a.shape[2], dtype=np.int32), indexing="ij")
                for b in range(len(bands)):
                    n = y.size
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), pa.array(np.full(n, b, np.int32)), pa.array(y.ravel()), pa.array(x.ravel()), pa.array(bands[b].ravel().astype(np.int32)), pa.array(mask.ravel().astype(np.int32))], ["t", "b", "y", "x", "v", "mask"])

    ship(spark)
    return steps.select("t", "uri").mapInArrow(pixels, "t int, b int, y int, x int, v int, mask int")
