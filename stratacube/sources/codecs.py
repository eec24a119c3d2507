"""Bytes of chunks: compressors, blosc frames, shard indexes, checksums. No package beyond pyarrow and numpy is needed."""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa

#: Types of stored data, as numpy reads them.
DTYPES = {"uint8": "<u1", "uint16": "<u2", "int16": "<i2", "int32": "<i4", "int64": "<i8", "float32": "<f4", "float64": "<f8"}
#: Offset and length of a chunk that isn't in its shard.
EMPTY = 2**64 - 1
#: Compression levels: least, most, default.
LEVELS = {"zstd": (1, 22, 5), "blosc-zstd-shuffle": (0, 9, 1)}


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0x82F63B78 if n & 1 else 0)
        out.append(n)
    return out


_CRC = _crc_table()


def crc32c(data: bytes) -> int:
    """Castagnoli's CRC."""
    c = 0xFFFFFFFF
    for b in data:
        c = _CRC[(c ^ b) & 255] ^ (c >> 8)
    return c ^ 0xFFFFFFFF


class CorruptShard(ValueError):
    """An index that can't be right: its length, checksum or an entry."""


def index_bytes(n: int, checked: bool) -> int:
    return 16 * n + 4 * checked


def read_index(raw: bytes, n: int, checked: bool, shard_bytes: int | None = None) -> list[tuple[int, int] | None]:
    """(offset, length) of each inner chunk, None for those that aren't there."""
    if len(raw) != index_bytes(n, checked):
        raise CorruptShard(f"the index has {len(raw)} bytes, not {index_bytes(n, checked)}")
    if checked and struct.unpack("<I", raw[-4:])[0] != crc32c(raw[: 16 * n]):
        raise CorruptShard("the index doesn't match its checksum")
    out: list[tuple[int, int] | None] = []
    for at, size in struct.iter_unpack("<QQ", raw[: 16 * n]):
        if (at, size) == (EMPTY, EMPTY):
            out.append(None)
            continue
        if shard_bytes is not None and at + size > shard_bytes:
            raise CorruptShard(f"an entry ends at byte {at + size} of {shard_bytes}")
        out.append((at, size))
    return out


def write_shard(chunks: Sequence[bytes | None]) -> bytes:
    """Inner chunks one after the other, then the index with its checksum."""
    body, index = [], []
    at = 0
    for c in chunks:
        index.append(struct.pack("<QQ", EMPTY, EMPTY) if c is None else struct.pack("<QQ", at, len(c)))
        if c is not None:
            body.append(c)
            at += len(c)
    raw = b"".join(index)
    return b"".join(body) + raw + struct.pack("<I", crc32c(raw))


def index_range(n: int, checked: bool, at_start: bool, shard_bytes: int | None) -> tuple[int | None, int]:
    """(offset, length) of the read that gets an index; no offset means the last bytes of the shard."""
    size = index_bytes(n, checked)
    if at_start:
        return 0, size
    return (shard_bytes - size, size) if shard_bytes is not None and shard_bytes >= size else (None, size)


def _lz4_block(raw: bytes, size: int) -> bytes:
    return pa.Codec("lz4_raw").decompress(raw, size).to_pybytes()


def _zstd(raw: bytes, size: int) -> bytes:
    return pa.Codec("zstd").decompress(raw, size).to_pybytes()


def shuffled(raw: bytes, width: int) -> bytes:
    """Bytes of items of a width, first all first bytes, then all second ones."""
    n = len(raw) // width * width
    return np.frombuffer(raw, np.uint8, n).reshape(-1, width).T.tobytes() + raw[n:]


def unshuffled(raw: bytes, width: int) -> bytes:
    n = len(raw) // width * width
    return np.frombuffer(raw, np.uint8, n).reshape(width, -1).T.tobytes() + raw[n:]


# Fixed values of blosc frames (version 2 of the format): flags of the header and numbers of the compressors.
BLOSC_SHUFFLE, BLOSC_PLAIN, BLOSC_BITSHUFFLE, BLOSC_WHOLE = 0x1, 0x2, 0x4, 0x10
BLOSC_CODECS = {1: _lz4_block, 3: lambda raw, size: zlib.decompress(raw), 4: _zstd}


def blosc_decode(raw: bytes) -> bytes:
    _, _, flags, width, size, block, total = struct.unpack("<BBBBIII", raw[:16])
    if total != len(raw):
        raise ValueError(f"a blosc frame of {total} bytes comes as {len(raw)}")
    if flags & BLOSC_PLAIN:
        return raw[16 : 16 + size]
    if flags & BLOSC_BITSHUFFLE:
        raise ValueError("blosc's bit shuffle isn't supported")
    codec = BLOSC_CODECS.get(flags >> 5)
    if codec is None:
        raise ValueError(f"blosc's compressor {flags >> 5} isn't supported")
    n = -(-size // block) if block else 0
    out = []
    for k, at in enumerate(struct.unpack(f"<{n}I", raw[16 : 16 + 4 * n])):
        length = min(block, size - k * block)
        last_short = length < block
        streams = 1 if flags & BLOSC_WHOLE or last_short or width < 2 or width > 16 or block // width < 128 else width
        parts = []
        for _ in range(streams):
            packed = struct.unpack("<i", raw[at : at + 4])[0]
            at += 4
            want = length // streams
            parts.append(raw[at : at + packed] if packed == want else codec(raw[at : at + packed], want))
            at += packed
        data = b"".join(parts)
        out.append(unshuffled(data, width) if flags & BLOSC_SHUFFLE and width > 1 else data)
    return b"".join(out)


def blosc_encode(raw: bytes, width: int, level: int) -> bytes:
    """One block, bytes shuffled, zstd."""
    flags = 4 << 5 | BLOSC_WHOLE | (BLOSC_SHUFFLE if width > 1 else 0)
    body = shuffled(raw, width) if width > 1 else raw
    packed = pa.Codec("zstd", compression_level=max(1, 2 * level)).compress(body).to_pybytes() if level else body
    if not level or len(packed) >= len(body):
        return struct.pack("<BBBBIII", 2, 1, flags | BLOSC_PLAIN, width, len(raw), len(raw), 16 + len(raw)) + raw
    return struct.pack("<BBBBIII", 2, 1, flags, width, len(raw), len(raw), 24 + len(packed)) + struct.pack("<Ii", 20, len(packed)) + packed


def decode(raw: bytes, codecs: Sequence[Mapping], dtype: str, elements: int) -> np.ndarray:
    """The values of one chunk, by its chain: little-endian bytes, then at most one of each compressor."""
    first, *rest = codecs
    if first["name"] != "bytes" or np.dtype(DTYPES[dtype]).itemsize > 1 and (first.get("configuration") or {}).get("endian", "little") != "little":
        raise ValueError(f"the codecs {[c['name'] for c in codecs]} don't begin with little-endian bytes")
    size = elements * np.dtype(DTYPES[dtype]).itemsize
    for c in reversed(rest):
        match c["name"]:
            case "zstd":
                raw = _zstd(raw, size)
            case "gzip":
                raw = gzip.decompress(raw)
            case "zlib":
                raw = zlib.decompress(raw)
            case "blosc":
                raw = blosc_decode(raw)
            case "lz4":
                raw = _lz4_block(raw[4:], struct.unpack("<I", raw[:4])[0])
            case "crc32c":
                if struct.unpack("<I", raw[-4:])[0] != crc32c(raw[:-4]):
                    raise ValueError("a chunk doesn't match its checksum")
                raw = raw[:-4]
            case name:
                raise ValueError(f"the codec {name!r} isn't supported")
    if len(raw) != size:
        raise ValueError(f"a chunk decodes to {len(raw)} bytes, not {size}")
    return np.frombuffer(raw, DTYPES[dtype])


def chain(codec: str, dtype: str, level: int | None = None) -> list[dict]:
    """The codecs of a new array: zstd, or blosc-zstd-shuffle, at a level."""
    if codec not in LEVELS:
        raise ValueError(f"no codec {codec!r}; there are {', '.join(LEVELS)}")
    lo, hi, default = LEVELS[codec]
    level = default if level is None else level
    if not lo <= level <= hi:
        raise ValueError(f"{codec} has levels {lo} to {hi}, not {level}")
    width = np.dtype(DTYPES[dtype]).itemsize
    first = {"name": "bytes", "configuration": {"endian": "little"}} if width > 1 else {"name": "bytes"}
    if codec == "zstd":
        return [first, {"name": "zstd", "configuration": {"level": level, "checksum": False}}]
    return [first, {"name": "blosc", "configuration": {"cname": "zstd", "clevel": level, "shuffle": "shuffle", "typesize": width, "blocksize": 0}}]


def encode(values: np.ndarray, codecs: Sequence[Mapping], dtype: str) -> bytes:
    raw = np.ascontiguousarray(values, DTYPES[dtype]).tobytes()
    for c in codecs[1:]:
        conf = c.get("configuration") or {}
        match c["name"]:
            case "zstd":
                raw = pa.Codec("zstd", compression_level=conf.get("level", 5)).compress(raw).to_pybytes()
            case "blosc":
                raw = blosc_encode(raw, conf["typesize"], conf["clevel"])
            case "gzip":
                raw = gzip.compress(raw, conf.get("level", 5), mtime=0)
            case name:
                raise ValueError(f"the codec {name!r} isn't written")
    return raw


def vlen_encode(names: Sequence[str]) -> bytes:
    """Strings as the vlen-utf8 codec stores them: their number, then each with its length."""
    parts = [struct.pack("<I", len(names))]
    for n in names:
        raw = n.encode("utf-8")
        parts += [struct.pack("<I", len(raw)), raw]
    return b"".join(parts)


def vlen_decode(raw: bytes) -> list[str]:
    (n,), at, out = struct.unpack("<I", raw[:4]), 4, []
    for _ in range(n):
        (size,) = struct.unpack("<I", raw[at : at + 4])
        out.append(raw[at + 4 : at + 4 + size].decode("utf-8"))
        at += 4 + size
    return out
