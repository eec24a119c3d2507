"""Checks of stores: every rule of the format as a row, and what a reader finds when it decodes."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacube.functions import labels
from stratacube.functions.geometry import cells, level_transform
from stratacube.operators import planning
from stratacube.shipping import ship
from stratacube.sources import codecs, store
from stratacube.sources import metadata as M
from stratacube.sources.files import Files, HttpFiles, files

CHECKS = "name string, status string, detail string, hint string"
#: Compressors that data arrays may use.
COMPRESSORS = {"zstd", "blosc"}


def close(a: Iterable[float], b: Iterable[float]) -> bool:
    a, b = list(a), list(b)
    return len(a) == len(b) and all(abs(x - y) <= 1e-9 * max(1.0, abs(x), abs(y)) for x, y in zip(a, b, strict=True))


def _array(f, path: str, nodes: Mapping[str, dict]) -> dict | None:
    raw = f.get(f"{path}/zarr.json")
    return json.loads(raw) if raw is not None else nodes.get(path)


def _plane_codecs(array: Mapping) -> list[str]:
    first = array["codecs"][0]
    chain = first["configuration"]["codecs"] if first["name"] == "sharding_indexed" else array["codecs"]
    return [c["name"] for c in chain]


def problems(path: str, block: str | None = None) -> list[str]:
    """Everything in a store's metadata that isn't as the format asks; empty for a valid store."""
    f = files(path)
    raw = f.get("zarr.json")
    if raw is None:
        return [f"{path} is no Zarr v3 group: there is no zarr.json"]
    doc = json.loads(raw)
    attributes = doc.get("attributes") or {}
    try:
        cube, arrays, _ = store.load(path, block)
    except (M.SchemaError, KeyError, ValueError) as e:
        return [str(e)]
    b = M.find_block(attributes, block)
    out: list[str] = []
    nodes = dict((doc.get("consolidated_metadata") or {}).get("metadata") or {})
    for d in attributes["multiscales"][0]["datasets"]:
        if d.get("crs") not in (None, cube.crs):
            out.append(f"multiscales: level {d['path']} has {d['crs']}, the cube {cube.crs}")
    top = cube.levels[0]
    inner0, shard0 = M.layout(arrays[f"0/{cube.variable}"])
    for i, k in enumerate(cube.levels):
        where = f"level {k.path}"
        group = _array(f, k.path, nodes)
        if group is None:
            out.append(f"{where}: there is no group")
            continue
        at = group.get("attributes") or {}
        if at.get("crs") != cube.crs:
            out.append(f"{where}: crs {at.get('crs')!r} differs from {cube.crs!r}")
        if not close(at.get("transform", [])[:6], level_transform(top.transform, i)):
            out.append(f"{where}: the transform isn't level 0's scaled by {2**i}")
        if not close([at.get("resolution", 0)], [abs(top.transform[0]) * 2**i]):
            out.append(f"{where}: the resolution is {at.get('resolution')}")
        want = (-(-top.height // 2**i), -(-top.width // 2**i))
        if (k.height, k.width) != want:
            out.append(f"{where}: {k.height} x {k.width} pixels, not {want[0]} x {want[1]}")
        data = _array(f, f"{k.path}/{cube.variable}", nodes)
        out += _check_array(data, f"{where}/{cube.variable}", ["time", "band", "y", "x"], cube.dtype, [len(cube.times), len(cube.bands), k.height, k.width], [1, len(cube.bands), inner0[2], inner0[2]], shard0, cube.fill)
        if cube.nodata is not None and (data.get("attributes") or {}).get("nodata") != cube.nodata:
            out.append(f"{where}/{cube.variable}: the attribute nodata isn't {cube.nodata}")
        for plane in filter(None, (cube.mask, cube.coverage)):
            p = _array(f, f"{k.path}/{plane}", nodes)
            if p is None:
                out.append(f"{where}: there is no array {plane}")
            else:
                out += _check_array(p, f"{where}/{plane}", ["time", "y", "x"], "uint8", [len(cube.times), k.height, k.width], [1, inner0[2], inner0[2]], shard0, 0)
        out += _check_coordinates(f, cube, k, nodes)
    for i, (mirror, k) in enumerate(zip(b.get("levels") or [], cube.levels, strict=False)):
        same = mirror.get("path") == k.path and mirror.get("shape") == [len(cube.times), len(cube.bands), k.height, k.width] and mirror.get("grid") == list(cells(k.height, k.width, cube.cell)) and close(mirror.get("transform", []), k.transform)
        if not same:
            out.append(f"levels[{i}] doesn't mirror level {k.path}")
    if b.get("levels") and len(b["levels"]) != len(cube.levels):
        out.append(f"levels lists {len(b['levels'])} levels of {len(cube.levels)}")
    for path_, meta in nodes.items():
        own = f.get(f"{path_}/zarr.json")
        if own is not None and json.loads(own) != meta:
            out.append(f"consolidated metadata of {path_} differs from its own")
    if b.get("shard_bytes"):
        if shard0 is None:
            out.append("shard_bytes is there, but the store has no shards")
        for level, sizes in b["shard_bytes"].items():
            for key, size in sizes.items():
                t, r, c = key.split("/")
                if f.size(f"{level}/{cube.variable}/c/{t}/0/{r}/{c}") != size:
                    out.append(f"shard_bytes: {level}/{key} isn't {size} bytes")
    v = _array(f, b.get("volatility_path", "volatility"), nodes)
    rows, cols = cells(top.height, top.width, cube.cell)
    if v is None:
        out.append("there is no volatility array")
    elif v.get("data_type") != "float32" or v.get("shape") != [rows, cols]:
        out.append(f"volatility is {v.get('data_type')} {v.get('shape')}, not float32 [{rows}, {cols}]")
    return out


def _check_array(a: Mapping | None, where: str, dims: list[str], dtype: str, shape: list[int], chunk: list[int], shard: int | None, fill) -> list[str]:
    if a is None:
        return [f"{where}: there is no array"]
    out = []
    if a.get("dimension_names") != dims or (a.get("attributes") or {}).get("_ARRAY_DIMENSIONS") != dims:
        out.append(f"{where}: dimensions must be {dims}")
    if a.get("data_type") != dtype:
        out.append(f"{where}: data type {a.get('data_type')}, not {dtype}")
    if a.get("shape") != shape:
        out.append(f"{where}: shape {a.get('shape')}, not {shape}")
    inner, own = M.layout(a)
    if inner != chunk:
        out.append(f"{where}: chunks {inner}, not {chunk}")
    if own != shard:
        out.append(f"{where}: shards of {own} steps, not {shard}")
    if a.get("fill_value") != fill:
        out.append(f"{where}: fill value {a.get('fill_value')}, not {fill}")
    names = _plane_codecs(a)
    if len(names) != 2 or names[0] != "bytes" or names[1] not in COMPRESSORS:
        out.append(f"{where}: codecs {names}, not bytes and one of {sorted(COMPRESSORS)}")
    return out


def _check_coordinates(f, cube: M.Cube, k: M.Level, nodes: Mapping[str, dict]) -> list[str]:
    """time, y and x hold what the mirrors say."""
    t = k.transform
    want = {
        "time": np.array([round(labels.parse_time(s).timestamp() * 1000) for s in cube.times], np.int64),
        "y": t[5] + (np.arange(k.height) + 0.5) * t[4],
        "x": t[2] + (np.arange(k.width) + 0.5) * t[0],
    }
    out = []
    for dim, values in want.items():
        a = _array(f, f"{k.path}/{dim}", nodes)
        raw = f.get(f"{k.path}/{dim}/c/0")
        if a is None or raw is None or a["shape"] != [len(values)]:
            out.append(f"level {k.path}/{dim}: it is missing or has another length")
        elif not np.allclose(codecs.decode(raw, a["codecs"], a["data_type"], len(values)), values, rtol=0, atol=1e-6):
            out.append(f"level {k.path}/{dim}: the values aren't those of the {'times' if dim == 'time' else 'pixel centres'}")
    return out


def both_paths(spark: SparkSession, path: str, level: int) -> DataFrame:
    """cells, steps, only_a, only_b: pixels of sampled cells and steps that reading by cell gives and reading the level doesn't, and the other way."""
    cube, arrays, _ = store.load(path)
    k = cube.levels[level]
    picked = planning.sample_cells(*cells(k.height, k.width, cube.cell))
    steps = planning.sample_steps(len(cube.times))
    samples = spark.createDataFrame([(t, r, c) for t in steps for r, c in picked], "t int, row int, col int")

    def pixels(batches):
        one = store.CellReader(path, cube, arrays, level)
        for batch in batches:
            for t, r, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                part = one.values(t, r, c)[:, : k.height - r * cube.cell, : k.width - c * cube.cell]
                b, y, x = (i.ravel() for i in np.indices(part.shape))
                columns = [np.full(part.size, t), b, y + r * cube.cell, x + c * cube.cell]
                yield pa.RecordBatch.from_arrays([*(pa.array(z.astype(np.int32)) for z in columns), pa.array(part.ravel().astype(np.float64))], ["t", "b", "y", "x", "v"])

    ship(spark)
    by_cell = samples.repartition(min(len(steps) * len(picked), spark.sparkContext.defaultParallelism)).mapInArrow(pixels, "t int, b int, y int, x int, v double")
    whole = store.read(spark, path, level).select("t", "b", "y", "x", F.col("v").cast("double").alias("v"))
    where = [F.col("t") == F.col("_t"), F.floor(F.col("y") / cube.cell) == F.col("_row"), F.floor(F.col("x") / cube.cell) == F.col("_col")]
    whole = whole.filter(F.col("t").isin(steps)).join(samples.toDF("_t", "_row", "_col"), where, "left_semi")
    return planning.compared(by_cell, whole).select(F.lit(len(picked)).alias("cells"), F.lit(len(steps)).alias("steps"), "only_a", "only_b")


def doctor(spark: SparkSession, path: str) -> DataFrame:
    """CHECKS rows: metadata, encoding, decoding of each level by two paths, sizes."""
    rows: list[tuple[str, str, str, str]] = []
    found = problems(path)
    rows.append(("metadata", "fail" if found else "ok", "; ".join(found[:5]) or "valid", "see the format's rules" if found else ""))
    if not found:
        cube, arrays, _ = store.load(path)
        raw_bytes = len(cube.times) * len(cube.bands) * cube.levels[0].height * cube.levels[0].width * np.dtype(codecs.DTYPES[cube.dtype]).itemsize
        rows.append(("encoding", "ok", f"{cube.encoding}, {len(cube.times)} steps, {len(cube.levels)} levels, {raw_bytes} bytes of values", ""))
        for i, k in enumerate(cube.levels):
            seen = both_paths(spark, path, i).first()
            same = seen["only_a"] == seen["only_b"] == 0
            rows.append((f"decode level {i}", "ok" if same else "fail", f"{seen['cells']} cells of {seen['steps']} steps: {seen['only_a']} pixels only by cell, {seen['only_b']} only by level", "" if same else "cells and level give different values"))
        if isinstance(files(path), Files):
            inventory = files(path).inventory()
            rows.append(("objects", "ok", f"{len(inventory)} objects, {sum(s for _, s in inventory)} bytes", ""))
    return spark.createDataFrame(rows, CHECKS)


def served(path: str) -> list[tuple[str, str, str]]:
    """(name, status, detail) of what a web server must do for a store: ranges, suffixes, sizes, missing keys."""
    f = files(path)
    if not isinstance(f, HttpFiles):
        return [("http", "skip", f"{path} isn't served over HTTP")]
    whole = f.get("zarr.json")
    if whole is None:
        return [("root", "fail", "there is no zarr.json")]
    out = [("root", "ok", f"{len(whole)} bytes")]
    out.append(("range", "ok" if f.part("zarr.json", 2, 5) == whole[2:7] else "fail", "bytes=2-6"))
    out.append(("suffix", "ok" if f.part("zarr.json", None, 4) == whole[-4:] else "fail", "bytes=-4"))
    out.append(("size", "ok" if f.size("zarr.json") == len(whole) else "fail", "HEAD"))
    out.append(("missing", "ok" if f.get("no/such/key") is None else "fail", "404"))
    return out


def stack_checks(stack: DataFrame, expected: DataFrame, keys: tuple[str, ...] = ("t", "y", "x")) -> DataFrame:
    """name, bad: how many pixels of a water stack (ndwi, water, mask) differ from what is expected, by rule."""
    both = stack.select(*keys, "ndwi", "water", "mask").join(expected.select(*keys, F.col("ndwi").alias("e_ndwi"), F.col("water").alias("e_water"), F.col("mask").alias("e_mask")), list(keys), "full")
    rules = {
        "ndwi is what the bands give": ~F.col("ndwi").eqNullSafe(F.col("e_ndwi")),
        "water is what the threshold gives": ~F.col("water").eqNullSafe(F.col("e_water")),
        "mask is where there were observations": ~F.col("mask").eqNullSafe(F.col("e_mask")),
        "ndwi is within its range": F.coalesce(F.abs("ndwi") > 10_000, F.lit(False)),
        "masked pixels hold 0": F.coalesce((F.col("mask") == 0) & ((F.col("ndwi") != 0) | (F.col("water") != 0)), F.lit(False)),
        "water is 0 or full": F.coalesce(~F.col("water").isin(0, 10_000), F.lit(False)),
    }
    counts = both.agg(*[F.count_if(c).alias(f"_{i}") for i, c in enumerate(rules.values())])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"_{i}").alias("bad")) for i, n in enumerate(rules)])).alias("r")).select("r.*")
