"""From sources to a store: plan, stage one table per step with resume, write."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacube.operators import planning, pyramid, temporal
from stratacube.shipping import ship
from stratacube.sources import codecs, store
from stratacube.sources import metadata as M

#: Raw bytes that are encoded in a second, for estimates.
ENCODE_BYTES_PER_SECOND = 150e6


@dataclass(frozen=True)
class Plan:
    cube: M.Cube
    raw_bytes: int
    ratio: float | None
    output_bytes: int | None
    seconds: float

    def lines(self) -> list[str]:
        c = self.cube
        out = [f"{len(c.times)} steps, {len(c.bands)} bands of {c.dtype}, {c.levels[0].height} x {c.levels[0].width} pixels in {c.crs}, {len(c.levels)} levels", f"{self.raw_bytes / 1e6:.1f} MB of values"]
        if self.output_bytes is not None:
            out.append(f"about {self.output_bytes / 1e6:.1f} MB as a store (ratio {self.ratio:.3f}), {self.seconds:.0f} s to encode")
        return out


def compressed_sizes(df: DataFrame, cube: M.Cube, deltas: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """by (columns of int), row, col, t, plain[, delta]: compressed bytes of the chunks of df's cells; with deltas, also of the differences to each step's anchor."""
    chain = codecs.chain("zstd", cube.dtype)
    interval = cube.interval or M.NOMINAL_INTERVAL
    star = temporal.anchor_of(F.col("t"), len(cube.times), interval)
    keys = [*by, "row", "col"]
    cell = lambda c: F.floor(F.col(c) / cube.cell).cast("int")
    rows = df.withColumn("row", cell("y")).withColumn("col", cell("x")).withColumn("star", star).withColumn("late", (F.col("t") != F.col("star")).cast("int"))
    rows = rows.select(*keys, "star", "late", "t", "b", "y", "x", "v").repartition(*keys, "star").sortWithinPartitions(*keys, "star", "late", "t")
    shape = (len(cube.bands), cube.cell, cube.cell)
    dtype = codecs.DTYPES[cube.dtype]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, of, parts = None, None, []

        def done():
            nonlocal anchor
            *lead, r, c, s, late, t = of
            plane = np.full(shape, cube.fill, dtype)
            table = pa.Table.from_batches(parts)
            b, y, x, v = (table.column(n).to_numpy() for n in "byxv")
            plane[b, y - r * cube.cell, x - c * cube.cell] = v
            plain = len(codecs.encode(plane, chain, cube.dtype))
            if not late:
                anchor = of[:-2], plane
            base = anchor[1] if anchor is not None and anchor[0] == of[:-2] else np.full(shape, cube.fill, dtype)
            delta = len(codecs.encode(plane - base, chain, cube.dtype)) if late and deltas else plain
            return pa.RecordBatch.from_arrays([pa.array([z], k) for z, k in (*((z, pa.int32()) for z in (*lead, r, c, t)), (plain, pa.int64()), (delta, pa.int64()))], [*keys, "t", "plain", "delta"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.stack([batch.column(i).to_numpy() for i in range(len(keys) + 3)], 1)
            cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1).tolist(), len(ids)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                key = tuple(int(z) for z in ids[lo])
                if of is not None and key != of:
                    yield done()
                    parts = []
                of = key
                parts.append(batch.slice(lo, hi - lo))
        if parts:
            yield done()

    ship(df.sparkSession)
    out = rows.mapInArrow(run, ", ".join(f"{k} int" for k in keys) + ", t int, plain long, delta long")
    return out if deltas else out.drop("delta")


def choose_encoding(df: DataFrame, cube: M.Cube, interval: int) -> tuple[bool, dict]:
    """Whether star deltas take at most DELTA_LIMIT of the plain bytes on a sample of cells, and the measurement."""
    k = cube.levels[0]
    rows, cols = -(-k.height // cube.cell), -(-k.width // cube.cell)
    picked = planning.sample_cells(rows, cols)
    cells = df.sparkSession.createDataFrame(picked, "_row int, _col int")
    chosen = df.join(cells, (F.floor(F.col("y") / cube.cell) == F.col("_row")) & (F.floor(F.col("x") / cube.cell) == F.col("_col")), "left_semi")
    measured = M.new_cube(cube.times, cube.bands, cube.crs, k.transform, k.height, k.width, cube.dtype, cube.cell, interval=interval, nodata=cube.nodata)
    total = compressed_sizes(chosen, measured, deltas=True).agg(F.sum("plain"), F.sum("delta")).first()
    keep, ratio = planning.keep_deltas(total[1] or 0, total[0] or 0)
    return keep, {"mode": "auto", "sampled_cells": len(picked), "ratio": ratio}


def plan(df: DataFrame, cube: M.Cube, sample: bool = True) -> Plan:
    """Sizes and times; with sample, from the compressed top-left cell of three steps."""
    k = cube.levels[0]
    step = len(cube.bands) * k.height * k.width * np.dtype(codecs.DTYPES[cube.dtype]).itemsize
    raw = step * len(cube.times)
    ratio = output = None
    if sample:
        few = df.filter(F.col("t").isin(planning.sample_steps(len(cube.times))) & (F.col("y") < cube.cell) & (F.col("x") < cube.cell))
        sizes = compressed_sizes(few, cube).agg(F.avg("plain")).first()[0]
        ratio = float(sizes or 0) / (len(cube.bands) * cube.cell * cube.cell * np.dtype(codecs.DTYPES[cube.dtype]).itemsize)
        pixels = sum(h * w for h, w in pyramid.shapes(k.height, k.width, cube.cell, len(cube.levels)))
        output = int(raw * ratio * pixels / (k.height * k.width))
    return Plan(cube, raw, ratio, output, raw / ENCODE_BYTES_PER_SECOND)


def fingerprint(cube: M.Cube, *more) -> str:
    """Of all that decides what staging produces."""
    return hashlib.sha256(json.dumps([cube.times, [M.band_object(b) for b in cube.bands], cube.crs, cube.dtype, cube.nodata, cube.levels[0].transform, more], sort_keys=True, default=str).encode()).hexdigest()


def source_fingerprint(spark: SparkSession, paths: Sequence[str]) -> str:
    """Of the files that a source reads: their names, lengths and times of change, from the listing alone."""
    rows = spark.read.format("binaryFile").load(list(paths)).select("path", "length", F.unix_micros("modificationTime").alias("changed"))
    digests = rows.select(F.sha2(F.concat_ws("|", "path", "length", "changed"), 256).alias("d"))
    # Sums don't depend on the order, and nothing but them comes to the driver.
    sums = digests.agg(F.count("*").alias("n"), *[F.sum(F.conv(F.substring("d", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(5)]).first()
    return hashlib.sha256(str(tuple(sums)).encode()).hexdigest()


def staged(spark: SparkSession, folder: str, key: str) -> DataFrame | None:
    """What is staged under a plan's fingerprint, None if nothing is."""
    path = f"{folder}/{key}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return spark.read.parquet(path)


def stage(spark: SparkSession, read_step: Callable[[Sequence[int]], DataFrame], n_time: int, folder: str, key: str, batch: int = 16) -> tuple[DataFrame, int, int]:
    """All steps as a table partitioned by step, the steps read now, and those found from an earlier run.

    Steps that are there already (under the same fingerprint) aren't read again; a batch is committed as a whole.
    """
    path = f"{folder}/{key}"
    there = staged(spark, folder, key)
    have = {r["t"] for r in there.select("t").distinct().collect()} if there is not None else set()
    todo = [t for t in range(n_time) if t not in have]
    for i in range(0, len(todo), batch):
        read_step(todo[i : i + batch]).write.mode("append").partitionBy("t").parquet(path)
    return spark.read.parquet(path), len(todo), len(have)


def convert(spark: SparkSession, read_step: Callable[[Sequence[int]], DataFrame], cube: M.Cube, out: str, work: str, encoding: str = "auto", interval: int = 6, codec: str = "zstd", dry_run: bool = False, source: str = "") -> dict:
    """Plan, stage with resume, choose the encoding, write. encoding: auto, none or star-delta.

    source is the fingerprint of what read_step() reads (source_fingerprint()): what was staged of another one isn't used.
    """
    key = fingerprint(cube, source)
    if dry_run:
        return {"plan": plan(read_step(planning.sample_steps(len(cube.times))), cube), "read": 0, "reused": 0}
    df, read, reused = stage(spark, read_step, len(cube.times), work, key)
    df = df.select("t", "b", "y", "x", "v", *[c for c in ("mask", "coverage") if c in df.columns])
    selection = None
    deltas = encoding == "star-delta"
    if encoding == "auto" and cube.dtype in M.DELTA_BITS:
        deltas, selection = choose_encoding(df, cube, interval)
    k = cube.levels[0]
    final = M.new_cube(cube.times, cube.bands, cube.crs, k.transform, k.height, k.width, cube.dtype, cube.cell, interval=interval if deltas else None, nodata=cube.nodata, mask=cube.mask, coverage=cube.coverage, coverage_dtype=cube.coverage_dtype, shard_time=cube.shard_time, provenance=cube.provenance, selection=selection, n_levels=len(cube.levels))
    store.write(df, out, final, codec)
    return {"plan": plan(df, cube, sample=False), "read": read, "reused": reused, "encoding": final.encoding, "selection": selection}


def reference_cost(df: DataFrame, cube: M.Cube, interval: int) -> dict[str, float]:
    """What frozen references cost: bytes of differences to the preceding anchor in place of the nearest one.

    Only steps whose nearest anchor comes later differ. Sizes are those of the chunks a store holds.
    """
    n = len(cube.times)
    nearest = M.new_cube(cube.times, cube.bands, cube.crs, cube.levels[0].transform, cube.levels[0].height, cube.levels[0].width, cube.dtype, cube.cell, interval=interval, nodata=cube.nodata)
    near = compressed_sizes(df, nearest, deltas=True)
    affected = [t for t, a in temporal.anchor_schedule(n, interval)[1].items() if a > t]
    # With the last steps cut off behind each anchor, the preceding anchor is the nearest one: measure block by block.
    block = F.floor(F.col("t") / interval).cast("int")
    parts = df.withColumn("block", block).withColumn("t", F.col("t") % interval)
    short = M.new_cube(cube.times[:interval], cube.bands, cube.crs, cube.levels[0].transform, cube.levels[0].height, cube.levels[0].width, cube.dtype, cube.cell, interval=interval, nodata=cube.nodata)
    prev = compressed_sizes(parts, short, deltas=True, by=["block"]).withColumn("t", F.col("block") * interval + F.col("t"))
    total = near.agg(F.sum("plain"), F.sum("delta"), F.sum(F.when(F.col("t").isin(affected), F.col("delta")))).first()
    other = prev.filter(F.col("t").isin(affected)).agg(F.sum("delta")).first()[0] or 0
    return {"plain": total[0], "nearest": total[1], "affected_steps": len(affected), "affected_nearest": total[2] or 0, "affected_preceding": other, "store_increase": (other - (total[2] or 0)) / total[1] if total[1] else 0.0}
