"""Command line: ``python -m stratacube.cli COMMAND ...``."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from stratacube.functions import labels
from stratacube.operators import convert, validate
from stratacube.sources import geotiff, manifest, png, stac, store
from stratacube.sources import metadata as M


def _numbers(text: str, n: int) -> tuple[float, ...]:
    parts = tuple(float(p) for p in text.split(","))
    if len(parts) != n:
        raise argparse.ArgumentTypeError(f"{n} numbers separated by commas are needed, not {text!r}")
    return parts


def _nodata(text: str):
    return text if text == "auto" else None if text == "none" else float(text)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stratacube")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, help_: str, *paths: str):
        c = sub.add_parser(name, help=help_)
        for x in paths:
            c.add_argument(x)
        return c

    for name, help_ in (("encode", "GeoTIFF files to a new store"), ("append", "GeoTIFF files after the last step of a store")):
        c = command(name, help_, "files", "store")
        c.add_argument("--times", type=lambda t: t.split(","), help="ISO times; by default from the files' names")
        c.add_argument("--codec", default="zstd", choices=["zstd", "blosc-zstd-shuffle"])
        c.add_argument("--level", type=int)
        if name == "encode":
            c.add_argument("--encoding", default="auto", choices=["auto", "none", "star-delta"])
            c.add_argument("--anchor-interval", type=int, default=6)
            c.add_argument("--chunk-size", type=int, default=512)
            c.add_argument("--shard-time", type=int)
            c.add_argument("--bands", type=lambda t: t.split(","))
            c.add_argument("--crs")
            c.add_argument("--nodata", type=_nodata, default="auto")
    command("validate", "list what is wrong with a store", "store")
    command("info", "describe a store", "store")
    command("doctor", "check a store by reading it", "store")
    c = command("export", "one GeoTIFF per step", "store", "folder")
    c.add_argument("--lod", type=int, default=0)
    c.add_argument("--times", nargs="*", default=[])
    c.add_argument("--physical", action="store_true")
    c = command("stac", "write STAC documents", "store", "folder")
    c.add_argument("--href")
    c.add_argument("--id")
    c = command("convert", "a manifest of GeoTIFF or PNG files to a store", "manifest", "store")
    c.add_argument("--work", required=True, help="folder for staged steps; a second run goes on there")
    c.add_argument("--crs")
    c.add_argument("--bounds", type=lambda t: _numbers(t, 4))
    c.add_argument("--chunk-size", type=int, default=512)
    c.add_argument("--encoding", default="auto", choices=["auto", "none", "star-delta"])
    c.add_argument("--dry-run", action="store_true")
    return p


def _first(spark, path: str) -> geotiff.Image:
    raw = spark.read.format("binaryFile").load(path).orderBy("path").select("content").first()[0]
    return geotiff.decode(bytes(raw))


def _steps(spark, df, times):
    n = df.agg({"t": "max"}).first()[0] + 1
    if times is None:
        found = df.select("t", labels.name_date(df["file"]).cast("string").alias("day")).distinct().orderBy("t").collect()
        times = [f"{r['day']}T00:00:00Z" for r in found]
    if len(times) != n:
        raise SystemExit(f"{len(times)} times for {n} files")
    return times


def main(argv: Sequence[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    if args.command == "validate":
        found = validate.problems(args.store)
        print("\n".join(found) or "valid")
        return int(bool(found))
    if args.command == "info":
        cube, _, _ = store.load(args.store)
        print(json.dumps({"times": [len(cube.times), cube.times[0], cube.times[-1]], "bands": [b.name for b in cube.bands], "dtype": cube.dtype, "crs": cube.crs, "encoding": cube.encoding, "cell": cube.cell, "levels": [[k.height, k.width, k.resolution] for k in cube.levels], "mask": cube.mask, "coverage": cube.coverage, "nodata": cube.nodata}, indent=1))
        return 0
    if args.command == "stac":
        cube, _, _ = store.load(args.store)
        print("\n".join(stac.write(cube, args.href or args.store, args.folder, args.id)))
        return 0
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "doctor":
        rows = validate.doctor(spark, args.store).collect()
        for r in rows:
            print(f"{r['status']:5} {r['name']}: {r['detail']}" + (f" ({r['hint']})" if r["hint"] else ""))
        for name, status, detail in validate.served(args.store):
            print(f"{status:5} {name}: {detail}")
        return int(any(r["status"] == "fail" for r in rows))
    if args.command == "export":
        cube, _, _ = store.load(args.store)
        chosen = labels.select_times(args.times, cube.times)
        df = store.read(spark, args.store, args.lod)
        for r in geotiff.export(df.filter(df["t"].isin(chosen)), args.folder, cube, args.lod, args.physical).collect():
            print(r["file"])
        return 0
    if args.command == "encode":
        image, df = _first(spark, args.files), geotiff.read(spark, args.files)
        m, h, w = image.values.shape
        dtype = str(image.values.dtype)
        crs = args.crs or (f"EPSG:{image.epsg}" if image.epsg else None)
        if crs is None or image.transform is None:
            raise SystemExit("the files have no reference system or transform; pass --crs")
        nodata = image.nodata if args.nodata == "auto" and image.nodata is not None else M.default_nodata(dtype, False) if args.nodata == "auto" else args.nodata
        bands = args.bands or [M.Band(n, None, s, o) for n, s, o in zip(image.names, image.scales, image.offsets, strict=True)]
        times = _steps(spark, df, args.times)
        cube = M.new_cube(times, bands, crs, image.transform, h, w, dtype, args.chunk_size, nodata=nodata, shard_time=args.shard_time)
        pixels = df.drop("file")
        keep, how = args.encoding == "star-delta", None
        if args.encoding == "auto" and dtype in M.DELTA_BITS:
            keep, how = convert.choose_encoding(pixels, cube, args.anchor_interval)
        cube = M.new_cube(times, bands, crs, image.transform, h, w, dtype, args.chunk_size, nodata=nodata, shard_time=args.shard_time, interval=args.anchor_interval if keep else None, selection=how)
        store.write(pixels, args.store, cube, args.codec, args.level)
        print(f"{args.store}: {len(times)} steps, {cube.encoding}")
        return 0
    if args.command == "append":
        from pyspark.sql import functions as F

        old, _, _ = store.load(args.store)
        df = geotiff.read(spark, args.files)
        times = _steps(spark, df, args.times)
        grown = store.append(df.withColumn("t", F.col("t") + len(old.times)).drop("file"), args.store, times, args.codec, args.level)
        print(f"{args.store}: {len(grown.times)} steps")
        return 0
    rows, names, bounds = manifest.read(spark, args.manifest)
    listed = [(r["t"], r["uri"], r["iso"]) for r in rows.select("t", "uri", "iso").orderBy("t").collect()]  # a row per step
    steps = spark.createDataFrame([(t, u) for t, u, _ in listed], "t int, uri string")
    first = listed[0][1]
    if first.lower().endswith(".png"):
        folder, name = first.rsplit("/", 1)
        shape = png.decode(store.files(folder).get(name)).shape
        transform = png.georeference(first, shape[1], shape[2], args.bounds or bounds)
        alpha = shape[0] in (2, 4)
        m, dtype, crs, h, w = shape[0] - alpha, "uint8", args.crs, shape[1], shape[2]

        def read(some):
            out = png.read(spark, steps.filter(steps["t"].isin(list(some))))
            return out if alpha else out.drop("mask")

        extra = {"mask": "mask"} if alpha else {"nodata": None}
    else:
        image = _first(spark, first)
        m, h, w = image.values.shape
        transform, dtype, crs = image.transform, str(image.values.dtype), args.crs or (f"EPSG:{image.epsg}" if image.epsg else None)

        def read(some):
            found = geotiff.read(spark, [u for t, u, _ in listed if t in set(some)])
            order = spark.createDataFrame([(t, u.rsplit("/", 1)[1]) for t, u, _ in listed], "step int, name string")
            from pyspark.sql import functions as F

            return found.withColumn("name", F.substring_index("file", "/", -1)).join(order, "name").select(F.col("step").alias("t"), "b", "y", "x", "v")

        extra = {"nodata": image.nodata}
    if crs is None or transform is None:
        raise SystemExit("the files have no reference system or transform; pass --crs and --bounds")
    cube = M.new_cube([i for *_, i in listed], names or [f"band{i + 1}" for i in range(m)], crs, transform, h, w, dtype, args.chunk_size, **extra)
    done = convert.convert(spark, read, cube, args.store, args.work, args.encoding, dry_run=args.dry_run, source=convert.source_fingerprint(spark, [u for _, u, _ in listed]))
    print("\n".join(done["plan"].lines()))
    print(f"{done['read']} steps read, {done['reused']} found staged")
    return 0


if __name__ == "__main__":
    sys.exit(main())
