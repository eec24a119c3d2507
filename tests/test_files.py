import http.server
import struct
import threading
import zlib

import numpy as np
import pyarrow as pa
import pytest

from stratacube import cli
from stratacube.operators import inventory, validate
from stratacube.sources import files, geotiff, manifest, png, stac, store
from stratacube.sources import metadata as M

T0 = (10.0, 0.0, 746090.0, 0.0, -10.0, 2540440.0)


def months(n, first=1):
    return [f"2024-{first + i:02}-01T00:00:00Z" for i in range(n)]


@pytest.mark.parametrize("dtype", ["u1", "u2", "i2", "f4"])
def test_geotiff(dtype):
    r = np.random.default_rng(3)
    a = r.integers(0, 200, (3, 300, 270)).astype(dtype) - (100 if dtype == "i2" else 0)
    image = geotiff.decode(geotiff.encode(a, T0, "EPSG:32631", -1.5 if dtype == "f4" else 7, ["x", "y & z", "w"], [1e-4, 1, 2], [0, -0.1, 3], {"TIME": "now"}))
    assert (image.values == a).all() and image.transform == T0 and image.epsg == 32631 and image.nodata == (-1.5 if dtype == "f4" else 7)
    assert image.names == ("x", "y & z", "w") and image.scales == (1e-4, 1.0, 2.0) and image.offsets == (0.0, -0.1, 3.0) and image.tags == {"TIME": "now"}


def test_striped_tiff_and_refusals():
    a = np.arange(5 * 7, dtype=">u2").reshape(5, 7)
    body = a.tobytes()
    fields = [(256, 3, [7]), (257, 3, [5]), (258, 3, [16]), (259, 3, [1]), (262, 3, [1]), (273, 4, [8]), (277, 3, [1]), (278, 3, [5]), (279, 4, [len(body)])]

    def file(fs):
        out = b"MM\0*" + struct.pack(">I", 8 + len(body)) + body + struct.pack(">H", len(fs))
        for tag, kind, v in fs:
            out += struct.pack(">HHI", tag, kind, 1) + (struct.pack(">HH", v[0], 0) if kind == 3 else struct.pack(">I", v[0]))
        return out + b"\0\0\0\0"

    assert (geotiff.decode(file(fields)).values[0] == a).all()
    with pytest.raises(ValueError, match="compression 7"):
        geotiff.decode(file([(t, k, [7] if t == 259 else v) for t, k, v in fields]))
    with pytest.raises(ValueError, match="TIFF"):
        geotiff.decode(b"nothing at all")


def png_file(a, colour, filters=(0, 1, 2, 3, 4)):
    h, w, n = a.shape
    raw, before = b"", np.zeros(w * n, int)
    for y in range(h):
        kind, line = filters[y % len(filters)], a[y].ravel().astype(int)
        left, corner = np.concatenate([np.zeros(n, int), line[:-n]]), np.concatenate([np.zeros(n, int), before[:-n]])
        p = left + before - corner
        d = np.stack([abs(p - left), abs(p - before), abs(p - corner)])
        paeth = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], before, corner))
        guess = [0, left, before, (left + before) // 2, paeth][kind]
        raw += bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes()
        before = line
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_png(tmp_path):
    r = np.random.default_rng(1)
    for colour, n in png.CHANNELS.items():
        a = r.integers(0, 256, (11, 9, n))
        assert (png.decode(png_file(a, colour)) == a.transpose(2, 0, 1)).all()
    with pytest.raises(ValueError, match="palette"):
        png.decode(png_file(r.integers(0, 9, (2, 2, 1)), 3))
    bad = bytearray(png_file(r.integers(0, 9, (2, 2, 1)), 0))
    bad[20] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        png.decode(bytes(bad))
    assert png.world_file("10\n0\n0\n-10\n746095\n2540435\n") == T0
    assert png.aux_transform("<x><GeoTransform> 746090, 10, 0, 2540440, 0, -10</GeoTransform></x>") == T0 and png.aux_transform("<x/>") is None
    (tmp_path / "a.png").write_bytes(b"")
    assert png.georeference(f"{tmp_path}/a.png", 5, 4, [0, 0, 40, 50]) == (10.0, 0.0, 0.0, 0.0, -10.0, 50.0) and png.georeference(f"{tmp_path}/a.png", 5, 4) is None
    (tmp_path / "a.pgw").write_text("10\n0\n0\n-10\n746095\n2540435\n")
    assert png.georeference(f"{tmp_path}/a.png", 5, 4) == T0


def test_manifests(spark, tmp_path):
    (tmp_path / "m.csv").write_text("uri,datetime,bands\nb.tif,2024-02-01T00:00:00+02:00,B03;B08\n/abs/a.tif,2024-01-01,\ns3://x/c.tif,2024-03-01T10:30:00.250Z,B03; B08\n")
    rows, names, bounds = manifest.read(spark, f"{tmp_path}/m.csv")
    got = [(r.t, r.uri, r.iso) for r in rows.orderBy("t").collect()]
    assert got == [(0, "/abs/a.tif", "2024-01-01T00:00:00.000Z"), (1, f"{tmp_path}/b.tif", "2024-01-31T22:00:00.000Z"), (2, "s3://x/c.tif", "2024-03-01T10:30:00.250Z")]
    assert names == ["B03", "B08"] and bounds is None
    (tmp_path / "m.json").write_text('{"bands": ["a"], "bounds": [0, 0, 2, 1], "items": [{"uri": "x", "datetime": "2024-01-01"}]}')
    rows, names, bounds = manifest.read(spark, f"{tmp_path}/m.json")
    assert names == ["a"] and bounds == (0, 0, 2, 1) and rows.count() == 1
    for text, what in (("uri,when\na,2024\n", "no datetime"), ("uri,datetime\na,2024-01-01\nb,2024-01-01T00:00:00Z\n", "share the times"), ("uri,datetime\n,2024-01-01\n", "lack"), ("uri,datetime,bands\na,2024-01-01,x\nb,2024-01-02,y\n", "different bands")):
        (tmp_path / "bad.csv").write_text(text)
        with pytest.raises(ValueError, match=what):
            manifest.read(spark, f"{tmp_path}/bad.csv")


@pytest.fixture
def small(spark, tmp_path):
    r = np.random.default_rng(5)
    a = r.integers(1, 4000, (4, 2, 20, 24)).astype("u2")
    folder = tmp_path / "tif"
    folder.mkdir()
    for t in range(4):
        (folder / f"scene_2024-{t + 1:02}.tif").write_bytes(geotiff.encode(a[t], T0, "EPSG:32631", 0, ["B03", "B08"], [1e-4, 1e-4], [0, 0]))
    return a, folder


def pixels_of(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.t, r.b, r.y, r.x] = r.v
    return out


def test_command_line(spark, small, tmp_path, capsys):
    a, folder = small
    path = f"file://{tmp_path}/store"
    assert cli.main(["encode", f"{folder}/scene_2024-0[123].tif", path, "--chunk-size", "8", "--encoding", "star-delta", "--anchor-interval", "2"], spark) == 0
    assert (pixels_of(store.read(spark, path), (3, 2, 20, 24)) == a[:3]).all()
    assert cli.main(["append", f"{folder}/scene_2024-04.tif", path], spark) == 0
    assert (pixels_of(store.read(spark, path), a.shape) == a).all()
    assert cli.main(["validate", path], spark) == 0 and cli.main(["info", path], spark) == 0 and cli.main(["doctor", path], spark) == 0
    assert cli.main(["export", path, f"file://{tmp_path}/out", "--times", "2024-02,-1"], spark) == 0
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["L0_2024-02-01.tif", "L0_2024-04-01.tif"]
    assert (geotiff.decode((tmp_path / "out/L0_2024-04-01.tif").read_bytes()).values == a[3]).all()
    assert cli.main(["stac", path, f"file://{tmp_path}/stac", "--id", "s"], spark) == 0 and (tmp_path / "stac/s/s.json").exists()
    (tmp_path / "m.csv").write_text("uri,datetime\n" + "".join(f"{folder}/scene_2024-{t + 1:02}.tif,2024-{t + 1:02}-01\n" for t in range(4)))
    args = ["convert", f"{tmp_path}/m.csv", f"file://{tmp_path}/made", "--work", f"{tmp_path}/work", "--chunk-size", "8"]
    assert cli.main([*args, "--dry-run"], spark) == 0 and not (tmp_path / "made").exists()
    assert cli.main(args, spark) == 0
    assert (pixels_of(store.read(spark, f"file://{tmp_path}/made"), a.shape) == a).all()
    args[2] = f"file://{tmp_path}/again"
    capsys.readouterr()
    assert cli.main(args, spark) == 0 and "0 steps read, 4 found staged" in capsys.readouterr().out


def test_png_frames(spark, tmp_path):
    r = np.random.default_rng(2)
    frames = r.integers(0, 256, (3, 12, 10, 2))
    frames[..., 1] = r.integers(0, 2, frames.shape[:3]) * 128
    lines = ["uri,datetime"]
    for t in range(3):
        (tmp_path / f"f{t}.png").write_bytes(png_file(frames[t], 4))
        lines.append(f"f{t}.png,2024-0{t + 1}-01")
    (tmp_path / "m.csv").write_text("\n".join(lines) + "\n")
    path = f"file://{tmp_path}/s"
    assert cli.main(["convert", f"{tmp_path}/m.csv", path, "--work", f"{tmp_path}/w", "--chunk-size", "8", "--crs", "EPSG:32631", "--bounds", "0,0,100,120"], spark) == 0
    df = store.read(spark, path)
    assert (pixels_of(df, (3, 1, 12, 10))[:, 0] == frames[..., 0]).all()
    assert all((r.mask == 1) == (frames[r.t, r.y, r.x, 1] > 0) for r in df.collect())


def test_problems_are_found(spark, small, tmp_path):
    import json

    a, folder = small
    path, root = f"file://{tmp_path}/store", tmp_path / "store"
    cli.main(["encode", f"{folder}/scene_2024-0[12].tif", path, "--chunk-size", "8", "--shard-time", "2"], spark)
    assert validate.problems(path) == []
    good = (root / "zarr.json").read_text()
    doc = json.loads(good)
    block = doc["attributes"][M.BLOCK]

    def edit(change, what, file="zarr.json"):
        before = (root / file).read_text()
        d = json.loads(before)
        change(d)
        (root / file).write_text(json.dumps(d))
        found = validate.problems(path)
        (root / file).write_text(before)
        assert any(what in f for f in found), (what, found)

    edit(lambda d: d["attributes"][M.BLOCK]["levels"][0].update(grid=[1, 1]), "doesn't mirror")
    edit(lambda d: d["attributes"][M.BLOCK]["shard_bytes"]["0"].update({"0/0/0": 5}), "isn't 5 bytes")
    edit(lambda d: d["attributes"][M.BLOCK].update(spec_version="9.9.9"), "version")
    edit(lambda d: d["attributes"]["multiscales"][0]["datasets"][1].update(crs="EPSG:1"), "multiscales")
    edit(lambda d: d.update(data_type="uint8"), "data type", "0/data/zarr.json")
    edit(lambda d: d.update(fill_value=3), "fill value", "1/data/zarr.json")
    edit(lambda d: d["attributes"].update(resolution=3), "resolution", "1/zarr.json")
    assert block["shard_bytes"] and "no zarr.json" in validate.problems(f"file://{tmp_path}/nothing")[0]


def test_http(spark, small, tmp_path):
    _, folder = small
    path = f"file://{tmp_path}/store"
    cli.main(["encode", f"{folder}/scene_2024-0[12].tif", path, "--chunk-size", "8", "--shard-time", "2"], spark)
    failures = {"left": 2}

    class Handler(http.server.SimpleHTTPRequestHandler):
        def __init__(self, *args):
            super().__init__(*args, directory=str(tmp_path / "store"))

        def log_message(self, *args):
            pass

        def do_GET(self):
            if failures["left"]:
                failures["left"] -= 1
                return self.send_error(503)
            file = tmp_path / "store" / self.path.lstrip("/")
            if not file.is_file():
                return self.send_error(404)
            raw = file.read_bytes()
            from stratacube.functions.labels import byte_range

            span = byte_range(self.headers["Range"], len(raw)) if self.headers["Range"] else (0, len(raw) - 1)
            if span is None:
                return self.send_error(416)
            body = raw[span[0] : span[1] + 1]
            self.send_response(206 if self.headers["Range"] else 200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}"
        assert [s for _, s, _ in validate.served(url)] == ["ok"] * 5
        assert store.read(spark, url).exceptAll(store.read(spark, path)).isEmpty() and store.read(spark, url).count() == 2 * 2 * 20 * 24
    finally:
        server.shutdown()
    assert validate.served(path)[0][1] == "skip"


def test_inventory_and_stac(spark, small, tmp_path):
    _, folder = small
    path = f"file://{tmp_path}/store"
    cli.main(["encode", f"{folder}/scene_2024-0[12].tif", path, "--chunk-size", "8"], spark)
    before = spark.createDataFrame(inventory.objects(spark, path, digests=True).collect())
    assert inventory.summary(before).first()["objects"] == before.count() == len(files.Files(path).inventory())
    cli.main(["append", f"{folder}/scene_2024-03.tif", path], spark)
    diff = {r.change for r in inventory.changed(before, inventory.objects(spark, path, digests=True)).filter("key LIKE '%/c/%' AND key LIKE '%data%'").collect()}
    assert diff == {"new"}
    cube, _, _ = store.load(path)
    collection, item = stac.documents(cube, "https://x.org/a/b")
    assert collection["id"] == "a-b" and item["properties"]["proj:shape"] == [20, 24] and item["bbox"][0] < item["bbox"][2] and len(item["properties"]["bands"]) == 2


def test_tiff_compressions():
    """Packed here by the rules of the format, unpacked by the source."""
    import random

    from stratacube.sources import geotiff

    def bits(codes):
        out = "".join(f"{c:0{w}b}" for c, w in codes)
        return int(out.ljust(-(-len(out) // 8) * 8, "0"), 2).to_bytes(-(-len(out) // 8), "big")

    def lzw(data):
        table, codes, held = {bytes([i]): i for i in range(256)}, [(256, 9)], b""
        size = 258
        for b in data:
            one = held + bytes([b])
            if one in table:
                held = one
                continue
            codes.append((table[held], min(12, max(9, size.bit_length()))))
            table[one], size, held = size, size + 1, bytes([b])
            if size == 4094:
                codes.append((table[held], 12))
                codes.append((256, 12))
                table, size, held = {bytes([i]): i for i in range(256)}, 258, b""
        if held:
            codes.append((table[held], min(12, max(9, size.bit_length()))))
            size += 1
        return bits([*codes, (257, min(12, max(9, size.bit_length())))])

    r = random.Random(1)
    for data in (b"", b"a", b"aaaaaaaaaa" * 50, bytes(r.choices(range(256), k=20_000)), bytes(r.choices(b"ab", k=60_000))):
        assert geotiff.unpack_lzw(lzw(data)) == data
        packed = b"".join(bytes([len(data[i : i + 128]) - 1]) + data[i : i + 128] for i in range(0, len(data), 128))
        assert geotiff.unpack_bits(packed + bytes([128, 254]) + b"z") == data + b"zzz"
    assert geotiff.UNPACK[geotiff.ZSTD](pa.compress(b"x" * 999, "zstd", asbytes=True)) == b"x" * 999
