import json

import numpy as np
import pytest

from stratacube.operators import validate
from stratacube.sources import codecs, store
from stratacube.sources import metadata as M

T0 = (10.0, 0.0, 746090.0, 0.0, -10.0, 2540440.0)


def months(n, first=0):
    return [f"{2020 + (first + i) // 12}-{(first + i) % 12 + 1:02}-01T00:00:00Z" for i in range(n)]


def raster(n, b, h, w, seed=7, hi=65535):
    r = np.random.default_rng(seed)
    return r.integers(0, hi, (n, b, h, w))


def frame(spark, a, first=0, mask=None, coverage=None):
    rows = [(first + t, b, y, x, a[t, b, y, x].item(), *([int(mask[t, y, x])] if mask is not None else []), *([int(coverage[t, y, x])] if coverage is not None else [])) for t, b, y, x in np.ndindex(a.shape)]
    kind = "float" if a.dtype.kind == "f" else "int"
    return spark.createDataFrame(rows, f"t int, b int, y int, x int, v {kind}" + (", mask int" if mask is not None else "") + (", coverage int" if coverage is not None else ""))


def array(df, shape, column="v"):
    out = np.full(shape, -1.0)
    for r in df.collect():
        out[r.t, r.b, r.y, r.x] = r[column]
    return out


def halved(a, ok, floats=False):
    """The next level of [y, x] by plain loops, edges repeated."""
    h, w = a.shape
    out, any_ok = np.zeros(((h + 1) // 2, (w + 1) // 2)), np.zeros(((h + 1) // 2, (w + 1) // 2), bool)
    for y, x in np.ndindex(out.shape):
        cells = [(min(2 * y + i, h - 1), min(2 * x + j, w - 1)) for i in (0, 1) for j in (0, 1)]
        vs = [float(a[c]) for c in cells if ok[c]]
        any_ok[y, x] = bool(vs)
        out[y, x] = (sum(vs) / len(vs) if floats else sum(vs) // len(vs)) if vs else 0
    return out, any_ok


@pytest.mark.parametrize("dtype,interval,shard,codec", [("uint16", 3, None, "zstd"), ("uint8", 2, 4, "blosc-zstd-shuffle"), ("int16", None, 3, "zstd"), ("float32", None, None, "blosc-zstd-shuffle")])
def test_round_trip(spark, tmp_path, dtype, interval, shard, codec):
    n, b, h, w = 5, 2, 21, 13
    a = raster(n, b, h, w, hi=250 if dtype == "uint8" else 30000)
    a = a.astype("f4") / 7 if dtype == "float32" else a - 15000 if dtype == "int16" else a
    cube = M.new_cube(months(n), ["green", {"name": "nir", "scale": 1e-4}], "EPSG:32631", T0, h, w, dtype, 8, interval=interval, shard_time=shard, nodata=None)
    path = f"file://{tmp_path}/s"
    store.write(frame(spark, a), path, cube, codec)
    assert store.is_store(path) and not store.is_store(f"file://{tmp_path}")
    got = store.read(spark, path)
    assert (array(got, a.shape).astype("f4") == a.astype("f4")).all()
    ok = np.ones((h, w), bool)
    for lod in (1, 2):
        want = np.stack([[halved(a[t, k] if lod == 1 else halved(a[t, k], ok, dtype == "float32")[0].astype("f4"), ok if lod == 1 else np.ones(((h + 1) // 2, (w + 1) // 2), bool), dtype == "float32")[0] for k in range(b)] for t in range(n)])
        assert np.allclose(array(store.read(spark, path, lod), want.shape), want.astype("f4"), rtol=1e-6)
    back, arrays, _ = store.load(path)
    assert back.references == cube.references and back.levels == cube.levels and back.bands == cube.bands
    with pytest.raises(FileExistsError):
        store.write(frame(spark, a), path, cube)


def test_sparse_mask_and_coverage(spark, tmp_path):
    n, b, h, w = 4, 2, 9, 11
    a, r = raster(n, b, h, w), np.random.default_rng(1)
    mask, cov = r.integers(0, 2, (n, h, w)), r.integers(0, 7, (n, h, w))
    cube = M.new_cube(months(n), ["a", "b"], "EPSG:32631", T0, h, w, "uint16", 4, interval=2, mask="mask", coverage="coverage")
    assert cube.nodata is None
    path = f"file://{tmp_path}/s"
    store.write(frame(spark, a, mask=mask, coverage=cov), path, cube)
    got = store.read(spark, path)
    assert (array(got, a.shape) == a).all() and (array(got, a.shape, "mask")[:, 0] == mask).all() and (array(got, a.shape, "coverage")[:, 1] == cov).all()
    one = store.read(spark, path, 1)
    want = [halved(a[0, 0], mask[0] == 1) for _ in (0,)][0]
    got0 = array(one, (n, b, 5, 6))
    assert (got0[0, 0] == want[0]).all() and (array(one, (n, b, 5, 6), "mask")[0, 0] == want[1]).all()
    padded = np.pad(cov[2], ((0, 1), (0, 1)), "edge")
    sums = padded.reshape(5, 2, 6, 2).sum((1, 3))
    assert (array(one, (n, b, 5, 6), "coverage")[2, 0] == (sums + 2) // 4).all()


def test_missing_pixels_are_fill(spark, tmp_path):
    a = raster(4, 1, 9, 9)
    cube = M.new_cube(months(4), ["a"], "EPSG:32631", T0, 9, 9, "uint16", 4, interval=3, nodata=7)
    path = f"file://{tmp_path}/s"
    few = frame(spark, a).filter("(y < 4 AND t <> 1) OR (t = 2 AND x > 6)")
    store.write(few, path, cube)
    want = np.full(a.shape, 7)
    for t, _, y, x in np.ndindex(a.shape):
        if (y < 4 and t != 1) or (t == 2 and x > 6):
            want[t, 0, y, x] = a[t, 0, y, x]
    assert (array(store.read(spark, path), a.shape) == want).all()


def test_filters_choose_chunks(spark, tmp_path):
    a = raster(12, 2, 32, 32)
    cube = M.new_cube(months(12), ["a", "b"], "EPSG:32631", T0, 32, 32, "uint16", 8, interval=6)
    path = f"file://{tmp_path}/s"
    store.write(frame(spark, a), path, cube)
    df = store.read(spark, path).filter("t = 4 AND y >= 8 AND y < 16 AND x = 20 AND b = 1")
    assert sorted((r.y, r.v) for r in df.collect()) == [(y, a[4, 1, y, 20]) for y in range(8, 16)]
    reader = store.StoreReader({"path": path}, df.schema)
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    list(reader.pushFilters([EqualTo(("t",), 4), GreaterThanOrEqual(("y",), 8), LessThan(("y",), 16), EqualTo(("x",), 20)]))
    parts = reader.partitions()
    assert [(p.row, p.col, p.steps) for p in parts] == [(1, 2, (4,))]
    cell = store.CellReader(path, cube, store.load(path)[1], 0)
    cell.values(4, 1, 2)
    assert cell.data.reads == 2  # an anchor and a difference
    cell.values(5, 1, 2)
    assert cell.data.reads == 3  # the anchor is at hand


def test_raw_residuals(spark, tmp_path):
    a = raster(4, 1, 8, 8)
    cube = M.new_cube(months(4), ["a"], "EPSG:32631", T0, 8, 8, "uint16", 8, interval=4)
    path = f"file://{tmp_path}/s"
    store.write(frame(spark, a), path, cube)
    raw = array(store.read(spark, path, raw=True), a.shape)
    assert (raw[0] == a[0]).all() and (raw[2] == (a[2] - a[0]) % 65536).all()


@pytest.mark.parametrize("shard", [None, 4])
def test_append(spark, tmp_path, shard):
    a, mask = raster(9, 1, 10, 10), np.ones((9, 10, 10), int)
    cube = M.new_cube(months(6), ["a"], "EPSG:32631", T0, 10, 10, "uint16", 8, interval=4, shard_time=shard, mask="mask")
    path, root = f"file://{tmp_path}/s", tmp_path / "s"
    store.write(frame(spark, a[:6], mask=mask[:6]), path, cube)
    before = {p: p.read_bytes() for p in root.rglob("c/*/0/*/*") if p.is_file()}
    store.append(frame(spark, a[6:], 6, mask=mask[6:]), path, months(3, 6))
    assert (array(store.read(spark, path), a.shape) == a).all()
    grown, _, _ = store.load(path)
    assert {t: r for t, r in grown.references.items() if t < 6} == dict(cube.references) and grown.references[7] == 8
    if shard is None:
        assert all(p.read_bytes() == raw for p, raw in before.items())
    fresh = M.new_cube(months(9), ["a"], "EPSG:32631", T0, 10, 10, "uint16", 8, interval=4, mask="mask")
    store.write(frame(spark, a, mask=mask), f"file://{tmp_path}/f", fresh)
    for lod in (0, 1):
        assert store.read(spark, path, lod).exceptAll(store.read(spark, f"file://{tmp_path}/f", lod)).isEmpty()
    with pytest.raises(ValueError, match="not after.*steps|mask"):
        store.append(frame(spark, a[:1], 0), path, months(1))


def test_codecs_and_indexes():
    raw = bytes(range(256)) * 40
    for codec in codecs.LEVELS:
        for dtype in ("uint8", "uint16", "float32"):
            v = np.frombuffer(raw, codecs.DTYPES[dtype])
            chain = codecs.chain(codec, dtype)
            assert codecs.decode(codecs.encode(v, chain, dtype), chain, dtype, len(v)).tobytes() == raw
    assert codecs.blosc_decode(codecs.blosc_encode(np.random.default_rng(0).bytes(999), 2, 5)) == np.random.default_rng(0).bytes(999)
    assert codecs.crc32c(b"123456789") == 0xE3069283
    shard = codecs.write_shard([b"abc", None, b"de"])
    assert codecs.read_index(shard[-codecs.index_bytes(3, True) :], 3, True, len(shard)) == [(0, 3), None, (3, 2)]
    bad = bytearray(shard[-codecs.index_bytes(3, True) :])
    bad[0] ^= 1
    for args in ((bytes(bad), 3, True), (shard[-51:], 3, True), (shard[-codecs.index_bytes(3, True) :], 3, True, 4)):
        with pytest.raises(codecs.CorruptShard):
            codecs.read_index(*args)
    assert codecs.index_range(3, True, True, None) == (0, 52) and codecs.index_range(3, True, False, None) == (None, 52) and codecs.index_range(3, False, False, 100) == (52, 48)
    assert codecs.vlen_decode(codecs.vlen_encode(["a", "é", ""])) == ["a", "é", ""]


def test_strict_parsing(tmp_path, spark):
    cube = M.new_cube(months(5), ["a"], "EPSG:32631", T0, 8, 8, "uint16", 8, interval=2)
    nodes = M.cube_arrays(cube, codecs.chain("zstd", "uint16"), codecs.chain("zstd", "uint8"))
    groups = {k.path: M.level_attributes(cube, k) for k in cube.levels}
    good = M.root_attributes(cube)
    assert M.parse_root(good, nodes, groups).references == cube.references

    def edited(**change):
        out = json.loads(json.dumps(good))
        out[M.BLOCK] |= change
        return out

    t = good[M.BLOCK]["temporal"]
    for change in (
        {"spec_version": "0.3.0"}, {"times": []}, {"times": months(5)[::-1]}, {"times": ["x"] * 5}, {"bands": []}, {"bands": ["a", "a"]}, {"bands": [{"name": "a", "scale": 0}]}, {"band_names": ["z"]}, {"nodata": "x"}, {"nodata": 70000},
        {"temporal": {"encoding": "x"}}, {"temporal": t | {"anchor_interval": 0}}, {"temporal": t | {"anchor_indices": [0]}}, {"temporal": t | {"delta_reference": {"1": 0}}}, {"temporal": t | {"delta_reference": {"1": 4, "3": 2}}}, {"provenance": {"sources": [], "composite": "x", "gap_fill": "y"}},
    ):
        with pytest.raises(M.SchemaError):
            M.parse_root(edited(**change), nodes, groups)
    assert M.parse_root(edited(spec_version="0.1.7", bands=["a"], band_names=None), nodes, groups).bands[0].scale == 1


@pytest.mark.parametrize("dtype,shard", [("uint8", None), ("int32", None), ("int32", 3)])
def test_coverage_above_255(spark, tmp_path, dtype, shard):
    """Saturates at 255 where the format's bytes hold it, before levels are made; whole counts where 32 bits do, appended ones too."""
    n, b, h, w = 4, 1, 6, 6
    a, cov = raster(n, b, h, w), np.random.default_rng(3).integers(200, 70_000, (n, h, w))
    cov[0, 0, :2] = 255, 256
    more = {"nodata": None, "coverage": "coverage", "coverage_dtype": dtype, "shard_time": shard}
    path = f"file://{tmp_path}/s"
    store.write(frame(spark, a[:2], coverage=cov[:2]), path, M.new_cube(months(2), ["a"], "EPSG:32631", T0, h, w, "uint16", 4, **more), "blosc-zstd-shuffle")
    assert store.append(frame(spark, a[2:], 2, coverage=cov[2:]), path, months(2, 2), "blosc-zstd-shuffle").coverage_dtype == dtype
    want = np.minimum(cov, 255) if dtype == "uint8" else cov
    assert (array(store.read(spark, path), a.shape, "coverage")[:, 0] == want).all()
    sums = want.reshape(n, 3, 2, 3, 2).sum((2, 4))
    assert (array(store.read(spark, path, 1), (n, b, 3, 3), "coverage")[:, 0] == (sums + 2) // 4).all()
    assert [p for p in validate.problems(path) if "coverage" not in p] == [] and bool(validate.problems(path)) == (dtype != "uint8")


def test_coverage_type_is_checked(spark, tmp_path):
    with pytest.raises(M.SchemaError, match="int64"):
        M.new_cube(months(1), ["a"], "EPSG:32631", T0, 4, 4, "uint16", 4, coverage="coverage", coverage_dtype="int64")


def test_null_coverage_is_none(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    df = spark.createDataFrame([(0, 0, 0, 0, 5, None), (0, 0, 0, 1, 6, 300)], "t int, b int, y int, x int, v int, coverage int")
    store.write(df, path, M.new_cube(months(1), ["a"], "EPSG:32631", T0, 1, 2, "uint16", 4, coverage="coverage", coverage_dtype="int32"))
    assert sorted((r.x, r.coverage) for r in store.read(spark, path).collect()) == [(0, 0), (1, 300)]
