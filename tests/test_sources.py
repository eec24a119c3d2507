import json

import numpy as np
import pyarrow as pa
import pytest

from stratacube.operators import commands, convert
from stratacube.sources import codecs, mosaics, store, variable
from stratacube.sources import metadata as M

T0 = (10.0, 0.0, 100.0, 0.0, -10.0, 400.0)


def zarr3(root, arrays, consolidated=True):
    nodes = {}
    for name, (values, dims, chunks, attributes) in arrays.items():
        dtype = str(values.dtype)
        chain = codecs.chain("zstd", dtype)
        meta = M.array_metadata(values.shape, chunks, dtype, 0, chain, dims, attributes)
        nodes[name] = meta
        for index in np.ndindex(*(-(-n // c) for n, c in zip(values.shape, chunks))):
            part = tuple(slice(i * c, (i + 1) * c) for i, c in zip(index, chunks))
            full = np.zeros(chunks, values.dtype)
            got = values[part]
            full[tuple(slice(0, n) for n in got.shape)] = got
            path = root / name / "c" / "/".join(map(str, index))
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(codecs.encode(full, chain, dtype))
        (root / name / "zarr.json").write_text(json.dumps(meta))
    doc = {"zarr_format": 3, "node_type": "group", "attributes": {"crs": "EPSG:32631"}}
    if consolidated:
        doc["consolidated_metadata"] = {"metadata": nodes}
    (root / "zarr.json").write_text(json.dumps(doc))


def cf(root, flip=False, consolidated=True, **attributes):
    r = np.random.default_rng(1)
    v = r.integers(-500, 500, (3, 7, 9)).astype("i2")
    v[:, 2, 3] = -999
    y = 395 - 10.0 * np.arange(7)
    zarr3(root, {
        "v": (v[:, ::-1] if flip else v, ["time", "lat", "x"], [2, 4, 5], {"_FillValue": -999, "scale_factor": 0.01, "add_offset": 1.5, "units": "m", **attributes}),
        "ok": ((v % 2 == 0).astype("u1")[:, ::-1] if flip else (v % 2 == 0).astype("u1"), ["time", "lat", "x"], [3, 3, 9], {}),
        "time": (np.array([31, 0, 60], "i4"), ["time"], [3], {"units": "days since 2024-01-01"}),
        "lat": (y[::-1] if flip else y, ["lat"], [7], {}), "x": (105 + 10.0 * np.arange(9), ["x"], [4], {}),
    }, consolidated)
    return v[[1, 0, 2]]


def pixels(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.t, r.b, r.y, r.x] = r.v
    return out


@pytest.mark.parametrize("flip,consolidated", [(False, True), (True, False)])
def test_cf_variable(spark, tmp_path, flip, consolidated):
    want = cf(tmp_path, flip, consolidated)
    v = variable.open_variable(str(tmp_path), "v")
    assert v.times == ("2024-01-01T00:00:00Z", "2024-02-01T00:00:00Z", "2024-03-01T00:00:00Z") and v.transform == T0 and v.validity["nodata"] == -999
    assert v.bands == (M.Band("v", None, 0.01, 1.5, "m"),) and v.crs == "EPSG:32631"
    assert (pixels(variable.read(spark, v), (3, 1, 7, 9))[:, 0] == want).all()
    masked = variable.open_variable(str(tmp_path), "v", mask="ok")
    assert masked.validity["mask"]
    for r in variable.read(spark, masked).collect():
        assert (r.mask == 1) == (want[r.t, r.y, r.x] % 2 == 0 and want[r.t, r.y, r.x] != -999)
    path = f"file://{tmp_path}/out"
    store.write(variable.read(spark, masked), path, masked.cube(cell=4))
    assert (pixels(store.read(spark, path), (3, 1, 7, 9))[:, 0] == want).all()


def test_unclear_variables_are_refused(tmp_path):
    cf(tmp_path)
    for args, what in ((("w",), "no variable"), ((None,), "choose one"), (("v", {"y": "no"}), "no dimension"), (("v", None, 1e9), "can't hold"), (("v", None, "auto", "v"), "mask")):
        with pytest.raises(ValueError, match=what):
            variable.open_variable(str(tmp_path), *args)
    with pytest.raises(ValueError, match="time=NAME"):
        variable.parse_dims("z=a")
    assert variable.parse_dims("time=a, y=b") == {"time": "a", "y": "b"}
    with pytest.raises(ValueError, match="can't be read"):
        variable.moments(np.array([1]), "fortnights since 2000-01-01")
    with pytest.raises(FileNotFoundError):
        variable.group(str(tmp_path / "nothing"))


def test_zarr_v2(spark, tmp_path):
    a = np.random.default_rng(2).normal(size=(2, 4, 6)).astype("f4")
    a[0, 1, 1] = np.nan
    for name, values, attributes, comp in (("t2", a, {"_ARRAY_DIMENSIONS": ["time", "y", "x"], "_FillValue": float("nan")}, {"id": "zstd"}), ("time", np.array([0, 3600], "i8"), {"_ARRAY_DIMENSIONS": ["time"], "units": "seconds since 2024-01-01T00:00:00Z"}, None), ("y", 395 - 10.0 * np.arange(4), {"_ARRAY_DIMENSIONS": ["y"]}, None), ("x", 105 + 10.0 * np.arange(6), {"_ARRAY_DIMENSIONS": ["x"]}, None)):
        (tmp_path / name).mkdir()
        raw = values.astype(values.dtype.newbyteorder("<")).tobytes()
        (tmp_path / name / ".".join("0" * values.ndim)).write_bytes(pa.Codec("zstd").compress(raw).to_pybytes() if comp else raw)
        (tmp_path / name / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": values.shape, "chunks": values.shape, "dtype": values.dtype.str, "compressor": comp, "filters": None, "fill_value": 0, "order": "C"}))
        (tmp_path / name / ".zattrs").write_text(json.dumps(attributes))
    (tmp_path / ".zgroup").write_text('{"zarr_format": 2}')
    v = variable.open_variable(str(tmp_path))
    assert v.validity["mask"] and v.times[1] == "2024-01-01T01:00:00Z"
    rows = variable.read(spark, v).collect()
    assert sum(r.mask == 0 for r in rows) == 1 and all(np.float32(r.v) == a[r.t, r.y, r.x] for r in rows if r.mask)
    plain = variable.open_variable(str(tmp_path), nodata=None)
    with pytest.raises(Exception, match="NaN"):
        variable.read(spark, plain).collect()


def test_mosaics(spark, tmp_path):
    a = np.random.default_rng(3).integers(0, 5000, (3, 2, 5, 6)).astype("u2")
    for t in range(3):
        np.savez(tmp_path / f"2024-0{3 - t}.npz", bands=a[2 - t], coverage=(a[2 - t, 0] % 2).astype("f4"), transform=T0, epsg=32631, band_names=["B03", "B08"])
    assert mosaics.months(spark, str(tmp_path)) == ["2024-01", "2024-02", "2024-03"]
    df = mosaics.read(spark, str(tmp_path))
    assert (pixels(df, a.shape) == a).all() and all(r.coverage == a[r.t, 0, r.y, r.x] % 2 for r in df.collect())
    np.savez(tmp_path / "2024-09.npz", bands=a[0], transform=T0, epsg=32632, band_names=["B03", "B08"])
    with pytest.raises(ValueError, match="2024-09"):
        mosaics.months(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        mosaics.months(spark, _empty(tmp_path))


def _empty(tmp_path):
    (tmp_path / "empty").mkdir()
    return str(tmp_path / "empty")


def test_commands(spark):
    bad = [{"v": 2}, {"t": -1}, {"t": "soon"}, {"product": ""}, {"range": [2, 1]}, {"range": [1]}, {"zoom": 0}, {"zoom": "1"}, {"center": {"lon": 181, "lat": 0}}, {"center": 3}, {"playing": 1}, {"speed": -1}]
    good = [{"t": "2024-01-17", "product": "ndvi", "range": None, "center": {"x": 1, "y": 2}, "later": 1}, {"t": 2, "range": [1, 2.5], "playing": True}, {"t": 3}, {"band": "x", "zoom": 2}]
    texts = [json.dumps({"type": "cube:set", **m}) for m in bad + good] + ["x", None, "3", '{"type": "other:set"}', '{"type": "cube:get"}', '{"type": "cube:jump"}']
    got = commands.parsed(spark.createDataFrame(list(enumerate(texts)), "id int, message string")).orderBy("id")
    rows = got.collect()
    assert [r.kind for r in rows] == ["error"] * len(bad) + ["set"] * len(good) + ["ignore"] * 4 + ["get", "error"]
    assert [r.wrong for r in rows[1 : len(bad)]] == [[next(iter(m))] for m in bad[1:]] and rows[0].product is None
    first = rows[len(bad)]
    assert (first.product, first.x, first.y, first.range, first.step) == ("ndvi", 1.0, 2.0, None, None) and rows[len(bad) + 1].range == [1.0, 2.5] and rows[len(bad) + 1].playing
    times = spark.createDataFrame([(i, f"2024-0{i + 1}-01 00:00:00") for i in range(3)], "t int, ts string").selectExpr("t", "to_timestamp(ts) AS ts")
    plan = {r.id - len(bad): (r.step, r.absent) for r in commands.resolved(got, times, ["ndvi"], ["B03"]).collect()}
    assert plan == {0: (1, []), 1: (2, []), 2: (3, ["t"]), 3: (None, ["band"])}


def test_encoding_choice_and_cost(spark):
    r = np.random.default_rng(4)
    still = np.broadcast_to(r.integers(0, 4000, (1, 1, 16, 16)), (7, 1, 16, 16)) + r.integers(0, 3, (7, 1, 16, 16))
    noise = r.integers(0, 65535, (7, 1, 16, 16))
    times = [f"2024-0{t + 1}-01T00:00:00Z" for t in range(7)]
    cube = M.new_cube(times, ["a"], "EPSG:32631", T0, 16, 16, "uint16", 8, nodata=None)
    frame = lambda a: spark.createDataFrame([(t, b, y, x, int(a[t, b, y, x])) for t, b, y, x in np.ndindex(a.shape)], "t int, b int, y int, x int, v int")
    keep, how = convert.choose_encoding(frame(still), cube, 6)
    assert keep and how["ratio"] < 0.85 and how["sampled_cells"] == 3
    assert not convert.choose_encoding(frame(noise), cube, 6)[0]
    cost = convert.reference_cost(frame(still), cube, 6)
    assert cost["affected_steps"] == 2 and cost["nearest"] < cost["plain"] and cost["affected_preceding"] > 0
    plan = convert.plan(frame(still), cube)
    assert plan.raw_bytes == 7 * 256 * 2 and 0 < plan.ratio < 1.5 and len(plan.lines()) == 3


def test_source_fingerprints(spark, tmp_path):
    for name, text in (("a.tif", "one"), ("b.tif", "two")):
        (tmp_path / name).write_text(text)
    paths = [str(tmp_path / n) for n in ("a.tif", "b.tif")]
    first = convert.source_fingerprint(spark, paths)
    assert first == convert.source_fingerprint(spark, paths[::-1]) != convert.source_fingerprint(spark, paths[:1])
    (tmp_path / "b.tif").write_text("three")
    assert convert.source_fingerprint(spark, paths) != first
