from pyspark.sql import functions as F

from stratacube.streaming import append


def test_append_stream(spark, tmp_path):
    source, out, schema = str(tmp_path / "in"), str(tmp_path / "out"), "t int, y int, x int, v int"
    make = lambda steps: spark.createDataFrame([(t, y, 0, 10 * t + y) for t in steps for y in range(3)], schema)

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        append.append_stream(stream, out, str(tmp_path / "ck"), lambda: append.stored_step(spark, out)).start().awaitTermination()

    make([0, 1]).write.mode("append").parquet(source)
    run()
    make([1, 2, 3]).write.mode("append").parquet(source)  # step 1 is late
    run()
    run()  # nothing new
    assert sorted((r.t, r.y, r.v) for r in spark.read.parquet(out).collect()) == [(t, y, 10 * t + y) for t in range(4) for y in range(3)]
    assert [r.t for r in spark.read.parquet(out + "_late").select("t").distinct().collect()] == [1]


def test_windows_and_state_on_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(f"2024-0{1 + i // 10}-0{1 + i % 9} 00:00:00", i % 4, i) for i in range(30)]
    spark.createDataFrame(rows, "s string, y int, v int").select(F.to_timestamp("s").alias("ts"), "y", F.lit(0).alias("x"), F.col("v").alias("t"), "v").write.parquet(source)
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).parquet(source)
    for name, df, mode in (("months", append.monthly(stream.withWatermark("ts", "1 day"), "ts", F.count("*").alias("n")), "complete"), ("latest", append.latest_per_pixel(spark, stream), "complete")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    assert {r.month: r.n for r in spark.table("months").collect()} == {"2024-01": 10, "2024-02": 10, "2024-03": 10}
    assert {r.y: r.v for r in spark.table("latest").collect()} == {0: 28, 1: 29, 2: 26, 3: 27}


def test_late_rows_stop_a_batch_append(spark):
    import pytest

    a = spark.createDataFrame([(0, 1), (1, 1)], "t int, v int")
    with pytest.raises(ValueError, match=r"\[1\]"):
        append.appended(a, spark.createDataFrame([(1, 2), (2, 2)], "t int, v int"))


def test_stream_into_a_store(spark, tmp_path):
    import numpy as np

    from stratacube.sources import metadata as M
    from stratacube.sources import store
    from stratacube.streaming import stores

    a = np.random.default_rng(1).integers(1, 60000, (5, 1, 6, 6))
    iso = [f"2024-0{t + 1}-01T00:00:00Z" for t in range(5)]
    path, schema = f"file://{tmp_path}/s", "iso string, b int, y int, x int, v int"
    rows = lambda steps: [(iso[t], 0, y, x, int(a[t, 0, y, x])) for t in steps for y in range(6) for x in range(6)]
    cube = M.new_cube(iso[:2], ["a"], "EPSG:32631", (10.0, 0.0, 0.0, 0.0, -10.0, 0.0), 6, 6, "uint16", 4, interval=3)
    store.write(spark.createDataFrame([(t, 0, y, x, int(a[t, 0, y, x])) for t in range(2) for y in range(6) for x in range(6)], "t int, b int, y int, x int, v int"), path, cube)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stores.append_stream(stream, path, f"file://{tmp_path}/ck", str(tmp_path / "late")).start().awaitTermination()

    spark.createDataFrame(rows([1, 2, 3]), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    spark.createDataFrame(rows([4]), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    got = {(r.t, r.y, r.x): r.v for r in store.read(spark, path).collect()}
    assert got == {(t, y, x): int(a[t, 0, y, x]) for t in range(5) for y in range(6) for x in range(6)}
    assert store.load(path)[0].times == tuple(iso)
    assert {r.iso for r in spark.read.parquet(str(tmp_path / "late")).collect()} == {iso[1]}
