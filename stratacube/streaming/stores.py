"""Structured Streaming into a Zarr store: each micro-batch appends its new steps, late rows are set apart."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacube.sources import store
from stratacube.sources.files import Files


def append_stream(source: DataFrame, path: str, checkpoint: str, late_path: str):
    """A streaming query of rows (iso, b, y, x, v[, mask, coverage]) that appends to a store, run until its input is used up.

    Times after the store's last one become steps in their order; a time must come in one micro-batch as a whole. Rows at
    or before the last time go to late_path. What a batch is about to append is noted below the checkpoint first, so a
    batch that is run again after a failure neither appends twice nor takes its own rows for late ones.
    """

    def sink(batch: DataFrame, number: int) -> None:
        notes = Files(f"{checkpoint}/appends")
        cube, _, _ = store.load(path)
        noted = notes.get(f"{number}.json")
        rows = batch.persist()
        try:
            times = sorted(r["iso"] for r in rows.select("iso").distinct().collect())  # as many as a batch has steps
            new = json.loads(noted) if noted is not None else [t for t in times if t > cube.times[-1]]
            if noted is None:
                notes.put(f"{number}.json", json.dumps(new).encode())
            rows.filter(~F.col("iso").isin(new) if new else F.lit(True)).write.mode("overwrite").parquet(f"{late_path}/batch={number}")
            if new and new[0] not in cube.times:
                steps = rows.sparkSession.createDataFrame([(t, len(cube.times) + i) for i, t in enumerate(new)], "iso string, t int")
                store.append(rows.join(steps, "iso").drop("iso"), path, new)
        finally:
            rows.unpersist()

    return source.writeStream.foreachBatch(sink).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True)
