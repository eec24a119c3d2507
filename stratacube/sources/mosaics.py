"""Folders of monthly mosaics, ``YYYY-MM.npz`` with bands, transform, epsg, band_names and perhaps coverage."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacube.shipping import ship


def _grid(z) -> str:
    return f"{int(z['epsg'])} {[float(v) for v in z['transform']]} {[str(b) for b in z['band_names']]} {list(z['bands'].shape)}"


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(folder)


def months(spark: SparkSession, folder: str) -> list[str]:
    """YYYY-MM of the files, in order; raises if there are none or grids, systems or bands differ."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grids = []
            for raw in batch.column(1).to_pylist():
                with np.load(io.BytesIO(raw), allow_pickle=False) as z:
                    grids.append(_grid(z))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grids, pa.string())], ["path", "grid"])

    ship(spark)
    found = sorted((re.search(r"(\d{4}-\d{2})\.npz$", r["path"])[1], r["grid"]) for r in _files(spark, folder).select("path", "content").mapInArrow(heads, "path string, grid string").collect())  # a row per step
    if not found:
        raise FileNotFoundError(f"there are no mosaics in {folder}")
    if bad := [m for m, g in found if g != found[0][1]]:
        raise ValueError(f"{bad[0]} has another grid, reference system or bands than {found[0][0]}")
    return [m for m, _ in found]


def read(spark: SparkSession, folder: str) -> DataFrame:
    """t, b, y, x, v, coverage: coverage is 1 where any scene was valid, null where a file has none."""
    steps = spark.createDataFrame([(m, t) for t, m in enumerate(months(spark, folder))], "month string, t int")
    found = _files(spark, folder).select(F.regexp_extract("path", r"(\d{4}-\d{2})\.npz$", 1).alias("month"), "content").join(steps, "month").select("t", "content")

    def pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with np.load(io.BytesIO(raw), allow_pickle=False) as z:
                    bands, cov = z["bands"], (z["coverage"] > 0).astype(np.int32).ravel() if "coverage" in z else None
                m, h, w = bands.shape
                y, x = np.meshgrid(np.arange(h, dtype=np.int32), np.arange(w, dtype=np.int32), indexing="ij")
                for b in range(m):
                    n = h * w
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), pa.array(np.full(n, b, np.int32)), pa.array(y.ravel()), pa.array(x.ravel()), pa.array(bands[b].ravel().astype(np.int32)), pa.nulls(n, pa.int32()) if cov is None else pa.array(cov)], ["t", "b", "y", "x", "v", "coverage"])

    ship(spark)
    return found.mapInArrow(pixels, "t int, b int, y int, x int, v int, coverage int")
