"""Helpers shared by the text operators: table access, shared scratch tables, batches of rows, shipping of code."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacube import scratch as made
from stratacube.shipping import ship

#: Rows and (about) bytes of one slice of an Arrow batch, which are Python objects at the same time.
SLICE_ROWS, SLICE_BYTES = 512, 2 << 20
#: Bytes of an Arrow batch between Spark and Python, the setting for it and that setting's default.
BATCH_BYTES, BATCH_CONF, DEFAULT_BATCH = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


scratch = made.path


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write a table to the shared folder and read it again: the lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that stored() made and that nothing needs any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        made.delete(df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration(), folder)


def step(df: DataFrame, what: str, since: int) -> DataFrame:
    """stored(df); every other table made since ``since`` (scratch.mark()) goes, as what it was for is in this one now."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    made.clear(spark, since, keep=(path,))
    return spark.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    if batch.num_rows:
        rows = max(1, min(rows, batch.num_rows * SLICE_BYTES // max(1, batch.get_total_buffer_size())))
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a column as UTF-8; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def release() -> None:
    """Give memory that a task has freed back to the system: workers live on, and other tasks of the executor need it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with batches of BATCH_BYTES and memory released after each task.

    Their size is a setting that Spark reads when the query is run, so this sets it for the session unless it has been set.
    """
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get(BATCH_CONF, DEFAULT_BATCH) == DEFAULT_BATCH:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(task, schema)


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema) -> DataFrame:
    """map_batches() by small slices. make() runs once per task and returns what turns a slice into rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        act = make()
        for batch in batches:
            for part in slices(batch):
                out = act(part)
                if out is not None and out.num_rows:
                    yield out

    return map_batches(df, run, schema)


def free(name: str, columns: list[str]) -> str:
    """The name, with as many underscores behind it as it takes to be no column's, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that most operators read, under fixed names; others can't clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
