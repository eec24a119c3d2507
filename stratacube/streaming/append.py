"""Appending to a cube in time: batch operators, and the same as a Structured Streaming sink.

New steps come strictly after the stored ones; stored rows and references never change. Late rows are set apart, not
dropped in silence.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratacube.functions import pixels
from stratacube.operators import temporal


def late(batch: DataFrame, last: int | None, t: str = "t") -> DataFrame:
    """Rows of a batch that aren't after the last stored step."""
    return batch.filter(F.col(t) <= last) if last is not None else batch.filter(F.lit(False))


def fresh(batch: DataFrame, last: int | None, t: str = "t") -> DataFrame:
    return batch.filter(F.col(t) > last) if last is not None else batch


def appended(stored: DataFrame, batch: DataFrame, t: str = "t") -> DataFrame:
    """The table after the append; raises if the batch holds steps that aren't after the stored ones, listing them."""
    last = stored.agg(F.max(t)).first()[0]
    bad = [r[t] for r in late(batch, last, t).select(t).distinct().orderBy(t).limit(20).collect()]
    if bad:
        raise ValueError(f"steps {bad} are not after step {last}, the last that is stored; nothing was written")
    return stored.unionByName(batch)


def extended_references(refs: DataFrame, n_before: int, n_after: int, interval: int) -> DataFrame:
    """t, anchor_t after an append: recorded references as they are, new steps refer to the nearest anchor there is now."""
    new = temporal.references(refs.sparkSession, n_after, interval).filter(F.col("t") >= n_before)
    return refs.filter(F.col("t") < n_before).unionByName(new)


def encoded_batch(batch: DataFrame, known: DataFrame, refs: DataFrame, keys: Sequence[str] = ("b", "y", "x"), value: str = "v", bits: int = 16) -> DataFrame:
    """batch as stored rows (r): anchors may lie in earlier batches, so the batch is joined with the known anchors it refers to."""
    rows = temporal.with_reference(batch, refs)
    anchors = known.join(refs.select(F.col("anchor_t").alias("t")).distinct(), "t", "left_semi").select(F.col("t").alias("anchor_t"), *keys, F.col(value).alias("_a"))
    base = F.when(F.col("t") == F.col("anchor_t"), F.lit(0)).otherwise(F.coalesce("_a", F.lit(0)))
    return rows.join(anchors, ["anchor_t", *keys], "left").withColumn("r", pixels.residual(F.col(value), base, bits)).select("t", *keys, "r")


def decoded(stored: DataFrame, refs: DataFrame, keys: Sequence[str] = ("b", "y", "x"), bits: int = 16) -> DataFrame:
    """Values from stored rows through the recorded references only."""
    rows = temporal.with_reference(stored, refs)
    return temporal.star_delta_decode(rows, F.col("anchor_t"), keys, "r", "t", bits, "v")


def monthly(df: DataFrame, ts: str, *aggregates: Column) -> DataFrame:
    """month ("yyyy-MM") and aggregates; the same on a batch and on a stream (give the stream a watermark on ts)."""
    return df.groupBy(F.date_format(ts, "yyyy-MM").alias("month")).agg(*aggregates)


def append_stream(source: DataFrame, path: str, checkpoint: str, last_step: Callable[[], int | None], t: str = "t"):
    """A streaming query that appends each micro-batch's fresh steps to ``path`` and its late rows to ``path``_late.

    The batch number is part of the folder, so a batch that is run again after a failure replaces what it wrote before.
    last_step() gives the last step stored before this batch (see stored_step()).
    """

    def sink(batch: DataFrame, number: int) -> None:
        last = last_step()
        rows = batch.persist()
        try:
            fresh(rows, last, t).write.mode("overwrite").parquet(f"{path}/batch={number}")
            late(rows, last, t).write.mode("overwrite").parquet(f"{path}_late/batch={number}")
        finally:
            rows.unpersist()

    return source.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def stored_step(spark, path: str, t: str = "t") -> int | None:
    """The last step stored under path, None if nothing is."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return spark.read.parquet(path).agg(F.max(t)).first()[0]


def latest_per_pixel(spark, source: DataFrame, keys: Sequence[str] = ("y", "x"), value: str = "v", t: str = "t") -> DataFrame:
    """A stream of carried-forward values: the last value seen so far of each pixel, kept as state (update mode)."""
    return source.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.max(F.struct(F.col(t), F.col(value))).alias("_last")).select(*keys, F.col(f"_last.{t}").alias(t), F.col(f"_last.{value}").alias(value))
