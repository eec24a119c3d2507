"""Tables and files that are made on the way: in the folder that all executors share, and gone when they have served."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import SparkSession

_made: list[str] = []


def path(spark: SparkSession, what: str) -> str:
    """A new path in ``spark.checkpoint.dir``.

    Only where that setting is absent, as in local tests, a temporary folder takes its place. What is still there when
    the application ends is deleted then.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "stratacube-scratch")
    if not _made:
        atexit.register(_at_end)
    _made.append(f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}")
    return _made[-1]


def mark() -> int:
    """For clear(): what has been made up to now stays."""
    return len(_made)


def delete(jvm, conf, uri: str) -> None:
    where = jvm.org.apache.hadoop.fs.Path(uri)
    where.getFileSystem(conf).delete(where, True)


def clear(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Delete what path() has given since mark(), but for the paths to keep. No table that is read later may be among it."""
    for uri in _made[since:]:
        if uri not in keep:
            delete(spark._jvm, spark.sparkContext._jsc.hadoopConfiguration(), uri)
    _made[since:] = [uri for uri in _made[since:] if uri in keep]


def _at_end() -> None:
    jvm = SparkContext._jvm
    if jvm is not None:
        with contextlib.suppress(Exception):  # the application may have lost its gateway by now
            for uri in _made:
                delete(jvm, jvm.org.apache.hadoop.conf.Configuration(), uri)
