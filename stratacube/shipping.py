"""Making this package importable on the executors."""

from __future__ import annotations

import os
import sys
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Send the package out with ``addPyFile``, once per context, unless the repository is on PYTHONPATH already."""
    paths = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    sc = spark.sparkContext
    if str(ROOT) in paths or getattr(sc, "_stratacube_shipped", False):
        return
    out = os.path.join(tempfile.mkdtemp(prefix="stratacube-ship-"), "stratacube_pkg.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in (ROOT / "stratacube").rglob("*.py"):
            z.write(p, p.relative_to(ROOT))
    kept = list(sys.path)
    sc.addPyFile(out)
    sys.path[:] = kept  # the driver goes on using the sources
    sc._stratacube_shipped = True
