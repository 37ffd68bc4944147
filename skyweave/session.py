"""Shipping the package to Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()

#: What a Python worker takes at a time, where the session does not say: a
#: quarter of Spark's own default, as texts take several times their size.
BATCH, DEFAULT = "16m", "67108864b"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``;
    one is made only where none is named and all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="skyweave-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python once per application, so
    that functions which run there find it without any set-up; and bound what
    workers hold at a time (:data:`BATCH`)."""
    context = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", DEFAULT) == DEFAULT:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp()  # the driver serves the file from here until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, f"{top.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
