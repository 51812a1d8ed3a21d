"""Sends this package to the Python workers, so that a session started anywhere can run it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the session's Python files, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    here = Path(__file__).parent
    target = os.path.join(tempfile.mkdtemp(prefix="parlance-"), f"{here.name}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(here.rglob("*.py")):
            z.write(path, str(path.relative_to(here.parent)))
    spark.sparkContext.addPyFile(target)
    _sent.add(app)


def small_batches(spark: SparkSession) -> None:
    """The session's Arrow batches get ``BATCH_ROWS`` rows at most, and a batch ends when it has ``BATCH_BYTES``.

    The JVM and the worker hold a batch of whole texts or samples each, several where one worker feeds another, and with
    Spark's 10,000 rows or 64 MB the copies are hundreds of MB.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(name).removesuffix("b")) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def map_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with the package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
