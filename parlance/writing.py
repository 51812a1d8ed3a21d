"""Intermediate tables of iterative plans, written to the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one of this machine only with a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="parlance-")
    return folder


def keeper(spark: SparkSession):
    """A function that writes a table down and reads it again, so a loop's plan stays short."""
    folder = shared_folder(spark)

    def keep(df: DataFrame) -> DataFrame:
        path = f"{folder}/kept-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return keep
