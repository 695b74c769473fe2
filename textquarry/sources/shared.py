"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where that is unset, as in tests on one machine, a folder that the session keeps."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("textquarry.shared", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="textquarry-")
        spark.conf.set("textquarry.shared", folder)
    return folder


def new_path(spark: SparkSession, name: str = "table") -> str:
    return f"{shared_folder(spark)}/textquarry-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """`df` written as Parquet and read back, which ends its lineage in files that outlive executors."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
