"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where it is unset, as in tests on one machine, a folder of our own that the session then keeps."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("textquarry.scratch", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="textquarry-")
        spark.conf.set("textquarry.scratch", folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """Writes `df` as a Parquet table in the shared folder and reads it back: lineage ends there, and any executor can reread it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/textquarry-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["stored_at"] = path
    return out


def discard(*frames: DataFrame) -> None:
    """Removes what `stored` wrote for these frames. Only for frames that nothing but tables already written was made from."""
    for df in frames:
        path = df.__dict__.get("stored_at")
        if path:
            jvm = df.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


@contextmanager
def by_key(df: DataFrame, key: str) -> Iterator[DataFrame]:
    """`df` as a table laid out by `key`, so that joins on it don't move it again. It is dropped at the end."""
    spark = df.sparkSession
    name, buckets = f"textquarry_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(buckets, key).write.bucketBy(buckets, key).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"drop table if exists {name}")
