"""Tables kept by whole versions: modules and snapshots by project, artifacts by type, vectors by index version.

A write puts its rows in a folder of its own; a commit, written last as one file, says which parts (values of the column `by`) they replace or that
parts are gone. Readers see committed rows only, so a write that was cut off changes nothing, and earlier versions can still be read.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

_COMMITS = "part string, placed string, version long"


def _part(by: str) -> Column:
    return F.col(by).cast("string")


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """(part, placed, version): what each version replaced; `placed` is null where it removed a part."""
    try:
        return spark.read.schema(_COMMITS).parquet(f"{folder}/commits")
    except AnalysisException:
        return spark.createDataFrame([], _COMMITS)


def last_version(spark: SparkSession, folder: str) -> int:
    return commits(spark, folder).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]


def _commit(parts: DataFrame, folder: str) -> int:
    version = last_version(parts.sparkSession, folder) + 1
    parts.select("part", "placed").coalesce(1).write.mode("errorifexists").parquet(f"{folder}/commits/version={version}")
    return version


def save(table: DataFrame, folder: str, by: str = "project") -> int:
    """Replaces the parts that `table` has rows of, leaves the others alone, and gives the new version's number.

    Null is a part like others. An empty table changes nothing. Of two writers at once one fails at its commit and may write again.
    """
    placed = uuid.uuid4().hex
    path = f"{folder}/rows/_placed={placed}"
    table.sortWithinPartitions(by).write.parquet(path)
    parts = table.sparkSession.read.schema(table.schema).parquet(path).select(_part(by).alias("part")).distinct()
    return _commit(parts.withColumn("placed", F.lit(placed)), folder)


def remove(parts: DataFrame, folder: str, by: str = "project") -> int:
    """Removes the parts that `parts` names in its column `by`; unknown ones are as well removed already."""
    return _commit(parts.select(_part(by).alias("part"), F.lit(None).cast("string").alias("placed")).distinct(), folder)


def load(spark: SparkSession, folder: str, schema: T.StructType, by: str = "project", version: int | None = None) -> DataFrame:
    """The rows of the last version or of `version`; without a commit the empty table."""
    known = commits(spark, folder)
    known = known if version is None else known.where(F.col("version") <= version)
    live = known.groupBy("part").agg(F.max_by("placed", "version").alias("_live")).where("_live is not null").withColumnRenamed("part", "_part")
    try:
        rows = spark.read.schema(T.StructType([*schema, T.StructField("_placed", T.StringType())])).parquet(f"{folder}/rows")
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return rows.join(live, (F.col("_placed") == F.col("_live")) & _part(by).eqNullSafe(F.col("_part")), "left_semi").drop("_placed")
