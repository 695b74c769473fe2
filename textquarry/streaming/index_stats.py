"""Statistics of a passage index, kept up to date by signed differences: passages, their total length, and how many have each term.

A store is a folder of three tables, each partitioned by batch. `ledger` has a row (sign -1, the state before) and a row (sign 1, the state after) for
each passage that a batch changed; `deltas` adds them up by term; `commits`, written last, has one row of totals and makes the batch count. A batch
that was cut off has no commit, so no reader sees it, and its repetition writes the same partitions again; a committed batch is not taken twice.
Nothing is rebuilt: a batch reads the ledger only for the passages it changes, and readers add up differences.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from textquarry.operators.block_max import counted


def _table(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """A table of the store; without a file it is empty."""
    try:
        return spark.read.schema(schema).parquet(f"{folder}/{name}")
    except AnalysisException:
        return spark.createDataFrame([], schema)


_TERMS = "array<struct<term: string, tf: int>>"
_COMMITS = "n long, total_len long, batch long"


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """(n, total_len, batch) of the batches that count: what each added."""
    return _table(spark, folder, "commits", _COMMITS)


def _committed(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    return _table(spark, folder, name, schema).join(F.broadcast(commits(spark, folder).select("batch")), "batch", "left_semi")


def _ledger(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    return _committed(spark, folder, "ledger", f"k {kind}, sign int, len long, terms {_TERMS}, batch long")


def _latest(rows: DataFrame) -> DataFrame:
    """(k, len, terms) of the passages that are there after all of the rows."""
    last = rows.groupBy("k").agg(F.max_by(F.struct("sign", "len", "terms"), F.struct("batch", "sign")).alias("s"))
    return last.where("s.sign = 1").select("k", "s.len", "s.terms")


def apply(changes: DataFrame, batch: int, folder: str, key: str = "doc_id", text: str = "text", seq: str | None = None) -> None:
    """Takes one batch of changes (key, text): the new text of a passage, null if it is removed; of several rows of a key the last by `seq` counts.

    Without `seq` keys have to be unique in a batch. Rows with a null key are ignored; so is a batch that has been committed. Numbers of batches rise.
    """
    spark, kind = changes.sparkSession, changes.schema[key].dataType.simpleString()
    if not commits(spark, folder).where(F.col("batch") == batch).isEmpty():
        return
    rows = changes.where(F.col(key).isNotNull())
    if seq is not None:
        rows = rows.groupBy(key).agg(F.max_by(F.struct(F.col(text)), seq).alias("s")).select(key, F.col(f"s.{text}").alias(text))
    new = counted(rows.where(F.col(text).isNotNull()), key, text)
    after = new.select(F.col(key).alias("k"), F.lit(1).alias("sign"), F.col("len").cast("long").alias("len"), F.coalesce("terms", F.array().cast(_TERMS)).cast(_TERMS).alias("terms"))
    earlier = _ledger(spark, folder, kind).where(F.col("batch") < batch).join(rows.select(F.col(key).alias("k")), "k", "left_semi")
    before = _latest(earlier).select("k", F.lit(-1).alias("sign"), "len", "terms")
    before.union(after).write.mode("overwrite").parquet(f"{folder}/ledger/batch={batch}")
    made = spark.read.schema(f"k {kind}, sign int, len long, terms {_TERMS}").parquet(f"{folder}/ledger/batch={batch}")
    deltas = made.select("sign", F.explode("terms.term").alias("term")).groupBy("term").agg(F.sum("sign").alias("df"))
    deltas.where("df <> 0").write.mode("overwrite").parquet(f"{folder}/deltas/batch={batch}")
    totals = made.agg(F.coalesce(F.sum("sign"), F.lit(0)).cast("long").alias("n"), F.coalesce(F.sum(F.col("sign") * F.col("len")), F.lit(0)).cast("long").alias("total_len"))
    totals.coalesce(1).write.mode("overwrite").parquet(f"{folder}/commits/batch={batch}")


def totals(spark: SparkSession, folder: str) -> DataFrame:
    """One row (n, total_len)."""
    return commits(spark, folder).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total_len"), F.lit(0)).alias("total_len"))


def document_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    """(term, df) of all terms that a passage has."""
    return _committed(spark, folder, "deltas", "term string, df long, batch long").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")


def passages(spark: SparkSession, folder: str, kind: str = "bigint") -> DataFrame:
    """(k, len, terms) of the passages that are there; `kind` is the type of their keys."""
    return _latest(_ledger(spark, folder, kind))


def compact(spark: SparkSession, folder: str, into: str, kind: str = "bigint") -> None:
    """Writes the store's present state to a new folder as one batch, numbered like the last, so that later batches go on there."""
    last = commits(spark, folder).agg(F.max("batch")).first()[0]
    if last is None:
        return
    passages(spark, folder, kind).select("k", F.lit(1).alias("sign"), "len", "terms").write.mode("overwrite").parquet(f"{into}/ledger/batch={last}")
    document_frequencies(spark, folder).write.mode("overwrite").parquet(f"{into}/deltas/batch={last}")
    totals(spark, folder).coalesce(1).write.mode("overwrite").parquet(f"{into}/commits/batch={last}")


def maintained(changes: DataFrame, folder: str, checkpoint: str, key: str = "doc_id", text: str = "text", seq: str | None = None) -> StreamingQuery:
    """Applies each micro-batch of a stream of changes to the store; runs until what is there has been taken. A store belongs to one checkpoint."""
    take = lambda batch, number: apply(batch, number, folder, key, text, seq)
    return changes.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
