"""Corpus size profiles and stratified samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from textquarry.operators.ordered import running


def size_profile(files: DataFrame, by: list[str], stratum: str = "language", sample_above: int = 200) -> DataFrame:
    """(by, stratum, n, n_files, size_class, needs_sample, estimate_s) from counts of files in each group and stratum."""
    counts = files.groupBy(*by, stratum).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("n_files"))
    rows = counts.join(totals, by) if by else counts.join(totals)
    n = F.col("n_files")
    kind = F.when(n < 50, "small").when(n < 200, "medium").when(n < 500, "large").otherwise("xlarge")
    seconds = F.when(n < 50, 10).when(n < 200, 30).when(n < 500, 60).otherwise(120)
    return rows.withColumns({"size_class": kind, "needs_sample": n > sample_above, "estimate_s": seconds})


def scan_counts(files: DataFrame, analysable: Column) -> DataFrame:
    return files.agg(F.count("*").alias("n_files"), F.count_if(analysable).alias("n_analysable"))


def quotas(files: DataFrame, stratum: str = "language", target: int = 200, least: int = 5, left_out: str | None = "other") -> DataFrame:
    """(stratum, n, quota): `least` files of each stratum, or all it has, and then the rest of the target in proportion to what is left, rounded down."""
    rows = files.where(F.col(stratum) != left_out) if left_out is not None else files
    counts = rows.groupBy(stratum).agg(F.count("*").alias("n")).withColumn("base", F.least(F.col("n"), F.lit(least)))
    sums = counts.agg(F.greatest(F.lit(0), F.lit(target) - F.sum("base")).alias("budget"), F.sum(F.col("n") - F.col("base")).alias("left"))
    spare = F.col("n") - F.col("base")
    extra = F.when(F.col("left") > 0, F.floor(spare * F.col("budget") / F.col("left"))).otherwise(0)
    return counts.join(sums).select(stratum, "n", (F.col("base") + F.least(spare, extra)).cast("long").alias("quota"))


def stratified_sample(files: DataFrame, key: str = "path", stratum: str = "language", target: int = 200, least: int = 5, left_out: str | None = "other", seed: str = "sample") -> DataFrame:
    """The rows of each stratum with the smallest hashes of seed and key, as many as its quota."""
    w = Window.partitionBy(stratum).orderBy(F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary"), 256), F.col(key))
    ranked = files.join(quotas(files, stratum, target, least, left_out).select(stratum, "quota"), stratum).withColumn("k", F.row_number().over(w))
    return ranked.where("k <= quota").drop("k", "quota")


def coverage(files: DataFrame, sample: DataFrame, key: str = "path", confidence: str | None = None, factor: float = 0.9) -> DataFrame:
    """All files with sampled, and, if a confidence column is named, that confidence times `factor` where the file wasn't sampled."""
    rows = files.join(sample.select(key).distinct().withColumn("sampled", F.lit(True)), key, "left").withColumn("sampled", F.coalesce("sampled", F.lit(False)))
    return rows if confidence is None else rows.withColumn(confidence, F.when(F.col("sampled"), F.col(confidence)).otherwise(F.col(confidence) * factor))


def prioritised(files: DataFrame, entry: Column, config: Column, n_imports: str = "n_imports", by: tuple[str, ...] = (), key: str = "path") -> DataFrame:
    """Adds tier (1 entry points, 2 configuration, 3 files with imports, 4 the rest) and rank: tier 3 by imports, most first, others by path. Paths are unique."""
    tier = F.when(entry, 1).when(config, 2).when(F.col(n_imports) > 0, 3).otherwise(4)
    rows = files.withColumn("tier", tier)
    order = [F.col("tier"), F.when(F.col("tier") == 3, -F.col(n_imports)).otherwise(0), F.col(key)]
    return running(rows, order, F.lit(1), "rank", by).withColumn("rank", (F.col("rank") + 1).cast("int"))


def key_files(entries: DataFrame, import_counts: DataFrame, configs: DataFrame, by: list[str], keep: int = 20, least: int = 2) -> DataFrame:
    """(by, path, priority, rank): entry points, then modules imported `least` times or more by count, then configuration; `keep` in each group."""
    tagged = entries.select(*by, "path", F.lit(0).alias("priority"), F.lit(0).cast("long").alias("o"))
    tagged = tagged.union(import_counts.where(F.col("n") >= least).select(*by, "path", F.lit(1), -F.col("n").cast("long"))).union(configs.select(*by, "path", F.lit(2), F.lit(0).cast("long")))
    first = tagged.groupBy(*by, "path").agg(F.min(F.struct("priority", "o")).alias("s"))
    w = Window.partitionBy(*by).orderBy("s", "path")
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep).select(*by, "path", "s.priority", "rank")
