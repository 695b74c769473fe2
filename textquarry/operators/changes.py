"""Change data: snapshot differences, incremental work sets, merges, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

KEY = ["project", "path"]


def diff(old: DataFrame, new: DataFrame, use_checksum: bool = True) -> DataFrame:
    """(project, path, status) with status added, deleted, changed or unchanged: one shuffle of both sides on the key.

    A file is changed when its time or size differs, or, if checksums are used, when both are there and differ.
    """
    a, b = old.alias("a"), new.alias("b")
    joined = a.join(b, (F.col("a.project") == F.col("b.project")) & (F.col("a.path") == F.col("b.path")), "full_outer")
    other = ~F.col("a.mtime").eqNullSafe(F.col("b.mtime")) | ~F.col("a.size").eqNullSafe(F.col("b.size"))
    if use_checksum:
        x, y = F.coalesce("a.checksum", F.lit("")), F.coalesce("b.checksum", F.lit(""))
        other = other | ((x != "") & (y != "") & (x != y))
    status = F.when(F.col("a.path").isNull(), "added").when(F.col("b.path").isNull(), "deleted").when(other, "changed").otherwise("unchanged")
    return joined.select(F.coalesce("a.project", "b.project").alias("project"), F.coalesce("a.path", "b.path").alias("path"), status.alias("status"))


def to_analyse(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keys of files that are new or changed; all of them on the first run, when `old` has none."""
    return diff(old, new).where(F.col("status").isin("added", "changed")).select(*KEY)


def failed(purpose: Column) -> Column:
    """Whether a module's purpose records a failed analysis."""
    return F.coalesce(purpose.startswith("[LLM Error"), F.lit(False))


def to_refresh(old: DataFrame, new: DataFrame, modules: DataFrame) -> DataFrame:
    """(project, path, reason) of files that are new, changed, or whose last result (found by full path, else by relative path) had failed."""
    state = diff(old, new).where(F.col("status") != "deleted")
    by_full = modules.select("project", F.col("full_path").alias("path"), failed(F.col("purpose")).alias("full_failed")).dropDuplicates(KEY)
    by_path = modules.select("project", "path", failed(F.col("purpose")).alias("path_failed")).dropDuplicates(KEY)
    rows = state.join(by_full, KEY, "left").join(by_path, KEY, "left")
    bad = F.coalesce("full_failed", "path_failed", F.lit(False))
    reason = F.when(F.col("status") == "added", "new").when(F.col("status") == "changed", "changed").when(bad, "failed")
    return rows.select(*KEY, reason.alias("reason")).where("reason is not null")


def merged(table: DataFrame, fresh: DataFrame, current: DataFrame) -> DataFrame:
    """Module rows with the fresh ones in place of old ones and without paths that are no longer in `current`."""
    kept = table.join(fresh.select(*KEY), KEY, "left_anti").unionByName(fresh.select(*table.columns))
    return kept.join(current.select(*KEY).distinct(), KEY, "left_semi")


def freshness(old: DataFrame, new: DataFrame) -> DataFrame:
    """(project, n_new, n_changed, n_deleted, is_fresh) by time and size alone."""
    rows = diff(old, new, use_checksum=False).groupBy("project").agg(*[F.count_if(F.col("status") == s).alias(n) for s, n in (("added", "n_new"), ("changed", "n_changed"), ("deleted", "n_deleted"))])
    return rows.withColumn("is_fresh", F.col("n_new") + F.col("n_changed") + F.col("n_deleted") == 0)


def described(counts: DataFrame) -> DataFrame:
    """Adds description, such as "2 modified, 1 new", to rows with n_new, n_changed and n_deleted."""
    parts = [F.when(F.col(c) > 0, F.concat_ws(" ", F.col(c).cast("string"), F.lit(w))) for c, w in (("n_changed", "modified"), ("n_new", "new"), ("n_deleted", "deleted"))]
    return counts.withColumn("description", F.coalesce(F.nullif(F.concat_ws(", ", *parts), F.lit("")), F.lit("no changes")))


def consistency(snapshot: DataFrame, modules: DataFrame) -> DataFrame:
    """(project, n_files, n_modules, n_failed, force): everything is to be redone where files outnumber modules or a module had failed."""
    files = snapshot.groupBy("project").agg(F.count("*").alias("n_files"))
    found = modules.groupBy("project").agg(F.count("*").alias("n_modules"), F.count_if(failed(F.col("purpose"))).alias("n_failed"))
    rows = files.join(found, "project", "full_outer").na.fill(0, ["n_files", "n_modules", "n_failed"])
    return rows.withColumn("force", (F.col("n_files") > F.col("n_modules")) | (F.col("n_failed") > 0))
