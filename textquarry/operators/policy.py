"""Import policies: forbidden and required imports by file glob."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from textquarry.functions.paths import glob_regex, matches_glob


@dataclass(frozen=True)
class Policy:
    rule_id: str
    description: str = ""
    match_files: str = "*"
    forbidden: tuple[str, ...] = field(default=())
    required: tuple[str, ...] = field(default=())


def forbidden_imports(imports: DataFrame, policies: list[Policy]) -> DataFrame:
    """(path, rule_id, kind, detail, rule_glob): each import (path, module) that a policy of its file forbids, by the first glob that matches."""

    def hit(p: Policy):
        globs = F.filter(F.array(*[F.when(F.col("module").rlike(glob_regex(g)), F.lit(g)) for g in p.forbidden]), lambda g: g.isNotNull())
        found = F.when(matches_glob(F.col("path"), p.match_files) & (F.size(globs) > 0), F.struct(F.lit(p.rule_id).alias("rule_id"), F.get(globs, F.lit(0)).alias("rule_glob")))
        return found

    strict = [p for p in policies if p.forbidden]
    if not strict:
        return imports.limit(0).select("path", F.lit("").alias("rule_id"), F.lit("").alias("kind"), F.lit("").alias("detail"), F.lit("").alias("rule_glob"))
    rows = imports.select("path", "module", F.explode(F.filter(F.array(*[hit(p) for p in strict]), lambda h: h.isNotNull())).alias("h"))
    return rows.select("path", "h.rule_id", F.lit("forbidden").alias("kind"), F.col("module").alias("detail"), "h.rule_glob")


def required_imports(files: DataFrame, policies: list[Policy]) -> DataFrame:
    """(path, rule_id, kind, detail): each required token that neither the imports nor the content of a file (path, imports, content) has."""
    misses = []
    for p in policies:
        for token in p.required:
            absent = ~F.contains(F.array_join("imports", "\n"), F.lit(token)) & ~F.contains(F.col("content"), F.lit(token))
            misses.append(F.when(matches_glob(F.coalesce("path", F.lit("")), p.match_files) & absent, F.struct(F.lit(p.rule_id).alias("rule_id"), F.lit(token).alias("detail"))))
    if not misses:
        return files.limit(0).select("path", F.lit("").alias("rule_id"), F.lit("").alias("kind"), F.lit("").alias("detail"))
    rows = files.select("path", F.explode(F.filter(F.array(*misses), lambda h: h.isNotNull())).alias("h"))
    return rows.select("path", "h.rule_id", F.lit("required").alias("kind"), "h.detail")


def alternatives(forbidden_globs: DataFrame, modules: DataFrame, preferred: tuple[str, ...], most_keywords: int = 1000) -> DataFrame:
    """(keyword, path, score): for the last segment (3 characters or more) of each forbidden glob (glob) the best module whose name or path holds
    it, by how many of the preferred words its text has; ties go to the smaller path. At most `most_keywords` keywords, held on every executor."""
    from pyspark.sql.window import Window

    keywords = forbidden_globs.select(F.lower(F.regexp_replace(F.element_at(F.split("glob", r"[./]"), -1), r"[*?]", "")).alias("keyword")).where(F.length("keyword") >= 3).distinct()
    asked = [r[0] for r in keywords.limit(most_keywords + 1).collect()]
    if len(asked) > most_keywords:
        raise ValueError(f"more than {most_keywords} keywords")
    if not asked:
        return modules.limit(0).select(F.lit("").alias("keyword"), "path", F.lit(0).alias("score"))
    text = F.lower(F.concat_ws(" ", "name", "path", "purpose"))
    score = sum((F.contains(text, F.lit(w)).cast("int") for w in preferred), F.lit(0))
    hits = F.filter(F.array(*[F.lit(k) for k in sorted(asked)]), lambda k: F.contains(F.lower(F.concat_ws(" ", "name", "path")), k))
    rows = modules.select("path", score.alias("score"), F.explode(hits).alias("keyword"))
    best = Window.partitionBy("keyword").orderBy(F.desc("score"), "path")
    return rows.withColumn("k", F.row_number().over(best)).where("k = 1").select("keyword", "path", "score")
