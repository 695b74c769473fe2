"""Reports over findings, issues, chunk results and edit logs; tolerant JSON; artifact search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from textquarry.operators.ordered import running
from textquarry.operators.vectors import asked_all, in_blocks

SEVERITIES = ("critical", "high", "medium", "low")


def issue_summary(issues: DataFrame, by: list[str]) -> DataFrame:
    """(by, total, errors, warnings, infos)."""
    return issues.groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(F.col("severity") == s).alias(n) for s, n in (("error", "errors"), ("warning", "warnings"), ("info", "infos"))])


def json_candidates(raw: Column) -> list[Column]:
    """Texts that may be the JSON in an answer, each null if it can't be: all of it, the first fenced block, from the first brace or bracket to the last."""
    some = lambda t: F.when(t.rlike(r"\A\s*[\[{]"), t)
    fenced = F.when(raw.contains("```"), F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)```", 1))
    between = lambda a, b: F.when(F.locate(a, raw) > 0, F.substring(raw, F.locate(a, raw), F.length(raw) - F.locate(b, F.reverse(raw)) + 2 - F.locate(a, raw)))
    return [some(F.trim(raw)), some(F.trim(fenced)), *(F.when(F.contains(t, F.lit(b)), t) for t, b in ((between("{", "}"), "}"), (between("[", "]"), "]")))]


def plain_literals(text: Column) -> Column:
    """Python literals and quotes as JSON ones, for texts that hold no double quotes."""
    fixed = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\bTrue\b", "true"), r"\bFalse\b", "false"), r"\bNone\b", "null")
    return F.when(fixed.contains('"'), fixed).otherwise(F.translate(fixed, "'", '"'))


def parsed(df: DataFrame, raw: str, schema: str, out: str = "parsed") -> DataFrame:
    """Adds `out`, the first candidate that reads as JSON of the schema, ok, and fallback (the first 200 characters) where none does."""
    good = lambda t: F.when(F.try_parse_json(t).isNotNull(), t)
    # exploding arrays of one item keeps the optimizer from copying what is below into each use of it
    once = lambda rows, name, value: rows.withColumn(name, F.explode(F.array(value)))
    rows = once(df, "__tried", F.array_compact(F.array(*json_candidates(F.col(raw)))))
    rows = once(rows, "__good", F.coalesce(*[good(F.get("__tried", F.lit(i))) for i in range(4)], *[good(plain_literals(F.get("__tried", F.lit(i)))) for i in range(4)]))
    rows = rows.withColumns({out: F.from_json("__good", schema), "ok": F.col("__good").isNotNull()}).drop("__tried", "__good")
    return rows.withColumn("fallback", F.when(~F.col("ok"), F.substring(raw, 1, 200)))


FINDING = "array<struct<line int, category string, severity string, value string, reason string>>"


def findings(answers: DataFrame, key: str = "path", raw: str = "raw") -> DataFrame:
    """(key, line, category, severity, value, reason) of each finding in answers that hold a JSON array; an answer that doesn't is one row of category parse_failure."""
    rows = parsed(answers.select(key, raw), raw, FINDING)
    text = lambda v: v.cast("string")
    failure = F.struct(F.lit(None).cast("int").alias("line"), F.lit("parse_failure").alias("category"), F.lit("low").alias("severity"), text(F.lit(None)).alias("value"), F.coalesce("fallback", raw).alias("reason"))
    return rows.select(key, F.explode(F.coalesce("parsed", F.array(failure))).alias("f")).select(key, "f.*")


def severity_rank(severity: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.lower(severity)).cast("int"), F.lit(0))


def consolidated(found: DataFrame) -> DataFrame:
    """(severity, category, n, n_files) with the gravest severity first."""
    rows = found.groupBy(F.lower("severity").alias("severity"), "category").agg(F.count("*").alias("n"), F.count_distinct("path").alias("n_files"))
    rank = severity_rank(F.col("severity"))
    return rows.orderBy(F.when(rank == 0, 99).otherwise(rank), F.desc("n"), "category")


def merged_chunks(chunks: DataFrame, key: str = "path", index: str = "chunk_index") -> DataFrame:
    """One row per file from its chunks' results: last purpose and first hint that aren't empty, whether any is critical, and both lists'
    distinct items in order of first appearance."""
    filled = lambda c: F.when(F.trim(c) != "", F.col(c))
    rows = chunks.groupBy(key).agg(
        F.max_by(filled("purpose"), F.when(filled("purpose").isNotNull(), F.col(index))).alias("purpose"), F.min_by(filled("hint"), F.when(filled("hint").isNotNull(), F.col(index))).alias("hint"),
        F.coalesce(F.bool_or("critical"), F.lit(False)).alias("critical"), F.array_sort(F.collect_list(F.struct(index, "interface", "dependencies"))).alias("parts"),
    )
    lists = {n: F.array_distinct(F.flatten(F.filter(F.col(f"parts.{n}"), lambda x: x.isNotNull()))) for n in ("interface", "dependencies")}
    return rows.withColumns(lists).drop("parts")


def analysis_statistics(files: DataFrame, language: str = "language", n_lines: str = "n_lines", confidence: str = "confidence") -> DataFrame:
    """(language, n_files, n_lines, avg_confidence); no confidence averages to 0."""
    return files.groupBy(language).agg(F.count("*").alias("n_files"), F.coalesce(F.sum(n_lines), F.lit(0)).alias("n_lines"), F.coalesce(F.avg(confidence), F.lit(0.0)).alias("avg_confidence"))


def ordered_distinct(rows: DataFrame, by: list[str], item: str, order: str) -> DataFrame:
    """(by, item, position): distinct items in order of first appearance, from 1."""
    first = rows.groupBy(*by, item).agg(F.min(order).alias("first"))
    w = Window.partitionBy(*by).orderBy("first", item)
    return first.select(*by, item, F.row_number().over(w).alias("position"))


def edit_hints(edits: DataFrame, key: str = "path", order: str = "ts", note: str = "note", most: int = 400) -> DataFrame:
    """(key, hint): the newest notes first, cut to `most` characters; no more notes than could fit are gathered."""
    w = Window.partitionBy(key).orderBy(F.desc(order), F.col(note))
    some = edits.where(F.trim(note) != "").withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    rows = some.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("k", note))).alias("notes"))
    return rows.select(key, F.substring(F.array_join(F.col(f"notes.{note}"), " | "), 1, most).alias("hint"))


def window_batches(files: DataFrame, by: str = "project", key: str = "path", size: str = "size", budget: int = 300_000, cap: int = 20_000) -> DataFrame:
    """(by, key, batch): a file's batch is the budget's multiple its running size has reached. Large projects lie in several ranges; a batch may exceed the budget by one file. Keys are unique in a project."""
    sized = running(files.select(by, key, F.coalesce(F.least(F.col(size), F.lit(cap)), F.lit(0)).alias("s")), [F.col(key)], F.col("s"), "before", (by,))
    return sized.select(by, key, F.floor(F.col("before") / budget).cast("int").alias("batch"))


def keyword_hits(artifacts: DataFrame, queries: DataFrame, threshold: float = 0.80, keep: int = 5, block: int = 1000) -> DataFrame:
    """(query_id, artifact_type, artifact_id, relevance, rank): artifacts whose name, description or evidence holds the whole lower-cased query.

    Relevance is 1 for the exact name or 0.8 for a name that holds it, 0.5 for the description, 0.2 times the confidence, at most 1. Artifacts
    below the confidence threshold are left out; a missing confidence is 0.5. Queries are asked in blocks of about `block`.
    """
    asked = queries.select("query_id", F.lower("query").alias("q"))
    packed, blocks = in_blocks(asked, F.struct("query_id", "q"), "query_id", block)
    sure = F.coalesce("confidence", F.lit(0.5))
    rows = asked_all(artifacts.where(sure >= threshold), packed, blocks).withColumn("a", F.explode("asked"))
    q, name, about = F.col("a.q"), F.lower(F.coalesce("name", F.lit(""))), F.lower(F.coalesce("description", F.lit("")))
    found = name.contains(q) | about.contains(q) | F.coalesce(F.exists("evidence", lambda e: F.lower(e).contains(F.col("a.q"))), F.lit(False))
    relevance = F.when(name == q, 1.0).when(name.contains(q), 0.8).otherwise(0.0) + F.when(about.contains(q), 0.5).otherwise(0.0) + 0.2 * sure
    rows = rows.where(found).select(F.col("a.query_id").alias("query_id"), "artifact_type", "artifact_id", F.least(F.lit(1.0), relevance).alias("relevance"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("relevance", 9)), "artifact_type", "artifact_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def hydrated(hits: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(query_id, descriptions, sources, confidence): the artifacts behind each query's hits, in rank order, and their mean confidence."""
    rows = hits.join(artifacts.select("artifact_type", "artifact_id", "description", "source_file", "confidence"), ["artifact_type", "artifact_id"])
    grouped = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "description", "source_file"))).alias("r"), F.avg(F.coalesce("confidence", F.lit(0.5))).alias("confidence"))
    return grouped.select("query_id", F.col("r.description").alias("descriptions"), F.array_distinct("r.source_file").alias("sources"), "confidence")


def unified(**branches: DataFrame) -> DataFrame:
    """Hits (query_id, id, score) of several searches with the method that found them."""
    tagged = [df.select("query_id", F.col("id").cast("string").alias("id"), F.col("score").cast("double").alias("score"), F.lit(name).alias("method")) for name, df in branches.items()]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    return out


def module_matches(modules: DataFrame, queries: DataFrame, keep: int = 4, block: int = 1000) -> DataFrame:
    """(query_id, path, score, rank): shared distinct words of query and module, 5 more if the query names the module, 3 more for source files."""
    from textquarry.functions.paths import LANGUAGES, extension

    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda w: w != ""))
    asked = F.struct("query_id", F.lower("query").alias("q"), words(F.col("query")).alias("w"))
    packed, blocks = in_blocks(queries, asked, "query_id", block)
    own = modules.select("path", F.lower("name").alias("name"), words(F.concat_ws(" ", "name", "path", "purpose")).alias("w"))
    rows = asked_all(own, packed, blocks).withColumn("a", F.explode("asked"))
    code = extension(F.col("path")).isin(*[e for e in LANGUAGES if e not in ("toml", "yaml", "yml", "json", "md")])
    score = F.size(F.array_intersect("w", F.col("a.w"))) + F.when(F.col("a.q").contains(F.col("name")), 5).otherwise(0)
    rows = rows.select(F.col("a.query_id").alias("query_id"), "path", score.alias("s"), code.alias("code")).where("s > 0")
    rows = rows.select("query_id", "path", (F.col("s") + F.when(F.col("code"), 3).otherwise(0)).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "path")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def task_relevance(modules: DataFrame, task: str) -> DataFrame:
    """Adds relevance: how many of the task's words longer than 3 characters occur in the module's texts."""
    text = F.lower(F.concat_ws(" ", "name", "path", "purpose", F.array_join("public_interface", " ")))
    asked = sorted({w for w in task.lower().split() if len(w) > 3})
    return modules.withColumn("relevance", sum((F.contains(text, F.lit(w)).cast("int") for w in asked), F.lit(0)))
