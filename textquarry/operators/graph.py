"""Dependency graphs as node and edge tables: resolution, reverse index, hot spots, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textquarry.functions.paths import stem

#: What a dependency on `a.b` may be written as among paths, tried in this order after the stems.
PATH_FORMS = ("{}.py", "{}.ts", "{}.tsx", "{}.js", "{}.jsx", "{}/index.ts", "{}/index.tsx", "{}/index.js", "{}/__init__.py")


def stripped(dependency: Column) -> Column:
    """The module that an import text names: without `from`, `import` and what follows the name."""
    return F.regexp_replace(F.regexp_replace(F.trim(dependency), r"^(from|import)\s+", ""), r"\s+(import|as)\s+.*$", "")


def dependencies(modules: DataFrame) -> DataFrame:
    """(project, source, raw, name): one row for each distinct dependency of a module."""
    rows = modules.select("project", F.col("path").alias("source"), F.explode("dependencies").alias("raw")).where(F.trim("raw") != "").distinct()
    return rows.withColumn("name", stripped(F.col("raw")))


def resolved(modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the dependency graph.

    A dependency is looked up as a stem (whole name, first segment, last segment) and then as a path in PATH_FORMS; the first hit wins, and of
    modules with one stem the smallest path. A hit on the module itself or no hit makes an external node of the name's first segment.
    """
    deps = dependencies(modules)
    n = F.col("name")
    parts = F.split(n, "[./]")
    slashed = F.replace(n, F.lit("."), F.lit("/"))
    keys = [n, F.get(parts, F.lit(0)), F.element_at(parts, -1)]
    keys += [F.concat(F.lit("/"), F.format_string(f.replace("{}", "%s"), slashed)) for f in PATH_FORMS]
    tried = deps.select("project", "source", "raw", "name", F.posexplode(F.array(*keys)).alias("rank", "key"))
    stems = modules.select("project", stem(F.col("path")).alias("key"), F.col("path").alias("target"))
    paths = modules.select("project", F.concat(F.lit("/"), F.col("path")).alias("key"), F.col("path").alias("target"))
    lookup = stems.union(paths).groupBy("project", "key").agg(F.min("target").alias("target"))
    best = tried.join(lookup, ["project", "key"]).groupBy("project", "source", "raw", "name").agg(F.min_by("target", "rank").alias("target"))
    rows = deps.join(best, ["project", "source", "raw", "name"], "left")
    inside = F.col("target").isNotNull() & (F.col("target") != F.col("source"))
    rows = rows.select("project", "source", F.when(inside, F.col("target")).otherwise(F.concat(F.lit("external:"), F.get(F.split("name", "[./]"), F.lit(0)))).alias("target"), F.when(inside, "import").otherwise("external").alias("type"))
    edges = rows.groupBy("project", "source", "target").agg(F.min("type").alias("type"))
    own = modules.select("project", F.col("path").alias("id"), "name", "purpose", F.lit("module").alias("type"))
    outer = edges.where("type = 'external'").select("project", F.col("target").alias("id"), F.substring("target", 10, 1000).alias("name"), F.lit(None).cast("string").alias("purpose"), F.lit("external").alias("type")).distinct()
    return own.unionByName(outer), edges


def imported_by(modules: DataFrame) -> DataFrame:
    """(project, path, importers): modules whose dependency stems are the module's stem, itself left out, sorted."""
    # a dependency `a.b.c` has the stem `a.b`, one of a single part is its own
    name = F.regexp_replace(F.element_at(F.split(F.trim("raw"), "/"), -1), r"(.)\.[^.]*$", "$1")
    deps = dependencies(modules).select("project", "source", name.alias("stem")).distinct()
    targets = modules.select("project", F.col("path"), stem(F.col("path")).alias("stem"))
    found = deps.join(targets, ["project", "stem"]).where("source <> path")
    return found.groupBy("project", "path").agg(F.sort_array(F.collect_set("source")).alias("importers"))


def hot_spots(edges: DataFrame, least: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, target, used_by, hot): distinct sources of each target."""
    return edges.groupBy(*by, "target").agg(F.count_distinct("source").alias("used_by")).withColumn("hot", F.col("used_by") >= least)


def distinct_edges(edges: DataFrame, order: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Distinct (source, target); the type of the first in `order` is kept."""
    return edges.groupBy(*by, "source", "target").agg(F.min_by("type", order).alias("type"))


def neighbourhood(edges: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around a set of start nodes (id): the starts, what they touch, and the edges that touch them."""
    s = starts.select("id").distinct()
    out = edges.join(s.withColumnRenamed("id", "source"), "source", "left_semi").select(*edges.columns)
    touching = out.union(edges.join(s.withColumnRenamed("id", "target"), "target", "left_semi").select(*edges.columns)).distinct()
    nodes = s.union(touching.select("source")).union(touching.select("target")).distinct()
    return nodes, touching


def visible(nodes: DataFrame, edges: DataFrame, externals: bool = False, pattern: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes with or without the external ones, and the edges whose both ends are left; nodes that hold `pattern` are flagged."""
    shown = nodes if externals else nodes.where("type <> 'external'")
    if pattern is not None:
        shown = shown.withColumn("flagged", F.coalesce(F.array_contains("patterns", pattern), F.lit(False)))
    ids = shown.select("id").distinct()
    kept = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return shown, kept.select(*edges.columns)


def active_context(modules: DataFrame, touched: DataFrame, limit: int = 8) -> DataFrame:
    """(project, path): modules whose stem was touched (project, path), modules that import them, and what they import by name; the first `limit` of each project."""
    from pyspark.sql.window import Window

    keyed = modules.withColumn("stem", stem(F.col("path")))
    stems = touched.select("project", stem(F.col("path")).alias("stem")).distinct()
    seeds = keyed.join(stems, ["project", "stem"], "left_semi").select("project", "path", "name", "dependencies")
    importers = imported_by(modules).join(seeds.select("project", "path"), ["project", "path"], "left_semi").select("project", F.explode("importers").alias("path"))
    wanted = seeds.select("project", F.explode("dependencies").alias("raw")).select("project", stripped(F.col("raw")).alias("name")).distinct()
    imported = modules.join(wanted, ["project", "name"], "left_semi").select("project", "path")
    rows = seeds.select("project", "path", F.lit(0).alias("o")).union(importers.withColumn("o", F.lit(1))).union(imported.withColumn("o", F.lit(2))).groupBy("project", "path").agg(F.min("o").alias("o"))
    w = Window.partitionBy("project").orderBy("o", "path")
    return rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= limit).select("project", "path")
