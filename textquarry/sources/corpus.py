"""Sources and sinks: packed files, snapshots, module tables, artifacts, project catalogues."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from textquarry.functions.paths import LANGUAGES, base_name, extension, matches_glob
from textquarry.sources import versions

# Folders and files that a scan leaves out.
SKIP_FOLDERS = (
    "node_modules", ".git", "__pycache__", "venv", ".venv", "env", "dist", "build", ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", "coverage", ".coverage", "htmlcoverage", "site-packages", "eggs", ".eggs",
)
SKIP_FILES = (
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "pnpm-lock.yml", "poetry.lock", "Pipfile.lock", "Cargo.lock", "go.sum", "composer.lock", "Gemfile.lock", "mix.lock", ".DS_Store", "*.min.js", "*.min.css",
    "*.bundle.js", "*.chunk.js",
)

_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "array<string>": T.ArrayType(T.StringType())}


def _struct(ddl: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (x.split() for x in ddl.split(", "))])


CORPUS = _struct("project string, path string, content string, size bigint, mtime double, language string")
SNAPSHOT = _struct("project string, path string, size bigint, mtime double, checksum string")
MODULES = _struct("project string, path string, full_path string, name string, purpose string, public_interface array<string>, dependencies array<string>, critical_path boolean, edit_hints string, language string")
ARTIFACTS = _struct("artifact_type string, artifact_id string, name string, description string, evidence array<string>, handling string, confidence double, source_file string")


def scanned(files: DataFrame, extensions: tuple[str, ...] = tuple(LANGUAGES), skip_folders: tuple[str, ...] = SKIP_FOLDERS, skip_files: tuple[str, ...] = SKIP_FILES) -> DataFrame:
    """Rows of `files` (path, ...) that a corpus scan keeps: no skipped or hidden folder on the way, no skipped name, a known extension."""
    folders = F.slice(F.split("path", "/"), F.lit(1), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    skipped = F.exists(folders, lambda f: f.isin(*skip_folders) | (f.startswith(".") & ~f.isin(".", "..")))
    exact = [s for s in skip_files if "*" not in s]
    globs = [s for s in skip_files if "*" in s]
    return files.where(~skipped & extension(F.col("path")).isin(*extensions) & ~base_name(F.col("path")).isin(*exact) & ~matches_glob(base_name(F.col("path")), *globs))


def listed(files: DataFrame, *globs: str) -> DataFrame:
    """Paths that match a glob, sorted; none that climbs out of the root."""
    return files.where(matches_glob(F.col("path"), *globs) & ~F.col("path").rlike(r"(^/)|(^|/)\.\.(/|$)")).select("path").orderBy("path")


def read_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, content, size, mtime) of a folder's files, for packing. Spark's file sources skip names that begin with `_` or `.`: pack such files otherwise."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return raw.select("path", F.decode("content", "UTF-8").alias("content"), F.col("length").alias("size"), F.unix_micros("modificationTime").cast("double").alias("us")).withColumn("mtime", F.col("us") / 1e6).drop("us")


def checksum(content: Column) -> Column:
    """SHA-256 of the UTF-8 bytes."""
    return F.sha2(content.cast("binary"), 256)


def snapshot_of(corpus: DataFrame) -> DataFrame:
    return corpus.select("project", "path", "size", "mtime", checksum(F.col("content")).alias("checksum"))


def write_snapshot(snapshot: DataFrame, folder: str, snapshot_id: str) -> None:
    """Adds a snapshot as partitions of its own, so that a failed job leaves the earlier ones as they are."""
    snapshot.withColumn("snapshot_id", F.lit(snapshot_id)).write.mode("append").partitionBy("project", "snapshot_id").parquet(folder)


def read_snapshot(spark: SparkSession, folder: str, snapshot_id: str) -> DataFrame:
    """The stored snapshot; without a readable table there is none, which is the empty snapshot."""
    try:
        found = spark.read.parquet(folder)
    except AnalysisException:
        return spark.createDataFrame([], SNAPSHOT)
    return found.where(F.col("snapshot_id").cast("string") == snapshot_id).select(*[F.col(f.name).cast(f.dataType) for f in SNAPSHOT])


def write_modules(modules: DataFrame, folder: str) -> int:
    """Replaces the given projects' rows of the module table and leaves other projects alone; gives the new version's number."""
    return versions.save(modules.select(*[F.col(f.name).cast(f.dataType) for f in MODULES]), folder)


def read_modules(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    return versions.load(spark, folder, MODULES, version=version)


def without_project(table: DataFrame, project: str) -> DataFrame:
    """The table without a project's rows, to be written as its next version."""
    return table.where(~F.col("project").eqNullSafe(F.lit(project)))


def imported_artifacts(texts: DataFrame) -> DataFrame:
    """Artifact rows from Markdown texts (path, content) with `key: value` front matter and a fenced JSON block; the block's fields win."""
    front = F.regexp_extract("content", r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    pairs = F.map_from_entries(
        F.transform(
            F.filter(F.split(front, r"\r?\n"), lambda s: s.rlike(r"^\w+\s*:")), lambda s: F.struct(F.regexp_extract(s, r"^(\w+)\s*:", 1).alias("key"), F.trim(F.regexp_extract(s, r"^\w+\s*:\s*(.*)$", 1)).alias("value"))
        )
    )
    block = F.from_json(F.regexp_extract("content", r"(?s)```(?:json)?\s*\r?\n(.*?)\r?\n```", 1), ARTIFACTS)
    rows = texts.select("path", pairs.alias("front"), block.alias("block"))
    plain = [F.coalesce(F.col(f"block.{f.name}"), F.try_element_at("front", F.lit(f.name)).cast(f.dataType)).alias(f.name) for f in ARTIFACTS if not isinstance(f.dataType, T.ArrayType) and f.name != "source_file"]
    return rows.select(*plain, F.coalesce(F.col("block.evidence"), F.array().cast("array<string>")).alias("evidence"), F.coalesce(F.col("block.source_file"), F.col("path")).alias("source_file"))


def _canonical(columns: list[str]) -> Column:
    fields = sorted(c for c in columns if c not in ("artifact_type", "artifact_id"))
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).cast("binary"), 256)


def artifact_checksums(artifacts: DataFrame) -> DataFrame:
    """(artifact_type, artifact_id, checksum) of each artifact's canonical JSON."""
    return artifacts.select("artifact_type", "artifact_id", _canonical(artifacts.columns).alias("checksum"))


def write_artifacts(artifacts: DataFrame, folder: str) -> int:
    """Stores the artifacts of the given types, each with its checksum, as the table's next version."""
    rows = artifacts.select(*[F.col(f.name).cast(f.dataType) for f in ARTIFACTS])
    return versions.save(rows.withColumn("checksum", _canonical(rows.columns)), folder, "artifact_type")


def read_artifacts(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """Stored artifacts with `intact`: whether a row still has the checksum that it was stored with."""
    rows = versions.load(spark, folder, T.StructType([*ARTIFACTS, T.StructField("checksum", T.StringType())]), "artifact_type", version)
    return rows.withColumn("intact", _canonical([f.name for f in ARTIFACTS]) == F.col("checksum"))


def overall_checksum(checksums: DataFrame) -> DataFrame:
    """One row (n, checksum) for all artifacts: an order-free digest that is pre-aggregated, 16 hexadecimal digits at a time."""
    parts = [F.bit_xor(F.conv(F.substring(F.sha2(F.concat_ws("|", "artifact_type", "artifact_id", "checksum").cast("binary"), 256), 1 + 15 * i, 15), 16, 10).cast("long")).alias(f"x{i}") for i in range(4)]
    return checksums.agg(F.count("*").alias("n"), *parts).select("n", F.sha2(F.concat_ws(":", "n", *[F.col(f"x{i}") for i in range(4)]).cast("binary"), 256).alias("checksum"))


def catalogue(projects: DataFrame, modules: DataFrame) -> DataFrame:
    """(project, path, last_analysed, n_modules) with the last analysed first and those never analysed last."""
    counts = modules.groupBy("project").agg(F.count("*").alias("n_modules"))
    rows = projects.join(counts, "project", "left").withColumn("n_modules", F.coalesce("n_modules", F.lit(0)))
    return rows.orderBy(F.desc_nulls_last("last_analysed"), "project")
