import pytest
from pyspark.sql import functions as F

from textquarry.sources import corpus, versions

ROWS = "project string, path string, version int"


def kept(spark, folder, schema, version=None):
    return sorted(map(tuple, versions.load(spark, folder, schema, version=version).collect()), key=str)


def test_versions_replace_remove_and_stay_readable(spark, tmp_path):
    folder = str(tmp_path / "t")
    first = spark.createDataFrame([("p", "a", 1), ("p", "a", 1), ("q", "b", 1), (None, "c", 1), ("", "d", 1), ("01", "e", 1)], ROWS)
    assert kept(spark, folder, first.schema) == [] and versions.last_version(spark, folder) == 0
    assert versions.save(first, folder) == 1
    assert versions.save(spark.createDataFrame([("p", "z", 2), (None, "y", 2)], ROWS), folder) == 2
    assert versions.remove(spark.createDataFrame([("q",), ("unknown",)], "project string"), folder) == 3
    assert kept(spark, folder, first.schema, 1) == sorted(map(tuple, first.collect()), key=str)
    assert kept(spark, folder, first.schema) == sorted([("p", "z", 2), (None, "y", 2), ("", "d", 1), ("01", "e", 1)], key=str)
    versions.save(spark.createDataFrame([("q", "back", 4)], ROWS), folder)
    assert ("q", "back", 4) in kept(spark, folder, first.schema)
    before = kept(spark, folder, first.schema)
    versions.save(first.limit(0), folder)
    assert kept(spark, folder, first.schema) == before


def test_a_write_that_fails_changes_nothing(spark, tmp_path):
    folder = str(tmp_path / "t")
    rows = spark.createDataFrame([("p", "a", 1)], ROWS)
    broken = spark.range(4, numPartitions=4).select(F.lit("p").alias("project"), F.lit("x").alias("path"), F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).otherwise(1).cast("int").alias("version"))
    with pytest.raises(Exception, match="lost"):
        versions.save(broken, folder)
    assert kept(spark, folder, rows.schema) == []
    versions.save(rows, folder)
    with pytest.raises(Exception, match="lost"):
        versions.save(broken, folder)
    rows.write.parquet(f"{folder}/rows/_placed=written-but-not-committed")
    assert kept(spark, folder, rows.schema) == [("p", "a", 1)] and versions.last_version(spark, folder) == 1
    assert versions.save(rows, folder) == 2 and kept(spark, folder, rows.schema) == [("p", "a", 1)]


def test_module_artifact_and_vector_tables(spark, tmp_path):
    modules = spark.createDataFrame([("p", "a.py", "/a.py", "a", "x", ["f"], [], True, None, "python"), ("q", "b.py", "/b.py", "b", None, None, ["a"], False, "h", "python")], corpus.MODULES)
    corpus.write_modules(modules, str(tmp_path / "m"))
    corpus.write_modules(modules.where("project = 'q'").withColumn("name", F.lit("new")), str(tmp_path / "m"))
    assert {r["name"] for r in corpus.read_modules(spark, str(tmp_path / "m")).collect()} == {"a", "new"}
    assert {tuple(map(str, r)) for r in corpus.read_modules(spark, str(tmp_path / "m"), 1).collect()} == {tuple(map(str, r)) for r in modules.collect()}
    made = spark.createDataFrame([("pattern", "1", "n", None, ["e"], None, 0.5, "f"), ("rule", "2", None, "d", [], "h", None, "g")], corpus.ARTIFACTS)
    corpus.write_artifacts(made, str(tmp_path / "a"))
    assert [r["intact"] for r in corpus.read_artifacts(spark, str(tmp_path / "a")).collect()] == [True, True]
    assert {(r[0], r[2]) for r in corpus.artifact_checksums(made).collect()} == {(r["artifact_type"], r["checksum"]) for r in corpus.read_artifacts(spark, str(tmp_path / "a")).collect()}
    vectors = spark.createDataFrame([(1, [0.1, 0.2], "m1"), (2, [0.3, 0.4], "m2")], "vec_id long, embedding array<double>, version string")
    versions.save(vectors, str(tmp_path / "v"), "version")
    versions.remove(spark.createDataFrame([("m1",)], "version string"), str(tmp_path / "v"), "version")
    assert [r["vec_id"] for r in versions.load(spark, str(tmp_path / "v"), vectors.schema, "version").collect()] == [2]
