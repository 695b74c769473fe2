"""Connected components of a links table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textquarry.llm.scratch import discard, stored


def _settled(edges: DataFrame) -> bool:
    """Whether every node points to one node that points nowhere: then the steps change nothing more."""
    roles = edges.select(F.col("u").alias("x"), F.lit(1).alias("out")).union(edges.select("v", F.lit(0)))
    return roles.groupBy("x").agg(F.sum("out").alias("n"), F.min("out").alias("m")).where("n > 1 or (n > 0 and m = 0)").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return least.select("u", F.col("m").alias("v")).union(edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, root) for every node of `links` (a, b) that isn't its component's smallest node; root is that smallest node.

    Edges only ever point from a node to a smaller one, so the result is a star around each root. Each round is written to the shared folder;
    no round gathers a component in one task: minima are pre-aggregated and the joins are plain equi-joins that Spark may split. With `rounds`
    it stops after so many: each node then has a root of its own component, though not always the smallest.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    done = 0
    while (done < rounds) if rounds is not None else not _settled(edges):
        before, edges = edges, stored(_small_star(_large_star(edges)))
        discard(before)
        done += 1
    if rounds is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
