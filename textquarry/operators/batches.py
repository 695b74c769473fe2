"""Greedy batches under a budget, without a pass through a project's files in order.

Files are laid on the line of running sizes. The batch after the one that begins at p begins with the file that covers p + budget, so spans of the
line are worked out on their own: where a batch that enters the span at each possible place leads. Pointer doubling over spans then finds the
places that are really entered.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from textquarry.operators.ordered import running
from textquarry.sources.shared import stored


def _ways(budget: int, width: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """For one span and the head of the next: from each place that a batch can enter at, the beginnings in the span and the place in the next."""

    def one(files: pd.DataFrame) -> pd.DataFrame:
        files = files.sort_values("at")
        span, at, size = files["span"].iloc[0], files["at"].to_numpy(), files["s"].to_numpy()
        low, high = span * width, (span + 1) * width
        then = np.searchsorted(at, at + budget, "right") - 1
        then[at[then] + size[then] <= at + budget] = -1
        entries = np.flatnonzero((at < min(low + budget, high)) & ((span > 0) | (at == 0)))
        here, steps = entries.copy(), []
        while (inside := (here >= 0) & (at[here] < high)).any():
            steps.append(np.where(inside, at[here], -1))
            here = np.where(inside, then[here], here)
        out = pd.DataFrame({"by": [files["by"].iloc[0]] * len(entries), "span": span, "entry": at[entries]})
        out["starts"] = [[int(x) for x in row if x >= 0] for row in np.array(steps).T] if steps else []
        out["exit"] = pd.array([int(at[h]) if h >= 0 else None for h in here], dtype="Int64")
        return out

    return one


def _same(at: str, other: str) -> Column:
    """The condition of a join of `l`, by its column `at`, with `r`, by its column `other`, within a project."""
    return F.col("l.by").eqNullSafe(F.col("r.by")) & (F.col(f"l.{at}") == F.col(f"r.{other}"))


def _entered(ways: DataFrame) -> DataFrame:
    """(by, at, first): the places where a batch really enters a span and that batch's number; as many rounds as the longest project's spans have bits."""
    rounds = int(ways.agg(F.coalesce(F.max("span"), F.lit(0))).first()[0]).bit_length()
    jumps = ways.select("by", "entry", "exit", F.size("starts").cast("long").alias("n"))
    found = ways.where("entry = 0").select("by", F.col("entry").alias("at"), F.lit(0).cast("long").alias("first"))
    for _ in range(rounds):
        go = jumps.where("exit is not null")
        led = found.alias("l").join(go.alias("r"), _same("at", "entry")).selectExpr("l.by", "r.exit AS at", "l.first + r.n AS first")
        found = stored(found.unionByName(led))
        jumps = stored(go.alias("l").join(jumps.alias("r"), _same("exit", "entry")).selectExpr("l.by", "l.entry", "r.exit", "l.n + r.n AS n"))
    return found


def greedy_batches(files: DataFrame, by: str = "project", key: str = "path", size: str = "size", budget: int = 300_000, cap: int = 20_000, spread: int = 16) -> DataFrame:
    """(by, key, batch): files in order of key; a new batch begins where the next file would exceed the budget.

    A file counts as at most `cap`, which may not exceed the budget; one of unknown size as `cap`, a negative one as 0. Empty files stay in the
    batch before them. Null is a project like others; keys are unique in a project. A task holds `spread` budgets' worth of files, never a project.
    """
    if not 0 < cap <= budget:
        raise ValueError("cap has to lie between 1 and the budget")
    width = spread * budget
    rows = files.select(F.col(by).alias("by"), F.col(key).alias("key"), F.greatest(F.least(F.col(size), F.lit(cap)), F.lit(0)).cast("long").alias("s"))
    laid = stored(running(rows, [F.col("key")], F.col("s"), "at", ("by",)).withColumn("span", F.expr(f"at div {width}")))
    full = laid.where("s > 0").select("by", "span", "at", "s")
    heads = full.where((F.col("at") % width < budget) & (F.col("span") > 0)).withColumn("span", F.col("span") - 1)
    kind = dict(rows.dtypes)["by"]
    ways = stored(full.unionByName(heads).groupBy("by", "span").applyInPandas(_ways(budget, width), f"by {kind}, span long, entry long, starts array<long>, exit long"))
    met = _entered(ways)
    real = ways.alias("l").join(met.alias("r"), _same("entry", "at")).selectExpr("l.by", "span", "starts", "exit", "first")
    ends = real.where("exit is null").select("by", F.col("span") + 1, F.array().cast("array<long>"), "exit", F.col("first") + F.size("starts"))
    marks = real.union(ends).drop("exit")
    begun = F.size(F.filter("starts", lambda x: (x < F.col("at")) | ((x == F.col("at")) & (F.col("s") > 0))))
    batch = F.greatest(F.coalesce(F.col("first") - 1 + begun, F.lit(0)), F.lit(0)).cast("int")
    return laid.alias("l").join(marks.alias("r"), _same("span", "span"), "left").select(F.col("l.by").alias(by), F.col("key").alias(key), batch.alias("batch"))
