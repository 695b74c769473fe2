"""Totals over a global order without one task that sees all of it: rows are sorted by ranges, and what lies in earlier ranges is added as an offset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from textquarry.sources.shared import stored


def running(rows: DataFrame, order: list[Column], amount: Column, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds `name`: the sum of `amount`, a long, over the rows of the same `by` that come before in `order`, which has to tell any two rows apart.

    Each range adds up its own rows; a window over one total for each range gives the offsets.
    """
    sorts = [*[F.col(c) for c in by], *order]
    made = rows.withColumn("_amount", amount.cast("long"))
    keys = [f"_o{i}" for i in range(len(sorts))]
    made = made.select("*", *[c.alias(k) for c, k in zip(sorts, keys, strict=True)])
    placed = made.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()).drop(*keys)
    placed = stored(placed).withColumn("_range", F.shiftright("_at", 33))
    totals = placed.groupBy(*by, "_range").agg(F.sum("_amount").alias("_total"))
    if by:
        earlier = F.sum("_total").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
        groups = [F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]
        offsets = totals.select(*groups, F.col("_range").alias("_r"), F.coalesce(earlier, F.lit(0)).alias("_offset"))
        same = F.col("_r") == F.col("_range")
        for i, c in enumerate(by):
            same = same & F.col(f"_g{i}").eqNullSafe(F.col(c))
        met = placed.join(offsets, same).drop("_r", *[f"_g{i}" for i in range(len(by))])
    else:
        every = totals.agg(F.collect_list(F.struct("_range", "_total")).alias("_totals"))  # one number for each range
        before = F.aggregate(F.filter("_totals", lambda t: t["_range"] < F.col("_range")), F.lit(0).cast("long"), lambda s, t: s + t["_total"])
        met = placed.join(F.broadcast(totals.select("_range").join(F.broadcast(every)).select("_range", before.alias("_offset"))), "_range")
    inside = F.sum("_amount").over(Window.partitionBy(*by, "_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    return met.withColumn(name, F.col("_offset") + F.coalesce(inside, F.lit(0))).drop("_amount", "_at", "_range", "_offset")
