"""Query, session and event logs in batch: usage, windows, histories, stalls, rate limits."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

MINUTE, HOUR = 60, 3600


def routing_metrics(log: DataFrame, prices: DataFrame, cheap: str) -> DataFrame:
    """(complexity, model, n, tokens, cost, cost_per_query, cheap_share, n_fallbacks) of a log (complexity, model, tokens, fallback)."""
    rows = log.join(prices, "model", "left").groupBy("complexity", "model").agg(
        F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") / 1000 * F.coalesce("price_per_1k", F.lit(0.0))).alias("cost"), F.count_if("fallback").alias("n_fallbacks")
    )
    total = rows.agg(F.sum("n").alias("all"), F.sum(F.when(F.col("model") == cheap, F.col("n")).otherwise(0)).alias("cheap"))
    rows = rows.join(total).withColumn("cheap_share", F.col("cheap") / F.greatest(F.lit(1), "all"))
    return rows.withColumn("cost_per_query", F.col("cost") / F.greatest(F.lit(1), "n")).drop("all", "cheap")


def usage(events: DataFrame, key: str) -> DataFrame:
    return events.groupBy(key).agg(F.count("*").alias("n_calls"))


def session_activity(events: DataFrame, session: str, project: str, ts: str = "ts") -> DataFrame:
    """(session, project, first_access, last_access, n)."""
    return events.groupBy(session, project).agg(F.min(ts).alias("first_access"), F.max(ts).alias("last_access"), F.count("*").alias("n"))


def last_items(rows: DataFrame, session: str, order: list[str], keep: int = 20) -> DataFrame:
    """The last `keep` rows of each session by `order`, numbered from 1 for the newest."""
    w = Window.partitionBy(session).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= keep)


def last_projects(events: DataFrame, session: str, project: str, order: list[str], keep: int = 5) -> DataFrame:
    """The last `keep` distinct projects of each session by first use: one that is used again keeps its place."""
    first = events.groupBy(session, project).agg(F.min(F.struct(*order)).alias("first"))
    w = Window.partitionBy(session).orderBy(F.desc("first"))
    return first.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= keep).drop("first")


def short_query(query: Column, most: int = 100) -> Column:
    return F.substring(query, 1, most)


def window_counts(events: DataFrame, key: str, ts: str = "ts", spans: tuple[tuple[str, int], ...] = (("last_minute", MINUTE), ("last_hour", HOUR))) -> DataFrame:
    """Adds for each event how many of its key lie in (ts - span, ts], rows of the same time included."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = events.withColumn("us", us)
    for name, seconds in spans:
        w = Window.partitionBy(key).orderBy("us").rangeBetween(-(seconds * 1_000_000 - 1), 0)
        rows = rows.withColumn(name, F.count("*").over(w))
    return rows.drop("us")


class Accepted:
    """Times of accepted calls in the last hour and the last minute; each goes in and out once."""

    def __init__(self, per_minute: int, per_hour: int, times: Iterable[float] = ()):
        self.per_minute, self.per_hour = per_minute, per_hour
        self.hour, self.minute = deque(times), deque(times)

    def ask(self, now: float) -> tuple[bool, int]:
        """Whether a call at `now` is allowed, and else after how many seconds."""
        for times, span in ((self.hour, HOUR), (self.minute, MINUTE)):
            while times and times[0] <= now - span:
                times.popleft()
        if len(self.minute) >= self.per_minute:
            return False, int(self.minute[0] + MINUTE - now) + 1
        if len(self.hour) >= self.per_hour:
            return False, int(self.hour[0] + HOUR - now) + 1
        self.hour.append(now)
        self.minute.append(now)
        return True, 0


def rate_limited(events: DataFrame, key: str, event_id: str, ts: str = "ts", per_minute: int = 60, per_hour: int = 1000) -> DataFrame:
    """(event_id, key, ts, allowed, retry_after): calls are decided one after another; denied ones are not counted later.

    The decision is sequential in one key, whose events stream through one task in time order; only the accepted times of the last hour, at most
    `per_hour`, are held.
    """
    rows = events.select(F.col(event_id), F.col(key), (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("t"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, accepted = object(), Accepted(per_minute, per_hour)
        for batch in batches:
            answers = []
            for k, t in zip(batch[key], batch["t"], strict=True):
                if k != current:
                    current, accepted = k, Accepted(per_minute, per_hour)
                answers.append(accepted.ask(t))
            yield batch.assign(allowed=[a for a, _ in answers], retry_after=[w for _, w in answers])

    ordered = rows.repartition(key).sortWithinPartitions(key, "t", event_id)
    return ordered.mapInPandas(part, f"{event_id} {kinds[event_id]}, {key} {kinds[key]}, t double, allowed boolean, retry_after int")


def stalls(calls: DataFrame, session: str = "session_id", phase: str = "phase", tool: str = "tool", args: str = "args", seq: str = "seq", times: int = 3) -> DataFrame:
    """Adds seen (how often the same call has been made in its phase so far) and stalled (seen at least `times`)."""
    w = Window.partitionBy(session, phase, tool, args).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    return calls.withColumn("seen", F.count("*").over(w)).withColumn("stalled", F.col("seen") >= times)


def active_connections(events: DataFrame, by: list[str], order: list[str], opened: Column, closed: Column) -> DataFrame:
    """Adds active: openings less closings up to each event."""
    step = F.when(opened, 1).when(closed, -1).otherwise(0)
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("active", F.sum(step).over(w))


def job_progress(events: DataFrame, job: str = "job_id", seq: str = "seq", kind: str = "type") -> DataFrame:
    """(job, n_done, total, status, last_seq, fraction) from job events; the latest status event decides the status."""
    status = F.when(F.col(kind).isin("queued", "running", "complete", "error"), F.col(kind))
    rows = events.groupBy(job).agg(F.count_if(F.col(kind) == "file_done").alias("n_done"), F.max("total").alias("total"), F.max(F.when(status.isNotNull(), F.struct(F.col(seq), status.alias("status")))).alias("s"), F.max(seq).alias("last_seq"))
    return rows.select(job, "n_done", "total", F.coalesce("s.status", F.lit("queued")).alias("status"), "last_seq", (F.col("n_done") / F.greatest(F.lit(1), "total")).alias("fraction"))
