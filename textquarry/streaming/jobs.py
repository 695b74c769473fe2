"""Structured Streaming twins of the log operators. Event time, watermarks and state bounds are stated for each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from textquarry.operators.logs import Accepted

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_HOUR_MS = 3_600_000


class _RateLimiter(StatefulProcessor):
    """State of a key: accepted times of its last hour, at most the hourly limit; none an hour after the last of them."""

    def __init__(self, per_minute: int, per_hour: int):
        self.per_minute, self.per_hour = per_minute, per_hour

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "t double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values(["t", "event_id"])
        accepted = Accepted(self.per_minute, self.per_hour, [r[0] for r in self.times.get()] if self.times.exists() else [])
        answers = [accepted.ask(t) for t in batch["t"]]
        if accepted.hour:
            self.times.put([(t,) for t in accepted.hour])
            self.handle.registerTimer(int(accepted.hour[-1] * 1000) + _HOUR_MS)
        yield pd.DataFrame({"event_id": batch["event_id"], "key": key[0], "t": batch["t"], "allowed": [a for a, _ in answers], "retry_after": [w for _, w in answers]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [r[0] for r in self.times.get()] if self.times.exists() else []
        if not held or int(max(held) * 1000) + _HOUR_MS <= timerValues.getCurrentWatermarkInMs():
            self.times.clear()
        yield from ()

    def close(self) -> None:
        pass


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query's operators with state have left out as later than their watermark, as far as its recent progress tells."""
    return sum(o.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for o in p["stateOperators"])


def rate_limited(events: DataFrame, key: str, event_id: str, ts: str = "ts", per_minute: int = 60, per_hour: int = 1000, late: str = "1 hour") -> DataFrame:
    """Stream of (event_id, key, t, allowed, retry_after). Needs the RocksDB state store.

    Events later than `late` behind the newest are left out (`late_rows` counts them). A key keeps no state once the watermark is an hour past its last
    accepted event.
    """
    us = F.col(ts).cast("timestamp")
    rows = events.select(F.col(event_id).cast("long").alias("event_id"), F.col(key).cast("long").alias("key"), us.alias("ts"), (F.unix_micros(us) / 1e6).alias("t")).withWatermark("ts", late)
    schema = "event_id long, key long, t double, allowed boolean, retry_after int"
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=_RateLimiter(per_minute, per_hour), outputStructType=schema, outputMode="Append", timeMode="EventTime")


class _History(StatefulProcessor):
    """State of a session: its last `keep` items, newest last."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getListState("items", "seq long, item string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [tuple(r) for r in self.items.get()] if self.items.exists() else []
        for batch in rows:
            held = sorted([*held, *zip(batch["seq"].astype(int), batch["item"], strict=True)])[-self.keep :]
        self.items.put(held)
        yield pd.DataFrame({"session": key[0], "recency": range(len(held), 0, -1), "seq": [h[0] for h in held], "item": [h[1] for h in held]})

    def close(self) -> None:
        pass


def bounded_history(rows: DataFrame, session: str, seq: str, item: str, keep: int = 20) -> DataFrame:
    """Stream of (session, recency, seq, item): after each batch the last items of the sessions it touched, 1 the newest."""
    shaped = rows.select(F.col(session).cast("long").alias("session"), F.col(seq).cast("long").alias("seq"), F.col(item).cast("string").alias("item"))
    return shaped.groupBy("session").transformWithStateInPandas(statefulProcessor=_History(keep), outputStructType="session long, recency int, seq long, item string", outputMode="Update", timeMode="None")


class _Stalls(StatefulProcessor):
    """State of a (session, phase, tool, args): how often it has been seen."""

    def __init__(self, times: int):
        self.times = times

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n = self.seen.get()[0] if self.seen.exists() else 0
        batch = pd.concat(list(rows)).sort_values("seq")
        seen = range(n + 1, n + len(batch) + 1)
        self.seen.update((n + len(batch),))
        yield pd.DataFrame({"seq": batch["seq"], "seen": seen, "stalled": [s >= self.times for s in seen]})

    def close(self) -> None:
        pass


def stalls(calls: DataFrame, session: str, phase: str, tool: str, args: str, seq: str, times: int = 3) -> DataFrame:
    """Stream of (seq, seen, stalled) for each call; calls have to come in order of seq, batch by batch."""
    keys = [F.col(c).cast("string").alias(n) for c, n in ((session, "session"), (phase, "phase"), (tool, "tool"), (args, "args"))]
    rows = calls.select(*keys, F.col(seq).cast("long").alias("seq"))
    return rows.groupBy("session", "phase", "tool", "args").transformWithStateInPandas(statefulProcessor=_Stalls(times), outputStructType="seq long, seen long, stalled boolean", outputMode="Append", timeMode="None")


def job_progress(events: DataFrame, job: str = "job_id", seq: str = "seq", kind: str = "type") -> DataFrame:
    """Running (job, n_done, total, status, last_seq) of job events, to be written in update mode."""
    status = F.when(F.col(kind).isin("queued", "running", "complete", "error"), F.col(kind))
    rows = events.groupBy(job).agg(F.count_if(F.col(kind) == "file_done").alias("n_done"), F.max("total").alias("total"), F.max(F.when(status.isNotNull(), F.struct(F.col(seq), status.alias("status")))).alias("s"), F.max(seq).alias("last_seq"))
    return rows.select(job, "n_done", "total", F.coalesce("s.status", F.lit("queued")).alias("status"), "last_seq")


def logged(events: DataFrame, folder: str, checkpoint: str, job: str = "job_id") -> StreamingQuery:
    """Appends all job events to a table partitioned by job; runs until what is there has been taken."""
    return events.writeStream.format("parquet").partitionBy(job).option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replayed(spark, folder: str, job_id: str, job: str = "job_id", seq: str = "seq") -> DataFrame:
    """All events of a job in order, for one who comes late."""
    return spark.read.parquet(folder).where(F.col(job).cast("string") == job_id).orderBy(seq)


def active(events: DataFrame, ts: str, opened: str, closed: str, kind: str = "type", every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(window, opened, closed) of connections in tumbling windows, complete once the watermark has passed them."""
    rows = events.withColumn("w_ts", F.col(ts).cast("timestamp")).withWatermark("w_ts", late)
    return rows.groupBy(F.window("w_ts", every).alias("window")).agg(F.count_if(F.col(kind) == opened).alias("opened"), F.count_if(F.col(kind) == closed).alias("closed"))


class _Active(StatefulProcessor):
    """State of a key: events that the watermark has not passed, and how many connections are open before them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, event_id long, step int")
        self.open = handle.getValueState("open", "n long")

    def _held(self) -> list[tuple]:
        return [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []

    def _hold(self, rows: list[tuple]) -> None:
        if not rows:
            self.waiting.clear()
            return
        self.waiting.put(rows)
        self.handle.registerTimer(-(-min(r[0] for r in rows) // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [r for batch in rows for r in zip(batch["us"].astype(int), batch["event_id"].astype(int), batch["step"].astype(int), strict=True)]
        self._hold([*self._held(), *new])
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(self._held())
        due = [r for r in held if r[0] <= until]
        n = self.open.get()[0] if self.open.exists() else 0
        counts = []
        for _, _, step in due:
            n += step
            counts.append(n)
        if n:
            self.open.update((n,))
        else:
            self.open.clear()
        self._hold(held[len(due) :])
        if due:
            yield pd.DataFrame({"event_id": [r[1] for r in due], "key": key[0], "us": [r[0] for r in due], "active": counts})

    def close(self) -> None:
        pass


def running_active(events: DataFrame, key: str, event_id: str, ts: str, opened: str, closed: str, kind: str = "type", late: str = "10 minutes") -> DataFrame:
    """Stream of (event_id, key, us, active): openings less closings of a key up to each event, in the order of time and then id, whatever order they come in.

    An event waits until the watermark, `late` behind the newest, has passed it; one that comes after that is dropped, and counted in the progress of
    the query (numRowsDroppedByWatermark). A key whose count is 0 and that has nothing waiting keeps no state. Needs the RocksDB state store.
    """
    step = F.when(F.col(kind) == opened, 1).when(F.col(kind) == closed, -1).otherwise(0)
    at = F.col(ts).cast("timestamp")
    rows = events.select(F.col(key).cast("long").alias("key"), F.col(event_id).cast("long").alias("event_id"), at.alias("ts"), F.unix_micros(at).alias("us"), step.alias("step")).withWatermark("ts", late)
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=_Active(), outputStructType="event_id long, key long, us long, active long", outputMode="Append", timeMode="EventTime")


def maintained(changes: DataFrame, checkpoint: str, update: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Runs `update(changed files, batch number)` for each micro-batch of a stream of changed files; a repeated batch has the same number, so updates keyed by it are applied once."""
    return changes.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
