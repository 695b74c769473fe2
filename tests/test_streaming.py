import pytest
from pyspark.sql import functions as F

from textquarry.operators import logs
from textquarry.streaming import jobs


@pytest.fixture(scope="module")
def feed(spark, sf, tmp_path_factory):
    """The events in time order, five files, read one file to a batch."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STATE_STORE)
    folder = tmp_path_factory.mktemp("feed")
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.timestamp_micros(F.expr("cast(unix_micros(cast(ts as timestamp)) / 400 as bigint)")))
    events = events.withColumn("part", F.ntile(5).over(__import__("pyspark").sql.Window.orderBy("ts", "event_id"))).cache()
    for i in range(1, 6):
        events.where(f"part = {i}").drop("part").coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(events.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    return events.drop("part"), stream


def drained(spark, df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    return spark.table(name)


def test_rate_limits_stream_equals_batch(spark, feed, tmp_path):
    events, stream = feed
    got = drained(spark, jobs.rate_limited(stream, "user_id", "event_id", per_minute=2, per_hour=4), "limits", "append", tmp_path)
    want = logs.rate_limited(events, "user_id", "event_id", per_minute=2, per_hour=4)
    assert {(r["event_id"], r["allowed"], r["retry_after"]) for r in got.collect()} == {(r["event_id"], r["allowed"], r["retry_after"]) for r in want.collect()}


def test_stalls_stream_equals_batch(spark, feed, tmp_path):
    events, stream = feed
    keyed = lambda d: d.withColumn("phase", F.lit("1")).withColumn("seq", F.unix_micros("ts") * 100_000 + F.col("event_id"))
    got = drained(spark, jobs.stalls(keyed(stream), "user_id", "phase", "event_type", "phase", "seq"), "stalled", "append", tmp_path)
    want = logs.stalls(keyed(events), "user_id", "phase", "event_type", "phase", "seq")
    assert {(r["seq"], r["seen"]) for r in got.collect()} == {(r["seq"], r["seen"]) for r in want.collect()}


def test_history_and_progress_end_like_batch(spark, feed, tmp_path):
    events, stream = feed
    shaped = lambda d: d.withColumn("seq", F.unix_micros("ts") * 100_000 + F.col("event_id")).withColumn("type", F.when(F.col("event_type") == "purchase", "file_done").otherwise("running")).withColumn("total", F.lit(10))
    rows = drained(spark, jobs.bounded_history(shaped(stream), "user_id", "seq", "event_type", 4), "history", "update", tmp_path).collect()
    want = {(r["user_id"], r["seq"]) for r in logs.last_items(shaped(events), "user_id", ["seq"], 4).collect()}
    last = {}
    for r in rows:
        last.setdefault(r["session"], []).append(r["seq"])
    assert {(s, q) for s, seqs in last.items() for q in sorted(set(seqs))[-4:]} == want
    rows = drained(spark, jobs.job_progress(shaped(stream), "user_id", "seq"), "progress", "update", tmp_path).collect()
    best = {}
    for r in rows:
        if r["last_seq"] >= best.get(r["user_id"], (0,))[0]:
            best[r["user_id"]] = (r["last_seq"], r["n_done"], r["status"])
    assert best == {r["user_id"]: (r["last_seq"], r["n_done"], r["status"]) for r in logs.job_progress(shaped(events), "user_id", "seq").collect()}


def test_log_replay_and_maintenance(spark, feed, tmp_path):
    events, stream = feed
    q = jobs.logged(stream, str(tmp_path / "log"), str(tmp_path / "c1"), "event_type")
    assert q.awaitTermination(300)
    kind = events.first()["event_type"]
    back = [r["event_id"] for r in jobs.replayed(spark, str(tmp_path / "log"), kind, "event_type", "event_id").collect()]
    assert back == sorted(r["event_id"] for r in events.where(F.col("event_type") == kind).collect())
    seen = []
    q = jobs.maintained(stream, str(tmp_path / "c2"), lambda df, n: seen.append((n, df.count())))
    assert q.awaitTermination(300)
    assert sum(n for _, n in seen) == events.count() and [b for b, _ in seen] == list(range(len(seen)))
    got = drained(spark, jobs.active(stream, "ts", "click", "view", kind="event_type"), "active", "append", tmp_path)
    assert 0 <= sum(r["opened"] for r in got.collect()) <= events.where("event_type = 'click'").count()


def test_running_count_of_a_shuffled_feed_equals_batch(spark, feed, tmp_path):
    events, _ = feed
    rows = events.select("event_id", "user_id", "ts", "event_type").where("user_id < 40")
    folder = str(tmp_path / "shuffled")
    # each file overlaps the next in time; the last one moves the watermark past all others
    part = F.greatest(F.lit(0), F.floor(F.unix_seconds("ts") / 600) + F.pmod(F.hash("event_id"), F.lit(3)) - 1)
    numbers = rows.withColumn("part", part).withColumn("part", F.dense_rank().over(__import__("pyspark").sql.Window.orderBy("part"))).cache()
    last = numbers.agg(F.max("part")).first()[0]
    assert last > 3
    for i in range(1, last + 1):
        numbers.where(f"part = {i}").drop("part").orderBy(F.hash("event_id")).coalesce(1).write.mode("append").parquet(folder)
    end = rows.limit(1).select(F.lit(10**9).cast("long").alias("event_id"), F.lit(10**6).cast("long").alias("user_id"), F.expr("timestamp'2100-01-01'").alias("ts"), F.lit("click").alias("event_type"))
    end.select(*[F.col(f.name).cast(f.dataType) for f in rows.schema]).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = drained(spark, jobs.running_active(stream, "user_id", "event_id", "ts", "click", "view", kind="event_type", late="1 hour"), "counted", "append", tmp_path)
    want = logs.active_connections(rows, ["user_id"], ["ts", "event_id"], F.col("event_type") == "click", F.col("event_type") == "view")
    assert {(r["event_id"], r["active"]) for r in got.collect()} == {(r["event_id"], r["active"]) for r in want.collect()}


def test_rate_limiter_forgets_and_counts_late_rows(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STATE_STORE)
    folder = str(tmp_path / "feed")
    files = [
        [(i, i % 7, f"2024-01-01 10:{i:02d}:00") for i in range(50)],
        [(100, 1, "2024-01-01 14:00:00")],
        [(150, 5, "2024-01-01 14:00:10")],  # rows are held against the watermark of the batch before
        [(200, 2, "2024-01-01 10:30:00"), (201, 3, "2024-01-01 11:59:00"), (202, 4, "2024-01-01 13:30:00")],  # two are before 13:00
        [(300, 6, "2024-01-02 10:00:00")],
    ]
    for rows in files:
        spark.createDataFrame(rows, "event_id long, user_id long, ts string").selectExpr("event_id", "user_id", "cast(ts as timestamp) ts").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("event_id long, user_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(folder)
    df = jobs.rate_limited(stream, "user_id", "event_id", late="1 hour")
    q = df.writeStream.format("memory").queryName("forgetful").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    assert jobs.late_rows(q) == 2
    assert {r["event_id"] for r in spark.table("forgetful").collect()} == {*range(50), 100, 150, 202, 300}
    most = max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress)
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4 < most
