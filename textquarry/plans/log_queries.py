"""Queries of the log operators over events and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from textquarry.functions import queries as asked
from textquarry.functions.texts import n_words
from textquarry.operators import logs
from textquarry.plans.catalog import query


def _events(t):
    return t("events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT user_id, count(*) AS n_calls FROM events GROUP BY user_id")
def usage_by_user(t):
    return logs.usage(t("events"), "user_id")


@query("SELECT user_id, event_type, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS n FROM events GROUP BY ALL")
def session_activity(t):
    """First and last access and number of events of each user and event type."""
    rows = logs.session_activity(_events(t), "user_id", "event_type")
    return rows.select("user_id", "event_type", F.unix_micros("first_access").alias("first_us"), F.unix_micros("last_access").alias("last_us"), "n")


@query(
    """WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events)
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS last_minute,
       count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS last_hour FROM e"""
)
def requests_in_windows(t):
    """Each user's events of the last minute and hour at each event."""
    return logs.window_counts(_events(t), "user_id").select("event_id", "last_minute", "last_hour")


@query()
def rate_limited(t):
    """Decisions at two calls a minute and five an hour; tests hold them against a plain loop and the stream."""
    return logs.rate_limited(_events(t), "user_id", "event_id", per_minute=2, per_hour=5)


@query(
    """SELECT event_id, count(*) OVER w AS seen, count(*) OVER w >= 3 AS stalled FROM events
WINDOW w AS (PARTITION BY user_id, date_trunc('day', ts), event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)"""
)
def stalled_calls(t):
    """Users' events of one type that occur three times or more in a day."""
    calls = _events(t).withColumn("phase", F.date_trunc("day", "ts")).withColumn("args", F.lit(""))
    return logs.stalls(calls, "user_id", "phase", "event_type", "args", "event_id").select("event_id", "seen", "stalled")


_JOBS = """j AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'file_done' WHEN 'click' THEN 'running' WHEN 'signup' THEN 'queued' ELSE event_type END AS type, floor(value)::BIGINT AS total FROM events)"""


@query(
    f"""WITH {_JOBS},
p AS (SELECT user_id, count(*) FILTER (type = 'file_done') AS n_done, max(total) AS total, coalesce(arg_max(type, event_id) FILTER (type IN ('queued', 'running', 'complete', 'error')), 'queued') AS status, max(event_id) AS last_seq FROM j GROUP BY user_id)
SELECT *, round(n_done / greatest(1, total), 9)::DOUBLE AS fraction FROM p"""
)
def job_progress(t):
    """Progress of jobs, users standing for jobs."""
    kind = F.when(F.col("event_type") == "purchase", "file_done").when(F.col("event_type") == "click", "running").when(F.col("event_type") == "signup", "queued").otherwise(F.col("event_type"))
    events = t("events").select("user_id", "event_id", kind.alias("type"), F.floor("value").cast("long").alias("total"))
    return logs.job_progress(events, "user_id", "event_id").withColumn("fraction", F.round("fraction", 9))


@query(
    """SELECT event_id, sum(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS active FROM events"""
)
def active_connections(t):
    """Clicks that views have not yet closed, for each user."""
    e = t("events")
    return logs.active_connections(e, ["user_id"], ["event_id"], F.col("event_type") == "click", F.col("event_type") == "view").select("event_id", "active")


@query(
    """SELECT user_id, event_id, recency::INTEGER AS recency FROM (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS recency FROM events) WHERE recency <= 10"""
)
def last_events(t):
    """The last ten events of each user."""
    return logs.last_items(t("events"), "user_id", ["ts", "event_id"], 10).select("user_id", "event_id", "recency")


@query(
    """SELECT user_id, event_type, recency::INTEGER AS recency FROM (
  SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id) DESC) AS recency FROM events GROUP BY user_id, event_type) WHERE recency <= 3"""
)
def last_event_types(t):
    """The last three event types of each user by first use."""
    return logs.last_projects(t("events"), "user_id", "event_type", ["event_id"], 3)


@query(
    """SELECT conv_id, turn, recency::INTEGER AS recency, substr(text, 1, 100) AS query FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS recency FROM conversations) WHERE recency <= 4"""
)
def chat_history(t):
    """The last four messages of each conversation, cut to 100 characters."""
    return logs.last_items(t("conversations"), "conv_id", ["turn"], 4).select("conv_id", "turn", "recency", logs.short_query(F.col("text")).alias("query"))


def _hits(words: tuple[str, ...], text: str = "q") -> str:
    return "(" + " + ".join(f"contains({text}, '{w}')::INTEGER" for w in words) + ")"


_CLASSIFIED = rf"""asked AS (SELECT conv_id, turn, text, trim(lower(text)) AS q FROM conversations WHERE role = 'user'),
f AS (
  SELECT *, length(q) - length(replace(q, '.', '')) + length(q) - length(replace(q, '?', '')) AS sentences, length(q) - length(replace(q, ',', '')) + length(q) - length(replace(q, ';', '')) AS clauses,
         len(list_filter(regexp_split_to_array(q, '\s+'), lambda x: x <> '')) AS words, {_hits(asked.SIMPLE)} AS simple_hits, {_hits(asked.COMPLEX)} AS complex_hits FROM asked),
classified AS (
  SELECT *, CASE WHEN complex_hits > 0 THEN 'complex' WHEN sentences > 1 OR clauses > 1 OR words > 15 THEN 'moderate' ELSE 'simple' END AS complexity,
         least(1.0, CASE WHEN complex_hits > 0 THEN 0.85 + 0.05 * complex_hits WHEN sentences > 1 OR clauses > 1 THEN 0.80 + 0.05 * clauses WHEN words > 15 THEN 0.70 ELSE 0.85 + 0.05 * simple_hits END)::DOUBLE AS confidence FROM f)"""


def _questions(t):
    return t("conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))


@query(f"WITH {_CLASSIFIED} SELECT conv_id, turn, sentences::INTEGER AS sentences, clauses::INTEGER AS clauses, words::INTEGER AS words, simple_hits, complex_hits, complexity, round(confidence, 6) AS confidence FROM classified")
def query_complexity(t):
    """Features, class and confidence of the users' messages."""
    return asked.with_complexity(_questions(t)).drop("query").withColumn("confidence", F.round("confidence", 6))


@query(
    rf"""WITH q AS (SELECT conv_id, turn, text, lower(text) AS q, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n FROM conversations WHERE role = 'user')
SELECT conv_id, turn, CASE WHEN {_hits(asked.DESIGN)} > 0 OR {_hits(asked.COMPARE)} > 0 THEN 'complex' WHEN contains(q, 'how') AND {_hits(asked.EXPLAIN)} > 0 AND n > 4 THEN 'moderate' ELSE 'simple' END AS complexity,
       CASE WHEN regexp_matches(text, '{asked.FULL_CONTEXT}') THEN 'FULL_CONTEXT' WHEN regexp_matches(text, '{asked.JUST_IN_TIME}') THEN 'MAP_THEN_JIT' WHEN regexp_matches(text, '{asked.MAP_ONLY}') THEN 'MAP_ONLY' ELSE 'MAP_THEN_JIT' END AS route, n::INTEGER AS n_words
FROM q"""
)
def query_routes(t):
    """Answer complexity and context route of the users' messages."""
    q = F.col("query")
    return _questions(t).select("conv_id", "turn", asked.answer_complexity(q).alias("complexity"), asked.context_route(q).alias("route"), n_words(q).alias("n_words"))


_DIMENSIONS = """rules(complexity, primary_model, second) AS (VALUES ('simple', 'small', 'large'), ('moderate', 'large', 'open'), ('complex', 'large', 'open')),
models(model, price, latency) AS (VALUES ('small', 0.001, 800), ('large', 0.003, 2000), ('open', 0.0005, 1500))"""


def _dimensions(t):
    spark = t("region").sparkSession
    rules = spark.createDataFrame([("simple", "small", ["small", "large"]), ("moderate", "large", ["open", "small"]), ("complex", "large", ["open", "small"])], "complexity string, primary string, fallbacks array<string>")
    models = spark.createDataFrame([("small", 0.001, 800), ("large", 0.003, 2000), ("open", 0.0005, 1500)], "model string, price_per_1k double, latency_ms int")
    return rules, models


@query(
    f"""WITH {_CLASSIFIED}, {_DIMENSIONS}
SELECT conv_id, turn, primary_model AS model, second AS fallback, latency AS latency_ms, round((greatest(50, length(text) // 4) + 400) / 1000 * price, 9)::DOUBLE AS estimated_cost
FROM classified JOIN rules USING (complexity) JOIN models ON model = primary_model"""
)
def routed_queries(t):
    """Model, first fallback and estimated cost of each message."""
    rows = asked.routed(asked.with_complexity(_questions(t)), *_dimensions(t))
    return rows.select("conv_id", "turn", F.col("primary").alias("model"), asked.fallback(F.col("fallbacks"), F.col("primary")).alias("fallback"), "latency_ms", F.round("estimated_cost", 9).alias("estimated_cost"))


@query(
    f"""WITH {_CLASSIFIED}, {_DIMENSIONS},
fails AS (SELECT conv_id, turn, primary_model AS model, turn % 4 AS r, price, text FROM classified JOIN rules USING (complexity) JOIN models ON model = primary_model),
taken AS (SELECT *, CASE r WHEN 0 THEN CASE WHEN model = 'small' THEN 'large' ELSE 'small' END WHEN 1 THEN CASE WHEN model <> 'small' THEN 'small' END
  ELSE CASE WHEN model = 'large' THEN 'small' ELSE 'large' END END AS degraded FROM fails)
SELECT conv_id, turn, model, degraded, CASE degraded WHEN 'small' THEN 1.6 WHEN 'large' THEN 4.0 ELSE 30.0 END::DOUBLE AS timeout_s,
       round((len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) + 400) / 1000 * price, 9)::DOUBLE AS cost_by_words FROM taken"""
)
def degraded_queries(t):
    """Which model takes over from each message's own, for four kinds of failure of which one is not listed; `open` is not available."""
    rules, models = _dimensions(t)
    rows = asked.routed(asked.with_complexity(_questions(t)), rules, models).withColumn("reason", F.get(F.array(*map(F.lit, ("timeout", "rate_limit", "error", "unheard of"))), (F.col("turn") % 4).cast("int")))
    ladders = models.sparkSession.createDataFrame([("timeout", ["small", "large"]), ("rate_limit", ["small"]), ("error", ["open", "large", "small"]), (None, ["large", "small"])], "reason string, ladder array<string>")
    found = asked.degraded(rows, ladders, models.withColumn("available", F.col("model") != "open"), model="primary")
    return found.select("conv_id", "turn", F.col("primary").alias("model"), "degraded", "timeout_s", F.round(asked.cost_by_words(F.col("query"), F.col("price_per_1k")), 9).alias("cost_by_words"))


@query(
    f"""WITH {_CLASSIFIED}, {_DIMENSIONS},
log AS (SELECT complexity, primary_model AS model, length(text) // 4 AS tokens, turn > 4 AS fallback, price FROM classified JOIN rules USING (complexity) JOIN models ON model = primary_model),
g AS (SELECT complexity, model, count(*) AS n, sum(tokens)::BIGINT AS tokens, sum(tokens / 1000 * price) AS cost, count(*) FILTER (fallback) AS n_fallbacks FROM log GROUP BY ALL)
SELECT complexity, model, n, tokens, n_fallbacks, round(cost, 6)::DOUBLE AS cost, round(cost / n, 8)::DOUBLE AS cost_per_query, round((SELECT sum(n) FROM g WHERE model = 'small') / (SELECT sum(n) FROM g), 6)::DOUBLE AS cheap_share FROM g"""
)
def routing_metrics(t):
    """Usage and cost of each class and model."""
    rules, models = _dimensions(t)
    rows = asked.routed(asked.with_complexity(_questions(t)), rules, models)
    log = rows.select("complexity", F.col("primary").alias("model"), F.floor(F.length("query") / 4).alias("tokens"), (F.col("turn") > 4).alias("fallback"))
    found = logs.routing_metrics(log, models.select("model", "price_per_1k"), "small")
    return found.select("complexity", "model", "n", "tokens", "n_fallbacks", F.round("cost", 6).alias("cost"), F.round("cost_per_query", 8).alias("cost_per_query"), F.round("cheap_share", 6).alias("cheap_share"))


@query(
    r"""WITH a AS (SELECT event_id, 'feasible to ' || floor(value)::BIGINT || CASE WHEN event_id % 2 = 0 THEN '/100' ELSE ' %' END AS answer FROM events)
SELECT event_id, least(1.0, regexp_extract(answer, '(\d{1,9})\s*(?:/\s*100|%)', 1)::DOUBLE / 100) AS score FROM a WHERE regexp_matches(answer, '\d{1,9}\s*(?:/\s*100|%)')"""
)
def feasibility_scores(t):
    """Scores read from answers made of the events' values."""
    answer = F.concat(F.lit("feasible to "), F.floor("value").cast("string"), F.when(F.col("event_id") % 2 == 0, "/100").otherwise(" %"))
    return t("events").select("event_id", asked.feasibility(answer).alias("score")).where("score is not null")
