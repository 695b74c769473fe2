"""Queries of the report operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from textquarry.operators import batches, reports
from textquarry.plans.catalog import query
from textquarry.sources import corpus


def _issues(t):
    severity = F.when(F.col("value") > 150, "error").when(F.col("value") > 50, "warning").otherwise("info")
    return t("events").select("user_id", "event_type", "event_id", severity.alias("severity"))


@query(
    """SELECT user_id, count(*) AS total, count(*) FILTER (value > 150) AS errors, count(*) FILTER (value > 50 AND value <= 150) AS warnings, count(*) FILTER (value <= 50 OR value IS NULL) AS infos FROM events GROUP BY user_id"""
)
def issue_summary(t):
    """Issues by severity for each user, the events' values standing for severities."""
    return reports.issue_summary(_issues(t), ["user_id"])


_ANSWERS = """answers AS (
  SELECT event_id::VARCHAR AS path, CASE event_type WHEN 'click' THEN '```json' || chr(10) || body || chr(10) || '```' WHEN 'view' THEN 'found: ' || body || ' done' WHEN 'purchase' THEN replace(body, '"', chr(39)) WHEN 'signup' THEN 'nothing at all' ELSE body END AS raw, severity, user_id
  FROM (SELECT *, '[{"line": ' || user_id || ', "category": "' || event_type || '", "severity": "' || severity || '"}]' AS body
        FROM (SELECT *, CASE WHEN value > 150 THEN 'critical' WHEN value > 50 THEN 'high' ELSE 'low' END AS severity FROM events)))"""


def _answers(t):
    severity = F.when(F.col("value") > 150, "critical").when(F.col("value") > 50, "high").otherwise("low")
    body = F.concat(F.lit('[{"line": '), F.col("user_id").cast("string"), F.lit(', "category": "'), F.col("event_type"), F.lit('", "severity": "'), severity, F.lit('"}]'))
    kind = F.col("event_type")
    raw = (
        F.when(kind == "click", F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind == "view", F.concat(F.lit("found: "), body, F.lit(" done"))).when(kind == "purchase", F.translate(body, '"', "'"))
        .when(kind == "signup", "nothing at all").otherwise(body)
    )
    return t("events").select(F.col("event_id").cast("string").alias("path"), raw.alias("raw"))


_FOUND = f"""{_ANSWERS},
found AS (
  SELECT path, CASE WHEN raw = 'nothing at all' THEN NULL ELSE user_id::INTEGER END AS line, CASE WHEN raw = 'nothing at all' THEN 'parse_failure' ELSE category END AS category, CASE WHEN raw = 'nothing at all' THEN 'low' ELSE severity END AS severity
  FROM (SELECT a.*, e.event_type AS category FROM answers a JOIN events e ON e.event_id::VARCHAR = a.path))"""


@query(f"WITH {_FOUND} SELECT path, line, category, severity FROM found")
def parsed_findings(t):
    """Findings read from answers that hold their JSON plain, fenced, inside prose, with Python quotes, or not at all."""
    return reports.findings(_answers(t)).select("path", "line", "category", "severity")


@query(f"WITH {_FOUND} SELECT severity, category, count(*) AS n, count(DISTINCT path) AS n_files FROM found GROUP BY ALL")
def consolidated_findings(t):
    return reports.consolidated(reports.findings(_answers(t)))


_PIECES = """pieces AS (SELECT doc_id, unnest(range(0, greatest(length(text), 1), 2000)) // 2000 AS i, text FROM documents WHERE length(text) > 0),
c AS (SELECT doc_id, i, substr(text, i * 2000 + 1, 2000) AS s FROM pieces),
r AS (SELECT doc_id, i, CASE WHEN contains(s, '!!') THEN '' ELSE split_part(s, ' ', 1) END AS purpose, CASE WHEN contains(s, ',') THEN split_part(s, ' ', 2) ELSE '' END AS hint, contains(s, 'license') OR contains(s, 'License') AS critical, split_part(s, ' ', 3) AS item FROM c)"""


@query(
    f"""WITH {_PIECES}
SELECT doc_id, arg_max(purpose, i) FILTER (trim(purpose) <> '') AS purpose, arg_min(hint, i) FILTER (trim(hint) <> '') AS hint, bool_or(critical) AS critical, count(DISTINCT item) AS n_items FROM r GROUP BY doc_id"""
)
def merged_chunk_results(t):
    """Results of a document's pieces folded into one row."""
    text = F.col("text")
    pieces = t("documents").where(F.length("text") > 0).select("doc_id", "text", F.posexplode(F.expr("sequence(0, length(text) - 1, 2000)")).alias("chunk_index", "b"))
    s = F.substring(text, F.col("b") + 1, F.lit(2000))
    rows = pieces.select("doc_id", "chunk_index", s.alias("s"))
    word = lambda k: F.coalesce(F.get(F.split("s", " ", -1), F.lit(k)), F.lit(""))
    rows = rows.select(
        "doc_id", "chunk_index", F.when(F.col("s").contains("!!"), "").otherwise(word(0)).alias("purpose"), F.when(F.col("s").contains(","), word(1)).otherwise("").alias("hint"),
        (F.col("s").contains("license") | F.col("s").contains("License")).alias("critical"), F.array(word(2)).alias("interface"), F.array(word(2)).alias("dependencies"),
    )
    return reports.merged_chunks(rows, "doc_id").select("doc_id", "purpose", "hint", "critical", F.size("interface").cast("long").alias("n_items"))


@query("SELECT lang, count(*) AS n_files, sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS n_lines, round(avg(quality), 6) AS avg_confidence FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def analysis_statistics(t):
    """Files, lines and mean label of each language."""
    docs = t("documents").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    rows = docs.select("lang", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("n_lines"), "quality")
    return reports.analysis_statistics(rows, "lang", "n_lines", "quality").withColumn("avg_confidence", F.round("avg_confidence", 6))


@query(
    """SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id), event_type)::INTEGER AS position FROM events GROUP BY user_id, event_type"""
)
def event_types_in_order(t):
    """Distinct event types of each user in order of first appearance."""
    return reports.ordered_distinct(t("events"), ["user_id"], "event_type", "event_id")


@query("SELECT conv_id, substr(string_agg(text, ' | ' ORDER BY turn DESC), 1, 400) AS hint FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def edit_hints(t):
    """Newest notes first, 400 characters at most, messages standing for notes."""
    return reports.edit_hints(t("conversations"), "conv_id", "turn", "text")


@query(
    """WITH r AS (SELECT source, doc_id, sum(least(n_chars, 20000)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - least(n_chars, 20000) AS before FROM documents)
SELECT source, doc_id, (before // 300000)::INTEGER AS batch FROM r"""
)
def window_batches(t):
    """Documents of a source in batches of 300,000 characters by running size."""
    return reports.window_batches(t("documents"), "source", "doc_id", "n_chars")


@query(
    """WITH RECURSIVE f AS (SELECT source, doc_id, least(n_chars, 20000) AS s, row_number() OVER w AS k, sum(least(n_chars, 20000)) OVER w AS upto FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
b AS (
  SELECT source, 0 AS batch, 1::BIGINT AS k, 0::HUGEINT AS at FROM f WHERE k = 1 UNION ALL
  SELECT f.source, b.batch + 1, min(f.k), min(f.upto - f.s) FROM b JOIN f ON f.source = b.source AND f.upto > b.at + 300000 GROUP BY f.source, b.batch)
SELECT f.source, f.doc_id, max(b.batch)::INTEGER AS batch FROM f JOIN b ON b.source = f.source AND b.k <= f.k GROUP BY ALL"""
)
def greedy_batches(t):
    """The same, packed greedily."""
    return batches.greedy_batches(t("documents"), "source", "doc_id", "n_chars")


@query()
def artifact_checksums(t):
    """Checksums of artifacts made of the documents; tests check that they follow content and not order."""
    docs = t("documents")
    made = docs.select(F.col("lang").alias("artifact_type"), F.col("doc_id").cast("string").alias("artifact_id"), F.col("source").alias("name"), F.col("text").alias("description"))
    return corpus.artifact_checksums(made)


@query(
    r"""WITH m AS (SELECT doc_id, source || '/' || lang || '.py' AS path, split_part(text, ' ', 1) AS name, substr(text, 1, 200) AS purpose FROM documents),
q AS (SELECT item_id, lower(substr(text, 1, 40)) AS q FROM benchmark),
mw AS (SELECT doc_id, lower(name) AS name, list_distinct(list_filter(regexp_split_to_array(lower(name || ' ' || path || ' ' || purpose), '[^\p{L}\p{N}_]+'), lambda x: x <> '')) AS w FROM m),
qw AS (SELECT item_id, q, list_distinct(list_filter(regexp_split_to_array(q, '[^\p{L}\p{N}_]+'), lambda x: x <> '')) AS w FROM q),
s AS (SELECT item_id, doc_id, len(list_intersect(mw.w, qw.w)) + CASE WHEN contains(q, name) THEN 5 ELSE 0 END AS s FROM mw, qw),
r AS (SELECT item_id, doc_id, s + 3 AS score, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id::VARCHAR) AS rank FROM s WHERE s > 0)
SELECT item_id AS query_id, doc_id, score::INTEGER AS score, rank::INTEGER AS rank FROM r WHERE rank <= 4"""
)
def matched_modules(t):
    """Documents, taken for modules, that match a benchmark question best."""
    modules = t("documents").select(
        F.concat(F.lit("x/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.concat("source", F.lit("/"), "lang", F.lit(".py")).alias("shown"), F.get(F.split("text", " ", -1), F.lit(0)).alias("name"), F.substring("text", 1, 200).alias("purpose")
    )
    rows = modules.select("path", "name", F.concat_ws(" ", "shown", "purpose").alias("purpose"))
    found = reports.module_matches(rows, t("benchmark").select(F.col("item_id").alias("query_id"), F.lower(F.substring("text", 1, 40)).alias("query")))
    return found.select("query_id", F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("doc_id"), "score", "rank")
