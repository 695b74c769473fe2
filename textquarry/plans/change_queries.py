"""Queries of the change-data operators, over two versions of the documents told apart by their content."""

from __future__ import annotations

from pyspark.sql import functions as F

from textquarry.functions.paths import project_id
from textquarry.operators import changes, sampling
from textquarry.plans.catalog import query
from textquarry.sources import corpus, versions
from textquarry.sources.shared import new_path

_SNAPSHOTS = """files AS (SELECT source AS project, 'docs/' || lang || '/' || doc_id || '.md' AS path, text, n_chars, lang FROM documents),
old AS (SELECT project, path, n_chars AS size, n_chars * 2.0 AS mtime, sha256(text) AS checksum FROM files WHERE lang <> 'es'),
new AS (
  SELECT project, path, n_chars + CASE WHEN contains(text, '!!') THEN 1 ELSE 0 END AS size, n_chars * 2.0 AS mtime,
         sha256(CASE WHEN contains(text, '|') THEN upper(text) ELSE text END) AS checksum
  FROM files WHERE lang <> 'de'),
diff AS (
  SELECT coalesce(a.project, b.project) AS project, coalesce(a.path, b.path) AS path,
         CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted'
              WHEN a.mtime <> b.mtime OR a.size <> b.size THEN 'changed' ELSE 'unchanged' END AS by_stat,
         CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted'
              WHEN a.mtime <> b.mtime OR a.size <> b.size OR a.checksum <> b.checksum THEN 'changed' ELSE 'unchanged' END AS status
  FROM old a FULL JOIN new b ON a.project = b.project AND a.path = b.path),
modules AS (
  SELECT project, path, path AS full_path, split_part(text, ' ', 1) AS name, CASE WHEN contains(text, '***') THEN '[LLM Error] none' ELSE substr(text, 1, 40) END AS purpose
  FROM files WHERE lang <> 'es' AND n_chars > 300)"""


def _files(t):
    return t("documents").select(F.col("source").alias("project"), F.concat(F.lit("docs/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text", "n_chars", "lang")


def _snapshots(t):
    files = _files(t)
    mtime = (F.col("n_chars") * 2.0).alias("mtime")
    old = files.where("lang <> 'es'").select("project", "path", F.col("n_chars").alias("size"), mtime, corpus.checksum(F.col("text")).alias("checksum"))
    text = F.when(F.col("text").contains("|"), F.upper("text")).otherwise(F.col("text"))
    size = F.col("n_chars") + F.col("text").contains("!!").cast("int")
    return old, files.where("lang <> 'de'").select("project", "path", size.alias("size"), mtime, corpus.checksum(text).alias("checksum"))


def _modules(t):
    purpose = F.when(F.col("text").contains("***"), "[LLM Error] none").otherwise(F.substring("text", 1, 40))
    return _files(t).where("lang <> 'es' and n_chars > 300").select("project", "path", F.col("path").alias("full_path"), F.get(F.split("text", " ", -1), F.lit(0)).alias("name"), purpose.alias("purpose"))


@query(f"WITH {_SNAPSHOTS} SELECT project, path, status FROM diff")
def snapshot_diff(t):
    """What was added, deleted or changed between the two versions."""
    return changes.diff(*_snapshots(t))


@query(f"WITH {_SNAPSHOTS} SELECT project, path FROM diff WHERE status IN ('added', 'changed')")
def files_to_analyse(t):
    return changes.to_analyse(*_snapshots(t))


@query(
    f"""WITH {_SNAPSHOTS}, c AS (
  SELECT project, count(*) FILTER (by_stat = 'added') AS n_new, count(*) FILTER (by_stat = 'changed') AS n_changed, count(*) FILTER (by_stat = 'deleted') AS n_deleted FROM diff GROUP BY project)
SELECT *, n_new + n_changed + n_deleted = 0 AS is_fresh,
       CASE WHEN n_new + n_changed + n_deleted = 0 THEN 'no changes' ELSE array_to_string(list_filter([
         CASE WHEN n_changed > 0 THEN n_changed || ' modified' END, CASE WHEN n_new > 0 THEN n_new || ' new' END, CASE WHEN n_deleted > 0 THEN n_deleted || ' deleted' END], lambda x: x IS NOT NULL), ', ') END AS description
FROM c"""
)
def freshness_report(t):
    """Counts of new, changed and deleted files of each project, and the sentence about them."""
    return changes.described(changes.freshness(*_snapshots(t)))


@query(
    f"""WITH {_SNAPSHOTS}
SELECT d.project, d.path, CASE WHEN status = 'added' THEN 'new' WHEN status = 'changed' THEN 'changed' ELSE 'failed' END AS reason
FROM diff d LEFT JOIN modules m ON d.project = m.project AND d.path = m.path
WHERE status IN ('added', 'changed') OR (status = 'unchanged' AND starts_with(m.purpose, '[LLM Error'))"""
)
def refresh_set(t):
    """Files to analyse again: new, changed, or failed the last time."""
    return changes.to_refresh(*_snapshots(t), _modules(t))


@query(
    f"""WITH {_SNAPSHOTS},
fresh AS (SELECT project, path, upper(name) AS name FROM modules WHERE path IN (SELECT path FROM diff WHERE status = 'changed')),
kept AS (SELECT project, path, name FROM modules WHERE path NOT IN (SELECT path FROM fresh) UNION ALL SELECT * FROM fresh)
SELECT project, path, name FROM kept WHERE path IN (SELECT path FROM new)"""
)
def modules_merged(t):
    """The module table after the changed files were analysed anew and the deleted ones dropped."""
    old, new = _snapshots(t)
    modules = _modules(t).select("project", "path", "name")
    fresh = modules.join(changes.diff(old, new).where("status = 'changed'"), ["project", "path"], "left_semi").withColumn("name", F.upper("name"))
    return changes.merged(modules, fresh, new)


@query(
    f"""WITH {_SNAPSHOTS}, f AS (SELECT project, count(*) AS n_files FROM old GROUP BY project),
m AS (SELECT project, count(*) AS n_modules, count(*) FILTER (starts_with(purpose, '[LLM Error')) AS n_failed FROM modules GROUP BY project)
SELECT project, coalesce(n_files, 0) AS n_files, coalesce(n_modules, 0) AS n_modules, coalesce(n_failed, 0) AS n_failed,
       coalesce(n_files, 0) > coalesce(n_modules, 0) OR coalesce(n_failed, 0) > 0 AS force FROM f FULL JOIN m USING (project)"""
)
def snapshot_consistency(t):
    """Whether a project's stored modules cover its snapshot."""
    return changes.consistency(_snapshots(t)[0], _modules(t))


@query(
    f"""WITH {_SNAPSHOTS}, p AS (SELECT source AS project, max(n_chars) AS last_analysed FROM documents GROUP BY source)
SELECT project, last_analysed, coalesce(n, 0) AS n_modules FROM p LEFT JOIN (SELECT project, count(*) AS n FROM modules GROUP BY project) USING (project)"""
)
def project_catalogue(t):
    """Projects with their module counts, last analysed first."""
    projects = t("documents").groupBy(F.col("source").alias("project")).agg(F.max("n_chars").alias("last_analysed"))
    return corpus.catalogue(projects, _modules(t))


@query(
    """WITH v AS (SELECT 1 AS version, source, doc_id, n_chars FROM documents WHERE lang <> 'de'
UNION ALL SELECT 2, source, doc_id, n_chars FROM documents WHERE lang <> 'de' AND (source NOT IN ('src0', 'src3') OR n_chars > 200)
UNION ALL SELECT 3, source, doc_id, n_chars FROM documents WHERE lang <> 'de' AND (source NOT IN ('src0', 'src3') OR n_chars > 200) AND source <> 'src5')
SELECT version, source, count(*) AS n_documents, sum(n_chars)::BIGINT AS n_chars FROM v GROUP BY ALL"""
)
def project_versions(t):
    """Three versions of a stored table of documents: two sources written anew in the second, one removed in the third, all of them still readable."""
    docs = t("documents").where("lang <> 'de'").select("source", "doc_id", "n_chars")
    spark, folder = docs.sparkSession, new_path(docs.sparkSession, "projects")
    versions.save(docs, folder, "source")
    versions.save(docs.where("source in ('src0', 'src3') and n_chars > 200"), folder, "source")
    versions.remove(spark.createDataFrame([("src5",)], "source string"), folder, "source")
    rows = [versions.load(spark, folder, docs.schema, "source", v).withColumn("version", F.lit(v)) for v in (1, 2, 3)]
    every = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return every.groupBy("version", "source").agg(F.count("*").alias("n_documents"), F.sum("n_chars").alias("n_chars"))


@query("SELECT DISTINCT source, split_part(source || '/' || lang, '/', -1) || '-' || substr(sha1(source || '/' || lang), 1, 12) AS project_id FROM documents")
def project_ids(t):
    return t("documents").select("source", project_id(F.concat_ws("/", "source", "lang")).alias("project_id")).distinct()


@query(
    """WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), p AS (SELECT source, sum(n)::BIGINT AS n_files FROM c GROUP BY source)
SELECT source, lang, n, n_files, CASE WHEN n_files < 50 THEN 'small' WHEN n_files < 200 THEN 'medium' WHEN n_files < 500 THEN 'large' ELSE 'xlarge' END AS size_class,
       n_files > 200 AS needs_sample, CASE WHEN n_files < 50 THEN 10 WHEN n_files < 200 THEN 30 WHEN n_files < 500 THEN 60 ELSE 120 END AS estimate_s FROM c JOIN p USING (source)"""
)
def size_profiles(t):
    """Size class and languages of each source."""
    return sampling.size_profile(t("documents"), ["source"], "lang")


_QUOTAS = """c AS (SELECT lang, count(*) AS n, least(count(*), 5) AS base FROM documents GROUP BY lang),
s AS (SELECT greatest(0, 200 - sum(base)) AS budget, sum(n - base) AS spare FROM c),
quotas AS (SELECT lang, n, (base + least(n - base, CASE WHEN spare > 0 THEN floor((n - base) * budget / spare) ELSE 0 END))::BIGINT AS quota FROM c, s),
ranked AS (SELECT doc_id, d.lang, row_number() OVER (PARTITION BY d.lang ORDER BY sha256('sample' || doc_id), doc_id) <= quota AS sampled FROM documents d JOIN quotas q ON d.lang = q.lang)"""


@query(f"WITH {_QUOTAS} SELECT lang, n, quota FROM quotas")
def sample_quotas(t):
    return sampling.quotas(t("documents"), "lang", left_out=None)


@query(f"WITH {_QUOTAS} SELECT doc_id, lang FROM ranked WHERE sampled")
def stratified_sample(t):
    """About 200 documents by language, chosen by hash."""
    return sampling.stratified_sample(t("documents"), "doc_id", "lang", left_out=None).select("doc_id", "lang")


@query(f"WITH {_QUOTAS} SELECT lang, count(*) AS n, count(*) FILTER (sampled) AS n_sampled, round(avg(CASE WHEN sampled THEN 0.8 ELSE 0.72 END), 6) AS confidence FROM ranked GROUP BY lang")
def sample_coverage(t):
    """How much of each language was sampled, and the confidence that is left."""
    docs = t("documents").select("doc_id", "lang", F.lit(0.8).alias("confidence"))
    rows = sampling.coverage(docs, sampling.stratified_sample(docs, "doc_id", "lang", left_out=None), "doc_id", "confidence")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if("sampled").alias("n_sampled"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query("SELECT count(*) AS n_files, count(*) FILTER (lang IN ('en', 'fr') AND n_chars > 100) AS n_analysable FROM documents")
def scan_counts(t):
    return sampling.scan_counts(t("documents"), F.col("lang").isin("en", "fr") & (F.col("n_chars") > 100))
