"""Temperature mixing of sources, in DataFrame functions only.

Source token shares are raised to an exponent and normalised. The exponent is bisected between 0 (all sources equal) and 1 (as they come) until
it meets a repetition limit or a target entropy. A source's weight times the budget is its number of tokens; it is realised as whole epochs and
a part of one more, each epoch a permutation of the source's blocks and of the documents in each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from textquarry.llm.scratch import stored

#: Hexadecimal digits of a document's hash that name its block: 16 ** 3 blocks in each source.
BLOCK_DIGITS = 3
REPETITION_LIMIT = 1.5
#: The exponent is found to a multiple of 2 ** -EXPONENT_BITS, FAN_BITS bits with each pass over the source totals.
EXPONENT_BITS, FAN_BITS = 40, 5
SEED = "mix"


def n_tokens(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of the text; none if it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def documents_by_source(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n): rows that repeat an id are one document, with the sum of their tokens and the first of their sources by name."""
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), n_tokens(F.col("text")).alias("n"))
    return rows.groupBy("doc_id").agg(F.min("source").alias("source"), F.sum("n").alias("n"))


def exponent(sources: DataFrame, budget: float, repetition_limit: float | None, entropy: float | None) -> float:
    """Smallest exponent in [0, 1] at which no source is repeated more than `repetition_limit` times, or the largest at which the entropy of
    the weights (nats) is at least `entropy`; 1 or 0 where none is. `sources` has (source, t), t > 0."""
    total = sources.agg(F.sum("t")).first()[0]
    if not total:
        return 1.0
    p, e = F.col("t") / float(total), F.col("e")
    low, width = 0, 1 << EXPONENT_BITS  # in units of 2 ** -EXPONENT_BITS: low fails (or is 0 untested), low + width holds
    sums = [F.sum(F.pow(p, e)).alias("z"), F.max(F.pow(p, e - 1)).alias("r"), F.sum(F.pow(p, e) * F.log(p)).alias("l")]

    def holds(row) -> bool:
        if entropy is None:
            return budget / total * row["r"] / row["z"] <= repetition_limit
        import math

        return math.log(row["z"]) - row["e"] * row["l"] / row["z"] < entropy

    def tried(marks: list[int]) -> dict[int, bool]:
        at = sources.withColumn("k", F.explode(F.array(*[F.lit(m).cast("long") for m in marks]))).withColumn("e", F.col("k") / float(1 << EXPONENT_BITS))
        return {r["k"]: holds(r) for r in at.groupBy("k", "e").agg(*sums).collect()}

    ends = tried([0, width])
    if ends[0] or not ends[width]:
        return 0.0 if ends[0] else 1.0
    while width > 1:
        step = width >> FAN_BITS
        found = tried([low + i * step for i in range(1, 1 << FAN_BITS)])
        good = [k for k in sorted(found) if found[k]]
        top = good[0] if good else low + width
        low, width = top - step, step
    return (low + width) / float(1 << EXPONENT_BITS)


def plan(docs: DataFrame, budget: float | None = None, repetition_limit: float | None = REPETITION_LIMIT, entropy: float | None = None, seed: str = SEED) -> DataFrame:
    """One row for each copy of a document in the mix: doc_id, source, n_tokens, epoch, block_rank, position, weight.

    A source's copies, read by (epoch, block_rank, position), are its permuted epochs; the last stops with the last document that fits what is
    left of the source's budget. `budget` is in tokens (all tokens of `docs` if None). A null source counts as the source "", a null text has
    no tokens, documents without tokens go with their block, and a source without any tokens has weight 0 and no copies. An empty table gives
    none. Rows that repeat an id are one document. Other columns of `docs` are ignored.
    """
    words = stored(documents_by_source(docs).withColumn("block", F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, BLOCK_DIGITS)))
    blocks = stored(words.groupBy("source", "block").agg(F.sum("n").alias("t")))
    sources = stored(blocks.groupBy("source").agg(F.sum("t").alias("t")).where("t > 0"))
    total = sources.agg(F.coalesce(F.sum("t"), F.lit(0))).first()[0]
    tokens = float(total if budget is None else budget)
    e = exponent(sources, tokens, repetition_limit, entropy)
    raised = sources.withColumn("p", F.pow(F.col("t") / float(total or 1), F.lit(e)))
    z = raised.agg(F.sum("p")).first()[0] or 1.0
    shares = raised.select("source", F.col("t").alias("source_t"), (F.col("p") / z).alias("weight"))
    shares = shares.withColumn("epochs", F.floor(F.col("weight") * tokens / F.col("source_t")).cast("long"))
    shares = shares.withColumn("rest", F.col("weight") * tokens - F.col("epochs") * F.col("source_t"))

    def mark(*parts: Column) -> Column:
        return F.md5(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts]).cast("binary"))

    # every (source, epoch, block): at most 16 ** BLOCK_DIGITS rows in each window
    epochs = blocks.join(shares, "source").withColumn("epoch", F.explode(F.expr("sequence(0L, epochs)")))
    epochs = epochs.withColumn("mark", mark(F.col("epoch"), F.col("source"), F.col("block")))
    inside = Window.partitionBy("source", "epoch").orderBy("mark", "block")
    epochs = epochs.withColumn("block_rank", F.row_number().over(inside) - 1).withColumn("before", F.sum("t").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("t"))
    epochs = epochs.where("epoch < epochs or before <= rest")
    copies = words.join(epochs.select("source", "block", "epoch", "epochs", "rest", "before", "block_rank", "weight"), ["source", "block"])
    copies = copies.withColumn("mark", mark(F.col("epoch"), F.col("doc_id")))
    order = Window.partitionBy("source", "block", "epoch").orderBy("mark", "doc_id")
    copies = copies.withColumn("position", F.row_number().over(order) - 1).withColumn("upto", F.col("before") + F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return copies.where("epoch < epochs or upto <= rest").select("doc_id", "source", F.col("n").alias("n_tokens"), "epoch", "block_rank", "position", "weight")


def mix(docs: DataFrame, **options: float | str | None) -> DataFrame:
    """The rows of `docs`, all columns, as often as `plan` copies them."""
    copies = plan(docs, **options).groupBy(F.col("doc_id").alias("copied")).agg(F.count("*").alias("copies"))
    joined = docs.join(copies, docs["doc_id"].eqNullSafe(copies["copied"]))
    return joined.withColumn("copied", F.explode(F.expr("array_repeat(0, cast(copies as int))"))).select(*[docs[c] for c in docs.columns])


ORACLE = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, min(coalesce(source, '')) AS source, sum(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)) AS n,
         substr(md5(coalesce(doc_id::VARCHAR, '')), 1, {BLOCK_DIGITS}) AS block
  FROM documents GROUP BY doc_id),
blocks AS (SELECT source, block, sum(n) AS t FROM words GROUP BY source, block),
sources AS (SELECT source, sum(t)::DOUBLE AS t FROM blocks GROUP BY source HAVING sum(t) > 0),
total AS (SELECT sum(t) AS total FROM sources),
shares AS (SELECT source, t, t / total AS p, total FROM sources, total),
halves AS (
  SELECT 0 AS i, 0::DOUBLE AS low, 1::DOUBLE AS high
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN low ELSE mid END, CASE WHEN ok THEN mid ELSE high END
  FROM (SELECT i, low, high, (low + high) / 2 AS mid,
               (SELECT max(pow(p, (low + high) / 2 - 1)) / sum(pow(p, (low + high) / 2)) FROM shares) <= {REPETITION_LIMIT} AS ok
        FROM halves WHERE i < {EXPONENT_BITS})),
best AS (
  SELECT CASE WHEN (SELECT max(1 / p) / count(*) FROM shares) <= {REPETITION_LIMIT} THEN 0 ELSE high END AS e
  FROM halves WHERE i = {EXPONENT_BITS}),
weights AS (SELECT source, t, total, pow(p, e) / (SELECT sum(pow(p, e)) FROM shares, best) AS weight FROM shares, best),
budgets AS (SELECT *, floor(weight * total / t)::BIGINT AS epochs FROM weights),
epochs AS (
  SELECT b.source, b.block, b.t, weight, epochs, weight * total - epochs * s.t AS rest, unnest(range(0, epochs + 1)) AS epoch
  FROM blocks b JOIN budgets s ON b.source = s.source),
ranked AS (
  SELECT *, row_number() OVER w - 1 AS block_rank, sum(t) OVER (w ROWS UNBOUNDED PRECEDING) - t AS before
  FROM epochs WINDOW w AS (PARTITION BY source, epoch ORDER BY md5('{SEED}|' || epoch || '|' || source || '|' || block), block)),
copies AS (
  SELECT d.doc_id, d.source, d.n, r.epoch, r.epochs, r.rest, r.block_rank, r.weight, row_number() OVER w - 1 AS position,
         r.before + sum(d.n) OVER (w ROWS UNBOUNDED PRECEDING) AS upto
  FROM words d JOIN ranked r ON d.source = r.source AND d.block = r.block
  WINDOW w AS (PARTITION BY d.source, d.block, r.epoch ORDER BY md5('{SEED}|' || r.epoch || '|' || d.doc_id), d.doc_id))
SELECT doc_id, source, n::BIGINT AS n_tokens, epoch::BIGINT AS epoch, block_rank::INTEGER AS block_rank, position::INTEGER AS position, round(weight, 9) AS weight
FROM copies WHERE epoch < epochs OR upto <= rest
"""
