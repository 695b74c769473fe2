"""Block-max BM25: a stored index whose postings lie in blocks with their highest contribution, and top-k search that skips blocks below the k-th score.

Three tables: `forward` has each passage's terms with their impact (all of a term's score but its weight) and the class of its length, `terms` their
weight and highest impact in each class, `blocks` postings of a term and class with near impacts, BLOCK or so in each; frequent terms so have many
blocks and no key holds more than one. Passages of one class have impacts of one order, which keeps the bounds near the truth. A search
first scores the passages that have most of each query's rarest terms, which gives a floor. With a query's terms in order of what they can add at most, a
block can hold a passage of the floor only if its highest impact and all later terms reach it; the others are not joined. The passages that the
rest of the terms may lift to the floor are scored in full.

An index for the terms of known queries alone has no blocks of postings: it keeps counts by passage, and `passage_scan` scores them where they lie.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from textquarry.functions.texts import tokens
from textquarry.operators import passage_scan
from textquarry.operators.retrieval import FLOOR, K1, B
from textquarry.sources.shared import stored

BLOCK, LEVELS = 128, 8
#: Postings of a query's rarest terms that give its first floor; part of a score that rounding may take.
RARE, SLACK = 4096, 1e-7
#: Classes of length to a doubling; part of the floor that a block and the terms after it must reach: less leaves fewer passages open, and reads more.
STEPS, SHARE = 2, 1.0
#: Passages looked at for one without any of a query's terms.
PROBES = 64
#: Queries' terms that are broadcast when an index is built for them alone; one for more of them has blocks.
FEW_TERMS = 200_000


@dataclass(frozen=True)
class PassageIndex:
    spark: SparkSession
    folder: str
    key: str
    n: int
    mean_len: float
    lowest: float
    k1: float = K1
    b: float = B
    rows: DataFrame | None = None

    @property
    def searched(self) -> tuple[float, float, float, int]:
        return self.k1, self.b, self.mean_len, BLOCK

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")


def counted(passages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, len, terms: (term, tf) of each passage), counted inside the row."""
    runs = F.expr("filter(sequence(1, greatest(size(s), 1)), i -> i = 1 or s[i - 1] <> s[i - 2])")
    # exploding arrays of one item keeps the optimizer from copying what is below into each use of it
    rows = passages.select(F.col(key), F.explode(F.array(tokens(F.col(text)))).alias("t"))
    rows = rows.select(key, F.size("t").alias("len"), F.explode(F.array(F.sort_array("t"))).alias("s")).withColumn("heads", F.explode(F.array(runs)))
    return rows.select(key, "len", F.when(F.col("len") > 0, F.expr("transform(heads, (h, i) -> struct(s[h - 1] as term, coalesce(get(heads, i + 1), size(s) + 1) - h as tf))")).alias("terms"))


def build(passages: DataFrame, folder: str, key: str = "doc_id", text: str = "text", asked: DataFrame | None = None, k1: float = K1, b: float = B, floor: float = FLOOR) -> PassageIndex:
    """Writes the index of `passages` to `folder`: Okapi BM25, negative idf replaced by `floor` times the mean idf.

    With `asked`, a table of distinct terms, only they can be searched; statistics are those of all terms. Up to FEW_TERMS of them are counted by
    passage, without blocks. A null text is a passage without terms.
    """
    spark = passages.sparkSession
    if asked is not None:
        asked = stored(asked)
        if asked.count() <= FEW_TERMS:
            return _counted_index(passages, folder, key, text, asked, k1, b, floor)
    n, mean = passages.agg(F.count("*"), F.avg(F.size(tokens(F.col(text))))).first()
    impact = f"x.tf * {k1 + 1:.17g}D / (x.tf + {k1:.17g}D * ({1 - b:.17g}D + {b:.17g}D * len / {mean or 1.0:.17g}D))"
    length = F.floor(F.log2(F.col("len") + 1) * STEPS).cast("int")
    counted(passages, key, text).select(key, length.alias("c"), F.expr(f"transform(terms, x -> struct(x.term as term, {impact} as impact))").alias("terms")).write.mode("overwrite").parquet(f"{folder}/forward")
    every = spark.read.parquet(f"{folder}/forward").select(key, "c", F.explode("terms").alias("p")).select(key, "c", "p.term", "p.impact")
    classes = every.groupBy("term", "c").agg(F.count("*").alias("n"), F.max("impact").alias("most"))
    df = classes.groupBy("term").agg(F.sum("n").alias("df"), F.collect_list(F.struct("c", "n", "most")).alias("classes"))
    idf = stored(df.withColumn("idf", F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)))
    mean_idf = idf.agg(F.avg("idf")).first()[0] or 0.0
    idf.select("term", "df", "classes", F.when(F.col("idf") < 0, floor * mean_idf).otherwise(F.col("idf")).alias("idf")).write.mode("overwrite").parquet(f"{folder}/terms")
    known = spark.read.parquet(f"{folder}/terms").select("term", "df")
    if asked is not None:
        known = stored(known.join(asked, "term", "left_semi"))
        known = F.broadcast(known) if known.count() <= FEW_TERMS else known
    salt = F.pmod(F.xxhash64(key), F.ceil(F.col("df") / (BLOCK * LEVELS)))
    level = F.when(F.col("df") > BLOCK, F.floor(F.col("impact") * LEVELS)).otherwise(0)
    blocks = every.join(known, "term").groupBy("term", "c", level.alias("level"), salt.alias("salt")).agg(F.max("impact").alias("most"), F.collect_list(F.struct(F.col(key).alias("k"), "impact")).alias("p"))
    blocks.select("term", "c", "most", "p").write.mode("overwrite").parquet(f"{folder}/blocks")
    return PassageIndex(spark, folder, key, n, float(mean or 0.0), floor * mean_idf, k1, b)


def _counted_index(passages: DataFrame, folder: str, key: str, text: str, asked: DataFrame, k1: float, b: float, floor: float) -> PassageIndex:
    spark, names = passages.sparkSession, sorted(asked.where("term is not null").toArrow().column("term").to_pylist())
    passage_scan.counts(passages, f"{folder}/counts", key, text, names)
    rows = passage_scan.passages_in(passages, f"{folder}/counts", key)
    n, mean = rows.agg(F.count("*"), F.avg("len")).first()
    idf = F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    mean_idf = passage_scan.terms_in(passages, f"{folder}/counts", key).agg(F.avg(idf)).first()[0] or 0.0
    numbered = spark.createDataFrame(pa.table({"id": pa.array(range(len(names)), pa.int32()), "term": pa.array(names, pa.string())}))
    df = rows.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("df"))
    df.join(F.broadcast(numbered), "id").select("term", "id", "df", F.when(idf < 0, floor * mean_idf).otherwise(idf).alias("idf")).write.mode("overwrite").parquet(f"{folder}/terms")
    return PassageIndex(spark, folder, key, n, float(mean or 0.0), floor * mean_idf, k1, b, rows)


def weighed(index: PassageIndex, queries: DataFrame, query_key: str = "item_id", text: str = "text") -> DataFrame:
    """(q, term, df, w, classes; id where terms are counted by passage) of each query's terms: the weight times how often it is asked. Stored."""
    asked = queries.select(F.col(query_key).alias("q"), F.explode(tokens(F.col(text))).alias("term")).groupBy("q", "term").agg(F.count("*").alias("qtf"))
    return stored(asked.join(index.table("terms"), "term").select("q", "term", "df", (F.col("qtf") * F.col("idf")).alias("w"), "classes" if index.rows is None else "id"))


def _bounds(asked: DataFrame) -> DataFrame:
    """(q, c, term, w, up, rest): what a term can add at most to passages of a class, and what all those after it can; first come those that add most for each posting read."""
    rows = asked.select("q", "term", "w", F.explode("classes").alias("x")).select("q", "term", "w", "x.c", "x.n", F.greatest(F.lit(0.0), F.col("w") * F.col("x.most")).alias("up"))
    after = Window.partitionBy("q", "c").orderBy(F.desc(F.col("up") / F.col("n")), "term").rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumn("rest", F.coalesce(F.sum("up").over(after), F.lit(0.0))).drop("n")


def scores_of(index: PassageIndex, asked: DataFrame, pairs: DataFrame) -> DataFrame:
    """(q, k, score) of these pairs (q, k) that share a term."""
    wanted = pairs.join(asked.select("q", "term", "w"), "q")
    postings = index.table("blocks").join(asked.select("term").distinct(), "term", "left_semi").select("term", F.explode("p").alias("p")).select("term", "p.k", "p.impact")
    return wanted.join(postings, ["k", "term"]).groupBy("q", "k").agg(F.sum(F.col("w") * F.col("impact")).alias("score"))


def _kth(scores: DataFrame, k: int) -> DataFrame:
    """(q, floor): the k-th best score of each query that has k."""
    top = scores.withColumn("i", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).where(F.col("i") <= k)
    return top.groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") == k).select("q", "floor")


def floors(index: PassageIndex, asked: DataFrame, k: int) -> DataFrame:
    """(q, floor): a score that k passages of the query reach, from its rarest terms, RARE postings or so; queries with fewer have none. Stored.

    A query of frequent terms alone is asked for the best block of the rarest of them.
    """
    order = Window.partitionBy("q").orderBy("df", "term")
    rare = asked.withColumn("sum", F.sum("df").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("i", F.row_number().over(order)).where((F.col("sum") <= RARE) | (F.col("i") == 1))
    few, often = rare.where(F.col("df") <= RARE).select("q", "term", "w"), rare.where(F.col("df") > RARE).select("q", "term", "w")
    blocks = index.table("blocks").select("term", "most", "p")
    best = blocks.join(often.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.max_by("p", "most").alias("p"))
    met = few.join(blocks, "term").select("q", "w", "p").union(often.join(best, "term").select("q", "w", "p"))
    met = met.select("q", "w", F.explode("p").alias("p")).select("q", F.col("p.k").alias("k"), (F.col("w") * F.col("p.impact")).alias("part"))
    partial = met.groupBy("q", "k").agg(F.sum("part").alias("part"))
    likely = partial.withColumn("i", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("part"), "k"))).where(F.col("i") <= 2 * k).select("q", "k")
    return stored(_kth(scores_of(index, asked, stored(likely)), k))


def _able(index: PassageIndex, asked: DataFrame, floor: DataFrame) -> DataFrame:
    """Blocks of each query's terms, and whether one may hold a passage that reaches the query's floor and has no earlier term."""
    rows = _bounds(asked).join(floor, "q", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))) * (1 - SLACK))
    blocks = index.table("blocks").withColumnRenamed("most", "top")
    return blocks.join(rows, ["term", "c"]).withColumn("able", F.greatest(F.lit(0.0), F.col("w") * F.col("top")) + F.col("rest") >= SHARE * F.col("floor"))


def joined_rows(index: PassageIndex, asked: DataFrame, floor: DataFrame) -> DataFrame:
    """One row (read, all): postings that a search with these floors joins, and those that meet a query's term."""
    sizes = _able(index, asked, floor).select("able", F.size("p").cast("long").alias("n"))
    return sizes.agg(F.coalesce(F.sum(F.when(F.col("able"), F.col("n"))), F.lit(0)).alias("read"), F.coalesce(F.sum("n"), F.lit(0)).alias("all"))


def reaching(index: PassageIndex, asked: DataFrame, floor: DataFrame) -> DataFrame:
    """(q, k, score) of all passages whose score is at least the query's floor (q, floor); all that share a term where it has none."""
    blocks = _able(index, asked, floor)
    skipped = blocks.where(~F.col("able")).groupBy("q", "c", "term").agg(F.max(F.greatest(F.lit(0.0), F.col("w") * F.col("top"))).alias("hidden"))
    totals = skipped.groupBy("q", "c").agg(F.sum("hidden").alias("hidden_all"))
    met = blocks.where("able").join(skipped, ["q", "c", "term"], "left").select("q", "c", "floor", "w", "hidden", F.explode("p").alias("p"))
    found = met.groupBy("q", "c", F.col("p.k").alias("k")).agg(F.first("floor").alias("floor"), F.sum(F.col("w") * F.col("p.impact")).alias("seen"), F.coalesce(F.sum("hidden"), F.lit(0.0)).alias("known"))
    hidden = F.coalesce("hidden_all", F.lit(0.0)) - F.col("known")
    likely = found.join(totals, ["q", "c"], "left").where(F.col("seen") + hidden >= F.col("floor") - SLACK).select("q", "k")
    rows = scores_of(index, asked, stored(likely)).join(floor, "q", "left")
    return rows.where(F.col("score") >= F.coalesce("floor", F.lit(float("-inf"))) * (1 - SLACK) - SLACK).select("q", "k", "score")


def _within(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, and all within rounding of the k-th."""
    floor = F.coalesce("floor", F.lit(float("-inf")))
    return found.join(_kth(found, k), "q", "left").where(F.col("score") >= floor - SLACK * (1 + F.abs(floor))).drop("floor")


def top(index: PassageIndex, asked: DataFrame, k: int) -> DataFrame:
    """(q, k, score): each query's k best passages, and all within rounding of the k-th."""
    if index.rows is None:
        found = stored(reaching(index, asked, floors(index, asked, k)))
    else:
        found = stored(passage_scan.best(index.rows, asked, k, *index.searched))
    return _within(found, k)


def _surely_zero(index: PassageIndex, asked: DataFrame) -> DataFrame:
    """Queries (q) for which some passage has none of their terms: their terms have fewer postings than there are passages, or a probed one has none."""
    term, every, own = ("term", "forward", F.coalesce(F.col("terms.term"), F.array().cast("array<string>"))) if index.rows is None else ("id", None, F.col("ids"))
    few = asked.groupBy("q").agg(F.sum("df").alias("df"), F.collect_list(term).alias("own"))
    probes = (index.table(every).orderBy(F.xxhash64(index.key)) if every else index.rows.orderBy(F.xxhash64("k"))).limit(PROBES).agg(F.collect_list(own).alias("probes"))
    return few.join(F.broadcast(probes)).where((F.col("df") < index.n) | F.exists("probes", lambda p: ~F.arrays_overlap(p, F.col("own")))).select("q")


def normed_top(index: PassageIndex, queries: DataFrame, k: int, query_key: str = "item_id", text: str = "text") -> DataFrame:
    """(query_key, key, norm): the k best passages of each query and those within rounding, scores scaled to 0..1 over all passages.

    The lowest score is 0 where some passage has none of a query's terms; the few queries that meet every passage, and indexes with negative weights,
    are scored in full for theirs.
    """
    asked = weighed(index, queries, query_key, text)
    low = lows(index, asked)
    best = top(index, asked, k)
    return scaled(best, best, low).select(F.col("q").alias(query_key), F.col("k").alias(index.key), "norm")


def lows(index: PassageIndex, asked: DataFrame) -> DataFrame:
    """(q, low): the lowest score of each query over all passages."""
    sure = stored(_surely_zero(index, asked)) if index.lowest >= 0 else asked.select("q").limit(0)
    rest = stored(asked.join(sure, "q", "left_anti"))
    exact = sure.select("q", F.lit(0.0).alias("low"))
    if rest.isEmpty():
        return exact
    if index.rows is None:
        full = reaching(index, rest, rest.select("q", F.lit(0.0).alias("floor")).limit(0)).groupBy("q").agg(F.min("score").alias("low"), F.count("*").alias("m"))
    else:
        full = passage_scan.lowest(index.rows, rest, *index.searched)
    return exact.union(full.select("q", F.when(F.col("m") < index.n, F.least(F.lit(0.0), "low")).otherwise(F.col("low")).alias("low")))


def scaled(scores: DataFrame, best: DataFrame, low: DataFrame) -> DataFrame:
    """`scores` (q, k, score) with norm; `best` holds each query's highest score. The highest is 0 at least where the lowest is below."""
    high = best.groupBy("q").agg(F.max("score").alias("high"))
    rows = scores.join(high, "q").join(low, "q")
    width = F.greatest("high", "low") - F.col("low")
    return rows.withColumn("norm", F.when(width < 1e-9, F.lit(0.0)).otherwise((F.col("score") - F.col("low")) / width)).drop("high", "low")


def fused_top(index: PassageIndex, queries: DataFrame, vectors: DataFrame, query_vectors: DataFrame, k: int, alpha: float = 0.4, query_key: str = "item_id", text: str = "text") -> DataFrame:
    """The same rows as `hybrid_top`, of an index whose terms are counted by passage: cosines and scores of a block of passages are made together.

    `vectors` (k, v) has passages' vectors, `query_vectors` (q, v) those of queries; either may lack some. Every passage beside every query is looked at
    where it lies, and only what can be among the k best leaves its task.
    """
    asked = weighed(index, queries, query_key, text)
    low, best = stored(lows(index, asked)), stored(top(index, asked, 1))
    ends = best.groupBy("q").agg(F.max("score").alias("high")).join(low, "q")
    found = stored(passage_scan.fused(index.rows, asked, ends, vectors, query_vectors, k, alpha, *index.searched))
    return _within(found, k).select(F.col("q").alias(query_key), F.col("k").alias(index.key), F.col("score").alias("final"))


def hybrid_top(
    index: PassageIndex, queries: DataFrame, near: DataFrame, cosines_of, k: int, alpha: float = 0.4, query_key: str = "item_id", text: str = "text"
) -> DataFrame:
    """(query_key, key, final) of each query's k best by alpha * norm + (1 - alpha) * (cosine + 1) / 2, and those within rounding.

    `near` (q, k, cosine) lists each query's nearest passages, more than k of them; `cosines_of(pairs)` gives (q, k, cosine) of pairs (q, k) that have
    one, others add nothing for it. What the best of both lists reach is the floor; a passage outside `near` is no nearer than its last, so it
    needs a norm that only few have. A query without a text or terms has its cosines alone.
    """
    asked = weighed(index, queries, query_key, text)
    low, best, near = stored(lows(index, asked)), stored(top(index, asked, k)), stored(near.select("q", "k", "cosine"))

    def finals(pairs: DataFrame, cosines: DataFrame) -> DataFrame:
        norms = scaled(scores_of(index, asked, pairs), best, low).select("q", "k", "norm")
        rows = pairs.join(norms, ["q", "k"], "left").join(cosines, ["q", "k"], "left")
        return rows.select("q", "k", (alpha * F.coalesce("norm", F.lit(0.0)) + (1 - alpha) * F.coalesce((F.col("cosine") + 1) / 2, F.lit(0.0))).alias("score"))

    far = stored(best.select("q", "k").join(near, ["q", "k"], "left_anti"))
    first = stored(finals(near.select("q", "k"), near).union(finals(far, cosines_of(far))))
    last = near.groupBy("q").agg(F.min("cosine").alias("last"))
    ends = _kth(first, k).join(last, "q").join(low, "q").join(best.groupBy("q").agg(F.max("score").alias("high")), "q")
    need = (F.col("floor") - (1 - alpha) * (F.col("last") + 1) / 2) / alpha
    floor = ends.where(need > 0).select("q", (F.col("low") + need * (F.greatest("high", "low") - F.col("low")) - 1e-9).alias("floor"))
    more = stored(reaching(index, asked, stored(floor)).select("q", "k").join(first, ["q", "k"], "left_anti"))
    rows = stored(first.union(finals(more, cosines_of(more))))
    kept = rows.join(_kth(rows, k), "q", "left").where(F.col("score") >= F.coalesce("floor", F.lit(float("-inf"))) - SLACK)
    return kept.select(F.col("q").alias(query_key), F.col("k").alias(index.key), F.col("score").alias("final"))
