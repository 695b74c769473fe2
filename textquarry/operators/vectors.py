"""Vector tables: cosine ranking, merges, TF-IDF, cached embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from textquarry.operators.vector_blocks import cosine_scores
from textquarry.sources.shared import stored

_WORDS, _ROWS = 1 << 20, 1024  # words that are counted at a time, rows that are weighed
#: A slice leaves out terms with fewer than a word in _SHARE words, or _MISSED at most; terms that are counted for each one asked.
_SHARE, _MISSED, _OPEN = 1 << 17, 7, 3


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column, smallest: float = 1e-10) -> Column:
    length = norm(v) + F.lit(smallest)
    return F.transform(v, lambda x: x.cast("double") / length)


def with_units(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Adds u, the vector at unit length, so that cosines are dot products from here on."""
    return vectors.withColumn("u", unit(F.col(vector)))


def in_blocks(queries: DataFrame, query: Column, key: str, block: int, most: int | None = None) -> tuple[DataFrame, int]:
    """(rows of one column, asked: the structs `query` of about `block` queries each, number of blocks); more than `most` queries are refused."""
    n = queries.count()
    if most is not None and n > most:
        raise ValueError(f"more than {most} queries")
    blocks = max(1, -(-n // block))
    dealt = queries.select(query.alias("s"), F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"))
    return dealt.groupBy("block").agg(F.collect_list("s").alias("asked")).select("asked"), blocks


def asked_all(rows: DataFrame, packed: DataFrame, blocks: int) -> DataFrame:
    """Every row beside every block of queries; only a single block is held on every executor."""
    return rows.join(F.broadcast(packed)) if blocks == 1 else rows.hint("shuffle_replicate_nl").join(packed)


def nearest(scores: DataFrame, k: int, min_score: float | None = None, key: str = "vec_id", query_key: str = "query_id", digits: int = 9) -> DataFrame:
    """The k highest cosines of each query, then without those below `min_score`; ties go to the smaller key."""
    order = Window.partitionBy(query_key).orderBy(F.round("cosine", digits).desc(), F.col(key))
    top = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top if min_score is None else top.where(F.col("cosine") >= min_score)


def merged(table: DataFrame, updates: DataFrame, removed: DataFrame | None = None, key: str = "vec_id") -> DataFrame:
    """Upsert by key and real removal: rows of `updates` replace those of `table` with their key, keys of `removed` go."""
    gone = updates.select(key) if removed is None else updates.select(key).union(removed.select(key))
    fresh = updates if removed is None else updates.join(removed.select(key), key, "left_anti")
    return table.join(gone.distinct(), key, "left_anti").unionByName(fresh.select(*table.columns))


def wrong_dimension(vectors: DataFrame, dimension: int, vector: str = "embedding") -> DataFrame:
    """Rows whose vector isn't of the dimension."""
    return vectors.where((F.size(vector) != dimension) | F.col(vector).isNull())


def terms(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf): lower-cased words and pairs of neighbouring words of each row, counted inside it: no shuffle."""
    # exploding arrays of one item keeps the optimizer from copying what is below into each use of it
    words = texts.select(key, F.explode(F.array(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)))).alias("w"))
    pairs = F.expr("transform(slice(w, 1, greatest(size(w) - 1, 0)), (x, i) -> concat(x, ' ', w[i + 1]))")
    runs = F.expr("filter(sequence(1, size(s)), i -> i = 1 or s[i - 1] <> s[i - 2])")
    rows = words.where(F.size("w") > 0).select(key, F.explode(F.array(F.sort_array(F.concat("w", pairs)))).alias("s")).withColumn("heads", F.explode(F.array(runs)))
    counted = F.expr("transform(heads, (h, i) -> struct(s[h - 1] as term, cast(coalesce(get(heads, i + 1), size(s) + 1) - h as long) as tf))")
    return rows.select(key, F.explode(counted).alias("x")).select(key, "x.term", "x.tf")


def _slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, pa.Array]]:
    """(keys, row and number of each word, the words so numbered) of runs of whole rows, of `most` words where a row has no more."""
    for batch in batches:
        keys, words = batch.column("k"), batch.column("w")
        begins = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(begins, begins[low] + most, "right")) - 1)
            found = words.slice(low, high - low).flatten().dictionary_encode()
            if len(found):
                yield keys.slice(low, high - low), np.repeat(np.arange(high - low), np.diff(begins[low : high + 1])), found.indices.to_numpy().astype(np.int64), found.dictionary
            low = high


def _tally(code: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes that occur `least` times, and how often they do."""
    found, total = np.unique(code, return_counts=True)
    return found[total >= least], total[total >= least]


def _totals(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(term, total, missed) of words and pairs of neighbouring words of each slice; a slice's rarest are left out.

    `missed` is the most that a term left out can have; a row without a term has it once for the slice. It is `most` at most, and 0 in small slices.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, row, word, words in _slices(batches, _WORDS):
            both, n, missed = row[:-1] == row[1:], len(words), min(most, len(word) // _SHARE)
            pairs, of_pairs = _tally((word[:-1] * n + word[1:])[both], missed + 1)
            single, of_words = _tally(word, missed + 1)
            one, two = (words.take(pa.array(x)) for x in np.divmod(pairs, n))
            names = pa.concat_arrays([words.take(pa.array(single)), pc.binary_join_element_wise(one, two, " ").cast(pa.string()), pa.nulls(1, pa.string())])
            totals = np.concatenate([of_words, of_pairs, [0]])
            yield pa.RecordBatch.from_arrays([names, pa.array(totals, pa.int64()), pa.array(np.full(len(names), missed), pa.int64())], ["term", "total", "missed"])

    return run


def _candidates(words: DataFrame, features: int) -> list[str]:
    """Terms among which the `features` most frequent are.

    A term's total is at least what slices tell of it, and at most that and what the others can have missed. If that leaves too many open, as where
    frequencies are flat, every term of every slice is counted.
    """
    for most in (_MISSED, 0):
        found = words.mapInArrow(_totals(most), "term string, total long, missed long").groupBy("term").agg(F.sum("total").alias("total"), F.sum("missed").alias("missed"))
        found = stored(found) if most else found
        if not most:
            return found.where("term is not null").orderBy(F.desc("total"), "term").limit(features).select("term").toArrow().column("term").to_pylist()
        missed = found.where("term is null").agg(F.sum("missed")).first()[0] or 0
        known = found.where("term is not null")
        last = known.orderBy(F.desc("total"), "term").limit(features).agg(F.count("*"), F.min("total")).first()
        if missed and (last[0] < features or missed >= last[1]):
            continue
        open_ = known.where(F.col("total") + missed - F.col("missed") >= (last[1] or 0)).orderBy("term").limit(_OPEN * features + 1).select("term").toArrow().column("term").to_pylist()
        if len(open_) <= _OPEN * features:
            return open_
    return []


def _counts_of(names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(k, ids, tf) of the rows that have some of these words and pairs; a term's place is its id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = [x.split(" ") for x in names]
        own = {w: i for i, w in enumerate(sorted({w for x in split for w in x}))}
        known, single = pa.array(list(own), pa.string()), np.full(len(own) + 1, -1)
        single[[own[x[0]] for x in split if len(x) == 1]] = [i for i, x in enumerate(split) if len(x) == 1]
        coded = sorted((own[x[0]] * len(own) + own[x[1]], i) for i, x in enumerate(split) if len(x) == 2)
        codes, places = (np.array([x[j] for x in coded], np.int64) for j in (0, 1))
        for keys, row, word, words in _slices(batches, _WORDS):
            mine = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)[word]
            on = single[mine] >= 0
            at, term = [row[on]], [single[mine][on]]
            if len(codes):
                both = (row[:-1] == row[1:]) & (mine[:-1] >= 0) & (mine[1:] >= 0)
                code, where = (mine[:-1] * len(own) + mine[1:])[both], row[1:][both]
                place = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                hit = codes[place] == code
                at, term = [*at, where[hit]], [*term, places[place[hit]]]
            cells, tf = np.unique(np.concatenate(at) * len(names) + np.concatenate(term), return_counts=True)
            row, term = np.divmod(cells, len(names))
            some, n = np.unique(row, return_counts=True)
            begins = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
            lists = [pa.ListArray.from_arrays(begins, pa.array(x, pa.int32())) for x in (term, tf)]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(some)), *lists], ["k", "ids", "tf"])

    return run


def _weights_of(places: np.ndarray, idf: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(k, ids, weights) of (k, ids, tf), at unit length; `places` are the ids that are given in place of these, or -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, _ROWS) for b in batches for i in range(0, b.num_rows, _ROWS)):
            n = pc.list_value_length(batch.column("ids")).to_numpy(zero_copy_only=False)
            ids, tf = places[batch.column("ids").flatten().to_numpy(zero_copy_only=False)], batch.column("tf").flatten().to_numpy(zero_copy_only=False)
            row, tf, ids = np.repeat(np.arange(len(n)), n)[ids >= 0], tf[ids >= 0], ids[ids >= 0]
            raw = (1 + np.log(tf)) * idf[ids]
            some, n = np.unique(row, return_counts=True)
            weights = raw / np.sqrt(np.bincount(row, raw * raw))[row] if len(row) else raw
            begins = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
            lists = [pa.ListArray.from_arrays(begins, pa.array(x, kind)) for x, kind in ((ids, pa.int32()), (weights, pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column("k").take(pa.array(some)), *lists], ["k", "ids", "weights"])

    return run


def repeated(texts: DataFrame, key: str = "doc_id") -> bool:
    """Whether some key has more than one row."""
    return not texts.groupBy(key).agg(F.count("*").alias("m")).where("m > 1").select(key).isEmpty()


def _vocabulary(found: DataFrame, texts: DataFrame, features: int) -> DataFrame:
    """(term, idf, id from 0) of the `features` most frequent terms of (term, total, df), in that order. Stored."""
    n, order = texts.agg(F.count("*").alias("n")), [F.desc("total"), F.col("term")]
    most = found.orderBy(*order).limit(features).join(n).withColumn("id", F.row_number().over(Window.orderBy(*order)) - 1)
    return stored(most.select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"), "id"))


def tf_idf_counts(texts: DataFrame, key: str = "doc_id", text: str = "text", features: int = 20_000) -> tuple[DataFrame, DataFrame, Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]]:
    """((k, ids, tf), vocabulary (term, idf, id), weigh): counts by row, for texts whose keys do not repeat, of which `weigh` makes (k, ids, weights) with
    the ids of the vocabulary and the weights of `tf_idf`.

    Texts are read twice: for the terms that may be frequent enough, at most _OPEN times `features`, which are broadcast, and for their counts, which are
    stored by row as numbers. No row is shuffled.
    """
    spark, kind = texts.sparkSession, texts.select(key).schema[0].dataType.simpleString()
    words = texts.select(F.col(key).alias("k"), F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)).alias("w"))
    names = _candidates(words.select("w", "k"), features)
    known = spark.sparkContext.broadcast(names)
    counts = stored(words.mapInArrow(lambda batches: _counts_of(known.value)(batches) if known.value else iter(()), f"k {kind}, ids array<int>, tf array<int>"))
    each = counts.select(F.explode(F.arrays_zip("ids", "tf")).alias("x")).groupBy(F.col("x.ids").alias("was")).agg(F.sum("x.tf").alias("total"), F.count("*").alias("df"))
    named = spark.createDataFrame(pa.table({"was": pa.array(range(len(names)), pa.int32()), "term": pa.array(names, pa.string())}))
    numbered = _vocabulary(each.join(F.broadcast(named), "was").select("term", "total", "df"), texts, features)
    table = numbered.orderBy("id").toArrow()
    at = {w: i for i, w in enumerate(table.column("term").to_pylist())}
    final = spark.sparkContext.broadcast((np.array([at.get(w, -1) for w in names], np.int64), table.column("idf").to_numpy()))
    return counts, numbered, lambda batches: _weights_of(*final.value)(batches)


def tf_idf_rows(texts: DataFrame, key: str = "doc_id", text: str = "text", features: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """((key, ids, weights), vocabulary (term, idf, id)) of texts whose keys do not repeat."""
    counts, numbered, weigh = tf_idf_counts(texts, key, text, features)
    kind = counts.schema["k"].dataType.simpleString()
    return counts.mapInArrow(weigh, f"k {kind}, ids array<int>, weights array<double>").withColumnRenamed("k", key), numbered


def tf_idf(texts: DataFrame, key: str = "doc_id", text: str = "text", features: int = 20_000) -> DataFrame:
    """(key, term, weight): (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1) at unit length, over the `features` most frequent terms.

    The vocabulary, of at most `features` terms, is broadcast. Rows of one key are one text; where keys repeat, counts are shuffled by key.
    """
    if not repeated(texts, key):
        rows, numbered = tf_idf_rows(texts, key, text, features)
        each = rows.select(key, F.explode(F.arrays_zip("ids", "weights")).alias("x")).select(key, F.col("x.ids").alias("id"), F.col("x.weights").alias("weight"))
        return each.join(F.broadcast(numbered.select("term", "id")), "id").select(key, "term", "weight")
    counts = terms(texts, key, text)
    found = counts.groupBy(key, "term").agg(F.sum("tf").alias("tf")).groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
    numbered = _vocabulary(found, texts, features)
    dealt = counts.join(F.broadcast(numbered.select("term", "id")), "term").select(key, "id", F.col("tf").cast("int").alias("tf")).repartition(key)
    merged_tf = dealt.groupBy(key, "id").agg(F.sum("tf").alias("tf"))
    raw = merged_tf.join(F.broadcast(numbered), "id").select(key, "term", ((1 + F.log("tf")) * F.col("idf")).alias("raw"))
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("raw") / length).alias("weight"))


def embedded_once(texts: DataFrame, cache: DataFrame, embed: Callable[[DataFrame], DataFrame], text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts with their embedding, the new cache): each distinct text that the cache (h, embedding) lacks is embedded once.

    `embed` takes (h, text) and returns (h, embedding).
    """
    hashed = texts.withColumn("h", F.sha2(F.col(text).cast("binary"), 256))
    new = hashed.groupBy("h").agg(F.first(text).alias("text")).join(cache.select("h"), "h", "left_anti")
    whole = cache.select("h", "embedding").unionByName(embed(new).select("h", "embedding"))
    return hashed.join(whole, "h").drop("h"), whole


def to_embed(texts: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """(h, n): hashes of distinct texts that the cache lacks, and how many rows have each."""
    return texts.groupBy(F.sha2(F.col(text).cast("binary"), 256).alias("h")).agg(F.count("*").alias("n")).join(cache.select("h"), "h", "left_anti")


def current_version(index: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """(usable rows, rows to embed again) of a stored index with an embed_version column."""
    same = F.col("embed_version").eqNullSafe(F.lit(version))
    return index.where(same), index.where(~same)


def artifact_text() -> Column:
    """Name, description, evidence and handling joined by bars; the id where all are empty."""
    parts = F.concat_ws(" | ", F.nullif(F.col("name"), F.lit("")), F.nullif(F.col("description"), F.lit("")), F.filter("evidence", lambda e: e != ""), F.nullif(F.col("handling"), F.lit("")))
    return F.coalesce(F.nullif(parts, F.lit("")), F.col("artifact_id"))


def artifact_hits(vectors: DataFrame, queries: DataFrame, k: int = 5, min_score: float = 0.0, query_key: str = "query_id") -> DataFrame:
    """(query_id, artifact_type, artifact_id, relevance, rank) of the nearest artifacts; `vectors` has ids of the form `type:id` and their embeddings.

    An id without a type is of type unknown. Relevance is the cosine.
    """
    found = nearest(cosine_scores(vectors, queries, query_key=query_key, k=k), k, min_score, query_key=query_key)
    typed = F.col("vec_id").contains(":")
    name = F.when(typed, F.expr("substring(vec_id, instr(vec_id, ':') + 1)")).otherwise(F.col("vec_id"))
    kind = F.when(typed, F.substring_index("vec_id", ":", 1)).otherwise(F.lit("unknown"))
    return found.select(query_key, kind.alias("artifact_type"), name.alias("artifact_id"), F.col("cosine").alias("relevance"), "rank")
