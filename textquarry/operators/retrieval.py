"""Chunking, BM25 and hybrid ranking over tables of passages and queries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from textquarry.functions.texts import chunk_id, token_estimate, tokens

K1, B, FLOOR = 1.5, 0.75, 0.25
_ROWS, _SENT = 64, 1_024  # texts held as Python strings at a time, chunks in one batch


def windows(docs: DataFrame, size: int, overlap: int = 0, key: str = "doc_id", text: str = "text", blank: bool = False, carried: tuple[str, ...] = ()) -> DataFrame:
    """(key, chunk_index, content, carried): windows of `size` characters that advance by size - overlap; blank ones are left out and not counted.

    With `blank` they stay: then an index is the window's place, no shuffle is needed, and keys may repeat.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    step = size - overlap
    begins = F.expr(f"sequence(0, greatest(length(`{text}`) - 1, 0), {step})")
    pieces = docs.where(F.length(text) > 0).select(key, *carried, text, F.posexplode(begins).alias("i", "begin"))
    pieces = pieces.select(key, *carried, "i", "begin", F.substring(F.col(text), F.col("begin") + 1, F.lit(size)).alias("content"))
    if blank:
        return pieces.select(key, F.col("i").alias("chunk_index"), "content", *carried)
    pieces = pieces.where(F.trim(F.regexp_replace("content", r"\s+", "")) != "")
    return pieces.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("begin")) - 1).alias("chunk_index"), "content", *carried)


def identified(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds chunk_id and n_tokens."""
    return chunks.withColumn("chunk_id", chunk_id(F.col(key), F.col("chunk_index"), F.col("content"))).withColumn("n_tokens", token_estimate(F.col("content")))


_HEADER = re.compile(r"^(#{1,3})[ \t]+(.+?)[ \t]*$", re.M)
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


def _sections(text: str) -> Iterator[tuple[str | None, str]]:
    found = list(_HEADER.finditer(text))
    lead = text[: found[0].start()] if found else text
    if lead.strip():
        yield None, lead.strip()
    for i, m in enumerate(found):
        body = text[m.end() : found[i + 1].start() if i + 1 < len(found) else len(text)].strip()
        yield m[2], f"## {m[2]}\n\n{body}" if body else f"## {m[2]}"


def _packed(section: str, most: int, overlap: int) -> Iterator[str]:
    """Whole sentences up to `most` characters; each next piece begins with the last whole sentences that fit the overlap."""
    if len(section) <= most:
        yield section
        return
    sentences = _SENTENCE_END.split(section)
    held: list[str] = []
    for s in sentences:
        if len(s) > most:
            if held:
                yield " ".join(held)
                held = []
            yield from (s[i : i + most] for i in range(0, len(s), most - overlap) if s[i : i + most].strip())
            continue
        if held and len(" ".join([*held, s])) > most:
            yield " ".join(held)
            tail: list[str] = []
            while held and len(" ".join([held[-1], *tail])) <= overlap:
                tail.insert(0, held.pop())
            held = tail if len(" ".join([*tail, s])) <= most else []
        held.append(s)
    if held:
        yield " ".join(held)


def markdown_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", max_tokens: int = 500, overlap_tokens: int = 50, min_tokens: int = 20) -> DataFrame:
    """(key, chunk_index, section_header, content): Markdown sections under H1 to H3 headers, packed by sentences where they are too long.

    A token is four characters. Chunks below `min_tokens` are left out and not counted. No shuffle: each text is cut where it is read.
    """

    kind = docs.schema[key].dataType.simpleString()
    made = f"{key} {kind}, chunk_index int, section_header string, content string"

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = pa.schema([(key, batch.schema.field(key).type), ("chunk_index", pa.int32()), ("section_header", pa.string()), ("content", pa.string())])
            for at in range(0, batch.num_rows, _ROWS):
                rows = batch.slice(at, _ROWS)
                out = []
                for k, t in zip(rows.column(key).to_pylist(), rows.column(text).to_pylist(), strict=True):
                    i = 0
                    for header, section in _sections(t or ""):
                        for piece in _packed(section, 4 * max_tokens, 4 * overlap_tokens):
                            if max(1, len(piece) // 4) >= min_tokens:
                                out.append((k, i, header, piece))
                                i += 1
                                if len(out) == _SENT:
                                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)
                                    out.clear()
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

    return docs.select(key, text).mapInArrow(part, made)


def postings(passages: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, len, term, tf) of each passage's terms, counted inside the row: no shuffle."""
    counted = passages.select(key, tokens(F.col(text)).alias("t")).withColumn("len", F.size("t"))
    # sorted terms, then the runs of equal ones
    runs = F.expr("transform(filter(sequence(1, greatest(size(s), 1)), i -> i = 1 or s[i - 1] <> s[i - 2]), i -> i)")
    counted = counted.where("len > 0").withColumn("s", F.array_sort("t")).withColumn("heads", runs)
    terms = F.expr("transform(heads, (h, i) -> struct(s[h - 1] as term, coalesce(get(heads, i + 1), size(s) + 1) - h as tf))")
    return counted.select(key, "len", F.explode(terms).alias("p")).select(key, "len", "p.term", "p.tf")


def bm25(passages: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", query_key: str = "item_id", query_text: str = "text", k1: float = K1, b: float = B, floor: float = FLOOR) -> DataFrame:
    """(query_key, key, score) for passages that share a term with the query: Okapi BM25, negative idf replaced by `floor` times the mean idf.

    Query terms count as often as they occur. Postings are counted once for the index statistics and once for scoring, where the terms of the
    queries (few against the corpus) are joined to them; passages without a shared term score 0 and are not listed.
    """
    index = postings(passages, key, text)
    stats = passages.select(F.size(tokens(F.col(text))).alias("len")).agg(F.count("*").alias("n"), F.avg("len").alias("mean_len"))
    df = index.groupBy("term").agg(F.count("*").alias("df")).join(stats)
    idf = df.select("term", "n", "mean_len", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    mean = idf.agg(F.avg("idf").alias("mean_idf"))
    idf = idf.join(mean).select("term", "mean_len", F.when(F.col("idf") < 0, floor * F.col("mean_idf")).otherwise(F.col("idf")).alias("idf"))
    asked = queries.select(F.col(query_key).alias("q"), F.explode(tokens(F.col(query_text))).alias("term")).groupBy("q", "term").agg(F.count("*").alias("qtf"))
    weighed = asked.join(idf, "term")
    tf = F.col("tf")
    part = F.col("qtf") * F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("mean_len")))
    return index.join(weighed, "term").groupBy("q", key).agg(F.sum(part).alias("score")).select(F.col("q").alias(query_key), key, "score")


def min_max(scores: DataFrame, n_passages: DataFrame, query_key: str = "item_id") -> DataFrame:
    """Adds norm, the score scaled to 0..1 over all passages of the query; those not listed count as 0. `n_passages` has one row (n)."""
    ends = scores.groupBy(query_key).agg(F.min("score").alias("low"), F.max("score").alias("high"), F.count("*").alias("m")).join(n_passages)
    low = F.when(F.col("m") < F.col("n"), F.least(F.lit(0.0), "low")).otherwise(F.col("low"))
    high = F.when(F.col("m") < F.col("n"), F.greatest(F.lit(0.0), "high")).otherwise(F.col("high"))
    ends = ends.select(query_key, low.alias("low"), high.alias("high"))
    width = F.col("high") - F.col("low")
    return scores.join(ends, query_key).withColumn("norm", F.when(width < 1e-9, F.lit(0.0)).otherwise((F.col("score") - F.col("low")) / width)).drop("low", "high")


def top_k(scores: DataFrame, k: int, by: str, query_key: str, key: str, digits: int | None = 9) -> DataFrame:
    """The k best rows of each query, ranked from 1; ties go to the smaller key. Scores are compared to `digits` decimals."""
    value = F.round(by, digits) if digits is not None else F.col(by)
    order = Window.partitionBy(query_key).orderBy(value.desc(), F.col(key))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def fused(vector_scores: DataFrame, bm25_norm: DataFrame, alpha: float = 0.4, query_key: str = "item_id", key: str = "doc_id") -> DataFrame:
    """(query_key, key, cosine, norm, final): final = alpha * norm + (1 - alpha) * (cosine + 1) / 2 of passages that either search has.

    A passage without shared terms has norm 0; one without a vector has no cosine, which adds nothing.
    """
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be from 0 to 1")
    both = vector_scores.join(bm25_norm.select(query_key, key, "norm"), [query_key, key], "full").withColumn("norm", F.coalesce("norm", F.lit(0.0)))
    return both.withColumn("final", alpha * F.col("norm") + (1 - alpha) * F.coalesce((F.col("cosine") + 1) / 2, F.lit(0.0)))


def from_sources(passages: DataFrame, sources: DataFrame, source: str = "source") -> DataFrame:
    """The passages of the wanted sources: applied before ranking, so that each query still gets its k best of them."""
    return passages.join(sources.select(source).distinct(), source, "left_semi").select(*passages.columns)


# Files of a project's memory, beside those of its modules folder.
MEMORY_FILES = ("PROJECT.md", "PATTERNS.md", "EDGE_CASES.md", "INDEX.md")


def memory_files(files: DataFrame, names: tuple[str, ...] = MEMORY_FILES, path: str = "path") -> DataFrame:
    """The Markdown files that make up each project's memory: those of the given names at the top, and all in the folder modules. Paths are relative to the project."""
    module = F.col(path).startswith("modules/") & F.col(path).endswith(".md") & ~F.substring(path, 9, 1 << 20).contains("/")
    return files.where(F.col(path).isin(*names) | module)


def indexed_memory(index: DataFrame, files: DataFrame, names: tuple[str, ...] = MEMORY_FILES) -> DataFrame:
    """The chunk table (project, path, chunk_index, section_header, content) with the chunks of all memory files of the given projects anew."""
    mine = memory_files(files, names)
    keyed = mine.select(F.to_json(F.struct("project", "path")).alias("f"), "content")
    chunks = markdown_chunks(keyed, "f", "content").withColumn("f", F.from_json("f", "project string, path string"))
    fresh = chunks.select("f.project", "f.path", "chunk_index", "section_header", "content")
    return reindexed(index, files.select("project").distinct(), fresh, "project")


def shaped(results: DataFrame, text: str = "content") -> DataFrame:
    """Adds relevance, source_confidence (both at most 1), confidence (0.4 and 0.6 of them) and n_tokens to fused results."""
    r, c = F.least(F.lit(1.0), "final"), F.least(F.lit(1.0), (F.col("cosine") + 1) / 2)
    return results.withColumns({"relevance": r, "source_confidence": c, "confidence": 0.4 * r + 0.6 * c, "n_tokens": token_estimate(F.col(text))})


def reindexed(chunks: DataFrame, changed: DataFrame, fresh: DataFrame, source: str = "source") -> DataFrame:
    """The chunk table with all chunks of the changed sources replaced by the fresh ones; a source without fresh chunks is removed."""
    return chunks.join(changed.select(source).distinct(), source, "left_anti").unionByName(fresh.select(*chunks.columns))
