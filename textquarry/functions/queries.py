"""Query classification, routing and cost as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textquarry.functions.texts import count_of, n_words

# Substrings that mark simple and complex questions.
SIMPLE = ("where", "what", "which", "list", "show", "find", "is", "exists", "count", "get")
COMPLEX = ("compare", "versus", "vs", "design", "architect", "build", "tradeoff", "trade-off", "pros", "cons", "alternative", "refactor", "improve", "why", "explain why", "how would you")
# The second classifier's substrings.
DESIGN = ("design", "architect", "build", "create")
COMPARE = ("compare", "vs", "versus", "difference")
EXPLAIN = ("how", "explain", "work", "does", "why")
# Context-route patterns, first match wins.
FULL_CONTEXT = (
    r"(?i)(整個流程|entire flow|end.to.end|從頭到尾|all files|所有檔案|跨.*模組|across.*module|system.wide|全系統|"
    r"hardcode|hard.code|magic.number|hard.coded|寫死|硬編碼|audit|scan all|grep.*all|列出所有|找出所有|有多少)"
)
JUST_IN_TIME = (
    r"(?i)(怎麼實作|how.*implement|實作細節|implementation|邏輯|logic|怎麼寫的|how is .+ written|細節|detail|具體|specific|"
    r"幫我.*改|幫我.*加|幫我.*修|add|edit|modify|fix|change|implement|show me|讓我看|給我看|the code|程式碼)"
)
MAP_ONLY = (
    r"(?i)(影響|affect|depend|import|誰呼叫|who call|called by|uses|用到|架構|architecture|pattern|模式|禁止|forbidden|規範|convention|"
    r"side effect|有沒有副作用|critical|核心路徑|overview|概覽|what does .+ do|這個.*做什麼|purpose|用途)"
)
# What marks a request as an audit for literals, and as a review of a whole code base.
AUDIT = r"(?i)(hardcode|hard.code|magic.number|hard.coded|寫死|硬編碼|audit|grep|列出所有|找出所有|所有檔案|scan)"
REVIEW = r"(?i)(問題|有什麼問題|哪些問題|架構問題|code.quality|code.smell|improvement|what.*wrong|any.*issue|review|檢查|掃描)"
# What sends a chat request past its chosen mode, to direct reading of files.
DIRECT = (
    r"(?i)(hardcode|hard.code|magic.number|hard.coded|寫死|硬編碼|audit|scan all|列出所有|找出所有|有多少|grep|"
    r"問題|有什麼問題|哪些問題|架構問題|code.quality|code.smell|improvement|what.*wrong|any.*issue|review|檢查|掃描)"
)


def with_intent(df: DataFrame, query: str = "query", mode: str | None = None) -> DataFrame:
    """Adds is_audit, is_review and reads_all (either), and, where `mode` names a column, mode with direct for requests that have to read files."""
    q = F.coalesce(F.col(query), F.lit(""))
    rows = df.withColumns({"is_audit": q.rlike(AUDIT), "is_review": q.rlike(REVIEW)}).withColumn("reads_all", F.col("is_audit") | F.col("is_review"))
    return rows if mode is None else rows.withColumn(mode, F.when(q.rlike(DIRECT), F.lit("direct")).otherwise(F.col(mode)))


def hits(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words occur as substrings."""
    total = F.lit(0)
    for w in words:
        total = total + text.contains(w).cast("int")
    return total


def complexity_features(df: DataFrame, query: str = "query") -> DataFrame:
    """Adds sentences, clauses, words, simple_hits and complex_hits, the features behind `with_complexity`."""
    q = F.trim(F.lower(F.col(query)))
    return df.withColumns({"sentences": count_of(q, ".", "?"), "clauses": count_of(q, ",", ";"), "words": n_words(q), "simple_hits": hits(q, SIMPLE), "complex_hits": hits(q, COMPLEX)})


def with_complexity(df: DataFrame, query: str = "query") -> DataFrame:
    """Adds the features, complexity (simple, moderate, complex) and its confidence, at most 1."""
    f = complexity_features(df, query)
    many = (F.col("sentences") > 1) | (F.col("clauses") > 1)
    kind = F.when(F.col("complex_hits") > 0, "complex").when(many | (F.col("words") > 15), "moderate").otherwise("simple")
    sure = (
        F.when(F.col("complex_hits") > 0, 0.85 + 0.05 * F.col("complex_hits")).when(many, 0.80 + 0.05 * F.col("clauses")).when(F.col("words") > 15, F.lit(0.70)).otherwise(0.85 + 0.05 * F.col("simple_hits"))
    )
    return f.withColumn("complexity", kind).withColumn("confidence", F.least(F.lit(1.0), sure))


def answer_complexity(query: Column) -> Column:
    """The second classifier: design or comparison words, then "how" with an explaining word in more than four words."""
    q = F.lower(query)
    return F.when((hits(q, DESIGN) > 0) | (hits(q, COMPARE) > 0), "complex").when(q.contains("how") & (hits(q, EXPLAIN) > 0) & (n_words(query) > 4), "moderate").otherwise("simple")


def context_route(query: Column) -> Column:
    return F.when(query.rlike(FULL_CONTEXT), "FULL_CONTEXT").when(query.rlike(JUST_IN_TIME), "MAP_THEN_JIT").when(query.rlike(MAP_ONLY), "MAP_ONLY").otherwise("MAP_THEN_JIT")


def routed(classified: DataFrame, rules: DataFrame, models: DataFrame, query: str = "query") -> DataFrame:
    """Joins each classified query to its model: primary, fallbacks, cost and latency.

    `rules` has (complexity, primary, fallbacks ARRAY<STRING>), `models` (model, price_per_1k, latency_ms). The cost is that of the estimated
    tokens: a quarter of the query's characters, 50 at least, and 400 for the answer.
    """
    found = classified.join(rules, "complexity").join(models.withColumnRenamed("model", "primary"), "primary")
    spent = (F.greatest(F.lit(50), F.floor(F.length(query) / 4)) + 400) / 1000 * F.col("price_per_1k")
    return found.withColumn("fallbacks", F.filter("fallbacks", lambda m: m != F.col("primary"))).withColumn("estimated_cost", spent)


def fallback(fallbacks: Column, failed: Column) -> Column:
    """First listed model other than the one that failed, null if there is none."""
    return F.get(F.filter(fallbacks, lambda m: m != failed), F.lit(0))


def cost_by_words(query: Column, price_per_1k: Column, answer_tokens: int = 400) -> Column:
    """The other estimate of a query's cost: a token for each word and `answer_tokens` for the answer."""
    words = F.size(F.filter(F.split(query, r"\s+"), lambda w: w != ""))
    return (words + answer_tokens) / 1000 * price_per_1k


def degraded(failures: DataFrame, ladders: DataFrame, models: DataFrame, model: str = "model", reason: str = "reason") -> DataFrame:
    """Adds degraded, the model that takes over, and timeout_s, how long it may take: twice its latency, 30 seconds without a known one.

    `ladders` (reason, ladder ARRAY<STRING>) lists what is tried for each reason, with a row for the null reason that stands for those not
    listed; `models` (model, latency_ms, available) says what there is. The first available model of the ladder other than the one that failed takes over; none does
    for a model that isn't known. Both tables are small, one row for each reason and model, and are broadcast.
    """
    there = models.agg(F.collect_list(F.when(F.col("available"), F.col("model"))).alias("_there"), F.collect_list("model").alias("_known"), F.map_from_entries(F.collect_list(F.struct("model", "latency_ms"))).alias("_latency"))
    named = ladders.where(F.col("reason").isNotNull()).select(F.col("reason").alias("_reason"), F.col("ladder").alias("_ladder"))
    rest = ladders.where(F.col("reason").isNull()).agg(F.first("ladder").alias("_rest"))
    rows = failures.join(F.broadcast(named), F.col(reason) == F.col("_reason"), "left").join(F.broadcast(rest)).join(F.broadcast(there))
    able = F.filter(F.coalesce("_ladder", "_rest"), lambda m: F.array_contains("_there", m) & (m != F.col(model)))
    rows = rows.withColumn("degraded", F.when(F.array_contains("_known", F.col(model)), F.get(able, F.lit(0))))
    return rows.withColumn("timeout_s", F.coalesce(F.try_element_at("_latency", F.col("degraded")) * 2 / 1000, F.lit(30.0))).drop("_reason", "_ladder", "_rest", "_there", "_known", "_latency")


def feasibility(answer: Column) -> Column:
    """First `NN/100` or `NN%` in the text as a share, at most 1; null without one."""
    n = F.regexp_extract(answer, r"(\d{1,9})\s*(?:/\s*100|%)", 1)
    return F.when(n != "", F.least(F.lit(1.0), n.cast("double") / 100))
