"""Line rules over texts: evidence, confidence, patterns per file and per corpus, robustness."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Rule:
    """A regular expression for single lines of some languages (all if empty); `after` more lines go into the snippet."""

    pattern: str
    rule_id: str
    regex: str
    weight: float
    languages: tuple[str, ...] = ()
    category: str = "other"
    after: int = 0
    at_least: int = 1  # hits in a file below which none counts; of a rule with more than 1, only the first at_least hits count
    ignore_case: bool = True


def _flagged(r: Rule) -> str:
    return ("(?iU)" if r.ignore_case else "(?U)") + r.regex


def _best(choices: list[frozenset[str] | None]) -> frozenset[str] | None:
    """Of sets of which one string each must be there, the one whose shortest string is longest."""
    return max((c for c in choices if c), key=lambda c: (min(map(len, c)), -len(c)), default=None)


def _required(parsed: object) -> frozenset[str] | None:
    """Strings of which every match of a parsed expression has at least one, in lower case; None if there are none."""
    sets, run = [], ""
    for op, value in parsed:
        name = str(op)
        if name == "LITERAL" and value < 128:
            run += chr(value).lower()
            continue
        sets.append(frozenset({run}) if run else None)
        run = ""
        if name == "SUBPATTERN":
            sets.append(_required(value[3]))
        elif name == "BRANCH":
            each = [_required(b) for b in value[1]]
            sets.append(frozenset().union(*each) if all(each) else None)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
            sets.append(_required(value[2]))
    sets.append(frozenset({run}) if run else None)
    return _best(sets)


def required_literals(regex: str) -> frozenset[str] | None:
    """ASCII strings, in lower case, of which a text has at least one wherever the expression matches; None where nothing is sure."""
    try:
        parsed = re._parser.parse(regex)
    except re.error:  # an expression of Java's own kind
        return None
    return _required(parsed)


#: Characters that case-insensitive expressions take for ASCII letters, and those.
_ALIKE = ("\u017f\u0131\u0130\u212a", "siik")


def folded(line: Column) -> Column:
    return F.lower(F.translate(line, *_ALIKE))


def _has_literal(rule: Rule, low: Column) -> Column | None:
    found = None
    for w in sorted(required_literals(rule.regex) or ()):
        found = low.contains(w) if found is None else found | low.contains(w)
    return found


def _gate(rule: Rule, low: Column, language: str | None) -> Column:
    """Whether a rule is for the language, and a `folded` text has a string that it requires."""
    literal = _has_literal(rule, low)
    own = F.col(language).isin(*rule.languages) if rule.languages and language else None
    return F.lit(True) if own is None and literal is None else literal if own is None else own if literal is None else own & literal


def regex_evaluations(texts: DataFrame, rules: list[Rule], text: str = "content", language: str | None = "language") -> DataFrame:
    """One row (gated, all): expressions evaluated on the lines of the texts with and without the literals that gate them."""
    lines = texts.select(*([language] if language else []), F.explode(F.split(F.regexp_replace(F.col(text), r"\r?\n\z", ""), r"\r?\n")).alias("line")).withColumn("low", folded(F.col("line")))
    gated, every = F.lit(0), F.lit(0)
    for r in rules:
        own = F.col(language).isin(*r.languages) if r.languages and language else F.lit(True)
        every = every + own.cast("int")
        gated = gated + _gate(r, F.col("low"), language).cast("int")
    return lines.select(gated.alias("g"), every.alias("e")).agg(F.coalesce(F.sum("g"), F.lit(0)).alias("gated"), F.coalesce(F.sum("e"), F.lit(0)).alias("all"))


#: Lines of a text that meet the rules together.
BLOCK = 256


def line_evidence(texts: DataFrame, rules: list[Rule], key: str = "path", text: str = "content", language: str | None = "language", carried: tuple[str, ...] = ()) -> DataFrame:
    """(key, pattern, rule_id, start_line, end_line, snippet, weight): one row for each line that a rule finds, with the `carried` columns.

    Rules are literal columns, so each is compiled once and a text is split once, in one pass without a shuffle. A block of lines meets only the rules
    of its language of which it has a required string, and a rule then only the lines that have it. Snippets are trimmed and cut to 250 characters
    (300 with following lines). Rules that count hits in a file get a pass of their own, over the texts that they can find, and a window.
    """
    plain, counted = [r for r in rules if r.at_least == 1], [r for r in rules if r.at_least > 1]
    if not counted:
        return _line_hits(texts, rules, key, text, language, carried)
    any_of = F.lit(False)
    for r in counted:
        any_of = any_of | _gate(r, F.col("low"), language)
    some = texts.withColumn("low", folded(F.col(text))).where(any_of).drop("low")
    least = F.element_at(F.create_map(*[F.lit(x) for r in counted for x in (r.rule_id, r.at_least)]), F.col("rule_id"))
    w = Window.partitionBy(key, "rule_id")
    rows = _line_hits(some, counted, key, text, language, carried).withColumn("n", F.count("*").over(w)).withColumn("k", F.row_number().over(w.orderBy("start_line")))
    few = rows.where((F.col("n") >= least) & (F.col("k") <= least)).drop("n", "k")
    return _line_hits(texts, plain, key, text, language, carried).unionByName(few) if plain else few


def _line_hits(texts: DataFrame, rules: list[Rule], key: str, text: str, language: str | None, carried: tuple[str, ...]) -> DataFrame:
    kinds = [*([language] if language else []), *carried]
    most = max((r.after for r in rules), default=0)
    texts = texts.select(key, *kinds, F.split(F.regexp_replace(F.col(text), r"\r?\n\z", ""), r"\r?\n").alias("all_lines")).where("all_lines is not null")
    # a block takes the few lines that follow it along, never the whole text; `explode` would first filter by whether the array is empty, and so work
    # it out twice
    block = lambda at: F.struct(at.alias("at"), F.slice("all_lines", at + 1, F.lit(BLOCK + most)).alias("near"))
    starts = F.sequence(F.lit(0), F.size("all_lines") - 1, F.lit(BLOCK))
    blocks = texts.select(key, *kinds, F.size("all_lines").alias("n_lines"), F.explode_outer(F.transform(starts, block)).alias("b")).select(key, *kinds, "n_lines", "b.*")
    numbered = F.transform(F.slice("near", 1, BLOCK), lambda x, i: F.struct(i.alias("i"), x.alias("line"), folded(x).alias("low")))
    blocks = blocks.select(key, *kinds, "n_lines", "at", folded(F.array_join(F.slice("near", 1, BLOCK), "\n")).alias("low"), numbered.alias("lines"), *(["near"] if most else []))

    def hits(k: int, r: Rule) -> Column:
        def found(x: Column) -> Column:
            literal, regex = _has_literal(r, x["low"]), x["line"].rlike(_flagged(r))
            return regex if literal is None else literal & regex

        def hit(x: Column) -> Column:
            snippet = F.array_join(F.slice("near", x["i"] + 1, F.lit(r.after + 1)), "\n") if r.after else x["line"]
            return F.struct(F.lit(k).alias("k"), x["i"].alias("i"), F.substring(F.trim(snippet), 1, 300 if r.after else 250).alias("snippet"))

        return F.when(_gate(r, F.col("low"), language), F.transform(F.filter("lines", found), hit))

    of_rules = F.flatten(F.filter(F.array(*[hits(k, r) for k, r in enumerate(rules)]), lambda h: h.isNotNull()))
    rows = blocks.select(key, *kinds, "n_lines", "at", of_rules.alias("hits")).select(key, *kinds, "n_lines", "at", F.explode_outer("hits").alias("h")).where("h is not null")
    rule = F.get(F.array(*[F.struct(F.lit(r.pattern).alias("pattern"), F.lit(r.rule_id).alias("rule_id"), F.lit(r.after).alias("after"), F.lit(float(r.weight)).alias("weight")) for r in rules]), F.col("h.k"))
    start = F.col("at") + F.col("h.i") + 1
    return rows.select(key, *kinds, rule["pattern"].alias("pattern"), rule["rule_id"].alias("rule_id"), start.alias("start_line"), F.least(start + rule["after"], F.col("n_lines")).alias("end_line"), "h.snippet", rule["weight"].alias("weight"))


@dataclass(frozen=True)
class PathRule:
    """Words in the base name, or folders on the path, that are evidence; the first that is found counts."""

    pattern: str
    weight: float
    names: tuple[str, ...] = ()
    folders: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()


def path_evidence(files: DataFrame, rules: list[PathRule], key: str = "path", language: str | None = "language", carried: tuple[str, ...] = ()) -> DataFrame:
    """Evidence rows, one for each row of `files` and path rule that holds, with the `carried` columns. Paths need not be unique."""
    path = F.lower(F.col(key))
    name = F.element_at(F.split(path, "/"), -1)
    kinds = [*([language] if language else []), *carried]

    def hit(r: PathRule) -> Column:
        found = F.lit(False)
        for n in r.names:
            found = found | name.contains(n)
        for f in r.folders:
            found = found | path.contains(f"/{f}/")
        if r.languages and language:
            found = found & F.col(language).isin(*r.languages)
        snippet = F.element_at(F.split(F.col(key), "/"), -1) if r.names else F.col(key)
        return F.when(found, F.struct(F.lit(r.pattern).alias("pattern"), F.lit("path").alias("rule_id"), snippet.alias("snippet"), F.lit(float(r.weight)).alias("weight")))

    found = files.select(key, *kinds, F.explode(F.filter(F.array(*[hit(r) for r in rules]), lambda h: h.isNotNull())).alias("h"))
    return found.select(key, *kinds, "h.pattern", "h.rule_id", F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), "h.snippet", "h.weight")


def confidence(n: Column) -> Column:
    """0 for none, 0.65 for one item, 0.80 for two or three, then 0.03 more for each beyond three, at most 0.95."""
    return F.when(n <= 0, F.lit(0.0)).when(n == 1, F.lit(0.65)).when(n <= 3, F.lit(0.80)).otherwise(F.least(F.lit(0.95), 0.80 + 0.03 * (n - 3)))


def evidence_quality(n: Column) -> Column:
    return F.when(n <= 0, "none").when(n == 1, "weak").when(n <= 3, "moderate").otherwise("strong")


def confidence_level(value: Column) -> Column:
    return F.when(value < 0.2, "very_low").when(value < 0.4, "low").when(value < 0.6, "medium").when(value < 0.8, "high").otherwise("very_high")


def deduplicated(evidence: DataFrame, key: str = "path") -> DataFrame:
    """Evidence without blank snippets and weights of 0 or less; of items with the same file, line and first 80 characters the heaviest stays."""
    w = Window.partitionBy(key, "start_line", F.substring("snippet", 1, 80)).orderBy(F.desc("weight"), "pattern", "rule_id")
    rows = evidence.where((F.trim("snippet") != "") & (F.col("weight") > 0))
    return rows.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def patterns_by_file(evidence: DataFrame, key: str = "path", threshold: float = 0.60) -> DataFrame:
    """(key, pattern, n, value, quality) with value at least the threshold."""
    rows = evidence.groupBy(key, "pattern").agg(F.count("*").alias("n"))
    return rows.withColumns({"value": confidence(F.col("n")), "quality": evidence_quality(F.col("n"))}).where(F.col("value") >= threshold)


def patterns_by_project(evidence: DataFrame, group: list[str], key: str = "path", language: str | None = None) -> DataFrame:
    """(group, pattern, n, n_files, n_strong, n_weak, has_strong, single_weight, value, quality): all of a pattern's evidence in a project.

    Strong evidence weighs 0.80 or more, has_strong says whether any weighs 0.85. The language is that of the smallest path.
    """
    aggregates = [
        F.count("*").alias("n"), F.count_distinct(key).alias("n_files"), F.count_if(F.col("weight") >= 0.80).alias("n_strong"), F.count_if(F.col("weight") < 0.80).alias("n_weak"),
        F.bool_or(F.col("weight") >= 0.85).alias("has_strong"), F.max("weight").alias("top_weight"),
    ]
    if language:
        aggregates.append(F.min_by(language, key).alias("language"))
    rows = evidence.groupBy(*group, "pattern").agg(*aggregates)
    return rows.withColumns({"value": confidence(F.col("n")), "quality": evidence_quality(F.col("n"))})


NEEDS_TWO = ("ErrorHandling", "Concurrency", "DependencyInjection")
NEEDS_TWO_STRONG = ("html", "sql")


def robust(patterns: DataFrame, language: str | None = "language") -> DataFrame:
    """Patterns that hold up: some names need two items, some languages two strong ones, and a single item has to weigh 0.70."""
    fine = ~F.col("pattern").isin(*NEEDS_TWO) | (F.col("n") >= 2)
    fine = fine & ((F.col("n") > 1) | (F.col("top_weight") >= 0.70))
    if language:
        fine = fine & (~F.col(language).isin(*NEEDS_TWO_STRONG) | (F.col("n_strong") >= 2))
    return patterns.where(fine)


def summary(patterns: DataFrame, categories: dict[str, str]) -> DataFrame:
    """(category, n, n_high, n_medium): high is a value of 0.85 or more."""
    category = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in categories.items() for x in pair]), F.col("pattern")), F.lit("other"))
    return patterns.groupBy(category.alias("category")).agg(F.count("*").alias("n"), F.count_if(F.col("value") >= 0.85).alias("n_high"), F.count_if(F.col("value") < 0.85).alias("n_medium"))


def found_lines(lines: DataFrame, regex: str, globs: tuple[str, ...] = (), limit: int = 50, key: str = "path") -> DataFrame:
    """(key, line_no, line, total): the first `limit` lines that match, in order, trailing white space cut, and how many match in all."""
    from textquarry.functions.paths import matches_glob

    rows = lines.where(F.col("line").rlike(f"(?U){regex}"))
    if globs:
        rows = rows.where(matches_glob(F.col(key), *globs))
    total = rows.agg(F.count("*").alias("total"))
    return rows.select(key, "line_no", F.rtrim("line").alias("line")).orderBy(key, "line_no").limit(limit).join(total)


def style_issues(lines: DataFrame, most: int = 120, key: str = "path") -> DataFrame:
    """(key, line_no, code, name): W002 for lines longer than `most`, W003 for trailing white space."""
    codes = F.array(F.when(F.length("line") > most, F.struct(F.lit("W002").alias("code"), F.lit("line-too-long").alias("name"))), F.when(F.col("line").rlike(r"\s+$"), F.struct(F.lit("W003").alias("code"), F.lit("trailing-space").alias("name"))))
    return lines.select(key, "line_no", F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("c")).select(key, "line_no", "c.code", "c.name")
