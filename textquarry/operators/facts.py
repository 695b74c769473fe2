"""Facts of Python files by parsing, one parse to a file, in Arrow batches; symbols of scripts, import counts, completeness, change impact.

Every fact is a row of the long table (path, kind, name, parent, line_start, line_end, detail); a file that can't be parsed gives an error row.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

FACTS = "path string, kind string, name string, parent string, line_start int, line_end int, detail string"
_COLUMNS = ["path", "kind", "name", "parent", "line_start", "line_end", "detail"]
# Annotation names that are known without an import, and the generic containers.
KNOWN_TYPES = frozenset("int float str bool bytes bytearray complex object type None Any Optional Union Callable Iterable Iterator Sequence Mapping Literal Self".split())
GENERICS = frozenset("list dict set tuple frozenset List Dict Set Tuple FrozenSet Type Optional Union Callable Iterable Iterator Sequence Mapping Generator Awaitable AsyncIterator Literal".split())


def _annotation_names(node: ast.AST) -> Iterator[tuple[str, bool]]:
    """(name, whether it is subscripted) of every name in an annotation."""
    generic = {id(n.value) for n in ast.walk(node) if isinstance(n, ast.Subscript)}
    for n in ast.walk(node):
        if isinstance(n, ast.Name):
            yield n.id, id(n) in generic


def _statements(tree: ast.Module) -> list[ast.AST]:
    """All statements, with the handlers and cases that hold some, level by level; expressions hold none and are not visited."""
    found: list[ast.AST] = [tree]
    for n in found:
        for field in ("body", "handlers", "orelse", "finalbody", "cases"):
            found += getattr(n, field, ())
    return found[1:]


def _is_main(test: ast.expr) -> bool:
    return isinstance(test, ast.Compare) and ast.unparse(test) in ("__name__ == '__main__'", "'__main__' == __name__")


def python_rows(path: str, content: str, kinds: frozenset[str] | None = None) -> Iterator[tuple]:
    """Facts of one file; of some `kinds` alone, if given."""
    if kinds is not None:
        if kinds.isdisjoint(_OTHER_KINDS):
            yield from _python_rows_of(path, content, kinds)
        else:
            yield from (row for row in python_rows(path, content) if row[1] in kinds)
        return
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        yield path, "error", type(e).__name__, None, getattr(e, "lineno", None) or 1, None, f"E001 column {getattr(e, 'offset', None) or 0}"
        return
    statements = _statements(tree)
    methods = {id(f) for c in statements if isinstance(c, ast.ClassDef) for f in c.body if isinstance(f, ast.FunctionDef | ast.AsyncFunctionDef)}
    top = {id(n) for n in tree.body}
    known = KNOWN_TYPES | GENERICS | {n.name for n in statements if isinstance(n, ast.ClassDef)}
    imports, unknown = set(), set()
    for n in statements:
        if isinstance(n, ast.Import):
            imports |= {a.name for a in n.names}
            known |= {(a.asname or a.name).split(".")[0] for a in n.names}
        elif isinstance(n, ast.ImportFrom):
            imports.add("." * n.level + (n.module or ""))
            known |= {a.asname or a.name for a in n.names}
        elif isinstance(n, ast.ClassDef):
            yield path, "class", n.name, None, n.lineno, n.end_lineno, None
            for b in n.bases:
                yield path, "inherits", n.name, ast.unparse(b), n.lineno, None, None
        elif isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
            yield path, "function", n.name, None, n.lineno, n.end_lineno, None
        if isinstance(n, ast.If) and _is_main(n.test):
            yield path, "main", "__main__", None, n.lineno, None, None
        if isinstance(n, ast.ClassDef) and id(n) in top:
            yield path, "symbol", n.name, None, n.lineno, n.end_lineno, "class " + n.name
        if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef) and (id(n) in top or id(n) in methods):
            signature = f"{n.name}({', '.join(a.arg for a in n.args.args)})"
            yield path, "symbol", n.name, None, n.lineno, n.end_lineno, ("method " if id(n) in methods else "function ") + signature
    for m in sorted(imports):
        yield path, "import", m, None, None, None, None
    for n in statements:
        found = [a.annotation for a in ast.walk(n) if isinstance(a, ast.arg) and a.annotation] + ([n.returns] if n.returns else []) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef) else [n.annotation] if isinstance(n, ast.AnnAssign) else []
        for annotation in found:
            for name, generic in _annotation_names(annotation):
                if name in known:
                    continue
                if generic:
                    yield path, "issue", name, None, annotation.lineno, None, "W002 unknown-generic"
                elif name not in unknown:
                    unknown.add(name)
                    yield path, "issue", name, None, annotation.lineno, None, "W001 unknown-name"


# A word that a file has if it has a fact of the kind.
_WORDS = {"import": "import", "class": "class", "inherits": "class", "function": "def"}
_OTHER_KINDS = frozenset(("error", "main", "symbol", "issue"))


def _python_rows_of(path: str, content: str, kinds: frozenset[str]) -> Iterator[tuple]:
    """Facts of those `kinds` that are in _WORDS; none of a file that can't be parsed. A file without any of their words needs no parse."""
    if not any(word in content for kind, word in _WORDS.items() if kind in kinds):
        return
    try:
        statements = _statements(ast.parse(content))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    imports = set()
    for n in statements:
        if isinstance(n, ast.Import):
            imports |= {a.name for a in n.names}
        elif isinstance(n, ast.ImportFrom):
            imports.add("." * n.level + (n.module or ""))
        elif isinstance(n, ast.ClassDef):
            if "class" in kinds:
                yield path, "class", n.name, None, n.lineno, n.end_lineno, None
            if "inherits" in kinds:
                for b in n.bases:
                    yield path, "inherits", n.name, b.id if isinstance(b, ast.Name) else ast.unparse(b), n.lineno, None, None
        elif "function" in kinds and isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
            yield path, "function", n.name, None, n.lineno, n.end_lineno, None
    if "import" in kinds:
        for m in sorted(imports):
            yield path, "import", m, None, None, None, None


def frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    """Rows as columns of Python's own values, which go to Arrow as they are."""
    return pd.DataFrame({c: pd.Series(list(v), dtype=object) for c, v in zip(columns, zip(*rows), strict=True)} if rows else {c: pd.Series([], dtype=object) for c in columns})


def python_facts(corpus: DataFrame) -> DataFrame:
    """Facts of the Python files of `corpus` (path, content)."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for p, c in zip(batch["path"], batch["content"], strict=True) for r in python_rows(p, c or "")]
            yield frame(rows, _COLUMNS)

    return corpus.where(F.lower("path").endswith(".py")).select("path", "content").mapInPandas(part, FACTS)


def extract_distinct(text: Column, regex: str, group: int = 1) -> Column:
    """What a group of the expression holds in each of its matches, each text once, in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(regex), F.lit(group)))


# What counts as an import in each language read by regular expressions.
IMPORTS = {
    "java": r"(?m)^[^\S\n]*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;",
    "js": r"""(?:import\s+(?:[^'";]*?\s+from\s+)?|require\s*\(\s*|import\s*\(\s*)['"]([^'"]+)['"]""",
    "cpp": r"""(?m)^[^\S\n]*#[^\S\n]*include[^\S\n]*[<"]([^>"]+)[>"]""",
    "html": r"""(?i)<(?:script[^>]*\bsrc|link[^>]*\bhref)\s*=\s*["']([^"']+)["']""",
}

def script_symbols(lines: DataFrame) -> DataFrame:
    """(path, name, type, line, signature): the first of four kinds that a line of a script declares."""
    kinds = [
        ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"), ("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"),
        ("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>"), ("type", r"^\s*(?:export\s+)?(?:interface|type|enum)\s+(\w+)"),
    ]
    tried = [F.when(F.col("line").rlike(r), F.struct(F.lit(k).alias("type"), F.regexp_extract("line", r, 1).alias("name"))) for k, r in kinds]
    rows = lines.withColumn("s", F.coalesce(*tried)).where("s is not null")
    return rows.select("path", "s.name", "s.type", F.col("line_no").alias("line"), F.substring(F.trim("line"), 1, 100).alias("signature"))


def python_symbols(corpus: DataFrame) -> DataFrame:
    """(path, name, type, line_start, line_end, signature) of top-level functions and classes and of methods."""
    s = python_facts(corpus).where("kind = 'symbol'")
    return s.select("path", "name", F.regexp_extract("detail", r"^(\w+)", 1).alias("type"), "line_start", "line_end", F.regexp_replace("detail", r"^\w+ ", "").alias("signature"))


def lint_imports(corpus: DataFrame) -> DataFrame:
    """(path, imports): names after `from` or `import` at line starts and quoted modules of scripts, distinct."""
    python = F.regexp_extract_all("content", F.lit(r"(?m)^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))"), F.lit(1))
    plain = F.regexp_extract_all("content", F.lit(r"(?m)^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))"), F.lit(2))
    scripts = F.regexp_extract_all("content", F.lit(IMPORTS["js"]), F.lit(1))
    return corpus.select("path", F.array_distinct(F.filter(F.concat(python, plain, scripts), lambda m: m != "")).alias("imports"))


def import_count(content: Column, most: int = 4096) -> Column:
    """Lines among the first characters that begin like imports or hold a require call."""
    lines = F.split(F.substring(content, 1, most), "\n")
    return F.size(F.filter(lines, lambda s: F.ltrim(s).rlike(r"^(import |from |use )") | s.contains("require(")))


def import_frequency(found: DataFrame) -> DataFrame:
    """(name, n_files): files that import each top-level module; a header counts whole, script modules up to `/`, others up to `.`."""
    path = F.lower("path")
    name = F.when(path.rlike(r"\.(c|cc|cpp|h|hpp)$"), F.col("module")).when(path.rlike(r"\.(js|jsx|ts|tsx)$"), F.get(F.split("module", "/"), F.lit(0))).otherwise(F.get(F.split("module", r"\."), F.lit(0)))
    return found.select("path", name.alias("name")).where("name <> ''").groupBy("name").agg(F.count_distinct("path").alias("n_files"))


def completeness(facts: DataFrame) -> DataFrame:
    """One row per file: has_imports, has_definitions, has_entry, n_errors, n_imports, most_parents (of one class)."""
    parents = facts.where("kind = 'inherits'").groupBy("path", "name").agg(F.count("*").alias("p")).groupBy("path").agg(F.max("p").alias("most_parents"))
    k = F.col("kind")
    rows = facts.groupBy("path").agg(
        F.bool_or(k == "import").alias("has_imports"), F.bool_or(k.isin("class", "function")).alias("has_definitions"), F.bool_or(k == "main").alias("has_entry"), F.count_if(k == "error").alias("n_errors"),
        F.count_if(k == "import").alias("n_imports"),
    )
    return rows.join(parents, "path", "left").withColumn("most_parents", F.coalesce("most_parents", F.lit(0)))


def change_impact(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, n_added, n_removed, breaking): functions by name between two versions of the corpus; a removed one breaks callers."""
    names = lambda c, tag: python_facts(c).where("kind = 'function'").select("path", "name").distinct().withColumn(tag, F.lit(1))
    rows = names(old, "o").join(names(new, "n"), ["path", "name"], "full_outer").groupBy("path")
    return rows.agg(F.count_if(F.col("o").isNull()).alias("n_added"), F.count_if(F.col("n").isNull()).alias("n_removed")).withColumn("breaking", F.col("n_removed") > 0)


def first_symbols(symbols: DataFrame, names: DataFrame, keep: int = 2) -> DataFrame:
    """Up to `keep` symbols of each (query_id, path) whose name the query names; `names` has (query_id, path, name)."""
    w = Window.partitionBy("query_id", "path").orderBy("line_start", "name")
    return symbols.join(names, ["path", "name"]).withColumn("k", F.row_number().over(w)).where(F.col("k") <= keep).drop("k")
