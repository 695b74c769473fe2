"""All code facts of a packed corpus in one read: each file is parsed or scanned by its language, and comments and strings are never taken for code.

Python files are parsed. Other files are masked first: comments become white space and the insides of strings a filler, both of the same length, so
that a pattern's place in the masked text is its place in the file and a module's name can be read from the original. Regular-expression literals
of scripts are not told from divisions.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from textquarry.operators.facts import IMPORTS, frame, python_rows

SCAN = "path string, language string, kind string, name string, parent string, line_start int, line_end int, detail string"
_COLUMNS = ["path", "language", "kind", "name", "parent", "line_start", "line_end", "detail"]
EXTENSIONS = {"python": ("py",), "java": ("java",), "js": ("js", "jsx", "ts", "tsx"), "cpp": ("c", "cc", "cpp", "h", "hpp"), "html": ("html", "htm"), "sql": ("sql",)}

_SLASHES = r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))"
_QUOTED = r""""(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'"""
_SKIPPED = {
    "java": re.compile(rf'{_SLASHES}|(?P<string>"""(?:\\.|[^\\])*?"""|{_QUOTED})', re.S),
    "js": re.compile(rf"{_SLASHES}|(?P<string>{_QUOTED}|`(?:\\.|[^`\\])*`)", re.S),
    "cpp": re.compile(rf"""{_SLASHES}|(?P<string>R"(?P<tag>[^\s()\\]{{0,16}})\(.*?\)(?P=tag)"|{_QUOTED})""", re.S),
    "sql": re.compile(r"(?P<comment>--[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>'(?:''|[^'])*')", re.S),
    "html": re.compile(r"(?P<comment><!--.*?(?:-->|\Z))|(?P<string>(?!))", re.S),
}
# What counts as a class or function in each language read by regular expressions. White space before a line's first word stays in its
# line, so that a run of blank lines is read once.
_CLASSES = {
    "java": r"\b(?:class|interface|enum)\s+(\w+)",
    "js": r"\bclass\s+(\w+)",
    "cpp": r"\b(?:class|struct)\s+(\w+)\s*[:{]",
    "sql": r"(?i)\bcreate\s+(?:or\s+replace\s+)?(?:table|view)\s+(?:if\s+not\s+exists\s+)?([\w.\"`]+)",
    "html": r"(?i)<([a-z][a-z0-9-]*)\b",
}
_FUNCTIONS = {
    "java": r"(?m)^[^\S\n]*(?:public|private|protected)\s+(?:static\s+)?[\w<>\[\]]+\s+(\w+)\s*\(",
    "js": r"\bfunction\s+(\w+)\s*\(|\b(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>",
    "cpp": r"(?<!\w)(\w+)\s*\([^;{}]*\)\s*(?:const\s*)?\{",
}
_NOT_FUNCTIONS = frozenset(("if", "for", "while", "switch", "return", "catch", "else"))
_BEFORE_CPP = re.compile(r"[\w:*&<>\s]*")
#: Languages that have facts of a kind, where not all have.
_LANGUAGES = {"import": {"python", "java", "js", "cpp", "html"}, "inherits": {"python", "java"}, "function": {"python", "java", "js", "cpp"}, "component": {"js"}, "table": {"sql"}, "tag": {"html"}}
#: Kinds of fact that a language's class pattern gives.
_CLASS_KIND = {"sql": "table", "html": "tag"}
_EXTENDS = r"\bclass\s+(\w+)(?:<[^>]*>)?\s+extends\s+([\w.]+)"


def masked(text: str, language: str) -> str:
    """`text` with comments as white space and the insides of strings as U+0000, line ends kept."""

    def blank(m: re.Match) -> str:
        found = m.group()
        if m.group("comment") is not None:
            return re.sub(r"[^\n]", " ", found) if "\n" in found else " " * len(found)
        return found[0] + (re.sub(r"[^\n]", "\0", found[1:-1]) if "\n" in found else "\0" * (len(found) - 2)) + found[-1]

    return _SKIPPED[language].sub(blank, text)


def _scanned(text: str, language: str, modules: str | None, kinds: frozenset[str] | None = None) -> Iterator[tuple[str, str, str | None, int]]:
    """(kind, name, parent, place) of a file that is not Python, each kind and name at its first place; of some kinds alone, if given."""
    code = masked(text, language)
    wanted = lambda *some: kinds is None or not kinds.isdisjoint(some)
    if modules and wanted("import"):
        for m in re.finditer(modules, code):
            yield "import", text[slice(*m.span(1))], None, m.start(1)
    named = _CLASS_KIND.get(language, "class")
    for m in re.finditer(_CLASSES[language], code) if wanted(named) else ():
        yield named, m.group(1), None, m.start(1)
    for m in re.finditer(_FUNCTIONS[language], code) if language in _FUNCTIONS and wanted("function", "component") else ():
        g = m.lastindex
        name = m.group(g)
        if name in _NOT_FUNCTIONS or (language == "cpp" and not _BEFORE_CPP.fullmatch(code, code.rfind("\n", 0, m.start()) + 1, m.start())):
            continue
        kind = "component" if language == "js" and "A" <= name[0] <= "Z" else "function"
        if wanted(kind):
            yield kind, name, None, m.start(g)
    if language == "java" and wanted("inherits"):
        for m in re.finditer(_EXTENDS, code):
            yield "inherits", m.group(1), m.group(2), m.start(1)


def scan(corpus: DataFrame, patterns: dict[str, str] | None = None, kinds: Iterable[str] | None = None) -> DataFrame:
    """(path, language, kind, name, parent, line_start, line_end, detail): all facts of `corpus` (path, content) in one read.

    Kinds: import, class, function, component, table, tag, inherits; of Python also symbol, main, issue and error. Outside Python each kind, name
    and parent comes once, at its first line. `patterns` replaces import patterns by language. Null and empty files and unknown endings have none.
    Of some `kinds` alone, if given: only files of languages that have them are read, and nothing else is looked for in these.
    """
    kinds = None if kinds is None else frozenset(kinds)
    found = {**IMPORTS, **(patterns or {})}
    able = lambda language: kinds is None or any(language in _LANGUAGES.get(k, EXTENSIONS) for k in kinds)
    by_ending = {e: language for language, endings in EXTENSIONS.items() for e in endings if able(language) or (kinds and patterns and language in patterns and "import" in kinds)}

    def rows_of(path: str, text: str) -> Iterator[tuple]:
        language = by_ending.get(path.rsplit(".", 1)[-1].lower())
        if language == "python":
            for p, *fact in python_rows(path, text, kinds):
                yield p, language, *fact
        elif language:
            ends = [m.start() for m in re.finditer("\n", text)]
            first: dict[tuple, int] = {}
            for kind, name, parent, place in _scanned(text, language, found.get(language), kinds):
                first.setdefault((kind, name, parent), place)
            for (kind, name, parent), place in first.items():
                yield path, language, kind, name, parent, bisect_left(ends, place) + 1, None, None

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for p, c in zip(batch["path"], batch["content"], strict=True) if p and c for r in rows_of(p, c)]
            yield frame(rows, _COLUMNS)

    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return corpus.where(ending.isin(*by_ending)).select("path", "content").mapInPandas(part, SCAN)


DEFINED = ("class", "table", "tag", "component", "function")


def imports(facts: DataFrame) -> DataFrame:
    """(path, module) of scanned facts, distinct in each file."""
    return facts.where("kind = 'import'").select("path", F.col("name").alias("module"))


def definitions(facts: DataFrame) -> DataFrame:
    """(path, kind, name): classes, tables, tags, components and functions, distinct in each file."""
    return facts.where(F.col("kind").isin(*DEFINED)).select("path", "kind", "name").distinct()


def inheritance(facts: DataFrame) -> DataFrame:
    """(path, class, parent) of Python and Java classes."""
    return facts.where("kind = 'inherits'").select("path", F.col("name").alias("class"), "parent")
