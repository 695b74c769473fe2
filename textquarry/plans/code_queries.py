"""Queries of the code-fact operators over packed corpora: source files for the events, in one to six languages."""

from __future__ import annotations

from pyspark.sql import functions as F

from textquarry.functions import paths
from textquarry.operators import code_scan, facts, rules
from textquarry.operators.pattern_rules import RULES
from textquarry.plans.catalog import query

_FILES = """f AS (SELECT event_id AS i, user_id % 50 AS m, user_id % 5 AS b, user_id % 3 = 0 AS entry, event_id % 4 AS k,
  'src/' || event_type || '/f' || event_id || CASE event_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.java' WHEN 2 THEN '.js' ELSE '.cpp' END AS path FROM events WHERE user_id IS NOT NULL)"""


def _corpus(t):
    """(path, content) of the files."""
    e = t("events").where("user_id is not null")
    i, m, b = (c.cast("string") for c in (F.col("event_id"), F.col("user_id") % 50, F.col("user_id") % 5))
    entry = F.when(F.col("user_id") % 3 == 0, "if __name__ == '__main__':\n    pass\n").otherwise("")
    k = F.col("event_id") % 4
    content = (
        F.when(k == 0, F.concat(F.lit("import mod_"), m, F.lit("\n\n\nclass C"), i, F.lit("(Base"), b, F.lit("):\n    pass\n\n\ndef f"), i, F.lit("():\n    return 1\n\n\n"), entry))
        .when(k == 1, F.concat(F.lit("import java.m"), m, F.lit(".X;\npublic class C"), i, F.lit(" extends Base"), b, F.lit(" {\n  public static void run() {}\n}\n")))
        .when(k == 2, F.concat(F.lit("import x from 'lib"), m, F.lit("/core';\nclass C"), i, F.lit(" {}\nfunction f"), i, F.lit("() {}\n")))
        .otherwise(F.concat(F.lit("#include <h"), m, F.lit(".h>\nint main() {\n}\n")))
    )
    ending = F.when(k == 0, ".py").when(k == 1, ".java").when(k == 2, ".js").otherwise(".cpp")
    return e.select(F.concat(F.lit("src/"), "event_type", F.lit("/f"), i, ending).alias("path"), content.alias("content"))


_MODULE = "CASE k WHEN 0 THEN 'mod_' || m WHEN 1 THEN 'java.m' || m || '.X' WHEN 2 THEN 'lib' || m || '/core' ELSE 'h' || m || '.h' END"


@query(f"WITH {_FILES} SELECT path, {_MODULE} AS module FROM f")
def code_imports(t):
    """What each file imports, by its language's rules."""
    return code_scan.imports(code_scan.scan(_corpus(t), kinds=("import",)))


@query(f"WITH {_FILES} SELECT CASE k WHEN 0 THEN 'mod_' || m WHEN 1 THEN 'java' WHEN 2 THEN 'lib' || m ELSE 'h' || m || '.h' END AS name, count(DISTINCT path) AS n_files FROM f GROUP BY ALL")
def import_frequency(t):
    """How many files import each top-level module."""
    return facts.import_frequency(code_scan.imports(code_scan.scan(_corpus(t), kinds=("import",))))


@query(
    f"""WITH {_FILES}
SELECT path, 'class' AS kind, 'C' || i AS name FROM f WHERE k < 3 UNION ALL SELECT path, 'function', CASE k WHEN 1 THEN 'run' WHEN 3 THEN 'main' ELSE 'f' || i END FROM f"""
)
def code_definitions(t):
    """Classes and functions of each file."""
    return code_scan.definitions(code_scan.scan(_corpus(t), kinds=code_scan.DEFINED))


@query(f"WITH {_FILES} SELECT path, 'C' || i AS class, 'Base' || b AS parent FROM f WHERE k < 2")
def code_inheritance(t):
    """Classes and what they extend."""
    return code_scan.inheritance(code_scan.scan(_corpus(t), kinds=("inherits",)))


@query(f"WITH {_FILES} SELECT path, CASE WHEN k = 3 THEN 0 ELSE 1 END::INTEGER AS n_imports FROM f")
def import_counts(t):
    """Lines that begin like imports."""
    return _corpus(t).select("path", facts.import_count(F.col("content")).alias("n_imports"))


@query(f"WITH {_FILES} SELECT path, true AS has_imports, true AS has_definitions, entry AS has_entry, 0::BIGINT AS n_errors, 1::BIGINT AS n_imports, 1::BIGINT AS most_parents FROM f WHERE k = 0")
def file_completeness(t):
    """What the parser found in each Python file."""
    return facts.completeness(facts.python_facts(_corpus(t)))


@query(f"WITH {_FILES} SELECT path, (k = 0 AND entry) OR k = 3 AS is_entry FROM f")
def entry_points(t):
    """Whether each file is an entry point."""
    return _corpus(t).select("path", paths.is_entry_point(F.col("path"), F.col("content")).alias("is_entry"))


@query(
    f"""WITH {_FILES}, old AS (SELECT path, 'f' || i AS name FROM f WHERE k = 0), new AS (SELECT path, CASE WHEN entry THEN name ELSE 'g' || i END AS name FROM old JOIN f USING (path))
SELECT path, count(*) FILTER (NOT kept) AS n_added, count(*) FILTER (NOT kept) AS n_removed, bool_or(NOT kept) AS breaking FROM (SELECT o.path, o.name = n.name AS kept FROM old o JOIN new n ON n.path = o.path) GROUP BY path"""
)
def function_changes(t):
    """Functions that a second version of the corpus renames where a file is no entry point."""
    old = _corpus(t)
    renamed = F.when(F.col("content").contains("__main__"), F.col("content")).otherwise(F.regexp_replace("content", r"def f(\d+)", "def g$1"))
    return facts.change_impact(old, old.withColumn("content", renamed))


# Lines of source code that the rules of the catalogue are to find, or nearly.
_LINES = (
    "def __new__(cls):", "    _instance = None", "def get_instance(self):", "private static Thing one;", "class ShapeFactory(Base):", "def create_shape(kind):", "@functools.wraps(func)", "    return wrapper",
    "def wrapper(*args):", "self.listeners = []", "def subscribe(self, f):", "def notify(self):", "class Strategy(ABC):", "self.state = State()", "class UserRepository:", "class LogMiddleware:",
    "try:", "except ValueError as e:", "raise RuntimeError(1)", "async def run():", "await thing", "import threading", "def __init__(self, service):", "class UserController:",
    "@Override", "public static Shape createShape() {", "addEventListener('x', f)", "catch (Exception e) {", "throw new Error(1);", "self.a = A()", "self.b = B()", "self.c = C()",
    "x = 1", "# a comment of nothing", "return x + y", "for i in range(3):", "while (true) { }", "int main() {", "print('hello')", "let z = q;", "SELFISH = instances", "factory of dreams", "value = wrapped", "",
)
_KINDS = ("python", "java", "cpp", "javascript", "typescript")
_PICKED = 12


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_CATALOGUE = f"""WITH lines AS (SELECT [{", ".join(_quoted(x) for x in _LINES)}] AS l, [{", ".join(_quoted(x) for x in _KINDS)}] AS k),
files AS (SELECT event_id, k[event_id % {len(_KINDS)} + 1] AS language, l FROM events, lines WHERE user_id IS NOT NULL),
rows AS (SELECT event_id, language, n, l[(event_id * 7 + n * n * 13 + n * (event_id % 5)) % {len(_LINES)} + 1] AS line FROM files, range({_PICKED}) r(n)),
rules(pattern, rule_id, languages, regex, least) AS (VALUES {", ".join(f"({_quoted(r.pattern)}, {_quoted(r.rule_id)}, [{', '.join(map(_quoted, r.languages))}]::VARCHAR[], {_quoted('(?i)' + r.regex)}, {r.at_least})" for r in RULES)}),
hits AS (
  SELECT event_id, pattern, rule_id, n + 1 AS start_line, least, count(*) OVER w AS m, row_number() OVER (PARTITION BY event_id, rule_id ORDER BY n) AS k
  FROM rows JOIN rules ON (len(languages) = 0 OR list_contains(languages, language)) AND regexp_matches(line, regex) WINDOW w AS (PARTITION BY event_id, rule_id))
SELECT event_id, pattern, rule_id, start_line::INTEGER AS start_line FROM hits WHERE least = 1 OR (m >= least AND k <= least)"""


def _catalogue_files(t):
    lines, kinds, i = F.array(*map(F.lit, _LINES)), F.array(*map(F.lit, _KINDS)), F.col("event_id")
    picked = F.transform(F.sequence(F.lit(0), F.lit(_PICKED - 1)), lambda n: F.get(lines, ((i * 7 + n * n * 13 + n * (i % 5)) % len(_LINES)).cast("int")))
    return t("events").where("user_id is not null").select("event_id", F.get(kinds, (i % len(_KINDS)).cast("int")).alias("language"), F.concat(F.array_join(picked, "\n"), F.lit("\n")).alias("content"))


@query(_CATALOGUE)
def catalogue_evidence(t):
    """What the whole catalogue of pattern rules finds in source files of twelve lines, one for each event."""
    return rules.line_evidence(_catalogue_files(t), RULES, key="event_id").select("event_id", "pattern", "rule_id", "start_line")


# Pieces of source files by language, each with the facts that are in it as (kind, name, line in the piece); many only look as if they had one.
_PIECES = {
    "py": (
        ("import os", (("import", "os", None),)), ("from pkg.core import a, b", (("import", "pkg.core", None),)), ("# import never", ()), ("text = 'import nothing'", ()),
        ('"""class Quoted:\nimport quoted\n"""', ()), ("class Outer(Base):\n    class Inner:\n        pass", (("class", "Outer", 0), ("class", "Inner", 1), ("inherits", "Outer", 0))),
        ("async def go():\n    import late", (("function", "go", 0), ("import", "late", None))), ("def plain():\n    return 'def no(): pass'", (("function", "plain", 0),)), ("# class Gone:", ()),
    ),
    "java": (
        ("import java.util.List;", (("import", "java.util.List", 0),)), ("// import not.me;", ()), ("/* import not.this;\n import not.that;\n*/", ()), ('String s = "class Fake extends No {";', ()),
        ("public class Shop extends Base {}", (("class", "Shop", 0), ("inherits", "Shop", 0))), ("import static org.x.Y.*;", (("import", "org.x.Y.*", 0),)),
        ("  private static int count(int a) { return a; }", (("function", "count", 0),)), ("interface Seen {}", (("class", "Seen", 0),)), ("char c = '\"'; // class Late", ()),
    ),
    "js": (
        ("import x from 'lib/core';", (("import", "lib/core", 0),)), ("// import y from 'no';", ()), ("const t = `import z from 'no'`;", ()), ("const Card = (p) => p;", (("component", "Card", 0),)),
        ("/* require('no')\n*/ const fs = require('fs');", (("import", "fs", 1),)), ("function run(a) {}", (("function", "run", 0),)), ('log("function no() {} class No");', ()), ("class Panel {}", (("class", "Panel", 0),)), ("let s = 'it\\'s // no';", ()),
    ),
    "cpp": (
        ("#include <vector>", (("import", "vector", 0),)), ("// #include <never>", ()), ('  #include "own.h"', (("import", "own.h", 0),)), ("/*\n#include <never>\nint never() {\n*/", ()),
        ("int area(int w) { return w; }", (("function", "area", 0),)), ("struct Box {};", (("class", "Box", 0),)), ('const char* p = "int no() {";', ()), ("void stop() { while (x) { } }", (("function", "stop", 0),)), ("int declared(int a);", ()),
    ),
    "html": (
        ("<script src='a.js'></script>", (("import", "a.js", 0), ("tag", "script", 0))), ("<!-- <link href='no.css'>\n<nav> -->", ()), ('<link rel="x" href="b.css">', (("import", "b.css", 0), ("tag", "link", 0))),
        ("<div>\n<p>text</p></div>", (("tag", "div", 0), ("tag", "p", 1))), ("a < b", ()),
    ),
    "sql": (
        ("CREATE TABLE IF NOT EXISTS shop.items (id INT);", (("table", "shop.items", 0),)), ("-- create table no (id int);", ()), ("SELECT 'create view no as';", ()), ("create or replace view seen AS SELECT 1;", (("table", "seen", 0),)), ("/* create table\nno */", ()),
    ),
}
_TAKEN, _BROKEN = 7, "def broken(:"


def _sql_pieces() -> str:
    rows = [(k, e, i, piece.count("\n") + 1, facts_) for k, (e, pieces) in enumerate(_PIECES.items()) for i, (piece, facts_) in enumerate(pieces)]
    facts_sql = lambda found: "[" + ", ".join(f"{{'kind': {_quoted(a)}, 'name': {_quoted(b)}, 'line': {'NULL' if c is None else c}::INTEGER}}" for a, b, c in found) + "]"
    return ", ".join(f"({k}, {_quoted(e)}, {i}, {n}, {len(_PIECES[e])}, {facts_sql(f)}::STRUCT(kind VARCHAR, name VARCHAR, line INTEGER)[])" for k, e, i, n, f in rows)


_SCANNED = f"""WITH pieces(k, ending, i, n_lines, of, found) AS (VALUES {_sql_pieces()}),
placed AS (
  SELECT event_id, event_id % {len(_PIECES)} = 0 AND event_id % 7 = 0 AS broken, 'src/' || event_type || '/g' || event_id || '.' || ending AS path, ending, found,
    coalesce(sum(n_lines) OVER (PARTITION BY event_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n_lines) OVER (PARTITION BY event_id) AS whole
  FROM events JOIN pieces ON k = event_id % {len(_PIECES)}, range({_TAKEN}) r(n) WHERE i = (event_id // 6 + n * (1 + event_id % 4)) % of),
facts AS (SELECT path, ending, unnest(found, recursive := true), before FROM placed WHERE NOT broken)
SELECT path, ending, kind, name, min(before + line + 1)::INTEGER AS line_start FROM facts GROUP BY ALL
UNION ALL SELECT path, ending, 'error', 'SyntaxError', max(whole + 1)::INTEGER FROM placed WHERE broken GROUP BY ALL"""


def _pieced(t):
    """(path, content): seven pieces of one language for each event; every seventh Python file does not parse."""
    i = F.col("event_id")
    k = (i % len(_PIECES)).cast("int")
    chosen = F.lit(None)
    for at, pieces in enumerate(_PIECES.values()):
        pool = F.array(*[F.lit(piece) for piece, _ in pieces])
        picked = F.array(*[F.get(pool, ((F.floor(i / 6) + n * (1 + i % 4)) % len(pieces)).cast("int")) for n in range(_TAKEN)])
        chosen = F.when(k == at, picked).otherwise(chosen)
    broken = F.when((k == 0) & (i % 7 == 0), F.lit(_BROKEN + "\n")).otherwise("")
    path = F.concat(F.lit("src/"), "event_type", F.lit("/g"), i.cast("string"), F.lit("."), F.get(F.array(*map(F.lit, _PIECES)), k))
    return t("events").select(path.alias("path"), F.concat(F.array_join(chosen, "\n"), F.lit("\n"), broken).alias("content"))


@query(_SCANNED)
def code_scan_facts(t):
    """Imports, classes, functions, tables, tags and errors that one scan finds in files of six languages with look-alikes in comments and strings."""
    found = code_scan.scan(_pieced(t)).where("kind not in ('symbol', 'issue', 'main')")
    ending = F.regexp_extract("path", r"\.(\w+)$", 1).alias("ending")
    return found.groupBy("path", ending, "kind", "name").agg(F.min("line_start").alias("line_start"))
