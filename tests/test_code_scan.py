import time

import pytest
from pyspark.sql import functions as F

from textquarry.operators import code_scan

FILES = {
    "a.JS": "import a from 'x'; // import b from 'no'\nconst q = \"require('no')\";\n/* class No {} */ class Yes {}\nimport(\n'late')",
    "B.java": 'package p;\n/* import no.No;\n*/ import a.B;\nString t = """\nclass No {\n""";\nclass C<T> extends D {}\n',
    "c.cpp": '#include "c.h"\nauto r = R"x(\n#include <no>\nint no() {\n)x";\nint\nmain() {\n}\nif (x) {\n}\n',
    "d.sql": "create table a (x int); -- create table no\ninsert into a values ('it''s create table no');\n/* create table no",
    "e.html": "<p>1 < 2</p><!-- <nav>\n--><main>",
    "f.py": "import os\n'''\nimport no\n'''\n",
    "g.txt": "import no",
}


def test_comments_and_strings_are_no_code(spark):
    df = spark.createDataFrame([*FILES.items(), ("h.js", None), ("i.js", ""), (None, "class X {}")], "path string, content string").withColumn("kind", F.lit(1)).repartition(3)
    facts = code_scan.scan(df)
    got = {(r["path"], r["kind"], r["name"], r["line_start"]) for r in facts.collect()}
    assert got == {
        ("a.JS", "import", "x", 1), ("a.JS", "class", "Yes", 3), ("a.JS", "import", "late", 5),
        ("B.java", "import", "a.B", 3), ("B.java", "class", "C", 7), ("B.java", "inherits", "C", 7),
        ("c.cpp", "import", "c.h", 1), ("c.cpp", "function", "main", 7),
        ("d.sql", "table", "a", 1), ("e.html", "tag", "p", 1), ("e.html", "tag", "main", 2), ("f.py", "import", "os", None),
    }
    assert code_scan.definitions(code_scan.scan(df))._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    assert code_scan.scan(df.limit(0)).count() == 0


@pytest.mark.parametrize("language", sorted(set(code_scan.EXTENSIONS) - {"python"}))
def test_masking_keeps_places(language):
    for text in [*FILES.values(), "'", '"""', "/*", "`", "\n" * 3, 'R"(']:
        out = code_scan.masked(text, language)
        assert len(out) == len(text) and [i for i, c in enumerate(out) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"]


def test_long_files_take_linear_time():
    for language, piece in [("cpp", "word word\n"), ("cpp", "\n"), ("java", "\n"), ("java", "/* x */\n"), ("js", '"a" '), ("sql", "'"), ("html", "<!-- ")]:
        start = time.monotonic()
        list(code_scan._scanned(piece * (1_000_000 // len(piece)), language, code_scan.IMPORTS.get(language)))
        assert time.monotonic() - start < 20, (language, piece)
