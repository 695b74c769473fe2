"""Odd rows on which a query differed from its SQL or failed."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F
from test_queries import table

from textquarry.operators import vectors
from textquarry.plans import catalog

PAGES = [
    (1, "http://a.example.com/en/1.html", '<a href="/The">x</a><a href="/The"><B>y</B><é><bé> &middot;'), (2, "http://a.example.com/en/1.html", '<a href="they.html"><A HREF="no"><a href="MIDDOT">'),
    (3, "http://m.example.com/fr/en/2", '<a href="they.html"><a href="apple/x"><x- y><x-y_><x_y>'), (4, "no-scheme/de/x", '<a href="tail.b">'), (5, None, '<a href="there">'), (6, "http://b.example.com/", None),
    (7, "", '<a href="/"> track(1)'), (8, "http://www.example.com/es/fr/", '<a href="to"><Kb>'),
]
DOCUMENTS = [
    (1, "Straße ß " * 900, "fr", "s"), (2, "ﬁn " + " " * 17000 + "end", "fr", "s"), (3, " " * 9000, "en", "s"), (4, "", "fr", "s"), (5, None, "fr", "s"), (6, "a" * 8001, "en", "s"), (7, "x", "es", "s"), (8, "ŉ" * 8000, "fr", "s"),
]
ROWS = {"pages": (PAGES, "page_id long, url string, html string"), "documents": (DOCUMENTS, "doc_id long, text string, lang string, source string")}
OF_PAGES = "page_links tag_frequency hot_link_targets imported_by dependency_edges link_neighbourhood visible_links forbidden_links required_tokens page_priorities key_targets module_relevance path_evidence".split()


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    for name, (rows, schema) in ROWS.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    con = duckdb.connect()
    for name in ROWS:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet/*.parquet'")
    return folder, con


@pytest.mark.parametrize("name", [*OF_PAGES, "reindexed_chunks"])
def test_odd_rows_equal_the_sql(spark, odd, name):
    folder, con = odd
    df = catalog.QUERIES[name](spark, folder)
    want = con.execute(catalog.ORACLES[name])
    assert table(df.columns, df.collect()) == table([d[0] for d in want.description], want.fetchall())


def test_active_page_context_runs_on_odd_rows(spark, odd):
    assert {r["path"] for r in catalog.QUERIES["active_page_context"](spark, odd[0]).collect()} >= {"the.html", "they.html", "there.html"}


def test_terms_are_counted_without_a_shuffle_and_repeated_ids_are_one_text(spark):
    docs = spark.createDataFrame([(1, "a1 b1 a1"), (1, "a1 c1"), (2, "c1 b1"), (3, None), (4, "")], "doc_id long, text string")
    assert "Exchange" not in vectors.terms(docs, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    got = {(r["doc_id"], r["term"]): r["weight"] for r in vectors.tf_idf(docs).collect()}
    assert len(got) == 9 and len([k for k in got if k[0] == 1]) == 6
    raw = {"a1": (1 + math.log(3)) * (math.log(6 / 2) + 1), "b1": math.log(6 / 3) + 1, "c1": math.log(6 / 3) + 1, **{p: math.log(6 / 2) + 1 for p in ("a1 b1", "b1 a1", "a1 c1")}}
    length = math.sqrt(sum(x * x for x in raw.values()))
    assert all(abs(got[1, t] - x / length) < 1e-12 for t, x in raw.items())


def test_markdown_chunks_go_out_in_small_batches(spark):
    """One text of more chunks than a batch holds, and more texts than are held at a time."""
    from textquarry.operators import retrieval

    long = "\n".join(f"# part {i}\n{'word ' * 30}" for i in range(3 * retrieval._SENT))
    docs = spark.createDataFrame([(0, long), *((i, "short text. " * 20) for i in range(1, 3 * retrieval._ROWS)), (-1, None)], "doc_id long, text string").coalesce(1)
    got = retrieval.markdown_chunks(docs).collect()
    assert [r["chunk_index"] for r in got if r["doc_id"] == 0] == list(range(3 * retrieval._SENT))
    assert {r["doc_id"] for r in got} == set(range(3 * retrieval._ROWS))


def test_each_rule_is_evaluated_at_one_place_and_blocks_lose_no_line(spark):
    """F32: a rule that counts hits, and the filter that Spark infers for explode, made every expression run again."""
    import re

    from textquarry.operators import rules

    found = [rules.Rule("A", "wrap", r"def\s+wrap", 0.9, ("python",), after=3), rules.Rule("B", "plain", r"[0-9]{2}$", 0.5), rules.Rule("C", "thrice", r"self\.\w+ =", 0.5, ("python",), at_least=3)]
    n = 2 * rules.BLOCK + 5
    lines = ["def wrap" if i % 51 == 0 else f"line {i}" if i % 7 else "" for i in range(n)]
    few = ["self.a = 1", "self.b = 2"]
    files = [("long", "python", "\r\n".join(lines) + "\n"), ("two", "python", "\n".join(few)), ("two", "python", "SELF.c = 3\nself.d = 4"), ("java", "java", "self.a = 11\nself.a = 1\nself.a = 1"), ("none", "python", None), ("empty", "python", ""), (None, None, "x 12")]
    df = rules.line_evidence(spark.createDataFrame(files, "path string, language string, content string"), found)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(f"(?iU){r.regex}") for r in found] == [1, 1, 1]
    got = sorted((r["path"] or "", r["rule_id"], r["start_line"], r["end_line"], r["snippet"]) for r in df.where("rule_id != 'thrice'").collect())
    want = [("long", "wrap", i + 1, min(i + 4, n), "\n".join(lines[i : i + 4]).strip(" ")) for i in range(n) if lines[i] == "def wrap"]
    want += [("long", "plain", i + 1, i + 1, x) for i, x in enumerate(lines) if re.search(r"[0-9]{2}$", x)] + [("java", "plain", 1, 1, "self.a = 11"), ("", "plain", 1, 1, "x 12")]
    assert got == sorted(want) and len(want) > 300
    # of two files of one path the hits are counted together, and only the first three count
    assert [(r["path"], r["start_line"]) for r in df.where("rule_id = 'thrice'").orderBy("start_line").collect()] == [("two", 1), ("two", 1), ("two", 2)]


def test_a_scan_for_some_kinds_finds_what_a_whole_one_does_and_reads_no_other_files(spark):
    """every scan parsed and matched all languages for all kinds."""
    from test_code_scan import FILES

    from textquarry.operators import code_scan

    python = "import a.b as c, d\nfrom .. import e\nclass A(B, c.D[int]):\n  def f(self):\n    try:\n      import g\n    except E:\n      class H(A): pass\n    match f:\n      case 1:\n        def i(): import j\nif __name__ == '__main__':\n  async def k(x: Q): pass\n"
    files = [*FILES.items(), ("x.py", python), ("bad.py", "import x\nclass ("), ("x.ts", "const Card = (p) => p; function low() {}"), ("no.py", "x = 1"), ("null.py", None), ("e.py", "")]
    df = spark.createDataFrame(files, "path string, content string")
    rows = lambda found: sorted(map(str, found.collect()))
    whole = code_scan.scan(df).cache()
    for kinds in (("import",), ("inherits",), code_scan.DEFINED, ("component", "error"), ("function",), ("symbol", "main", "issue", "tag"), ("table",), ()):
        assert rows(code_scan.scan(df, kinds=kinds)) == rows(whole.where(F.col("kind").isin(*kinds))), kinds
    assert "cpp" not in code_scan.scan(df, kinds=("inherits",))._jdf.queryExecution().optimizedPlan().toString()
    assert whole.where("path = 'x.py' and kind = 'import'").count() == 5 and whole.where("path = 'x.py' and kind = 'inherits'").count() == 3
