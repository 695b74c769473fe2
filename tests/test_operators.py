import random
import re

import pytest
from pyspark.sql import functions as F

from textquarry.functions import paths, queries, texts
from textquarry.operators import changes, code_scan, facts, graph, logs, policy, reports, retrieval, rules, sampling, vectors
from textquarry.operators.pattern_rules import CATEGORIES, PATH_RULES, RULES
from textquarry.sources import corpus

PY = '''import os
from typing import List
import a.b as c

class Base:
    pass

class PluginFactory(Base):
    _instance = None
    def create_thing(self, x: Foo, y: List[int]) -> Bar:
        return x

def wrapper(func):
    return func

async def go():
    await x

if __name__ == "__main__":
    go()
'''


@pytest.fixture(scope="module")
def code(spark):
    rows = [
        ("p", "src/factory_a.py", PY, "python"), ("p", "src/bad.py", "def (:\n", "python"), ("p", "src/models/x.py", "self.a = A()\nself.b = B()\nself.c = C()\nself.d = D()\n", "python"),
        ("p", "web/index.js", "import x from 'lib/core';\nconst f = (a) => a;\nexport function Go() {}\nclass W {}\nrequire('fs');\n", "javascript"),
        ("p", "A.java", "import java.util.List;\npublic class A extends B {\n  public static void main(String[] a) {}\n  private static A getInstance() {}\n}\n", "java"),
        ("p", "m.cpp", '#include <vector>\n#include "m.h"\nclass K : L {};\nint main() {\n  if (x) { }\n}\n', "cpp"), ("p", "t.sql", "CREATE TABLE IF NOT EXISTS users (id int);", "sql"),
        ("p", "i.html", '<html><script src="a.js"></script><link href="b.css"></html>', "html"),
    ]
    return spark.createDataFrame(rows, "project string, path string, content string, language string")


def test_paths(spark):
    rows = ["a/b/c.tar.gz", ".env", "src/main.py", "x/Makefile", "a.b/c"]
    df = spark.createDataFrame([(p,) for p in rows], "path string")
    p = F.col("path")
    got = df.select(paths.base_name(p), paths.stem(p), paths.extension(p), paths.language(p)).collect()
    assert [tuple(r) for r in got] == [("c.tar.gz", "c.tar", "gz", "other"), (".env", ".env", "", "other"), ("main.py", "main", "py", "Python"), ("Makefile", "Makefile", "", "other"), ("c", "c", "", "other")]
    for glob, path, want in [("*.py", "a/b.py", True), ("src/*.ts", "src/x/y.ts", True), ("**/x.py", "x.py", True), ("a?c", "abc", True), ("[!a]*.md", "a.md", False), ("a.c", "abc", False), ("x*", "d/xa", True)]:
        one = spark.createDataFrame([(path,)], "path string").select(paths.matches_glob(F.col("path"), glob)).first()[0]
        assert one is want, (glob, path)


def test_scan_and_listing(spark):
    files = spark.createDataFrame([(p,) for p in ["a.py", "node_modules/x.js", "src/.git/c.py", "src/u.min.js", "src/b.ts", "yarn.lock", "note.txt", "rebuild/z.go", "../up.py"]], "path string")
    assert sorted(r[0] for r in corpus.scanned(files).collect()) == ["../up.py", "a.py", "rebuild/z.go", "src/b.ts"]
    assert [r[0] for r in corpus.listed(files, "*.py").collect()] == ["a.py", "src/.git/c.py"]
    assert sorted(r[0] for r in paths.source_files(spark.createDataFrame([("a.py",), ("b.md",), ("package.json",), ("x.json",)], "path string")).collect()) == ["a.py", "package.json"]


def test_tables_survive_a_round_trip(spark, code, tmp_path):
    folder = str(tmp_path / "snap")
    assert corpus.read_snapshot(spark, folder, "1").count() == 0
    rows = code.withColumn("size", F.length("content").cast("long")).withColumn("mtime", F.lit(1.5))
    snap = corpus.snapshot_of(rows)
    corpus.write_snapshot(snap, folder, "1")
    assert sorted(map(tuple, corpus.read_snapshot(spark, folder, "1").collect())) == sorted(map(tuple, snap.collect()))
    text = "---\nname: Front\nconfidence: 0.9\n---\nwords\n```json\n{\"artifact_id\": \"7\", \"evidence\": [\"e\"]}\n```\n"
    made = corpus.imported_artifacts(spark.createDataFrame([("m.md", text), ("n.md", "nothing")], "path string, content string")).where("artifact_id = '7'").first()
    assert (made["name"], made["confidence"], made["evidence"], made["source_file"]) == ("Front", 0.9, ["e"], "m.md")
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.txt").write_text("héllo")
    assert corpus.read_files(spark, str(tmp_path / "raw")).first()["content"] == "héllo"
    assert corpus.without_project(code, "p").count() == 0


def test_overall_checksum_ignores_order_and_sees_changes(spark):
    made = spark.createDataFrame([("t", str(i), f"n{i}") for i in range(20)], "artifact_type string, artifact_id string, name string")
    one = corpus.overall_checksum(corpus.artifact_checksums(made)).first()
    assert one == corpus.overall_checksum(corpus.artifact_checksums(made.orderBy(F.desc("name")).repartition(3))).first()
    assert one != corpus.overall_checksum(corpus.artifact_checksums(made.withColumn("name", F.upper("name")))).first()


def test_diff_by_hand(spark):
    s = "project string, path string, size bigint, mtime double, checksum string"
    old = spark.createDataFrame([("p", "same", 1, 1.0, "x"), ("p", "touched", 1, 1.0, "x"), ("p", "sum", 1, 1.0, "x"), ("p", "gone", 1, 1.0, "x"), ("p", "nosum", 1, 1.0, "")], s)
    new = spark.createDataFrame([("p", "same", 1, 1.0, "x"), ("p", "touched", 1, 2.0, "x"), ("p", "sum", 1, 1.0, "y"), ("p", "new", 1, 1.0, "x"), ("p", "nosum", 1, 1.0, "z")], s)
    assert {r["path"]: r["status"] for r in changes.diff(old, new).collect()} == {"same": "unchanged", "touched": "changed", "sum": "changed", "gone": "deleted", "new": "added", "nosum": "unchanged"}
    assert changes.to_analyse(old.limit(0), new).count() == 5
    assert changes.freshness(old, old).first()["is_fresh"]


def test_windows_rejoin(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    whole = {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}
    got = {}
    for r in retrieval.windows(docs, 700, 100).orderBy("doc_id", "chunk_index").collect():
        got[r["doc_id"]] = got.get(r["doc_id"], "") + (r["content"] if r["chunk_index"] == 0 else r["content"][100:])
    assert got == {k: v for k, v in whole.items() if v}
    with pytest.raises(ValueError, match="overlap"):
        retrieval.windows(docs, 10, 10)


def test_markdown_chunks(spark):
    text = "lead words " * 10 + "\n# One\nbody one. " + "Sentence here. " * 300 + "\n### Two\nshort body that is long enough to stay, it has more than eighty characters in it, surely.\n" + "# Three\ntiny\n# Four\n" + "x" * 5000
    rows = retrieval.markdown_chunks(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")).orderBy("chunk_index").collect()
    assert {r["doc_id"] for r in rows} == {1} and [r["chunk_index"] for r in rows] == list(range(len(rows)))
    assert all(80 <= len(r["content"]) <= 2000 for r in rows)
    assert {r["section_header"] for r in rows} == {None, "One", "Two", "Four"}
    assert "".join(re.findall("x", "".join(r["content"] for r in rows if r["section_header"] == "Four"))).count("x") >= 5000


def test_rules_on_code(code):
    found = rules.line_evidence(code, RULES)
    kinds = {(r["path"], r["pattern"]) for r in found.collect()}
    assert {("src/factory_a.py", "Singleton"), ("src/factory_a.py", "Factory"), ("src/factory_a.py", "Concurrency"), ("A.java", "Singleton"), ("src/models/x.py", "Facade")} <= kinds
    assert found.where("rule_id = 'facade_delegates'").count() == 3
    wrapped = found.where("rule_id = 'decorator_wrapper'").first()
    assert wrapped["end_line"] == wrapped["start_line"] + 3 and "return func" in wrapped["snippet"]
    assert {(r["path"], r["pattern"]) for r in rules.path_evidence(code, PATH_RULES).collect()} == {("src/factory_a.py", "Factory"), ("src/models/x.py", "MVC")}
    whole = found.join(code.select("path", "project"), "path")
    assert rules.summary(rules.robust(rules.patterns_by_project(whole, ["project"], language="language")), CATEGORIES).count() > 0
    assert len(RULES) > 80 and len({r.rule_id for r in RULES}) == len(RULES)


def test_confidence_steps(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "n int").select(rules.confidence(F.col("n")).alias("c"), rules.evidence_quality(F.col("n")).alias("q"))
    got = [(round(r["c"], 2), r["q"]) for r in df.collect()]
    assert got[:5] == [(0.0, "none"), (0.65, "weak"), (0.8, "moderate"), (0.8, "moderate"), (0.83, "strong")] and got[9][0] == 0.95


def test_code_facts(code):
    f = facts.python_facts(code)
    rows = {(r["kind"], r["name"]) for r in f.where("path = 'src/factory_a.py'").collect()}
    assert {("import", "os"), ("import", "typing"), ("import", "a.b"), ("class", "PluginFactory"), ("inherits", "PluginFactory"), ("main", "__main__"), ("issue", "Foo"), ("issue", "Bar"), ("symbol", "create_thing")} <= rows
    assert f.where("path = 'src/bad.py'").first()["kind"] == "error"
    assert {tuple(r) for r in code_scan.imports(code_scan.scan(code)).where("path not like '%.py'").collect()} == {("web/index.js", "lib/core"), ("web/index.js", "fs"), ("A.java", "java.util.List"), ("m.cpp", "vector"), ("m.cpp", "m.h"), ("i.html", "a.js"), ("i.html", "b.css")}
    d = {tuple(r) for r in code_scan.definitions(code_scan.scan(code)).collect()}
    assert {("web/index.js", "component", "Go"), ("web/index.js", "function", "f"), ("web/index.js", "class", "W"), ("A.java", "class", "A"), ("A.java", "function", "main"), ("m.cpp", "class", "K"), ("m.cpp", "function", "main"), ("t.sql", "table", "users"), ("src/factory_a.py", "class", "Base")} <= d
    assert {tuple(r) for r in code_scan.inheritance(code_scan.scan(code)).collect()} == {("src/factory_a.py", "PluginFactory", "Base"), ("A.java", "A", "B")}
    assert {r["name"]: r["n_files"] for r in facts.import_frequency(code_scan.imports(code_scan.scan(code))).collect()}["lib"] == 1
    assert facts.completeness(f).where("path = 'src/factory_a.py'").first()["has_entry"]
    s = facts.script_symbols(texts.lines(code).where("path = 'web/index.js'"))
    assert {(r["name"], r["type"]) for r in s.collect()} == {("f", "function"), ("Go", "function"), ("W", "class")}
    assert facts.python_symbols(code).where("name = 'create_thing'").first()["signature"] == "create_thing(self, x, y)"
    assert facts.lint_imports(code).where("path = 'src/factory_a.py'").first()["imports"] == ["typing", "os", "a.b"]
    assert code.where("path = 'web/index.js'").select(facts.import_count(F.col("content"))).first()[0] == 2
    changed = code.withColumn("content", F.replace("content", F.lit("def wrapper"), F.lit("def wrapped")))
    assert tuple(facts.change_impact(code, changed).where("path = 'src/factory_a.py'").first()) == ("src/factory_a.py", 1, 1, True)
    entries = code.where(paths.is_entry_point(F.col("path"), F.col("content")))
    assert {r["path"] for r in entries.collect()} == {"src/factory_a.py", "web/index.js", "A.java", "m.cpp"}


@pytest.fixture(scope="module")
def modules(spark):
    rows = [("p", "src/a.py", "a", ["b", "from c import d", "os", "a"]), ("p", "src/b.py", "b", ["src.c", "a.x"]), ("p", "src/c.py", "c", []), ("p", "lib/c.py", "c", ["web/view"]), ("p", "web/view/index.ts", "view", [])]
    return spark.createDataFrame([(*r, "about", []) for r in rows], "project string, path string, name string, dependencies array<string>, purpose string, public_interface array<string>")


def test_dependency_graph(spark, modules):
    nodes, edges = graph.resolved(modules)
    assert {tuple(r) for r in edges.select("source", "target", "type").collect()} == {
        ("src/a.py", "src/b.py", "import"), ("src/a.py", "lib/c.py", "import"), ("src/a.py", "external:os", "external"), ("src/a.py", "external:a", "external"), ("src/b.py", "lib/c.py", "import"),
        ("src/b.py", "src/a.py", "import"), ("lib/c.py", "web/view/index.ts", "import"),
    }
    assert nodes.where("type = 'external'").count() == 2
    back = {r["path"]: r["importers"] for r in graph.imported_by(modules).collect()}
    assert back == {"src/b.py": ["src/a.py"], "src/a.py": ["src/b.py"]}
    shown, kept = graph.visible(nodes.withColumn("patterns", F.array(F.lit("X"))), edges, pattern="X")
    assert kept.where("target like 'external%'").count() == 0 and shown.where("flagged").count() == 5
    near, touching = graph.neighbourhood(edges, spark.createDataFrame([("src/b.py",)], "id string"))
    assert {r[0] for r in near.collect()} == {"src/a.py", "src/b.py", "lib/c.py"} and touching.count() == 3
    context = graph.active_context(modules, modules.where("path = 'src/b.py'").select("project", "path"))
    assert {r["path"] for r in context.collect()} == {"src/b.py", "src/a.py"}
    doubled = edges.withColumn("o", F.lit(1)).unionByName(edges.withColumn("o", F.lit(0)).withColumn("type", F.lit("first")))
    assert {r["type"] for r in graph.distinct_edges(doubled, "o").collect()} == {"first"}


def test_alternatives(spark, modules):
    globs = spark.createDataFrame([("x.view*",), ("no",)], "glob string")
    assert [tuple(r) for r in policy.alternatives(globs, modules, ("about",)).collect()] == [("view", "web/view/index.ts", 1)]


def plain_limits(events, per_minute, per_hour):
    out, times = {}, {}
    for t, e, k in sorted(events):
        held = [x for x in times.get(k, []) if x > t - 3600]
        recent = [x for x in held if x > t - 60]
        ok = len(recent) < per_minute and len(held) < per_hour
        out[e] = ok
        times[k] = [*held, t] if ok else held
    return out


def test_rate_limits_equal_a_loop(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    busy = events.withColumn("ts", F.timestamp_micros(F.expr("cast(unix_micros(ts) / 400 as bigint)")))
    got = {r["event_id"]: r["allowed"] for r in logs.rate_limited(busy, "user_id", "event_id", per_minute=2, per_hour=4).collect()}
    want = plain_limits([(r[0] / 1e6, r[1], r[2]) for r in busy.select(F.unix_micros("ts"), "event_id", "user_id").collect()], 2, 4)
    assert got == want and not all(want.values())


def test_tolerant_json(spark):
    raw = ['[{"line": 1}]', 'see ```json\n[{"line": 2}]\n``` ok', 'so [{"line": 3}] is', "[{'line': 4, 'value': None}]", "broken [", None, ""]
    rows = reports.findings(spark.createDataFrame([(str(i), r) for i, r in enumerate(raw)], "path string, raw string")).collect()
    assert {r["path"]: r["line"] for r in rows if r["category"] != "parse_failure"} == {"0": 1, "1": 2, "2": 3, "3": 4}
    assert {r["path"] for r in rows if r["category"] == "parse_failure"} == {"4", "5", "6"}


def test_vector_dimensions(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    asked = e.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    assert vectors.wrong_dimension(e, 64).count() == 0 and vectors.wrong_dimension(e, 63).count() == e.count()
    with pytest.raises(ValueError, match="queries"):
        vectors.cosine_scores(e, asked, most_queries=2)


def test_any_number_of_queries(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").limit(300).localCheckpoint()
    asked = e.select(F.col("vec_id").alias("query_id"), "embedding")
    rows = lambda **o: {tuple(r) for r in vectors.nearest(vectors.cosine_scores(e, asked, **o), 3).select("query_id", "vec_id", "rank").collect()}
    assert len(rows()) == 900 and rows(block=70) == rows()
    many = spark.range(1500).select(F.col("id").alias("query_id"), F.concat(F.lit("n"), F.col("id") % 40).alias("query"))
    artifacts = spark.createDataFrame([(f"a{i}", "t", f"n{i}", "", 0.9, ["x"]) for i in range(40)], "artifact_id string, artifact_type string, name string, description string, confidence double, evidence array<string>")
    assert reports.keyword_hits(artifacts, many).select("query_id").distinct().count() == 1500
    modules = spark.createDataFrame([(f"src/n{i}.py", f"n{i}", "") for i in range(40)], "path string, name string, purpose string")
    assert reports.module_matches(modules, many).select("query_id").distinct().count() == 1500


def test_embedding_cache(spark):
    t = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, text string")
    cache = spark.createDataFrame([], "h string, embedding array<double>")
    rows, whole = vectors.embedded_once(t, cache, lambda d: d.select("h", F.array(F.length("text").cast("double")).alias("embedding")))
    assert rows.count() == 3 and whole.count() == 2
    v = spark.createDataFrame([(1, "v1"), (2, "v2"), (3, None)], "id int, embed_version string")
    assert [x.count() for x in vectors.current_version(v, "v2")] == [1, 2]


def test_hybrid_ends(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha gamma delta"), (3, "omega")], "doc_id long, text string")
    asked = spark.createDataFrame([(9, "beta alpha beta")], "item_id long, text string")
    norm = retrieval.min_max(retrieval.bm25(docs, asked), docs.agg(F.count("*").alias("n")))
    cosines = spark.createDataFrame([(9, 1, -1.0), (9, 2, 0.2), (9, 3, 1.0)], "item_id long, doc_id long, cosine double")
    order = lambda a: [r["doc_id"] for r in retrieval.top_k(retrieval.fused(cosines, norm, a), 3, "final", "item_id", "doc_id").orderBy("rank").collect()]
    assert order(1.0)[0] == 1 and order(0.0) == [3, 2, 1]
    with pytest.raises(ValueError, match="alpha"):
        retrieval.fused(cosines, norm, 1.5)
    shown = retrieval.shaped(retrieval.fused(cosines, norm).withColumn("content", F.lit("x" * 40))).first()
    assert shown["n_tokens"] == 10 and 0 <= shown["confidence"] <= 1


def test_small_helpers(spark):
    q = spark.createDataFrame([("How does the parser, work?",), ("compare a vs b",), ("fix it",)], "query string")
    rows = asked = queries.with_complexity(q).collect()
    assert [r["complexity"] for r in rows][1] == "complex" and asked
    assert [r[0] for r in q.select(queries.context_route(F.col("query"))).collect()][2] == "MAP_THEN_JIT"
    assert [r[0] for r in q.select(texts.keywords(F.col("query"))).collect()][0] == ["parser", "work"]
    files = spark.createDataFrame([(f"f{i}", "x" if i < 90 else "y", i % 3) for i in range(100)], "path string, language string, n_imports int")
    sample = sampling.stratified_sample(files, target=20)
    assert {r["language"]: r["count"] for r in sample.groupBy("language").count().collect()} == {"x": 14, "y": 5}
    assert sampling.prioritised(files, F.col("path") == "f7", F.col("path") == "f8").orderBy("rank").first()["path"] == "f7"
    hints = reports.edit_hints(spark.createDataFrame([("a", i, "n" * 90 + str(i)) for i in range(9)], "path string, ts int, note string")).first()["hint"]
    assert len(hints) == 400 and hints.startswith("n" * 90 + "8")


def test_requests_that_read_all_files(spark):
    rows = [("a", "Find magic numbers, please"), ("b", "any open issue?"), ("c", "有什麼問題"), ("d", "show me the parser"), ("e", None), ("f", "有多少")]
    got = {r["id"]: (r["is_audit"], r["is_review"], r["reads_all"], r["mode"]) for r in queries.with_intent(spark.createDataFrame(rows, "id string, query string").withColumn("mode", F.lit("agent")), mode="mode").collect()}
    assert got == {"a": (True, False, True, "direct"), "b": (False, True, True, "direct"), "c": (False, True, True, "direct"), "d": (False, False, False, "agent"), "e": (False, False, False, "agent"), "f": (False, False, False, "direct")}


def test_cosines_in_blocks_and_with_k(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(80)] + [(80, None), (81, [1.0, 2.0]), (82, [0.0] * 6)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = v.where("vec_id < 9").select(F.col("vec_id").alias("query_id"), "embedding")
    every = vectors.cosine_scores(v, asked, block=4)
    assert every.count() == 9 * 81
    want = {(r["query_id"], r["vec_id"], r["rank"]) for r in vectors.nearest(every, 5).collect()}
    assert {(r["query_id"], r["vec_id"], r["rank"]) for r in vectors.nearest(vectors.cosine_scores(v, asked, k=5), 5).collect()} == want
    assert all((i, i, 1) in want for i in range(9))
    assert vectors.cosine_scores(v, asked.limit(0)).count() == 0
    with pytest.raises(ValueError, match="more than 3"):
        vectors.cosine_scores(v, asked, most_queries=3)


def test_artifact_hits_have_types(spark):
    index = spark.createDataFrame([("pattern:p:1", [1.0, 0.0]), ("edge_case:e", [0.6, 0.8]), ("bare", [0.0, 1.0])], "vec_id string, embedding array<double>")
    asked = spark.createDataFrame([(7, [0.0, 1.0])], "query_id int, embedding array<double>")
    got = [(r["artifact_type"], r["artifact_id"], round(r["relevance"], 3), r["rank"]) for r in vectors.artifact_hits(index, asked, min_score=0.5).orderBy("rank").collect()]
    assert got == [("unknown", "bare", 1.0, 1), ("edge_case", "e", 0.8, 2)]


def test_project_memory_is_indexed_anew(spark):
    text = "# Title\n\n" + "Some words that fill a section of a file. " * 6
    files = spark.createDataFrame([("p", "PROJECT.md", text), ("p", "modules/core.md", text), ("p", "modules/deep/x.md", text), ("p", "notes.md", text)], "project string, path string, content string")
    index = spark.createDataFrame([("p", "PATTERNS.md", 0, "old", "gone"), ("q", "PROJECT.md", 0, "h", "stays")], "project string, path string, chunk_index int, section_header string, content string")
    got = {(r["project"], r["path"]) for r in retrieval.indexed_memory(index, files).collect()}
    assert got == {("q", "PROJECT.md"), ("p", "PROJECT.md"), ("p", "modules/core.md")}


def test_passages_of_wanted_sources(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "doc_id int, source string")
    assert [r["doc_id"] for r in retrieval.from_sources(rows, rows.where("source = 'b'")).collect()] == [2]


def test_literals_gate_every_rule():
    from textquarry.operators.pattern_rules import RULES

    assert rules.required_literals(r"(get|set)_\w+|[Ff]actory") == {"get", "set", "actory"}
    assert rules.required_literals(r"a?b*") is None and rules.required_literals(r"(?<!q)Abc+") == {"ab"} and rules.required_literals(r"(x|y*)z") == {"z"}
    assert all(rules.required_literals(r.regex) for r in RULES)


def test_gated_rules_find_what_plain_expressions_find(spark):
    import re

    from textquarry.operators.pattern_rules import RULES
    from textquarry.plans.code_queries import _KINDS, _LINES

    odd = ["DEF GET_IN\u017fTANCE(", "\u212aey", "def m\u0131x(", "class \u00c9Factory(", "", "   "]
    text = "\n".join([*_LINES, *odd, *(x.upper() for x in _LINES), *(f"{a} {b}" for a, b in zip(_LINES, _LINES[5:], strict=False))])
    files = spark.createDataFrame([(k, k, text) for k in _KINDS], "path string, language string, content string")
    plain = [r for r in RULES if r.at_least == 1]
    got = {(r["path"], r["rule_id"], r["start_line"]) for r in rules.line_evidence(files, plain).collect()}
    want = {(k, r.rule_id, i) for k in _KINDS for r in plain if k in r.languages or not r.languages for i, line in enumerate(text.split("\n"), 1) if re.search(r.regex, line, re.I)}
    assert got == want and len(want) > 100


def test_three_times_fewer_expressions(spark, sf):
    from textquarry.operators.pattern_rules import RULES
    from textquarry.plans.code_queries import _catalogue_files

    n = rules.regex_evaluations(_catalogue_files(lambda name: spark.read.parquet(f"{sf}/{name}.parquet")), RULES).first()
    assert n["all"] > 3 * n["gated"]


def test_running_totals_equal_a_loop(spark):
    from textquarry.operators.ordered import running

    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "b", None]), rng.randint(0, 9), rng.randint(-3, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g string, o int, x int").repartition(5)
    for by in ((), ("g",)):
        done = running(df, [-F.col("o"), F.col("id")], F.col("x"), "before", by)
        got = {r["id"]: r["before"] for r in done.collect()}
        want, sums = {}, {}
        for i, g, o, x in sorted(rows, key=lambda r: (-r[2], r[0])):
            k = g if by else 0
            want[i] = sums.get(k, 0)
            sums[k] = sums.get(k, 0) + x
        assert got == want and done.columns == [*df.columns, "before"]
    assert running(df.limit(0), [F.col("id")], F.lit(1), "before").count() == 0
