import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.llm import chat, embedding_dedup, html_text
from textquarry.llm.small_world import SmallWorld, levels_of
from textquarry.llm.words import mixed


def collapse(rows):
    """Maximal conversations by comparing all pairs; rows are (conv, turn, role, text)."""
    import hashlib

    turns = {}
    for c, t, r, x in set(rows):
        sized = lambda v: "" if v is None else f"{len(v)}:{v}"
        h = hashlib.md5(f"{sized(r)} {sized(x)}".encode()).hexdigest()
        turns.setdefault(c, []).append((-1 if t is None else t, h, r or "", x or ""))
    seq = {c: [(h, r, x) for _, h, r, x in sorted(v)] for c, v in turns.items()}
    key = lambda c: (c is None, c or 0)
    keep = {c for c, s in seq.items() if not any(d != c and t[: len(s)] == s and (len(t) > len(s) or key(d) < key(c)) for d, t in seq.items())}
    return {(c, "".join(f"<|{r}|>\n{x}<|end|>\n" for _, r, x in seq[c])) for c in keep}


def rendered(df):
    out = {}
    for r in df.orderBy("conv_id", "part").collect():
        out[r["conv_id"]] = out.get(r["conv_id"], "") + r["text"]
    return set(out.items())


def test_collapse_equals_all_pairs(spark):
    rng = random.Random(4)
    rows, c = [], 0
    for _ in range(30):
        talk = [(t, rng.choice(["user", "assistant"]), rng.choice(["a", "b", "ccc", "", None])) for t in range(rng.randint(1, 7))]
        for _ in range(rng.randint(1, 4)):
            for t, r, x in talk[: rng.randint(1, len(talk))]:
                rows.append((c, t, r, x))
            c += 1
    rows += [(900, 0, None, "x"), (900, 0, None, "x"), (900, None, "user", "first"), (None, 3, "user", "orphan"), (None, 4, "user", "orphan"), (901, 0, "user", None), (902, 0, "user", "")]
    rows += [(903, t, "user", f"turn {t}") for t in range(700)] + [(904, t, "user", f"turn {t}") for t in range(650)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, part string")
    assert rendered(chat.render(df)) == collapse(rows)
    assert chat.render(df.limit(0)).count() == 0


def test_turns_that_differ_stay_apart(spark):
    rows = [(1, 0, "a\x1fb", "c"), (1, 0, "a", "b\x1fc"), (2, 0, None, "x"), (2, 0, "\0", "x"), (2, 0, "", "x"), (3, 0, "u", None), (3, 0, "u", "\0"), (3, 0, "u", ""), (4, 0, "1:a", "b"), (4, 0, "1", "a 1:b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {r["conv_id"]: r["n_turns"] for r in chat.render(df).collect()} == {1: 2, 2: 3, 3: 3, 4: 2}
    assert rendered(chat.render(df)) == collapse(rows)


def test_collapse_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    got = sorted(map(tuple, chat.render(spark.read.parquet(f"{sf}/conversations.parquet")).collect()))
    assert got == sorted(con.execute(chat.ORACLE).fetchall())


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar">
<header><a href="/">Site</a></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">We use cookies, sorry.</div><div class="ad">Buy, buy, buy.</div>
<div id="content"><h1>Head &amp; tail</h1><p>First  paragraph,\n with   <b>bold</b>, <a href="x">a link</a> and text.<p>Second &lt;one&gt; unclosed &eacute;.<ul><li>item one</li><li>item two</ul>
<form><input value="x"><p>Sign up</p></form><pre>code  here</pre></div>
<div class="sidebar"><p>Related, related, related things, many of them, and more.</p></div><section id="comments"><p>Nice, really nice, the best, I think, of all.</p></section><footer>&copy; me</footer></body></html>"""


def test_a_null_conversation_is_not_the_empty_one(spark):
    rows = [(None, 1, "user", "a"), ("", 1, "user", "b"), ("", 2, "user", "c")]
    got = chat.render(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()
    assert {(r["conv_id"], r["n_turns"]) for r in got} == {(None, 1), ("", 2)}


def test_main_text_of_a_page():
    assert html_text.main_text(PAGE) == "Head & tail\nFirst paragraph, with bold, a link and text.\nSecond <one> unclosed é.\nitem one\nitem two\ncode here"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("plain", "plain"), ("<p>a<br>b</p>", "a b"), ("<article><p>x", "x"), ("<script>x", ""), ("<!-- never closed", ""), ("<p>a</p></div></p>b", "a\nb"), ("a < b", "a < b"),
        ("<div><div><div>" * 3000 + "deep", "deep"), ("<p>" + "long, " * 50_000 + "</p>", ("long, " * 50_000).strip()), ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"), ('<p title="a>b">c</p>', "c"),
        ("<article><h1>H</h1><p>One.</p></article><footer>F</footer>", "H\nOne."), ("<nav>only</nav>", ""), ("&amp;amp; &#65;&#x42; &am", "&amp; AB &am"),
    ],
)
def test_odd_html(html, text):
    assert html_text.main_text(html) == text


@pytest.mark.parametrize("n", [1, 7, 60])
def test_long_articles_keep_what_short_ones_keep(n):
    part = "A sentence of the article, with commas, and of some length, as in the news. " * 4
    inner = f"<header><p>By me</p></header><p>Lead.</p><div class='body'>{f'<p>{part}</p>' * n}</div><ul><li>point</li></ul><pre>code</pre><dl><dt>term<dd>meaning</dl><figure><figcaption>Caption</figcaption></figure>"
    want = ["Head", "By me", "Lead.", *[part.strip()] * n, "point", "code", "term", "meaning", "Caption"]
    for tag in ("article", "main"):
        html = f"<body><nav><a href=/>Home</a></nav><{tag}><h1>Head</h1>{inner}</{tag}><div><a href='/x'>More, more, more</a></div><footer>F</footer></body>"
        assert html_text.main_text(html) == "\n".join(want)
    html = f"<body><div id='content'><h1>Head</h1>{inner.replace('header>', 'div>')}</div><div class='related'><p>Other, other</p></div></body>"
    assert html_text.main_text(html) == "\n".join(want)


def test_short_sections_beside_long_ones_stay():
    part = "A sentence of the text, with commas, and of some length. " * 6
    html = f"<body><div><section>{f'<p>{part}</p>' * 12}</section><section><p>Short, but part of it.</p></section><section><a href='/l'>Link list</a></section></div></body>"
    assert html_text.main_text(html) == "\n".join([part.strip()] * 12 + ["Short, but part of it."])


def test_extract_rows(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = html_text.extract(pages).collect()
    assert len(got) == pages.count() and all(r["n_chars"] == len(r["text"]) and "\n\n" not in r["text"] and r["text"] for r in got)
    odd = spark.createDataFrame([(None, None, None, "x"), (1, "u", "", "x"), (1, "u", "<p>é</p>", "x")], "page_id long, url string, html string, text string")
    assert sorted((r["text"], r["n_chars"]) for r in html_text.extract(odd).collect()) == [("", 0), ("", 0), ("é", 1)]
    assert html_text.extract(odd.limit(0)).count() == 0


def clusters(seed, n=600, dim=16):
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=dim) for _ in range(n)]
    hot = rng.normal(size=dim)
    rows += [hot + rng.normal(size=dim) * 0.02 for _ in range(150)]
    rows += [rows[i] + rng.normal(size=dim) * 0.05 for i in range(0, n, 5)]
    rows += [rows[i].copy() for i in range(0, 40)]
    return np.array(rows)


def brute(ids, labels, x, threshold=0.93):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= threshold) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    root = np.arange(len(ids))
    while True:
        new = np.minimum(root, np.where(near, root[None, :], len(ids)).min(axis=1))
        if (new == root).all():
            return near.sum(axis=1), ids[root]
        root = new


@pytest.mark.parametrize("shard_rows", [100_000, 150])
def test_links_equal_brute_force(spark, shard_rows):
    x = clusters(1)
    labels = np.array([i % 2 for i in range(len(x))])
    ids = np.arange(len(x))
    df = spark.createDataFrame([(int(i), [float(v) for v in r], int(k), "clash") for i, r, k in zip(ids, x, labels, strict=True)], "vec_id long, embedding array<double>, label int, kept string")
    got = embedding_dedup.link(df, shard_rows=shard_rows, query_rows=64).collect()
    n, root = brute(ids, labels, x)
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got}
    assert len(got) == len(ids) and sum(v[0] for v in found.values()) >= 0.99 * n.sum()
    assert all(found[i][0] <= n[i] for i in ids) and sum(found[i][1] == root[i] for i in ids) >= 0.99 * len(ids)
    assert all(v[2] == (i == v[1]) for i, v in found.items())


def test_vectors_that_link_with_nothing(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, [1.0, 0.0], 2), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [1.0, None], 1), (7, [inf, 0.0], 1), (8, [nan, 0.0], 1), (9, [], 1), (10, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (1, [2.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(map(tuple, embedding_dedup.link(df).collect()), key=repr)
    want = [(0, 2, 0, True), (1, 2, 0, False), (1, 2, 0, False), (None, 0, None, True)] + [(i, 0, i, True) for i in (2, 3, 4, 5, 6, 7, 8, 9, 10)]
    assert got == sorted(want, key=repr)
    assert embedding_dedup.link(df.limit(0)).count() == 0
    assert embedding_dedup.keep_one(df.where("vec_id < 2")).count() == 1


def test_links_found_from_one_end_count_for_both():
    n = 100
    hit = np.zeros((n, n), bool)
    hit[1:40, 0] = hit[50, 60] = hit[61, 60] = True
    bits = embedding_dedup._Bits(n, n)
    for at in range(0, n, 16):
        bits.add(at, hit[at : at + 16])
        bits.add_back(at, hit[at : at + 16])
    assert (bits.rows(0, n) == (hit | hit.T)).all()
    want = np.arange(n)
    want[1:40], want[[60, 61]] = 0, 50
    assert (bits.roots() == want).all()


def test_a_dense_label_equals_brute_force(spark):
    """Thousands of near copies, over one shard and over several: beams are full of hits, so queries are compared with whole shards."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=32) + rng.normal(size=(1500, 32)) * 0.27, rng.normal(size=(100, 32))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.93
    np.fill_diagonal(near, False)
    assert 200_000 < near.sum() < 2_200_000
    bits = embedding_dedup._Bits(len(x), len(x))
    bits.add(0, near)
    roots = bits.roots()
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    for shard_rows in (10_000, 600):
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.link(df, shard_rows=shard_rows).collect()}
        counted = np.array([got[i][0] for i in range(len(x))])
        assert (counted <= near.sum(axis=1)).all() and counted.sum() >= 0.999 * near.sum()
        assert np.mean([got[i][1] == roots[i] for i in range(len(x))]) > 0.999


def test_links_between_shards_count_for_both_ends(spark):
    rng = np.random.default_rng(5)
    rows = []
    for label in range(8):
        centre = rng.normal(size=16)
        rows += [(label * 1000 + i, (centre + rng.normal(size=16) * 0.25).tolist(), label) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for recall in (0.0, 0.99):  # narrow beams miss links, but never one end of a link
        got = embedding_dedup.link(df, shard_rows=30, beam=2, audit_rows=8, recall=recall).groupBy(F.expr("vec_id div 1000")).agg(F.sum("n_links")).collect()
        assert len(got) == 8 and all(r[1] % 2 == 0 for r in got)


class _Misses:
    """A graph whose narrow beams find those of large groups and miss pairs."""

    def __init__(self, x):
        self.x = x

    def search(self, q, width, own=None):
        sims = q @ self.x.T
        if width < 256:
            sims[(sims > 0.95).sum(axis=1) < 10] = -1
        ids = np.argsort(-sims, axis=1)[:, :width]
        return ids, np.take_along_axis(sims, ids, 1)


def test_audit_holds_pairs_and_large_groups_apart():
    x = np.zeros((1000, 500))
    x[:200, 499] = 1
    x[np.arange(200, 1000), np.arange(800) // 2] = 1  # 400 pairs
    search = embedding_dedup._Search(_Misses(x.astype(np.float32)), x, 0.93)
    assert search.audited(x, np.arange(1000), np.random.default_rng(0).permutation(1000), 16, 512, 0.99)[0] >= 256
    # the first queries have no link
    assert search.audited(np.concatenate([-x[:512], x[200:]]), None, np.arange(1312), 16, 512, 0.99)[0] >= 256


def test_small_world_finds_neighbours():
    x = clusters(2)
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    g = SmallWorld(u, levels_of(mixed(np.arange(len(x)).astype(np.uint64))))
    ids, sims = SmallWorld.loaded(g.dumped()).search(u, 32)
    best = np.sort(u @ u.T, axis=1)[:, ::-1][:, :10]
    assert (sims[:, :10] >= best - 1e-5).mean() > 0.95 and (ids >= 0).all()
