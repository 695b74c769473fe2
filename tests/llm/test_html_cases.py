import random
import time

import pytest

from textquarry.llm import html_text
from textquarry.llm.html_text import main_text

P = "<p>" + "Long words, and more, of the article text here. " * 6 + "</p>"


@pytest.mark.parametrize("name", ["post-comments", "main-navigation", "article-share", "text-ad", "content-sidebar", "body-footer", "commentList", "comment-content", "ad", "menu-box"])
def test_furniture_by_name_is_left_out(name):
    block = f'<div class="{name}"><p>JUNK, junk, junk.</p></div>'
    assert "JUNK" not in main_text(f"<body><div id=content>{P * 3}{block}{P}</div></body>")
    assert "JUNK" not in main_text(f"<body>{block}<article>{P}{block}{P}</article></body>")


@pytest.mark.parametrize("block", ['<div style="display: none">JUNK</div>', "<div hidden>JUNK</div>", '<section aria-hidden="true">JUNK</section>'])
def test_hidden_blocks_are_left_out(block):
    assert "JUNK" not in main_text(f"<article>{P}{block}{P}</article>")


@pytest.mark.parametrize("block", ['<p class="notice">KEEP</p>', '<p id="form">KEEP</p>', '<div class="search-algorithms"><p>KEEP</p></div>', "<h2 class=header>KEEP</h2>"])
def test_text_is_not_lost_to_a_name(block):
    assert "KEEP" in main_text(f"<article>{P}{block}{P}</article>") and "KEEP" in main_text(f"<body><div>{P}{block}{P}</div></body>")


def test_named_blocks_that_hold_the_page_are_its_text():
    assert main_text(f"<body><div class=modal>{P * 5}</div><div class=menu>x</div></body>").count("Long") == 30
    assert "JUNK" not in main_text("<body><div class=ad>JUNK, much longer, than the article, is.</div><article><h1>Head</h1></article></body>")


@pytest.mark.parametrize("html", ["<div>" * 100_000 + "x", "<font>" * 100_000 + "<p>x", "<p><font>" * 50_000, "<li>" * 100_000, "<a>" * 100_000, "<div><b>" * 50_000 + "</i>" * 1000])
def test_malformed_pages_take_time_in_proportion(html):
    began = time.process_time()
    main_text(html)
    assert time.process_time() - began < 5


def brute_best(page):
    """Scores by walking from every block up to the root."""
    blocks, _ = page._without_named()
    points, size, linked = ([0.0] * len(page.tag) for _ in range(3))
    for node, text, in_links in blocks:
        value, part, level = html_text._points(text, in_links), 1.0, node
        while level >= 0:
            size[level] += len(text)
            linked[level] += in_links
            if page.tag[level] in html_text.SCORED or level == 0:
                points[level] += value * part
                part /= 2
            level = page.parent[level]
    best, found = None, None
    for i, tag in enumerate(page.tag):
        if size[i] and (tag in html_text.SCORED or i == 0):
            score = points[i] * (1 - linked[i] / size[i]) + (25 if tag in ("article", "main") else 0)
            if best is None or score > best + 1e-9:
                best, found = score, i
    return found


def test_best_container_equals_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        parts = []
        for _ in range(rng.randint(1, 40)):
            parts.append(rng.choice(["<div>", "</div>", "<section>", "</section>", "<p>", "</p>", "<a>", "</a>", "<ul><li>", "</ul>", "<article>", "</article>", "word, word, " * rng.randint(1, 9)]))
        page = html_text._Page("".join(parts))
        best = brute_best(page)
        lines = page.main_blocks()
        if best is None:
            assert not lines
        else:
            whole = page._whole(best)
            inside = [text for node, text, _ in page._without_named()[0] if whole in _up(page, node)]
            assert [x for x in lines if x in set(inside)][: len(inside)] and set(inside) <= set(lines)


def _up(page, node):
    out = set()
    while node >= 0:
        out.add(node)
        node = page.parent[node]
    return out


def test_text_in_several_containers_is_kept():
    one, two = "One text, of some length. " * 6, "Two text, of some length. " * 6
    both = f"{one.strip()}\n{two.strip()}"
    assert html_text.main_text(f"<div><div><p>{one}</p></div></div><div><div><p>{two}</p></div></div>") == both
    assert html_text.main_text(f"<div><article><p>{one}</p></article></div><div><article><p>{two}</p></article></div>") == both
    assert html_text.main_text(f"<div><article><p>{one}</p></article></div><div><div><p>aside, small</p></div></div><div><div><a href=x>{two}</a></div></div>") == one.strip()


def test_hidden_and_names_are_read_from_their_own_attributes():
    text = "One text, of some length. " * 6
    kept = "<div title='is hidden here'><p>a</p></div><div data-class=\"ad\" data-style='display:none'><p>b</p></div>"
    cut = "<div hidden><p>c</p></div><div STYLE='color:red; display : none'><p>d</p></div><p aria-hidden=true>e</p><div hidden='hidden'>f</div>"
    assert html_text.main_text(f"<article>{kept}{cut}<p>{text}</p></article>") == f"a\nb\n{text.strip()}"


def test_furniture_outside_of_articles_by_any_word_of_its_name():
    text = "One text, of some length. " * 6
    names = ("responses", "discussion-area", "feedback", "ad-slot", "OUTBRAIN", "breadcrumb-trail", "related-posts", "popular-posts", "recommended-reading", "sitemap", "trending")
    around = "".join(f"<div class='{n}'><p>furniture, {n}</p></div>" for n in names)
    assert html_text.main_text(f"<body>{around}<article><p>{text}</p><section class='discussion'><p>Its matter</p></section></article>{around}</body>") == f"{text.strip()}\nIts matter"
