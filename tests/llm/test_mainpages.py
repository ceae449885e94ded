"""Main text of pages: the reader, the field's gradients and decoding, made pages held out, and the given pages."""

from __future__ import annotations

import itertools
import re
import time
from html import unescape

import numpy as np
import pytest

from rowloom.llm import catalog, mainpages
from rowloom.llm.dom import Marks, leaf_blocks
from rowloom.llm.labelled_pages import labelled_pages


@pytest.fixture(scope="module")
def field():
    return mainpages.default_field()


def texts(html):
    return [b.text for b in leaf_blocks(html, Marks())]


@pytest.mark.parametrize(
    ("html", "blocks"),
    [
        (None, []),
        ("", []),
        (" \n ", []),
        ("just text & more", ["just text & more"]),
        ("<p>a<p>b</b>c<br>d  e\n&nbsp;f&eacute;&#33;", ["a", "bc d e fé!"]),
        ("<p>x <b>y</b>z<!-- no > p --><!>w</p>1 < 2 <3 </ >", ["x yzw", "1 < 2 <3"]),
        ("<script>a<p>b</p></SCRIPT ><style>c</style>d<script>e", ["d"]),
        ("<div title='a>b' class=\"x y\">t</div><a href=>u</a><a b='>v", ["t", "uv"]),
        ("<ul><li>a<li>b<ul><li>c</ul>d</ul>e", ["a", "b", "c", "d", "e"]),
        ("<table><tr><td>a<td>b</div>c<tr><th>d</table>", ["a", "b", "c", "d"]),
        ("<b><p>a</b>b</p></i>c", ["ab", "c"]),
        ("<head><title>t</title><body>x</body></html>y", ["x", "y"]),
        ("<p>a<!-- open", ["a"]),
        ("<textarea><p>a</textarea><select><option>b</select>c<noscript>d</noscript>", ["c"]),
    ],
)
def test_blocks(html, blocks):
    assert texts(html) == blocks


def test_reader_is_linear():
    for bad in ("<", "<div>", "<p><b>", "<a b='", "</p>", "<!--", "<li>", "&", "<p a=\"", "<script>", "<td><div>", "</x ", "<x/ "):
        start = time.perf_counter()
        texts(bad * 100_000 + "end")
        assert time.perf_counter() - start < 20, bad


def test_decoding_and_gradients_against_all_labelings(field):
    rng = np.random.default_rng(1)
    own, same = rng.normal(size=(3, 5)), rng.random((3, 5)) < 0.5
    steps, first, last = rng.normal(size=(2, 2, 2)), rng.normal(size=2), rng.normal(size=2)
    mask = np.arange(5) < np.array([5, 1, 3])[:, None]
    truth = (rng.random((3, 5)) < 0.5) & mask

    def score(page, labels, own, steps, first, last):
        total = first[labels[0]] + last[labels[-1]] + sum(own[page, i] for i, y in enumerate(labels) if y)
        return total + sum(steps[int(same[page, i])][labels[i - 1]][labels[i]] for i in range(1, len(labels)))

    def likelihood(*values):
        total = 0.0
        for page, size in enumerate(mask.sum(axis=1)):
            every = [score(page, y, *values) for y in itertools.product((0, 1), repeat=int(size))]
            total += score(page, tuple(int(y) for y in truth[page, :size]), *values) - np.logaddexp.reduce(every)
        return total

    values = [own, steps, first, last]
    found = mainpages.gradients(own, same, mask, truth, steps, first, last)
    assert found[0] == pytest.approx(likelihood(*values))
    for k, slope in enumerate(found[1:]):
        for at in np.ndindex(values[k].shape):
            if k == 0 and not mask[at]:
                continue
            moved = [v.copy() for v in values]
            moved[k][at] += 1e-5
            assert slope[at] == pytest.approx((likelihood(*moved) - likelihood(*values)) / 1e-5, abs=1e-3)

    for html, _ in labelled_pages(60, 5):
        blocks = leaf_blocks(html, field.marks)[:9]
        if not blocks:
            continue
        scores = field.scores(mainpages.page_features(blocks, field.marks))

        def whole(labels, blocks=blocks, scores=scores):
            total = field.first[labels[0]] + field.last[labels[-1]] + sum(s for s, y in zip(scores, labels, strict=True) if y)
            moves = zip(blocks, blocks[1:], labels, labels[1:], strict=False)
            return total + sum(field.steps[int(a.container == b.container)][x][y] for a, b, x, y in moves)

        best = max(itertools.product((0, 1), repeat=len(blocks)), key=whole)
        assert whole([int(x) for x in field.decode(blocks)]) == pytest.approx(whole(best))


def test_held_out_pages(field):
    right = total = whole = 0
    pages = labelled_pages(400, 77)
    for html, main in pages:
        blocks = leaf_blocks(html, field.marks)
        labels = mainpages._labels(blocks, main)
        assert sum(labels) == len(main)
        found = [bool(x) for x in field.decode(blocks)]
        right += sum(a == b for a, b in zip(found, labels, strict=True))
        total += len(labels)
        whole += found == labels
    assert right / total > 0.99 and whole / len(pages) > 0.9


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_given_pages(field, sf):
    import pyarrow.parquet as pq

    for row in pq.read_table(f"/root/testdata/{sf}/pages.parquet").to_pylist():
        article = re.search("<article>(.*?)</article>", row["html"], re.S).group(1)
        parts = (" ".join(unescape(re.sub("<[^>]+>", " ", x)).split()) for x in re.split("</?p>|</?h1>", article))
        assert mainpages.main_text(row["html"], field) == "\n\n".join(p for p in parts if p)


BLOG = """<html><head><title>T</title></head><body class="home">
<div id="cookie-notice">We use cookies. <button>OK</button></div>
<header class="site-header"><a href="/">My Blog</a><nav><a href="/a">A</a> <a href="/b">B</a></nav></header>
<div class="wrapper"><main id="main"><article class="post hentry"><h1 class="entry-title">How to bake bread</h1>
<div class="entry-content"><p>Bread is old. It needs <a href="/flour">flour</a> &amp; water.</p><h2>Steps</h2>
<ol><li>Mix the flour and water.</li><li>Wait.</li></ol><div class="ad-slot">Buy our flour today!</div>
<blockquote><p>Good bread takes time.</p></blockquote><p>Enjoy.</p></div>
<div class="share-buttons"><a href="#">Tweet</a> <a href="#">Share</a></div></article>
<section id="comments"><h2>2 comments</h2><ol class="comment-list"><li><p>Nice post, I baked it twice.</p></li>
<li><p>Mine was too dry, what did I do wrong? I used warm water.</p></li></ol>
<form class="comment-form"><label>Name</label><input><button>Send</button></form></section></main>
<aside class="sidebar"><h3>Recent posts</h3><ul><li><a href="/1">Cakes</a></li><li><a href="/2">Pies</a></li></ul>
<p>I am a baker from the north and write about bread every week.</p></aside></div>
<footer><p>© 2024 My Blog. All rights reserved.</p></footer></body></html>"""
DIVS = """<body><div class="topbar"><div class="logo">News</div><ul class="menu"><li><a href=1>World</a><li><a href=2>Sport</a></ul></div>
<div class="content"><div class="article-body"><h1>Storm hits coast</h1><p>A storm hit the coast on Monday.<p>Nobody was hurt, officials said.
<div class="newsletter"><p>Subscribe to our newsletter and never miss a story.</p></div><p>The storm moved on at night.</div>
<div class="related"><h3>More stories</h3><a href=3>Rain tomorrow</a></div></div>
<div class="disqus"><div class="comment"><p>Stay safe everybody, it is not over yet.</p></div></div>
<div id="footer">Imprint | Privacy</div>"""


def test_usual_pages(field):
    blog = mainpages.main_text(BLOG, field).split("\n\n")
    assert blog == ["How to bake bread", "Bread is old. It needs flour & water.", "Steps", "Mix the flour and water.", "Wait.",
                    "Good bread takes time.", "Enjoy."]
    news = mainpages.main_text(DIVS, field).split("\n\n")
    assert news == ["Storm hits coast", "A storm hit the coast on Monday.", "Nobody was hurt, officials said.", "The storm moved on at night."]
    assert mainpages.main_text("<p>Only one.</p><p>And another sentence.</p>", field) == "Only one.\n\nAnd another sentence."


CLUTTER = [
    "<aside><h3>More to read here</h3><p>{}</p></aside>", '<div class="sidebar"><p>{}</p></div>',
    '<section class="comments"><h2>Comments</h2><p>{}</p></section>', '<div id="comments"><div class="comment"><b>Ann</b><p>{}</p></div></div>',
    '<div class="cookie-banner"><p>{}</p><button>OK</button></div>', '<div id="gdpr-notice">{}</div>', '<div class="newsletter-signup"><p>{}</p></div>',
    '<div class="ad-banner">{}</div>', '<div class="advertisement"><p>{}</p></div>', '<p class="disclaimer">{}</p>',
    '<form action="/s"><label>Name</label><input name="q"><p>{}</p><button>Go</button></form>', "<noscript><p>{}</p></noscript>",
    '<div style="display:none">{}</div>', '<div class="related-posts"><a href="/x">{}</a></div>',
]
FRAMES = [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="post">', "</div>"), ('<section class="story">', "</section>")]


def test_given_pages_with_clutter_of_other_kinds(field):
    """Pages whose article is framed otherwise, with one more block before, inside or after it."""
    import random

    import pyarrow.parquet as pq

    rng = random.Random(4)
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()[:80]
    texts = [" ".join(t.split())[: rng.choice((40, 200, 500))] for t in pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist() if len(t) > 60]
    right = total = 0
    for clutter in CLUTTER:
        for begin, end in FRAMES:
            for place in ("before", "inside", "after"):
                html = rng.choice(pages)
                first, last = html.index("<article>"), html.index("</article>")
                article, piece = html[first + 9 : last], clutter.format(rng.choice(texts))
                parts = (" ".join(unescape(re.sub("<[^>]+>", " ", x)).split()) for x in re.split("</?p>|</?h1>", article))
                at = article.find("</p>") + 4
                body = {"before": piece + begin + article + end, "after": begin + article + end + piece, "inside": begin + article[:at] + piece + article[at:] + end}[place]
                right += mainpages.main_text(html[:first] + body + html[last + 10 :], field) == "\n\n".join(p for p in parts if p)
                total += 1
    assert right / total > 0.95, right / total


def test_query_on_awkward_rows(spark, field):
    long = "<article>" + "<p>One more sentence here, of the very long page.</p>" * 30000 + "</article>"
    rows = [(1, "u", None, "x", 1), (2, None, "", "x", 2), (None, None, BLOG, None, None), (3, "u", BLOG, "x", 3), (3, "u", BLOG, "x", 3), (4, "u", long, "x", 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    found = mainpages.extract_main_text(df, "html", ["page_id", "url"])
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    expected = [(r[0], r[1], mainpages.main_text(r[2], field)) for r in rows]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([(*e, len(e[2])) for e in expected], key=repr)
    assert len(expected[-1][2].split("\n\n")) == 30000
    assert mainpages.extract_main_text(df.limit(0), "html", ["page_id", "url"]).collect() == []
    blocks = mainpages.page_blocks(df.where("page_id = 3"), "html", ["page_id"], field).first()["blocks"]
    assert [b["text"] for b in blocks if b["main"]] == expected[3][2].split("\n\n") and len(blocks) > 15


def test_registered(spark, folder):
    out = catalog.QUERIES["op12_page_text"](spark, folder)
    assert out.columns == ["page_id", "url", "text", "n_chars"] and out.where("n_chars = 0").count() == 0
