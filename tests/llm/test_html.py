import html
import math
import random
import re
import time
from itertools import product

import pytest
from samples import SMALL

from staygrid.llm import html_crf
from staygrid.llm.html_crf import Field, features, leaf_blocks, main_text, marginals, viterbi, written_page


def score_of(labels, scores, pairs):
    return sum(s for s, y in zip(scores, labels, strict=True) if y) + sum(
        pairs[a][b] for a, b in zip(labels, labels[1:], strict=False))


def test_marginals_and_viterbi_against_all_labellings():
    turn = random.Random(1)
    for n in range(1, 8):
        scores = [turn.gauss(0, 2) for _ in range(n)]
        pairs = [[turn.gauss(0, 1) for _ in range(2)] for _ in range(2)]
        every = {y: math.exp(score_of(y, scores, pairs)) for y in product((0, 1), repeat=n)}
        total = sum(every.values())
        one, seen = marginals(scores, pairs)
        for k in range(n):
            assert abs(one[k] - sum(w for y, w in every.items() if y[k]) / total) < 1e-9
        for a, b in product((0, 1), repeat=2):
            count = sum(w * sum(p == (a, b) for p in zip(y, y[1:], strict=False)) for y, w in every.items()) / total
            assert abs(seen[a][b] - count) < 1e-9
        assert every[tuple(viterbi(scores, pairs))] == pytest.approx(max(every.values()))
    assert viterbi([], [[0, 0], [0, 0]]) == []


def test_blocks_of_broken_and_odd_markup():
    texts = lambda page: [b.text for b in leaf_blocks(page)]
    assert texts("") == texts("<p></p><!-- open <p>x</p>") == []
    assert texts("plain &amp; simple\n\ttext") == ["plain & simple text"]
    assert texts("<p>a<b>b</b>c<br>d<p>e</p></div>f") == ["abc", "d", "e", "f"]
    assert texts("<script>var t='</p>';if(a<b){}</script><style>p{}</style><p>x</p>") == ["x"]
    assert texts("<SCRIPT>never closed <p>x") == []
    assert texts("1 < 2 and 3 > 2 <p title='a>b'>c</p>") == ["1 < 2 and 3 > 2", "c"]
    assert texts("<p>&#233;&eacute;&nbsp;&lt;b&gt; &unknown; &amp;amp;</p>") == ["éé <b> &unknown; &amp;"]
    assert texts("<!-- a --><p>x<!-- b -->y</p><!DOCTYPE html>") == ["xy"]
    nested = leaf_blocks('<div class="Post Body"><ul><li>a<li>b</ul></div><p id=main>c')
    assert [tuple(t for t, _ in b.above.tags()) for b in nested] == [("div", "ul", "li"), ("div", "ul", "li"), ("p",)]
    assert nested[0].above.tags()[0][1] == ("post", "body") and nested[2].above.tags()[0][1] == ("main",)


@pytest.fixture(scope="module")
def field(spark):
    return html_crf.train(spark.read.parquet(f"{SMALL}/pages.parquet"))


def test_held_out_layouts(field):
    turn, right, total = random.Random(99), 0, 0
    for _ in range(300):
        blocks, labels = written_page(turn)
        got = viterbi([float(field.weights[features(b)].sum()) for b in blocks], field.pairs.tolist())
        right += sum(a == b for a, b in zip(got, labels, strict=True))
        total += len(labels)
    assert right / total > 0.98


def article_of(page):
    inner = re.search("<article>(.*?)</article>", page, re.S)[1]
    inner = re.sub("</?b>", "", inner)
    return " ".join(html.unescape(re.sub("<[^>]+>", " ", inner)).split())


def test_table_gives_the_articles(spark, field):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r.page_id: r for r in html_crf.extract(pages, field).collect()}
    rows = pages.collect()
    assert len(found) == len(rows)
    assert sum(found[r.page_id].text == article_of(r.html) for r in rows) >= 0.99 * len(rows)
    assert all(r.n_chars == len(r.text) for r in found.values())


def test_parts_set_apart_are_left_out(field):
    page = (
        "<html><body><header><h1>Site name</h1></header><nav><a href='/'>Home</a></nav>"
        "<div class='cookie-notice'>We use cookies to make this site work better for you.</div>"
        "<article><h1>A title of some words</h1><p>The first paragraph is long enough to be read, with commas.</p>"
        "<div class='ad'>Buy this now and save a lot of money today.</div><p>The second paragraph ends it.</p></article>"
        "<aside class='sidebar'><h3>Related</h3><p>Something else you may like to read.</p></aside>"
        "<section id='comments' class='comments'><div class='comment'><p>I do not agree with this at all.</p></div></section>"
        "<form><label>Your name</label><p>Sign up for news by mail.</p></form><footer>© Someone, all rights reserved.</footer>"
    )
    text, _ = main_text(page, field, html_crf.Path())
    assert text == (
        "A title of some words The first paragraph is long enough to be read, with commas. The second paragraph ends it."
    )


def test_messy_pages(spark, field):
    rows = [(1, "u", None), (None, None, "<article><p>Text of a page, long enough to stay in it.</p></article>"), (2, "v", ""),
            (2, "v", ""), (3, None, "<nav>x</nav>"), (4, "w", "<article>" + "<p>Word after word.</p>" * 20_000 + "</article>")]
    schema = "page_id long, url string, html string, text string, n_chars string"
    pages = spark.createDataFrame([(*r, "x", "x") for r in rows], schema)
    got = html_crf.extract(pages, field).collect()
    assert sorted((str(r.page_id), str(r.url), len(r.text)) for r in got) == sorted(
        [("1", "u", 0), ("None", "None", 42), ("2", "v", 0), ("2", "v", 0), ("3", "None", 0), ("4", "w", 20_000 * 17 - 1)])
    empty = spark.createDataFrame([], schema)
    assert html_crf.extract(empty, html_crf.train(empty, layout_pages=5)).collect() == []


def test_deep_and_broken_pages_take_linear_time(field):
    """Each within seconds; the nesting, the unclosed tags and quotes once were quadratic."""
    n = 200_000
    pages = {
        "nested": "<article>" + "<div>x" * n, "closed": "<div>x" * n + "</div>" * n, "stray": "<b>" * n + "</i>" * n,
        "inline": "<b>" * n + "<li>y</li>" * n, "quotes": "<a \"" * n, "single": "<a '" * (n + 1) + ">", "open": "<a " * n,
        "less": "<" * n, "comments": "<!--" * n, "bang": "<!" * n, "spaces": " " * 2_000_000, "lines": "<p>" + "\n" * 2_000_000,
        "classes": "".join(f"<div class='c{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}'>z" for k in range(15_000)),
    }
    started = time.process_time()
    for name, page in pages.items():
        before = time.process_time()
        text, labels = main_text(page, field, html_crf.Path())
        assert time.process_time() - before < 20, name
    assert time.process_time() - started < 60
    assert len(leaf_blocks(pages["nested"])) == n and [b.text for b in leaf_blocks(pages["open"])][0][:4] == "<a <"


def test_parts_of_an_article_set_apart_are_not_main_text():
    page = "<article><p>a</p><div class='comments'><p>b</p></div><div id=share>c</div><aside>d</aside><div class='body'>e</div></article><p>f</p>"
    assert [html_crf.tag_label(b) for b in leaf_blocks(page)] == [1, 0, 0, 0, 1, 0]


def test_only_short_blocks_have_the_words_of_labels():
    key = html_crf.bucket("key cookies")
    for n in (html_crf.LABEL_WORDS, html_crf.LABEL_WORDS + 1):
        block = leaf_blocks("<p>" + "cookies " * n)[0]
        assert (key in features(block)) == (n <= html_crf.LABEL_WORDS)


def test_training_does_not_depend_on_order(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    a, b = html_crf.train(pages, 20, 5), html_crf.train(pages.repartition(5), 20, 5)
    assert isinstance(a, Field) and (a.weights == b.weights).all() and (a.pairs == b.pairs).all()
