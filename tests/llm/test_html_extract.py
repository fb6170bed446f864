"""Main text of pages: given pages, written layouts, held-out accuracy, decoding by brute force."""

import html
import itertools
import re

import numpy as np
import pytest

from tickloom.llm.html_extract import Node, TrainingSettings, decided_nodes, decode, extract, extract_pages, labelled_nodes, parse, text_of, train
from tickloom.llm.queries import op3_html_extract

DATA = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string, text string, n_chars string"


@pytest.fixture(scope="module")
def forest(spark):
    return train(spark, spark.read.parquet(f"{DATA}/pages.parquet"), TrainingSettings())


def article(page):
    inside = page[page.index("<article>") + 9 : page.index("</article>")]
    blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inside)]
    return "\n".join(b for b in blocks if b)


def test_query_gives_the_articles(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    want = sorted((r.page_id, r.url, article(r.html), len(article(r.html))) for r in pages)
    got = op3_html_extract(spark, DATA).select("page_id", "url", "text", "n_chars").collect()
    assert sorted(map(tuple, got)) == want


def test_held_out_accuracy(forest):
    texts = ["Unseen words, taken from nowhere in particular; they serve to fill pages of other layouts. " * 20]
    rows, labels = zip(*labelled_nodes(12345, texts, 150))
    right = (forest.log_odds(np.array(rows)) > 0) == (np.array(labels) > 0)
    assert right.mean() > 0.97


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body>
<header class="site-header"><a href="/">Home</a> <a href="/b">Blog</a></header>
<div class="cookie-notice"><p>We use cookies to do things.</p><button>OK</button></div>
<div id="wrapper"><div class="sidebar"><h3>Popular</h3><ul><li><a href="/1">One thing</a></li><li><a href="/2">Another</a></li></ul></div>
<div class="post-content"><h1>A  title &amp; more</h1><p>First paragraph with a <a href="/l">link</a> in it, long enough to count.
<p>Second one&nbsp;here, &lt;b&gt; kept, and more words follow to make it a paragraph.</p>
<ul><li>item one of the text</li><li>item two of the text</li></ul>
<div class="ad">Buy this now</div><p>Short.</p><script>var x = "<p>no</p>";</script></div>
<div class="comments"><h3>Comments</h3><div class="comment"><p>I liked it very much, thank you for writing this.</p></div></div></div>
<form class="newsletter"><label>Subscribe</label><input></form><footer>&copy; 2024 somebody <a href="/i">Imprint</a></footer></body></html>"""


def test_parts_around_the_text_are_left_out(forest):
    assert extract(PAGE, forest).split("\n") == [
        "A title & more",
        "First paragraph with a link in it, long enough to count.",
        "Second one here, <b> kept, and more words follow to make it a paragraph.",
        "item one of the text",
        "item two of the text",
        "Short.",
    ]


def test_decoding_is_the_best_consistent_labelling():
    random = np.random.default_rng(3)
    for _ in range(60):
        nodes = [Node("html")]
        for _ in range(random.integers(0, 8)):
            parent = nodes[random.integers(len(nodes))]
            nodes.append(Node("div", "", parent))
            parent.children.append(nodes[-1])
        odds = random.normal(0, 2, len(nodes))
        keep, drop = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
        index = {id(n): i for i, n in enumerate(nodes)}
        best = max(
            sum(keep[i] if k else drop[i] for i, k in enumerate(kept))
            for kept in itertools.product([0, 1], repeat=len(nodes))
            if all(not k or i == 0 or kept[index[id(nodes[i].parent)]] for i, k in enumerate(kept))
        )
        kept = decode(nodes, odds)
        assert all(i == 0 or id(n) not in kept or id(n.parent) in kept for i, n in enumerate(nodes))
        assert np.isclose(best, sum(keep[i] if id(n) in kept else drop[i] for i, n in enumerate(nodes)))


def test_unclosed_and_deep_markup():
    root = parse("<p>a<p>b<ul><li>c<li>d</ul><table><tr><td>e<td>f</table><br>g &eacute;&#x41;" + "<div>" * 5000 + "deep")
    kept = {id(n) for n in _all(root)}
    assert text_of(root, kept) == "a\nb\nc\nd\ne\nf\ng éA\ndeep"


def _all(root):
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo += node.elements()


def test_edge_cases(spark, forest):
    long = "<article>" + "<p>many words in one paragraph here</p>" * 5000 + "</article>"
    rows = [(1, None, None, "x", "y"), (2, "u", "", None, None), (None, "u", PAGE, "", ""), (4, "u", long, "", ""), (4, "u", long, "", ""), (5, "u", "<", "", ""), (6, None, "<script>x", "", "")]
    got = extract_pages(spark.createDataFrame(rows, SCHEMA), forest).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == 7 and texts[1] == texts[2] == texts[6] == "" and texts[None].startswith("A title")
    assert texts[4].count("\n") == 4999
    assert extract_pages(spark.createDataFrame([], SCHEMA), forest).count() == 0
    train(spark, spark.createDataFrame([], SCHEMA), TrainingSettings(pages=5, trees=1))


MAIN = PAGE[PAGE.index('<div class="post-content">') : PAGE.index('<div class="comments">')]


@pytest.mark.parametrize(
    "opening, closing",
    [("<app-root>", "</app-root>"), ("<ins>", "</ins>"), ("<font size=2><span>", "</span></font>"), ("<b>", ""), ("<app-root><div><x-view>", "</x-view></div></app-root>")],
)
def test_blocks_below_inline_and_unknown_elements(forest, opening, closing):
    page = PAGE.replace(MAIN, opening + MAIN + closing)
    assert extract(page, forest) == extract(PAGE, forest)
    root = parse(f"{opening}<h2>title</h2><p>text</p>{closing}")
    assert text_of(root, {id(n) for n in _all(root)}) == text_of(root, {id(n) for n in decided_nodes(root)}) == "title\ntext"


def test_head_without_its_end(forest):
    for page in (PAGE.replace("</head>", ""), PAGE.replace("</head><body>", ""), PAGE.replace("<head>", "").replace("</head>", "")):
        assert extract(page, forest) == extract(PAGE, forest) != ""
    root = parse("<head><title>T</title>text at once<p>more</p><head>and on</head>")
    assert text_of(root, {id(n) for n in _all(root)}) == "text at once\nmore\nand on"
