"""Main text of web pages: boosted trees over DOM nodes, decoded from the root downwards."""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title svg math iframe object canvas select textarea".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table caption tbody td "
    "tfoot th thead tr ul".split()
)
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
# What an opening tag ends, and the elements beyond which it doesn't reach.
ENDS: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "th": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "tbody": (frozenset({"tbody", "thead", "tfoot", "tr", "td", "th"}), frozenset({"table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
P_BARRIER = frozenset("td th table caption button object body html article section aside nav main header footer form li div".split())

# Words in tag names, classes, ids and roles that speak against and for main text.
AGAINST = re.compile(
    r"\b(nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|header|masthead|banner|topbar|footer|foot|bottom|sidebar|side"
    r"|aside|widget|related|recommend\w*|popular|trending|promo\w*|ads?|advert\w*|sponsor\w*|sponsored|cookies?|consent|gdpr"
    r"|notice|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|form|search|share|sharing|social"
    r"|comments?|commentlist|respond|reply|replies|disqus|discussion|copyright|legal|disclaimer|tags?|toolbar|skip|complementary"
    r"|contentinfo|hidden|visually|meta|byline|tracking|outbrain|taboola|teaser|more)\b"
)
FOR = re.compile(r"\b(article|articlebody|main|content|post|entry|story|body|text|prose|blog|page|document)\b")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

KINDS = ("article", "main", "section", "div", "p", "ul", "ol", "li", "a", "heading", "nav", "header", "footer", "aside", "form", "table", "pre", "blockquote", "figure", "inline")
FEATURES = (
    *(f"is_{k}" for k in KINDS), "depth", "against", "for", "against_above", "for_above", "chars", "chars_share", "link_share",
    "links", "blocks", "chars_per_tag", "words_per_block", "marks_share", "children", "place", "siblings", "alike", "sibling_share",
    "before_share", "longest_block",
)


@dataclass
class Node:
    tag: str
    tokens: str = ""
    parent: Node | None = None
    children: list[Node | str] = field(default_factory=list)

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]


class _Builder(HTMLParser):
    """Tree of a page as browsers build it in essence: void and unclosed elements, stray ends."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html")

    def _end(self, tags: frozenset[str], barrier: frozenset[str]) -> None:
        node, outer = self.at, None
        while node.parent is not None and node.tag not in barrier:
            if node.tag in tags:
                outer = node
            node = node.parent
        if outer is not None:
            self.at = outer.parent

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in ("html", "body") and (tag == "html" or any(n.tag == "body" for n in self._open())):
            return
        if tag == "head" and (self.at is not self.root or any(not isinstance(c, str) or c.strip() for c in self.root.children)):
            return
        self._leave_head(tag)
        if tag in CLOSES_P:
            self._end(frozenset({"p"}), P_BARRIER)
        if tag in ENDS:
            self._end(*ENDS[tag])
        said = " ".join(v for k, v in attrs if v and k in ("class", "id", "role", "aria-label", "itemprop"))
        words = " ".join(m[0].lower() for m in _TOKEN.finditer(said))
        hidden = any(k == "hidden" or k == "style" and v and re.search(r"display\s*:\s*none", v) for k, v in attrs)
        node = Node(tag, words + " hidden" * hidden, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def _leave_head(self, tag: str) -> None:
        """Closes an open head at a body, or at what can't stand in a head."""
        heads = (n for n in self._open() if n.tag == "head") if tag == "body" else iter((self.at,) if self.at.tag == "head" else ())
        if tag not in IN_HEAD and (head := next(heads, None)) is not None:
            self.at = head.parent

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)

    def _open(self) -> Iterator[Node]:
        node = self.at
        while node is not None:
            yield node
            node = node.parent

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body") or tag in VOID:
            return
        for node in self._open():
            if node.tag == tag and node.parent is not None:
                self.at = node.parent
                return
            if node.tag in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                return

    def handle_data(self, data: str) -> None:
        if self.at.tag == "head" and data.strip():
            self._leave_head("")
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def _kind(tag: str) -> str:
    if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
        return "heading"
    return tag if tag in KINDS else "div" if tag in BLOCK else "inline"


@dataclass
class Measures:
    """Sums over the visible text of a subtree."""

    chars: int = 0
    linked: int = 0
    links: int = 0
    tags: int = 0
    blocks: int = 0
    words: int = 0
    marks: int = 0
    longest: int = 0

    def add(self, other: Measures) -> None:
        for name in ("chars", "linked", "links", "tags", "blocks", "words", "marks"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        self.longest = max(self.longest, other.longest)


def decided_nodes(root: Node) -> list[Node]:
    """Visible block elements in page order, parents first; what a label is given to. They may lie
    in inline or unknown elements.
    """
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node is root or node.tag in BLOCK:
            out.append(node)
        todo += [c for c in reversed(node.elements()) if c.tag not in HIDDEN]
    return out


def decided_parents(nodes: list[Node]) -> list[int]:
    """Place of each node's nearest ancestor among ``nodes``; -1 for the first, the root."""
    nearest = {id(n): i for i, n in enumerate(nodes)}
    out = [-1]
    for node in nodes[1:]:
        passed, at = [], node.parent
        while id(at) not in nearest:
            passed.append(id(at))
            at = at.parent
        out.append(nearest[id(at)])
        nearest.update(dict.fromkeys(passed, out[-1]))
    return out


def _sums(root: Node) -> dict[int, Measures]:
    """Measures by node identity, without recursion: pages may be nested deeply."""
    order, todo, linked = [], [(root, False)], {}
    while todo:
        node, inside = todo.pop()
        inside = inside or node.tag == "a"
        linked[id(node)] = inside
        order.append(node)
        todo += [(c, inside) for c in node.elements() if c.tag not in HIDDEN]
    sums: dict[int, Measures] = {}
    holds_block: dict[int, bool] = {}
    for node in reversed(order):
        own = " ".join(" ".join(c for c in node.children if isinstance(c, str)).split())
        m = Measures(len(own), len(own) * linked[id(node)], node.tag == "a", 1, node.tag in BLOCK and bool(own), own.count(" ") + bool(own), sum(map(own.count, ".,;:!?")))
        for child in node.elements():
            if child.tag not in HIDDEN:
                m.add(sums[id(child)])
        holds_block[id(node)] = any(c.tag in BLOCK or holds_block.get(id(c), False) for c in node.elements())
        if node.tag in BLOCK and not holds_block[id(node)]:
            m.longest = max(m.longest, m.chars)
        sums[id(node)] = m
    return sums


@functools.lru_cache(maxsize=100_000)
def _hints(text: str) -> tuple[int, int]:
    """Attribute words that speak against main text and for it."""
    return len(AGAINST.findall(text)), len(FOR.findall(text))


def features(root: Node) -> tuple[list[Node], np.ndarray]:
    """Nodes to decide on and their features: own subtree, attribute words, depth, siblings."""
    nodes, sums = decided_nodes(root), _sums(root)
    below: list[list[Node]] = [[] for _ in nodes]
    for node, parent in zip(nodes[1:], decided_parents(nodes)[1:]):
        below[parent].append(node)
    whole = max(1, sums[id(root)].chars)
    rows = np.zeros((len(nodes), len(FEATURES)), np.float64)
    above: dict[int, tuple[int, float, float]] = {}
    places: dict[int, tuple[int, int, int, int, int]] = {}
    for row, node, children in zip(rows, nodes, below):
        depth, against_above, for_above = above.get(id(node), (0, 0.0, 0.0))
        m, kind = sums[id(node)], _kind(node.tag)
        against, favour = _hints(f"{node.tag} {node.tokens}")
        place, count, alike, beside, before = places.get(id(node), (0, 1, 1, whole, 0))
        row[: len(KINDS)] = [kind == k for k in KINDS]
        row[len(KINDS) :] = (
            depth, against, favour, against_above, for_above, m.chars, m.chars / whole, m.linked / max(1, m.chars),
            m.links, m.blocks, m.chars / max(1, m.tags), m.words / max(1, m.blocks), m.marks / max(1, m.words),
            len(node.elements()), place / max(1, count - 1), count, alike / count, m.chars / max(1, beside), before / whole,
            m.longest,
        )
        together = sum(sums[id(c)].chars for c in children)
        same = {t: sum(c.tag == t for c in children) for t in {c.tag for c in children}}
        passed = before
        for i, child in enumerate(children):
            above[id(child)] = (depth + 1, against_above + against, for_above + favour)
            places[id(child)] = (i, len(children), same[child.tag], together, passed)
            passed += sums[id(child)].chars
    for counted in (len(KINDS) + 5, rows.shape[1] - 1):
        rows[:, counted] = np.log1p(rows[:, counted])
    return nodes, rows


@dataclass(frozen=True)
class Forest:
    """Boosted trees as arrays: per tree feature, threshold, left and right child, value."""

    trees: tuple[tuple[np.ndarray, ...], ...]
    weights: tuple[float, ...]

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        for (feature, threshold, left, right, value), weight in zip(self.trees, self.weights):
            at = np.zeros(len(rows), np.int64)
            for _ in range(len(feature)):
                inner = left[at] >= 0
                if not inner.any():
                    break
                goes_left = rows[np.arange(len(rows)), feature[at]] <= threshold[at]
                at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
            total += weight * value[at]
        return 2 * total


def _arrays(tree) -> tuple[np.ndarray, ...]:
    columns: list[list] = [[], [], [], [], []]
    todo = [(tree._java_obj.rootNode(), -1, 0)]
    while todo:
        node, parent, side = todo.pop()
        at = len(columns[0])
        if parent >= 0:
            columns[2 + side][parent] = at
        inner = node.getClass().getSimpleName() == "InternalNode"
        split = node.split() if inner else None
        row = (split.featureIndex(), split.threshold(), -1, -1, 0.0) if inner else (0, 0.0, -1, -1, node.prediction())
        for column, value in zip(columns, row):
            column.append(value)
        if inner:
            todo += [(node.leftChild(), at, 0), (node.rightChild(), at, 1)]
    kinds = (np.int64, np.float64, np.int64, np.int64, np.float64)
    return tuple(np.array(c, k) for c, k in zip(columns, kinds))


def decode(nodes: list[Node], log_odds: np.ndarray) -> set[int]:
    """Identities of the kept nodes of the most probable labelling in which nothing is kept below
    a node that is not.
    """
    parents = decided_parents(nodes)
    keep, drop = -np.logaddexp(0, -log_odds), -np.logaddexp(0, log_odds)
    for i in range(len(nodes) - 1, 0, -1):
        parent = parents[i]
        keep[parent] += max(keep[i], drop[i])
        drop[parent] += drop[i]
    kept: set[int] = set()
    for i, node in enumerate(nodes):
        if (i == 0 or id(nodes[parents[i]]) in kept) and keep[i] >= drop[i]:
            kept.add(id(node))
    return kept


def text_of(root: Node, kept: set[int]) -> str:
    """Text of the kept nodes, a line for each run of text between block boundaries."""
    lines: list[list[str]] = [[]]
    todo: list[tuple] = [(root, "enter")]
    while todo:
        item, what = todo.pop()
        if what == "text":
            lines[-1].append(item)
        elif what == "break":
            lines.append([])
        elif item.tag == "br":
            lines[-1].append(" ")
        elif item.tag not in HIDDEN and (item.tag not in BLOCK or id(item) in kept or item is root):
            inner = [(c, "text" if isinstance(c, str) else "enter") for c in item.children]
            if item is root and id(root) not in kept:
                inner = []
            edge = [(None, "break")] if item.tag in BLOCK else []
            todo += reversed(edge + inner + edge)
        elif item.tag in BLOCK:
            todo.append((None, "break"))
    blocks = (" ".join("".join(line).split()) for line in lines)
    return "\n".join(block for block in blocks if block)


# --- labelled pages -------------------------------------------------------------------------


def bold(text: str, chance: float) -> str:
    """Bold text, closed properly or left open at a line break."""
    return f"<b>{text}</b>" if chance < 0.6 else f"<b>{text}<br>"


class PageWriter:
    """Pages of random layout around given texts; main parts carry ``data-main``."""

    def __init__(self, seed: int, texts: list[str]):
        self._random, self._texts = random.Random(seed), texts

    def _words(self, low: int, high: int) -> str:
        words = self._random.choice(self._texts).split() or ["word"]
        size = self._random.randint(low, high)
        begin = self._random.randrange(max(1, len(words) - size))
        picked = words[begin : begin + size]
        return " ".join(picked).replace("&", "&amp;").replace("<", "&lt;")

    def _links(self, count: int, listed: bool) -> str:
        links = [f'<a href="/{i}">{self._words(1, 4)}</a>' for i in range(count)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>" if listed else " | ".join(links)

    def _paragraphs(self, count: int, low: int = 1, high: int = 90) -> str:
        pick, out = self._random.random, []
        for _ in range(count):
            text = self._words(low, high)
            if pick() < 0.2:
                text = bold(text, pick()) if pick() < 0.5 else f'{text} <a href="/x">{self._words(1, 3)}</a> {self._words(3, 20)}'
            out.append(f"<p>{text}</p>" if pick() < 0.9 else f"<p>{text}")
        return "".join(out)

    def _rest(self) -> tuple[str, str]:
        """Tag and attributes, and inside, of one part that is not main text."""
        r = self._random
        name = r.choice(
            "nav menu header footer sidebar ad promo cookie-notice newsletter comments related share login breadcrumb banner "
            "widget legal popular consent subscribe".split()
        )
        tag = {"nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside"}.get(name, "div")
        tag = tag if r.random() < 0.6 else r.choice(["div", "section", "div", "aside"])
        style = r.random()
        if name in ("nav", "menu", "footer", "related", "popular", "login", "share", "breadcrumb") and r.random() < 0.25:
            return f'{tag} class="c{r.randint(1, 99)}"', self._inside(name)
        said = f' class="{name}"' if style < 0.5 else f' id="site-{name}"' if style < 0.75 else "" if tag not in ("div", "section") else f' class="{name}-box x{r.randint(1, 9)}"'
        return f"{tag}{said}", self._inside(name)

    def _inside(self, name: str) -> str:
        r = self._random
        if name == "comments":
            inside = f"<h3>{self._words(1, 3)}</h3>" + "".join(
                f'<{t} class="comment"><p>{self._words(3, 60)}</p><a href="#r">{self._words(1, 1)}</a></{t}>'
                for t in [r.choice(["div", "li", "article"])] for _ in range(r.randint(1, 6))
            )
        elif name in ("newsletter", "login", "subscribe", "cookie-notice", "consent"):
            inside = f"<form><label>{self._words(1, 6)}</label><input><button>{self._words(1, 2)}</button></form><p>{self._words(3, 30)}</p>"
            inside = inside if r.random() < 0.6 else f"<p>{self._words(5, 40)}</p><button>{self._words(1, 2)}</button>"
        elif name in ("ad", "promo", "banner", "legal", "widget"):
            inside = self._words(3, 40) if r.random() < 0.6 else self._paragraphs(r.randint(1, 2), 3, 40)
        elif name == "footer":
            inside = f"&copy; {self._words(1, 12)} " + self._links(r.randint(0, 5), r.random() < 0.5)
        else:
            inside = (f"<h3>{self._words(1, 3)}</h3>" if r.random() < 0.4 else "") + self._links(r.randint(2, 12), r.random() < 0.7)
        return inside

    def _part(self) -> str:
        opening, inside = self._rest()
        return f"<{opening}>{inside}</{opening.split()[0]}>"

    def page(self) -> str:
        r = self._random
        blocks = [f"<h1 data-main>{self._words(2, 12)}</h1>"] if r.random() < 0.9 else []
        body = self._paragraphs(r.randint(1, 14) if r.random() < 0.9 else r.randint(15, 60))
        if short := r.random() < 0.15:
            body = self._paragraphs(r.randint(1, 2), 1, 8)
        if not short and r.random() < 0.3:
            body += f"<h2>{self._words(1, 6)}</h2>" + self._paragraphs(r.randint(1, 4))
        if r.random() < 0.3:
            items = "".join(f"<li>{self._words(2, 25)}</li>" for _ in range(r.randint(2, 6)))
            body += f"<ul>{items}</ul>"
        if r.random() < 0.15:
            cells = "".join(f"<tr><td>{self._words(1, 4)}</td><td>{self._words(1, 4)}</td></tr>" for _ in range(3))
            body += f"<table>{cells}</table>"
        if r.random() < 0.15:
            body += f"<blockquote><p>{self._words(8, 40)}</p></blockquote>"
        body = re.sub(r"<(p|h2|ul|li|table|tr|td|blockquote)>", r"<\1 data-main>", body)
        if r.random() < 0.25:
            cut = body.find("<p", len(body) // 2)
            body = body[:cut] + self._part() + body[cut:] if cut > 0 else body + self._part()
        inner = "".join(blocks) + body
        tag = r.choice(["article", "article", "main", "div", "div", "section"])
        said = r.choice(["", "", ' class="content"', ' class="post-body"', ' id="main-content"', ' class="entry"', f' class="c{r.randint(1, 99)}"'])
        inner = f"<{tag}{said} data-main>{inner}</{tag}>"
        for _ in range(r.randint(0, 2)):
            around = [self._part() for _ in range(r.randint(0, 2))]
            place = r.randint(0, len(around))
            wrap = r.choice(["div", "main", "section", "div"])
            said = r.choice(["", ' class="container"', ' class="row"', ' id="page"', ' class="layout"'])
            inner = f"<{wrap}{said} data-main>" + "".join([*around[:place], inner, *around[place:]]) + f"</{wrap}>"
        before = "".join(self._part() for _ in range(r.randint(0, 3)))
        after = "".join(self._part() for _ in range(r.randint(0, 4)))
        return f"<html><body>{before}{inner}{after}</body></html>"


class _Marked(_Builder):
    """Remembers which nodes carry ``data-main``."""

    def __init__(self):
        super().__init__()
        self.main: set[int] = set()

    def handle_starttag(self, tag: str, attrs) -> None:
        count = len(self.at.children)
        super().handle_starttag(tag, attrs)
        if any(k == "data-main" for k, _ in attrs):
            node = self.at if tag not in VOID else self.at.children[count]
            self.main.add(id(node))


def labelled_nodes(seed: int, texts: list[str], pages: int) -> Iterator[tuple[np.ndarray, float]]:
    """Features and label (1 for main text and what holds it) of the nodes of random pages."""
    writer = PageWriter(seed, texts)
    for _ in range(pages):
        builder = _Marked()
        builder.feed(writer.page())
        builder.close()
        nodes, rows = features(builder.root)
        for node, row in zip(nodes, rows):
            yield row, float(id(node) in builder.main or node.tag in ("html", "body"))


@dataclass(frozen=True)
class TrainingSettings:
    """``pages`` labelled pages are written around the words in the first ``sample_chars`` characters of
    ``sample`` given pages; the three bound the training set whatever the input's size.
    """

    pages: int = 600
    sample: int = 200
    sample_chars: int = 20_000
    trees: int = 16
    depth: int = 5
    seed: int = 7


def train(spark: SparkSession, pages: DataFrame, settings: TrainingSettings = TrainingSettings(), html_col: str = "html") -> Forest:
    """Forest for main text, fitted on pages of random layout around words of the given ones.

    The sample is drawn by the hash of a page: first hashes alone are compared, then the chosen
    pages' beginnings are fetched, one of several equal pages.
    """
    hashed = pages.filter(F.length(html_col) > 0).select(F.xxhash64(html_col).alias("draw"), F.col(html_col).alias("html"))
    chosen = [r.draw for r in hashed.groupBy("draw").agg(F.count("*")).orderBy("draw").limit(settings.sample).collect()]
    beginning = F.first(F.substring("html", 1, settings.sample_chars)).alias("html")
    found = sorted(hashed.filter(F.col("draw").isin(chosen)).groupBy("draw").agg(beginning).collect())
    texts = [" ".join(re.sub(r"<[^>]*>", " ", r["html"]).replace("&", " ").split()) for r in found]
    texts = [t for t in texts if len(t) > 40] or ["some words of a page that has none, to be cut and put together"]
    rows = [(Vectors.dense(row), label) for row, label in labelled_nodes(settings.seed, texts, settings.pages)]
    schema = T.StructType([T.StructField("features", VectorUDT()), T.StructField("label", T.DoubleType())])
    frame = spark.createDataFrame(rows, schema).coalesce(2)
    model = GBTClassifier(maxIter=settings.trees, maxDepth=settings.depth, stepSize=0.3, seed=settings.seed, maxMemoryInMB=256).fit(frame)
    return Forest(tuple(_arrays(tree) for tree in model.trees), tuple(model.treeWeights))


def extract(html: str | None, forest: Forest) -> str:
    """Main text of one page; empty if there is none."""
    return extract_all([html], forest)[0]


def extract_all(pages: list[str | None], forest: Forest, most_nodes: int = 20_000) -> list[str]:
    """Main texts of pages, whose nodes are scored together, ``most_nodes`` at a time or one page."""
    texts: list[str] = []
    held: list[tuple] = []
    count = 0

    def flush() -> None:
        odds = forest.log_odds(np.concatenate([rows for _, _, rows in held]))
        bounds = np.cumsum([len(rows) for _, _, rows in held])[:-1]
        texts.extend(text_of(root, decode(nodes, own)) for (root, nodes, _), own in zip(held, np.split(odds, bounds)))
        held.clear()

    for html in pages:
        root = parse(html)
        nodes, rows = features(root)
        held.append((root, nodes, rows))
        count += len(nodes)
        if count >= most_nodes:
            flush()
            count = 0
    if held:
        flush()
    return texts


def _extract(batches: Iterator[pa.RecordBatch], forest: Forest) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            rows = batch.slice(at, 500)
            texts = extract_all(rows.column(2).to_pylist(), forest)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract_pages(
    pages: DataFrame, forest: Forest, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """``page_id``, ``url`` and main ``text`` of every page.

    The trees give each visible block element its odds; the labelling with the largest joint
    probability is taken among those in which every kept element lies in kept elements. White
    space in a block is one space, blocks are joined by a line break.

    A null or empty page, or one without main text, gives an empty text. Null ids and repeated
    rows are kept. Other columns are dropped. An empty table gives no rows. There is no shuffle.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(partial(_extract, forest=forest), "page_id long, url string, text string")
