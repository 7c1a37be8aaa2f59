"""Main text of web pages: gradient-boosted trees over DOM-node features, decoded top-down.

A page is parsed into a tree of block elements whose leaves are runs of text. Each node gets features
of its tag, of its class/id/role words, of its depth, of the text, links and sentences in its subtree, of
its siblings and of its ancestors; trees give the probability that it holds main text. Decoding picks
the labelling of the whole tree with the highest likelihood in which nothing below a dropped node is
kept, so an ancestor and a descendant never contradict each other.

No labelled pages are at hand: the trees are trained on pages that this module writes itself, with
seeded layouts, in which every run of text is known to be article or not.

Defined results: a null or empty page, and a page without main text, has the empty text; broken or cut
markup closes at the end; repeated rows are extracted each; only page_id, url and html are read.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import log1p

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duochron.llm.boosting import Trees
from duochron.llm.common import arrow_map

#: HTML's block elements, the elements whose text is never shown as prose, and void elements.
BLOCKS = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption header footer nav aside form fieldset legend address details summary dialog center hr head label".split())
SILENT = frozenset("script style noscript template textarea select option button iframe svg object title".split())
#: What an opening tag closes, and where that search ends.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "body": ({"head"}, set())}

GROUPS = ({"article", "main"}, {"section", "div", "center"}, {"body", "html"}, {"p"}, {"h1"}, {"h2", "h3", "h4", "h5", "h6"}, {"li", "dt", "dd"}, {"ul", "ol", "dl"}, {"table", "tr", "td", "th", "tbody", "thead"}, {"nav"}, {"header"}, {"footer"}, {"aside"}, {"form", "fieldset", "label", "legend"}, {"blockquote", "pre", "figure", "figcaption"}, {"address", "details", "summary", "dialog"}, {"#text"})
WORDS = (
    {"content", "article", "post", "entry", "story", "main", "body", "text", "prose"},
    {"nav", "menu", "breadcrumb", "breadcrumbs", "navbar", "pagination", "toc", "navigation"},
    {"sidebar", "widget", "related", "rail", "aside", "recommended", "popular", "more", "side"},
    {"ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner", "adbox"},
    {"comment", "comments", "reply", "replies", "discussion", "disqus", "respond"},
    {"cookie", "notice", "consent", "popup", "modal", "alert", "newsletter", "subscribe", "signup", "gdpr", "login", "search"},
    {"footer", "header", "masthead", "copyright", "legal", "top", "bottom", "logo"},
    {"share", "social", "byline", "meta", "tags", "author", "date"},
)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|select|button|iframe|svg|object|title)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S | re.I)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_SPACE = re.compile(r"\s+")
_SENTENCE = re.compile(r"[.!?](?:\s|$)")


class Node:
    __slots__ = ("tag", "words", "parent", "children", "text", "links", "truth")

    def __init__(self, tag: str, words: frozenset[str] | set[str], parent: "Node | None"):
        self.tag, self.words, self.parent, self.children = tag, words, parent, []
        self.text, self.links, self.truth = "", 0, False
        if parent is not None:
            parent.children.append(self)


def parse(page: str) -> Node:
    root = Node("#root", frozenset(), None)
    at, run, links, anchors = root, [], 0, 0

    def flush() -> None:
        nonlocal run, links
        if run:
            text = _SPACE.sub(" ", entities.unescape("".join(run))).strip()
            if text:
                leaf = Node("#text", frozenset(), at)
                leaf.text, leaf.links = text, min(links, len(text))
            run, links = [], 0

    end = 0
    for m in _TOKEN.finditer(page):
        if m.start() > end:
            run.append(page[end : m.start()])
            links += (m.start() - end) * (anchors > 0)
        end = m.end()
        if not m[3]:
            continue
        tag = m[3].lower()
        if tag not in BLOCKS:
            if tag == "a":
                anchors = 0 if m[2] else 1
            elif tag in ("br", "img", "input"):
                run.append(" ")
            continue
        flush()
        if m[2]:
            up = at
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                at = up.parent
            anchors = 0
            continue
        if at.tag == "p":
            at = at.parent
        closed, fence = CLOSES.get(tag, ((), ()))
        if closed:
            up, hit = at, None
            while up is not root and up.tag not in fence:
                hit = up if up.tag in closed else hit
                up = up.parent
            at = hit.parent if hit else at
        names = m[4] and " ".join(a or b or c for a, b, c in _NAMES.findall(m[4]))
        node = Node(tag, frozenset(_SPLIT.split(names.lower())) if names else frozenset(), at)
        if tag != "hr":
            at = node
    if end < len(page):
        run.append(page[end:])
    flush()
    return root


def nodes_of(root: Node) -> list[Node]:
    """Parents before children, in page order."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += reversed(node.children)
    return out


def features(order: list[Node]) -> np.ndarray:
    n = len(order)
    index = {id(x): i for i, x in enumerate(order)}
    parent = [index[id(x.parent)] if x.parent is not None else -1 for x in order]
    chars, links, leaves, paragraphs, stops = ([0] * n for _ in range(5))
    for i in range(n - 1, -1, -1):
        x = order[i]
        if x.tag == "#text":
            chars[i], links[i], leaves[i], stops[i] = len(x.text), x.links, 1, len(_SENTENCE.findall(x.text))
        paragraphs[i] += x.tag == "p"
        if (p := parent[i]) >= 0:
            chars[p] += chars[i]
            links[p] += links[i]
            leaves[p] += leaves[i]
            paragraphs[p] += paragraphs[i]
            stops[p] += stops[i]
    total = max(1, chars[0])
    rows, above, depth, before = [], [_NONE] * n, [0] * n, 0
    place, same, many = [0] * n, [1.0] * n, [1] * n
    for x in order:
        if x.children:
            tags = Counter(y.tag for y in x.children)
            for k, y in enumerate(x.children):
                i = index[id(y)]
                place[i], same[i], many[i] = k, tags[y.tag] / len(x.children), len(x.children)
    for i, x in enumerate(order):
        p = parent[i]
        own, marks = _own(x.tag, x.words)
        if p >= 0:
            above[i] = tuple(map(max, above[p], marks)) if marks is not _NONE and marks != above[p] else above[p]
            depth[i] = depth[p] + 1
        else:
            above[i] = marks
        c, cp = max(1, chars[i]), max(1, chars[p])
        rows.append((*own, *above[i], depth[i], log1p(chars[i]), links[i] / c, chars[i] / max(1, leaves[i]), chars[i] / total, paragraphs[i], stops[i], stops[i] / c * 100, place[i] / many[i], many[i], same[i], chars[i] / cp, before / total, links[p] / cp, paragraphs[p], log1p(chars[p]), float("©" in x.text or "(c)" in x.text)))
        if x.tag == "#text":
            before += chars[i]
    return np.array(rows, np.float64)


_NONE = (0.0,) * (7 + len(WORDS))


@lru_cache(4096)
def _own(tag: str, words: frozenset[str]) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """A node's own marks, and those that its descendants inherit."""
    group = tuple(float(tag in g) for g in GROUPS)
    named = tuple(float(not g.isdisjoint(words)) for g in WORDS)
    marks = (*group[:1], *group[9:14], *group[15:16], *named)
    return group + named, marks if any(marks) else _NONE


def decode(order: list[Node], raw: np.ndarray) -> list[str]:
    """The kept runs of text under the best labelling in which a dropped node drops all below it."""
    n = len(order)
    keep, drop = -np.logaddexp(0, -raw), -np.logaddexp(0, raw)
    index = {id(x): i for i, x in enumerate(order)}
    below, best = drop.copy(), keep.copy()
    for i in range(n - 1, 0, -1):
        p = index[id(order[i].parent)]
        below[p] += below[i]
        best[p] += max(best[i], below[i])
    kept = [False] * n
    out = []
    for i, x in enumerate(order):
        kept[i] = best[i] > below[i] and (i == 0 or kept[index[id(x.parent)]])
        if kept[i] and x.text:
            out.append(x.text)
    return out


_SYLLABLES = "the an er in on re ti es th or en at ed nd to ha le la que ment eau ion ung ich sch ver ein ado ción os ar".split()


def _written_page(rng: random.Random) -> tuple[str, set[str]]:
    """A page of a random layout, and the marks of its main text (every run of text begins with a mark of its own)."""
    marks: set[str] = set()
    count = [0]

    def words(n: int) -> str:
        return " ".join("".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4))) for _ in range(n))

    def prose(main: bool, least: int, most: int) -> str:
        count[0] += 1
        mark = f"q{count[0]}q"
        if main:
            marks.add(mark)
        said = mark
        for _ in range(rng.randint(least, most)):
            said += " " + words(rng.randint(1, 14)).capitalize() + rng.choice([".", ".", ".", "!", "?", ""])
        return said + rng.choice(["", "", "", " &amp;", " | " + words(3)])

    def named(*names: str) -> str:
        name = rng.choice(names)
        return rng.choice([f' class="{name}"', f' id="{name}"', f' class="{name} {rng.choice("abcd")}{rng.randint(1, 9)}"']) if name else ""

    def listed(n: int, linked: bool = True) -> str:
        return "<ul>" + "".join(f'<li><a href="/{words(1)}">{prose(False, 0, 0)} {words(1)}</a></li>' if linked else f"<li>{prose(False, 1, 1)}</li>" for _ in range(n)) + "</ul>"

    def chrome() -> str:
        return rng.choice([
            lambda: f"<nav{named('', 'menu', 'main-nav')}>{listed(rng.randint(2, 9))}</nav>",
            lambda: f"<div{named('nav', 'menu', 'navbar', 'breadcrumbs')}>{listed(rng.randint(2, 7))}</div>",
            lambda: f"<header{named('', 'masthead', 'site-header')}><div>{prose(False, 0, 1)}</div>{listed(3)}</header>",
            lambda: f"<div{named('header', 'masthead', 'top')}><p>{prose(False, 1, 1)}</p></div>",
            lambda: f"<div{named('ad', 'ads', 'advert', 'sponsored', 'promo', 'banner ad')}>{prose(False, 1, 3)}</div>",
            lambda: f"<aside{named('', 'sidebar', 'related')}><h3>{prose(False, 0, 0)}</h3>{listed(rng.randint(2, 6), rng.random() < 0.7)}</aside>",
            lambda: f"<div{named('sidebar', 'widget', 'related', 'rail')}><h2>{prose(False, 0, 0)}</h2><p>{prose(False, 1, 4)}</p></div>",
            lambda: f"<div{named('cookie-notice', 'notice', 'consent', 'popup', 'gdpr', 'alert')}><p>{prose(False, 1, 3)}</p></div>",
            lambda: f"<form{named('', 'newsletter', 'search', 'login')}><label>{prose(False, 0, 1)}</label><input><p>{prose(False, 0, 2)}</p></form>",
        ])()

    def inner() -> str:
        return rng.choice([
            lambda: f"<div{named('ad', 'advert', 'sponsored', 'promo')}>{prose(False, 1, 3)}</div>",
            lambda: f"<div{named('share', 'social')}>{listed(3)}</div>",
            lambda: f"<aside{named('', 'related', 'more')}><p>{prose(False, 1, 2)}</p></aside>",
            lambda: f"<div{named('newsletter', 'subscribe', 'signup')}><form><p>{prose(False, 1, 2)}</p></form></div>",
        ])()

    def article() -> str:
        parts = [f"<h1>{prose(True, 0, 1)}</h1>"] if rng.random() < 0.85 else []
        loose = rng.random() < 0.4
        for _ in range(rng.choice([1, 2, 3, 5, 8, 12, 20])):
            text = prose(True, 1, rng.choice([1, 2, 5, 12, 40]))
            kind = rng.random()
            if kind < 0.6:
                parts.append(f"<p>{text}</p>")
            elif kind < 0.75:
                parts.append(f"<p><b>{text}<br>" if loose else f"<p><b>{text}</b></p>")
            elif kind < 0.8:
                parts.append(f"<h2>{prose(True, 0, 1)}</h2><p>{text}</p>")
            elif kind < 0.85:
                parts.append("<ul>" + "".join(f"<li>{prose(True, 1, 2)}" + "</li>" * (not loose) for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.9:
                parts.append(f"<blockquote><p>{text}</p></blockquote>")
            elif kind < 0.93:
                parts.append(f'<p>{text} <a href="/x">{words(2)}</a> {words(4)}.</p>')
            elif kind < 0.96:
                parts.append(f"<div>{text}</div>")
            elif rng.random() < 0.7:
                parts.append(f"<p>{text}</p>{inner()}")
        body = "".join(parts)
        return rng.choice([lambda: f"<article{named('', '', 'post', 'story')}>{body}</article>"] * 4 + [lambda: f"<main{named('', 'content')}>{body}</main>", lambda: f"<main><article>{body}</article></main>", lambda: f"<div{named('content', 'article-body', 'post', 'entry', 'story', 'main-text')}>{body}</div>", lambda: f"<section{named('', 'content', 'story')}>{body}</section>", lambda: f"<div>{body}</div>"])()

    before = "".join(chrome() for _ in range(rng.choice([0, 1, 2, 2, 3, 4])))
    after = "".join(chrome() for _ in range(rng.choice([0, 0, 1, 1, 2])))
    remarks = ""
    if rng.random() < 0.4:
        said = "".join(rng.choice([f"<div{named('comment', 'reply')}><p>{prose(False, 1, 4)}</p></div>", f"<li{named('comment')}>{prose(False, 1, 4)}</li>", f"<article{named('comment')}><p>{prose(False, 1, 4)}</p></article>"]) for _ in range(rng.randint(1, 6)))
        remarks = rng.choice([f"<section{named('comments', 'discussion')}><h3>{prose(False, 0, 0)}</h3>{said}</section>", f"<div{named('comments', 'replies')}>{said}</div>"])
    foot = rng.choice(["", f"<footer>&copy; {prose(False, 0, 1)}</footer>", f"<footer{named('', 'site-footer')}><p>{prose(False, 1, 2)}</p>{listed(3)}</footer>", f"<div{named('footer', 'copyright', 'legal')}>&copy; {prose(False, 1, 1)}</div>"])
    main = article() if rng.random() < 0.95 else ""
    if rng.random() < 0.3:
        main = f"<div{named('', 'wrapper', 'container', 'page')}>{before}{main}{remarks}{after}</div>"
        return f"<html><head><title>{words(3)}</title></head><body>{main}{foot}</body></html>", marks
    return f"<html><body>{before}{main}{remarks}{after}{foot}</body></html>", marks


def training_nodes(pages: int, seed: int) -> tuple[np.ndarray, np.ndarray, list[tuple[list[Node], set[str]]]]:
    rng = random.Random(seed)
    xs, ys, kept = [], [], []
    for _ in range(pages):
        page, marks = _written_page(rng)
        order = nodes_of(parse(page))
        index = {id(x): i for i, x in enumerate(order)}
        truth = np.zeros(len(order))
        for i in range(len(order) - 1, -1, -1):
            if order[i].text:
                truth[i] = order[i].text.split(" ", 1)[0] in marks
            if order[i].parent is not None and truth[i]:
                truth[index[id(order[i].parent)]] = 1
        xs.append(features(order))
        ys.append(truth)
        kept.append((order, marks))
    return np.concatenate(xs), np.concatenate(ys), kept


_models: dict[tuple[int, int], Trees] = {}


def fit(pages: int = 500, seed: int = 7) -> Trees:
    """Trees trained on ``pages`` written pages; kept for the session."""
    if (pages, seed) not in _models:
        x, y, _ = training_nodes(pages, seed)
        _models[pages, seed] = Trees(trees=50, depth=4, rate=0.3).fit(x, y)
    return _models[pages, seed]


def extract(pages: DataFrame, model: Trees | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    trees = model or fit()

    def make():
        def run(batches) -> Iterator[dict]:
            for b in batches:
                orders = [nodes_of(parse(p)) for p in b["html"].to_pylist()]
                raw = np.split(trees.raw(np.concatenate([features(o) for o in orders])), np.cumsum([len(o) for o in orders])[:-1]) if orders else []
                said = ["\n\n".join(decode(o, r)) for o, r in zip(orders, raw, strict=True)]
                yield {"page_id": b["page_id"], "url": b["url"], "text": said, "n_chars": [len(t) for t in said]}

        return run

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return arrow_map(rows, make, "page_id bigint, url string, text string, n_chars bigint", 128)
