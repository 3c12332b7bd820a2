"""HTML extraction by tree scoring.

A page becomes a light tree (tags that imply the end of others are closed as
browsers do).  Subtrees that are never part of an article go: scripts, styles,
forms, menus, footers, sidebars, adverts, by tag or role.  Adverts, notices
and comments also go by the words of class and id, but inside the article only
if they read like it: mostly links, or without a paragraph.  Each paragraph's points, for being one, for its
commas and for its length, are passed to its ancestors, less with each level;
a container's total is discounted by the share of its text that lies in
links.  The best container is kept, widened to the ``article`` or ``main``
element it lies in, of whose other parts those that read like menus (several
links with most of the text) go, and else joined by those of its siblings that
score or read like it.  Their blocks make up the text, in page order.

Null, empty and textless pages give an empty text.  Broken markup is read as
far as it goes; an unclosed comment, script or style hides the rest.  Of
containers with the same worth the first is the best.  Pages are read whole,
in time that grows with their length; equal pages give equal rows, a repeated
id a row each time, an empty table none.  Only the three columns are read.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import register, slices, table

_MARKUP = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(script|style|title|textarea|noscript|iframe|xmp|noembed)(?=[\s/>])[^>]*+(?:>.*?(?:</\1(?=[\s/>])[^>]*+(?:>|\Z)|\Z)|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)(?:>|\Z)", re.S | re.I)
_ATTR = re.compile(r"([^\s/>=\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>]++)))?+|\"[^\"]*+\"?|'[^']*+'?")
_WORD = re.compile("[A-Z]?[a-z]+|[A-Z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr img "
                   "math semantics mi mn mo ms mtext mrow mstyle mpadded menclose mfrac msqrt mroot msub msup msubsup munder mover "
                   "munderover mmultiscripts mtable mtr mtd".split())
#: Elements that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split())
#: Elements ended by the next of the same kind, and where that search stops.
ENDS_SAME = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
             "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
             "option": ({"option"}, {"select"})}
DROPPED = frozenset("nav aside footer form button select menu dialog template svg canvas object audio video map head "
                    "fieldset datalist applet annotation annotation-xml".split())
DROPPED_ROLES = frozenset("navigation banner complementary contentinfo search alert alertdialog dialog menu menubar toolbar form".split())
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements adsense sponsor sponsored promo promotion promoted banner sidebar "
    "nav navbar navigation menu breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social related recommended recommendations comment comments disqus respond replies "
    "pagination pager widget toolbar masthead skip outbrain taboola".split())
KEPT_TAGS = frozenset("html body article main".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAST_PARAGRAPH = 25
#: From this share of its text in links on, a part reads like a menu.
MOST_LINKED = 0.5


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "never", "suspect", "inside", "length", "linked", "commas", "own", "score")

    def __init__(self, tag: str, parent: Node | None, dropped: bool, suspect: bool = False, inside: bool = False):
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.never = dropped  # whatever the suspects turn out to be
        self.suspect, self.inside = suspect, inside  # by class or id; in an article or main element
        self.children: list = []
        self.length = self.linked = self.commas = self.own = 0
        self.score = 0.0


def unwanted(tag: str, attrs: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is never part of an article, and whether the words
    of its class and id say that it may not be."""
    if tag in DROPPED or tag == "header" and not in_article:
        return True, False
    if not attrs or attrs == "/":
        return False, False
    suspect = False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True, False
        if name == "role" and value.lower() in DROPPED_ROLES:
            return True, False
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, False
        if name in ("class", "id") and tag not in KEPT_TAGS:
            words = {w.lower() for w in _WORD.findall(value)}
            if "header" in words and not in_article and tag not in HEADINGS:
                return True, False
            suspect = suspect or bool(words & DROPPED_WORDS)
    return False, suspect


def judge(nodes: list[Node]) -> tuple[set[Node], set[Node]]:
    """Drop the suspects in an article or main element that read like no part
    of it, and for now all others; returned are those of the dropped that read
    well, and those that do not.
    Paragraphs of a suspect that lie in another one do not speak for it."""
    if not any(n.suspect for n in nodes):
        return set(), set()
    total: dict[Node, list[int]] = {}  # length, length in links, paragraphs
    for node in reversed(nodes):
        length = linked = good = 0
        for child in node.children:
            if isinstance(child, str):
                length += len(child.strip())
            elif child in total:
                n, m, k = total[child]
                length += n
                linked += n if child.tag == "a" else m
                if not child.suspect or child.tag in PARAGRAPHS:
                    good += k
        if node.dropped:
            length = linked = good = 0
        elif node.tag in PARAGRAPHS and length >= LEAST_PARAGRAPH and linked < MOST_LINKED * length:
            good += 1
        total[node] = [length, linked, good]
    held, bad = set(), set()
    within = {nodes[0]: None}  # the paragraph or heading that a node lies in
    for node in nodes[1:]:
        up = node.parent
        around = within[node] = up if up.tag in PARAGRAPHS or up.tag in HEADINGS else within[up]
        node.dropped = node.dropped or up.dropped
        if node.never or not node.suspect:
            continue
        length, linked, good = total[node]
        if node.tag in INLINE and around is not None:
            well = total[around][0] > length
        else:
            well = (good > 0 or node.tag in PARAGRAPHS or node.tag in HEADINGS) and linked < MOST_LINKED * length
        if not (well and node.inside):
            node.dropped = True
            (held if well else bad).add(node)
    return held, bad


def restore(held: set[Node], bad: set[Node], roots: list[Node], nodes: list[Node]) -> None:
    """Take back the suspects below the kept nodes; below a whole page only
    paragraphs, headings and parts of them."""
    whole = any(r.tag in ("body", "html", "#root") for r in roots)
    below = set(roots)
    back: set[Node] = set()
    for node in nodes:
        if node.parent in below:
            below.add(node)
        if node not in below or node.never:
            continue
        if node in held:
            well = not node.parent.dropped and (not whole or node.tag in PARAGRAPHS or node.tag in HEADINGS or node.tag in INLINE)
        else:
            well = node.parent in back and node not in bad
        if well:
            node.dropped = False
            back.add(node)


def parse(html: str) -> list[Node]:
    """All nodes of a page in page order, the root first."""
    root = Node("#root", None, False)
    nodes, open_, node = [root], {"#root": 1}, root

    def close(last: Node) -> Node:
        """Close the open elements down to ``last`` and return its parent."""
        x = node
        while True:
            open_[x.tag] -= 1
            if x is last:
                return x.parent
            x = x.parent

    at = 0
    for m in _MARKUP.finditer(html):
        if m.start() > at:
            node.children.append(html[at:m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if m[2]:
            if tag == "br":
                node.children.append(" ")
            elif open_.get(tag):
                x = node
                while x.tag != tag:
                    x = x.parent
                node = close(x)
            continue
        if tag in ENDS_P and open_.get("p"):
            x = node
            while x.tag != "p" and x.tag not in ("td", "th", "button", "#root"):
                x = x.parent
            if x.tag == "p":
                node = close(x)
        if tag in ENDS_SAME:
            ended, bound = ENDS_SAME[tag]
            if any(open_.get(t) for t in ended):
                x, found = node, None
                while x.tag not in bound and x.tag != "#root":
                    found = x if x.tag in ended else found
                    x = x.parent
                if found:
                    node = close(found)
        if tag in VOID:
            if tag in ("br", "img", "wbr"):
                node.children.append(" " if tag != "wbr" else "")
            else:
                child = Node(tag, node, True)
                node.children.append(child)
            continue
        in_article = bool(open_.get("article") or open_.get("main"))
        drop, suspect = unwanted(tag, m[4] or "", in_article)
        child = Node(tag, node, node.dropped or drop, suspect, in_article)
        node.children.append(child)
        nodes.append(child)
        open_[tag] = open_.get(tag, 0) + 1
        if not (m[4] or "").endswith("/") or tag not in ("svg", "path", "use"):
            node = child
        else:
            open_[tag] -= 1
    if at < len(html):
        node.children.append(html[at:])
    return nodes


def weigh(nodes: list[Node]) -> None:
    """Lengths, commas and scores, from the leaves up."""
    for node in reversed(nodes):
        if node.dropped:
            continue
        for child in node.children:
            if isinstance(child, str):
                n = len(child.strip())
                node.length += n
                node.own += n
                node.commas += child.count(",")
            elif not child.dropped:
                node.length += child.length
                node.commas += child.commas
                node.linked += child.length if child.tag == "a" else child.linked
                if child.tag in INLINE:
                    node.own += child.length
    for node in nodes:
        if node.dropped or node.tag in INLINE or node.length < LEAST_PARAGRAPH:
            continue
        if node.tag in PARAGRAPHS or node.own >= LEAST_PARAGRAPH and node.tag not in HEADINGS:
            points = 1 + node.commas + min(node.length / 100, 3)
            x, level = node.parent, 1
            while x is not None and level <= 4:
                x.score += points / level
                x, level = x.parent, level + 1


def worth(node: Node) -> float:
    return node.score * (1 - node.linked / node.length) if node.length else 0.0


def reads_like_menu(node: Node) -> bool:
    """A part of several links that hold most of its text."""
    if node.length == 0 or node.linked < MOST_LINKED * node.length:
        return False
    links, todo = 0, [node]
    while todo:
        x = todo.pop()
        links += x.tag == "a"
        todo += [c for c in x.children if isinstance(c, Node) and not c.dropped]
    return links > 1


def drop_menus(whole: Node, best: Node) -> None:
    """Judge what the widened element adds to the best container: parts beside
    the way from one to the other (and parts of the element itself, where it is
    the best) go if they read like a menu; paragraphs and headings stay."""
    on_way, x = [], best
    while x is not whole:
        on_way.append(x)
        x = x.parent
    for parent in [*on_way[1:], whole]:
        for child in parent.children:
            if (isinstance(child, Node) and not child.dropped and child is not best and child not in on_way
                    and child.tag not in INLINE and child.tag not in PARAGRAPHS and child.tag not in HEADINGS and reads_like_menu(child)):
                child.dropped = True


def kept_nodes(nodes: list[Node]) -> list[Node]:
    """The best container, or it and the siblings that belong to it."""
    best = max((n for n in nodes if not n.dropped and n.tag not in INLINE), key=worth, default=None)
    if best is None or worth(best) <= 0:
        every = [n for n in nodes if n.tag in ("article", "main", "body") and not n.dropped]
        return [min(every, key=lambda n: ("article", "main", "body").index(n.tag))] if every else nodes[:1]
    for wanted in ("article", "main"):
        x = best
        while x is not None and x.tag != wanted:
            x = x.parent
        if x is not None:
            drop_menus(x, best)
            return [x]
    if best.parent is None:
        return [best]
    least = max(10.0, worth(best) / 5)
    out = []
    for x in best.parent.children:
        if x is best:
            out.append(x)
        elif isinstance(x, Node) and not x.dropped and x.length:
            density = x.linked / x.length
            if worth(x) >= least or x.tag == "section" == best.tag and density == 0 or x.tag in HEADINGS and density < 0.2 or x.tag in PARAGRAPHS and (density < 0.25 if x.length > 80 else density == 0):
                out.append(x)
    return out


def blocks(roots: list[Node]) -> list[str]:
    """The blocks of text below some nodes, in page order."""
    out: list[str] = []
    part: list[str] = []

    def flush() -> None:
        text = " ".join(unescape("".join(part)).split()) if part else ""
        if text:
            out.append(text)
        part.clear()

    stack: list = [x for root in reversed(roots) for x in (flush, root)]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            part.append(x)
        elif callable(x):
            x()
        elif x.tag == "hr":
            flush()
        elif not x.dropped:
            if x.tag in ("td", "th"):
                part.append(" ")
                stack.append(" ")
            elif x.tag not in INLINE:
                flush()
                stack.append(flush)
            stack.extend(reversed(x.children))
    flush()
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    nodes = parse(html)
    held, bad = judge(nodes)
    weigh(nodes)
    roots = kept_nodes(nodes)
    if held:
        restore(held, bad, roots, nodes)
    return "\n\n".join(blocks(roots))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each page (columns page_id, url, html)."""
    rows = pages.select("page_id", "url", "html")

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "html"):
                texts = [main_text(x) for x in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


@register("op1_html_extract")
def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
