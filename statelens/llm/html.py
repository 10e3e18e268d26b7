"""Operator 9: main text of web pages by tree scoring.

A page becomes a light tree. Every paragraph (and every other block's own text) passes points for its
length and commas to its parent, half of them to the grandparent and less to a few ancestors further up; a
container's score is discounted by its link density. The best container's article is kept with those of its siblings
that look like it. On pages without an article element the lowest node around all good containers is kept, with
what lies between them, and with prose, lists, tables and quotes before and behind; what is mostly links goes. Their text is read block by block: character references decoded,
white space inside a block made one space, blocks joined by one line break in page order.

Page furniture (menus, adverts, comments and so on) is told by tag, role, or a class or id of which a part is an advert
word, or every part is a furniture word or a neutral one; a named container that holds a page's h1, article or main element is none.
If nothing is left, names are ignored, but for comments.

Null and empty pages, and pages without any text outside of scripts and page furniture, give the empty
text. Nothing is capped; unclosed tags, stray end tags and cut-off pages are read as far as they go. The work
grows in proportion to the page, however deep its tags are nested.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

# HTML's element classes and the names of page furniture.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
FURNITURE = {"head", "nav", "footer", "aside", "form", "button", "select", "option", "input", "script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "object", "dialog", "menu", "header"}
COMMENTS = {"comment", "comments", "commentlist", "respond", "responses", "replies", "discussion", "disqus", "feedback"}
#: Words that name furniture wherever they stand in a name.
ADVERTS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "sponsors", "promo", "promos", "promotion"}
BAD_WORDS = COMMENTS | {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "sponsors", "promo", "promos", "promotion", "banner", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs",
    "footer", "masthead", "cookie", "cookies", "consent", "notice", "notices", "newsletter", "subscribe", "signup", "popup", "modal", "overlay", "share", "sharing", "social", "related", "recommend", "recommended", "recommendations",
    "pagination", "pager", "tags", "login", "search",
}
NEUTRAL = {
    "site", "page", "main", "top", "bottom", "left", "right", "side", "bar", "list", "area", "box", "wrap", "wrapper", "container", "inner", "outer", "block", "section", "widget", "slot", "unit", "post", "posts", "article", "articles", "links", "link",
    "buttons", "button", "icons", "form", "text", "header", "primary", "secondary", "global", "reader", "user", "the", "sign", "up", "sticky", "fixed", "mobile", "desktop", "small", "large",
}
BAD_NAMES = {"site-header", "page-header", "side-bar", "sign-up"}
PART = re.compile(r"[-_:]+")
BAD_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu", "menubar"}
# Quotes hold a > only as an attribute's value; "</" before anything but a letter opens a comment.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</(?![a-zA-Z])[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]*)|[^>=]+)*+)>|([^<]+|<(?![a-zA-Z/!?]))", re.S)
CUT = re.compile(r"<[/!?]?(?:\Z|[a-zA-Z](?:=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))|[^<])*+\Z)")
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>()")
NAMES = re.compile(r"""(?i)\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
SPACE = re.compile(r"\s+")
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


class Node:
    """An element: its tag, parent, children (nodes and strings), nearest block and whether it is page furniture.

    bad is 0 for content, 1 for furniture by name, 2 for furniture of any other kind and for comments. size and
    links count the characters of its text, and of them those in links.
    """

    __slots__ = ("bad", "block", "kids", "links", "parent", "points", "size", "story", "tag")

    def __init__(self, tag, parent, bad=0):
        self.tag, self.parent, self.bad, self.kids, self.points, self.size, self.links = tag, parent, bad, [], 0.0, 0, 0
        self.block = self if parent is None or tag in BLOCK else parent.block
        self.story = parent is not None and (parent.story or parent.tag in ("article", "main"))


def bad_name(value: str) -> int:
    """Whether a class or id names furniture (1) or comments (2)."""
    for token in value.lower().split():
        parts = [x for x in PART.split(token) if x and not x.isdigit()]
        if token in BAD_NAMES or parts and (any(x in ADVERTS for x in parts) or any(x in BAD_WORDS for x in parts) and all(x in BAD_WORDS or x in NEUTRAL for x in parts)):
            return 2 if any(x in COMMENTS for x in parts) else 1
    return 0


def _is_bad(tag: str, attrs: str, parent: Node) -> int:
    if tag == "header":
        return 0 if parent.story or parent.tag in ("article", "main") else 2  # a header inside the article holds its headings
    if tag in FURNITURE:
        return 2
    most = 0
    for m in NAMES.finditer(attrs) if attrs.strip() else ():
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            most = max(most, bad_name(value))
        if name == "role" and value.lower() in BAD_ROLE or name == "hidden" and tag != "body" or name == "aria-hidden" and value.lower() == "true":
            return 2
    return most


def parse(html: str) -> Node:
    """The page's tree."""
    root = at = Node("#root", None)
    pos, n = 0, len(html)
    opened: Counter = Counter()

    def close(node):
        """Leaves node and all that is open inside it."""
        up = at
        while up is not node:
            opened[up.tag] -= 1
            up = up.parent
        opened[node.tag] -= 1
        return node.parent

    while pos < n:
        # a quote that takes in all that follows ends with its tag
        m = TOKEN.match(html, pos) or LOOSE.match(html, pos)
        if not m:  # no > follows
            if CUT.match(html, pos):  # the page was cut off inside a tag
                break
            last = html.rfind("<")  # what lies before the last < is text, and so is that if no tag begins there
            at.kids.append(html[pos : last if last > pos else n])
            pos = last if last > pos else n
            continue
        pos = m.end()
        if m[4]:
            at.kids.append(m[4])
            continue
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if opened[tag] > 0:
                up = at
                while up.tag != tag:
                    up = up.parent
                at = close(up)
            continue
        if tag in BLOCK:
            closes = ("p", "li") if tag == "li" else ("p", "td", "th", "tr") if tag == "tr" else ("p", "td", "th") if tag in ("td", "th") else ("p",)
            while at.block.parent and at.block.tag in closes:
                at = close(at.block)
        node = Node(tag, at, _is_bad(tag, m[3], at))
        at.kids.append(node)
        if tag in ("h1", "article", "main"):
            up = at
            while up and up.bad == 1:  # furniture by name only, but the page's matter is in it
                up.bad = 0
                up = up.parent
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, pos)
            pos = end.end() if end else n
        elif tag not in VOID and not m[3].endswith("/"):
            at = node
            opened[tag] += 1
    return root


def _walk(node: Node, ignored: int = 0):
    """Nodes outside of furniture (of more than ``ignored``), parents first."""
    stack = [node]
    while stack:
        x = stack.pop()
        if x.bad <= ignored:
            yield x
            stack += [k for k in reversed(x.kids) if isinstance(k, Node)]


def _measure(root: Node, ignored: int) -> list[Node]:
    """The nodes outside of furniture, parents first, with size and links set: each is summed once, from its children."""
    nodes = list(_walk(root, ignored))
    for x in nodes:
        x.points = 0.0
        x.size = sum(len(k.strip()) for k in x.kids if isinstance(k, str))
        x.links = x.size if x.tag == "a" else 0
    for x in reversed(nodes):
        if x.tag == "a":
            x.links = x.size
        if x.parent and x is not root:
            x.parent.size += x.size
            x.parent.links += x.links
    return nodes


def _own(node: Node, ignored: int) -> str:
    """A block's text without that of the blocks inside."""
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        for k in x.kids:
            if isinstance(k, str):
                out.append(k)
            elif k.bad <= ignored and k.tag not in BLOCK:
                stack.append(k)
    return SPACE.sub(" ", "".join(out)).strip()


#: Shares of a paragraph's points for its parent and the ancestors above.
SHARES = (1.0, 0.5, 1 / 6, 1 / 9, 1 / 12, 1 / 15)


#: Shares of the best container's own points from which another one is good too, and of the links from which text is a menu.
GOOD, MENU = 0.2, 0.5
LISTED = {"p", "pre", "blockquote", "table", "ul", "ol", "dl", "figure"}


def best(root: Node, ignored: int = 0) -> list[Node]:
    """The nodes to keep, in page order."""
    nodes, scored = _measure(root, ignored), {}
    own: dict = {}
    density = lambda x: 1 - x.links / max(1, x.size)
    for node in nodes:
        if node.tag not in BLOCK or node.tag in HEADINGS:
            continue
        text = _own(node, ignored)
        if len(text) < 25:
            continue
        points = (1 + text.count(",") + min(len(text) / 100, 3)) * density(node)
        up = node.parent if node.tag in ("p", "pre", "td", "blockquote", "li", "dd") else node
        own[up] = own.get(up, 0.0) + points
        for share in SHARES:
            if not up or up.tag == "#root":
                break
            up.points += points * share
            scored[up] = None
            up = up.parent
    if not scored:
        return [root]
    final = {node: node.points * density(node) for node in scored}
    top = max(scored, key=lambda x: final[x])
    up = top
    while up and up.tag not in ("article", "main"):
        up = up.parent
    if not up:
        return _around(nodes, own, density, ignored)
    top = up
    if top.parent is None or top.tag == "main":
        return [top]
    keep, bar, alike = [], max(10.0, 0.2 * final.get(top, 0.0)), 0.1 * top.size
    for k in top.parent.kids:
        if not isinstance(k, Node) or k.bad > ignored:
            continue
        if k is top or final.get(k, 0) >= bar or k.tag == top.tag == "article" and k.size >= alike and k.points and density(k) > 0.5:
            keep.append(k)
        elif k.tag in HEADINGS:
            keep.append(k)
        elif k.tag == "p" and k.links * 4 < k.size and (k.size > 80 or (k.links == 0 and k.size and _own(k, ignored)[-1:] in ".!?")):
            keep.append(k)
    return keep


def _around(nodes: list[Node], own: dict, density, ignored: int) -> list[Node]:
    """Without an article element: the lowest node around all good containers, without what in it is a menu or stands outside.

    own: the points of each container's own paragraphs. Between the first and the last good part everything stays
    that isn't mostly links; before and behind them headings and prose, lists, tables and quotes.
    """
    bar = GOOD * max(p * density(x) for x, p in own.items())
    good = {x for x, p in own.items() if p * density(x) >= bar}
    # how many of them each node holds; the last node that holds all is the lowest
    holds = dict.fromkeys(good, 1)
    for x in reversed(nodes):
        if x in holds and x.parent:
            holds[x.parent] = holds.get(x.parent, 0) + holds[x]
    around = next(x for x in reversed(nodes) if holds.get(x) == len(good))
    if around in good and around.parent and around.parent.tag != "#root":
        around = around.parent  # what stands beside the only good container is looked at too
    for level in (around, *(x for x in good if x.parent is around)):
        kids = [k for k in level.kids if isinstance(k, Node) and k.bad <= ignored and k.tag in BLOCK]
        # a container that has good paragraphs of its own begins with the first and ends with the last of them
        mine = level in good
        at = [i for i, k in enumerate(kids) if k in holds or mine and k.tag in LISTED and len(_own(k, ignored)) >= 25 and density(k) > MENU]
        first, last = (at[0], at[-1]) if at else (0, len(kids) - 1)
        strict = level.tag in ("body", "html", "#root")
        for i, k in enumerate(kids):
            if k in holds or k.tag in HEADINGS or k.size == 0:
                continue
            if k.links > MENU * k.size or not first <= i <= last and not _is_prose(k, strict, ignored):
                k.bad = 3
    return [around]


#: What short blocks beside a page's parts say that are none of the article.
SMALL_PRINT = re.compile(r"(?i)copyright|\u00a9|&copy;|all rights reserved|cookies?\b|privacy|terms of (use|service)|imprint|newsletter|subscribe|sign up|log ?in\b")


def _is_prose(k: Node, strict: bool, ignored: int) -> bool:
    """Whether a block outside of the good parts reads like one of them; strictly, where it stands beside the page's other parts."""
    if k.links * 4 >= k.size:
        return False
    text = text_of([k], ignored)
    if k.size < 200 and SMALL_PRINT.search(text):
        return False
    if strict:
        return k.tag in LISTED and k.size > 80 or k.links == 0 and text[-1:] in ".!?"
    return k.tag in LISTED or k.size > 80 or text[-1:] in ".!?:"


def text_of(nodes: list[Node], ignored: int = 0) -> str:
    """The nodes' blocks, one on a line."""
    blocks: list[list[str]] = [[]]
    for top in nodes:
        stack: list = [top]
        while stack:
            x = stack.pop()
            if x is None:
                blocks.append([])
            elif isinstance(x, str):
                blocks[-1].append(x)
            elif x.bad <= ignored:
                edge = x.tag in BLOCK or x.tag == "#root"
                if x.tag == "br":
                    blocks[-1].append(" ")
                if edge:
                    blocks.append([])
                    stack.append(None)
                stack += reversed(x.kids)
        blocks.append([])
    lines = (SPACE.sub(" ", unescape("".join(b))).strip() for b in blocks)
    return "\n".join(x for x in lines if x)


def main_text(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    root = parse(html)
    return text_of(best(root)) or text_of(best(root, 1), 1)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages without the html, with ``text`` and ``n_chars`` (code points)."""
    keep = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    schema = pages.select(*keep).schema.add("text", "string").add("n_chars", "long")

    def run(batches):
        for b in batches:
            column = b.column(b.schema.get_field_index(html))
            for lo in range(0, b.num_rows, 500):
                made = [main_text(x.as_py()) for x in column.slice(lo, 500)]
                cols = [b.column(b.schema.get_field_index(c)).slice(lo, 500) for c in keep]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(made, pa.string()), pa.array([len(t) for t in made], pa.int64())], [*keep, "text", "n_chars"])

    return pages.select(*keep, html).mapInArrow(run, schema)
