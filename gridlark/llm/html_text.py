"""Main-text extraction by tree scoring.

Each paragraph earns points for its length and its commas; the points go to its ancestors, whole to the parent and half as
much to each one above, and every container's sum is discounted by the share of its text that stands in links. The best
container (of rows their table, and the article element around it) is kept together with the siblings that look like more of the same article.

Scripts, styles and other parts without text never count. Menus, headers, footers, notices, adverts, forms and comment threads,
known by their elements, roles or class names, go before containers are scored, unless the page's article is in them: names
such as `layout header-fixed` or a form around the whole page say nothing if most points of the page are inside. A header
or footer element inside the article goes too, with the title or standfirst that it holds.

Cases: a null, empty or text-free page gives an empty string; broken markup (unclosed or stray tags) is repaired as
browsers do for paragraphs, lists and cells, within skipped parts too, and unknown declarations are comments; pages without a scored paragraph fall back to the body; equal pages give equal rows;
extra columns of the input are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML's void and block elements, and the parts of a page that are never article text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol p pre section summary table tbody td tfoot th thead title tr ul caption".split()
)
NEVER = frozenset("script style noscript template svg math iframe object embed canvas audio video head title select textarea input option button dialog".split())
ASIDE = frozenset("nav header footer aside form menu label fieldset".split())
CLOSES_P = BLOCK - frozenset("body html title tr td th tbody thead tfoot caption li dt dd".split())
SCOPE = frozenset("html body table td th caption div article section main aside nav header footer form blockquote".split())
_CELL, _ROW, _ROWS = {"td", "th"}, {"tr"}, {"tbody", "thead", "tfoot", "caption"}
#: What a start tag closes, from the inside out: a cell ends with the next cell, row or group of rows, whether its end tag stands there or not.
PEERS = {"li": [{"li"}], "dt": [{"dt", "dd"}], "dd": [{"dt", "dd"}], "option": [{"option"}], "td": [_CELL], "th": [_CELL], "tr": [_CELL, _ROW, {"caption"}]}
PEERS |= {tag: [_CELL, _ROW, _ROWS] for tag in ("tbody", "thead", "tfoot")}
BOILER = re.compile(
    r"(^|[_-])(ads?|advert\w*|adsense|adbox|sponsor\w*|banner|promo\w*|outbrain|taboola|sidebar|side-?bar|menu|nav|navbar|"
    r"navigation|breadcrumbs?|pagination|pager|footer|foot|header|masthead|topbar|cookies?|consent|gdpr|notice|alert|modal|popup|"
    r"overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|widget|toolbar|skip-link|search|"
    r"copyright|legal|disclaimer)($|[_-])",
    re.I,
)
COMMENTS = re.compile(r"(^|[_-])(comments?|commentlist|disqus|respond|replies|discussion)($|[_-])", re.I)
MODIFIER = re.compile(r"(has|with|without|no|is|not|hide|show)-", re.I)  # such a name tells of something else on the page
ARTICLE = re.compile(r"(^|[\s_-])(article|body|content|entry|hentry|main|page|post|story|text|blog)($|[\s_-])", re.I)
BOILER_ROLE = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
SEALED = frozenset("iframe noscript template object select textarea svg math".split())  # inner end tags close nothing outside
HEAD = frozenset("title meta link base basefont bgsound noframes script style noscript template".split())
LONG_REFERENCE = re.compile(r"&#[0-9]{4000,};?")  # more digits than int() takes; no such character
PARAGRAPH = frozenset("p pre td blockquote li dd".split())


class Node:
    __slots__ = ("tag", "attrs", "parent", "kids", "score", "n_text", "n_link", "own", "own_link", "commas", "off", "kind", "points", "p_open")

    def __init__(self, tag: str, attrs: dict, parent: Node | None, off: bool = False, kind: str = ""):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.kids: list = []
        self.score = self.points = 0.0
        self.n_text = self.n_link = 0  # characters, and those of them in links
        self.own = self.own_link = self.commas = 0  # the same without what stands in inner blocks
        self.off = off  # in a part that doesn't count, or counts only if the article is in it
        self.p_open = tag == "p" or bool(parent and parent.p_open and tag not in SCOPE)  # a later block closes a paragraph
        self.kind = kind  # of such a part: never, element, name, sure name or comments


def kind_of(tag: str, attrs: dict) -> str:
    """What part of a page an element is by itself: "" for the article and all that may hold it."""
    if tag in NEVER:
        return "never"
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in (attrs.get("style") or "").replace(" ", "").lower():
        return "never" if tag not in ("html", "body") else ""
    if tag in ("html", "body", "article", "main") and not (tag == "article" and any(map(COMMENTS.search, names_of(attrs)))):
        return ""
    names = [x for x in names_of(attrs) if not MODIFIER.match(x)]
    if any(map(COMMENTS.search, names)):
        return "comments"
    if tag in ASIDE or attrs.get("role") in BOILER_ROLE:
        return "element"
    found = [m for m in map(BOILER.search, names) if m]
    return ("sure name" if any(m[0] == m.string for m in found) else "name") if found else ""


def names_of(attrs: dict) -> list[str]:
    return f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split()


class _Tree(HTMLParser):
    """The page as nodes; parts that never count are left out while reading."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", {}, None)

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i)  # as browsers do; the base class raises for unknown ones

    def _close_to(self, tags, scope) -> None:
        n = self.at
        while n.parent is not None and n.tag not in scope:
            if n.tag in tags:
                self.at = n.parent
                return
            # An item inside a skipped part is none of the list around that part.
            if n.off and not n.parent.off and not tags & {"td", "th", "p"} and n.tag in BLOCK | SEALED and n.tag not in ("div", "p", "address"):
                return
            n = n.parent

    def handle_starttag(self, tag, attrs):
        if self.at.tag == "head" and tag not in HEAD:
            self.at = self.at.parent
        if tag in CLOSES_P and self.at.p_open:
            self._close_to({"p"}, SCOPE)
        if tag in PEERS:
            for tags in PEERS[tag]:
                self._close_to(tags, {"ul", "ol", "dl", "table", "select"})
        off, attrs = self.at.off, dict(attrs)
        kind = "" if self.dead else kind_of(tag, attrs)
        if not kind and tag in ("html", "body") and (tag == "html" or off or any(isinstance(k, Node) and k.tag == "body" for k in self.root.kids)):
            return
        node = Node(tag, attrs, self.at, off or bool(kind), kind)
        if self.dead or kind == "never":
            node.kids = None  # nothing is kept of it
        if not self.dead:
            self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    @property
    def dead(self) -> bool:
        """Inside a part of which nothing is kept."""
        return self.at.kids is None

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:  # "<div/>" opens a div in HTML
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None:
            if n.tag == tag:
                self.at = n.parent
                return
            if n.tag in ("td", "th", "table", "article", "main", "body") and tag not in ("table", "tr", "article", "main", "body", "html"):
                return
            if n.tag in SEALED and tag not in ("body", "html"):
                return
            if n.off and not n.parent.off and n.tag in BLOCK and tag not in BLOCK:
                return
            n = n.parent

    def handle_data(self, data):
        if data and not self.dead:
            self.at.kids.append(data)


_COMMA = re.compile("[,،、，]")


def _walk(node: Node) -> list[Node]:
    """Nodes below, children before parents, without recursion."""
    order, todo = [], [node]
    while todo:
        n = todo.pop()
        order.append(n)
        todo.extend(k for k in n.kids or () if isinstance(k, Node))
    return order[::-1]


def _measure(order: list[Node]) -> None:
    """Sizes of all nodes, each from its children's."""
    for n in order:
        n.n_text = n.n_link = n.own = n.own_link = n.commas = 0
        for k in n.kids or ():
            if isinstance(k, str):
                size = len(k.strip())
                n.n_text += size
                n.own += size
                n.commas += len(_COMMA.findall(k))
            else:
                n.n_text += k.n_text
                n.n_link += k.n_link
                if k.tag not in BLOCK:
                    n.own += k.own
                    n.own_link += k.own_link
                    n.commas += k.commas
        if n.tag == "a":
            n.n_link, n.own_link = n.n_text, n.own


def link_density(n: Node) -> float:
    return n.n_link / n.n_text if n.n_text else 0.0


def points_of(n: Node) -> float:
    """A paragraph's points: blocks that hold running text of their own, paragraph elements of any length."""
    if not n.own or n.tag not in BLOCK or n.tag[0] == "h" or (n.own < 25 and n.tag not in PARAGRAPH):
        return 0.0
    return (1 + n.commas + min(n.own / 100, 3)) * (1 - n.own_link / n.own)


def drop_asides(root: Node) -> None:
    """Takes out the parts that are known by element, role or name, unless the page's article is in them."""
    order = _walk(root)
    _measure(order)
    inside = {}  # of each node: points without comment threads, points of article and main elements
    for n in order:
        all_, held = points_of(n), 0.0
        for k in n.kids or ():
            if isinstance(k, Node) and k.kind != "comments":
                all_, held = all_ + inside[k][0], held + inside[k][1]
        inside[n] = all_, all_ if n.tag in ("article", "main") and not n.kind else held
    total, held = inside[root]
    open_ = 0.0  # of articles outside such parts
    todo = [root]
    parts = []
    while todo:
        n = todo.pop()
        if n.kind and n is not root:
            parts.append(n)
        elif n.tag in ("article", "main"):
            open_ += inside[n][0]
        else:
            todo.extend(k for k in n.kids or () if isinstance(k, Node))
    least = {"form": 0.5, "name": 0.7, "sure name": 0.99}
    while parts:
        n = parts.pop()
        if n.kids is None:
            continue
        all_, mine = inside[n]
        most = least.get("form" if n.tag == "form" else n.kind, float("inf"))
        if open_ == 0 and (mine > 0.5 * held > 0 or (held == 0 and all_ > most * total)):
            n.kind = ""
            todo = [n]
        elif n.kind == "comments" and mine > 0.5 * total:
            n.kind = ""
            todo = [n]
        else:
            n.kids = None
            todo = []
        while todo:  # parts inside one that stays are judged in their turn
            for k in todo.pop().kids or ():
                if isinstance(k, Node):
                    (parts if k.kind else todo).append(k)
    for n in order:  # parts inside articles
        if n.kind:
            n.kids = None


def best_container(order: list[Node]) -> Node | None:
    """The node whose points, discounted by its share of links, are the most; of equal ones the innermost and first."""
    sums: dict[Node, float] = {}
    best = None
    for n in order:
        own = points_of(n)
        sums[n] = total = (own if n.tag not in PARAGRAPH else 0.0) + n.points
        if total > 0:
            names = f"{n.attrs.get('class') or ''} {n.attrs.get('id') or ''}"
            n.score = (total + 25.0 * (n.tag in ("article", "main")) + 15.0 * bool(ARTICLE.search(names))) * (1 - link_density(n))
            if best is None or n.score > best.score:
                best = n
        if n.parent is not None:
            n.parent.points += total / 2 + (own if n.tag in PARAGRAPH else 0.0)
    return best


def kept_parts(best: Node) -> list[Node]:
    """The best container, or the article around it, and the siblings that carry on the article, in page order."""
    around = best
    while around is not None and around.tag != "article":
        around = around.parent
    best = around or best
    while best.tag in ("tr", *_ROWS) and best.parent is not None:  # rows of running text: their table
        best = best.parent
    if best.parent is None or best.tag == "body":
        return [best]
    out = []
    least = max(10.0, 0.2 * best.score)
    for k in best.parent.kids:
        if not isinstance(k, Node):
            continue
        alike = 0.2 * best.score if k.tag == best.tag and k.attrs.get("class") and k.attrs.get("class") == best.attrs.get("class") else 0
        if k is best or k.score + alike >= least:
            out.append(k)
        elif k.tag in ("p", "pre", "blockquote") and link_density(k) < 0.25 and (k.n_text > 80 or k.n_text and not k.n_link):
            out.append(k)
        elif k.tag in ("h1", "h2", "h3") and k.n_text and not k.n_link:
            out.append(k)
    return out


def _is_list_of_links(n: Node) -> bool:
    return n.tag in ("ul", "ol", "dl", "table", "div", "section") and n.n_text > 0 and n.n_link >= 0.6 * n.n_text and sum(isinstance(k, Node) for k in n.kids or ()) > 1


def drop_link_lists(part: Node) -> None:
    """Takes lists of links before the first and after the last paragraph out of a container; those between, and an article's, stay."""
    if part.tag == "article":
        return
    order = _walk(part)[::-1]
    running = [k for k, n in enumerate(order) if points_of(n) * (n.own - n.own_link) >= 25]
    first, last = (running[0], running[-1]) if running else (len(order), -1)
    prose = set()  # nodes with a p element inside
    for n in reversed(order):
        if n.tag == "p" or any(isinstance(k, Node) and k in prose for k in n.kids or ()):
            prose.add(n)
    for k, n in enumerate(order):
        if n is not part and n not in prose and not first < k < last and _is_list_of_links(n):
            n.kids = None


def blocks(parts: list[Node]) -> list[str]:
    out: list[str] = []
    run: list[str] = []

    def end():
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append(text)

    for part in parts:
        end()
        todo: list = [part]
        while todo:
            n = todo.pop()
            if n is None:
                end()
            elif isinstance(n, str):
                run.append(n)
            elif n.kids is None:
                end() if n.tag in BLOCK else run.append(" ")
            elif n.tag == "br":
                run.append(" ")
            else:
                if n.tag in BLOCK:
                    end()
                    todo.append(None)
                todo.extend(reversed(n.kids))
        end()
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    tree = _Tree()
    tree.feed(LONG_REFERENCE.sub("\ufffd", html))
    tree.close()
    drop_asides(tree.root)
    order = _walk(tree.root)
    _measure(order)
    best = best_container(order)
    parts = kept_parts(best) if best is not None else [tree.root]
    for part in parts:
        drop_link_lists(part)
    return "\n".join(blocks(parts))


def extract(pages: DataFrame, html_col: str = "html"):
    """Column expression: the main text of each page."""

    @F.pandas_udf("string")
    def text(html: pd.Series) -> pd.Series:
        return pd.Series([main_text(x) for x in html], dtype=object)

    return text(F.col(html_col).cast("string"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    return pages.select("page_id", "url", extract(pages).alias("text")).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars")
    )
