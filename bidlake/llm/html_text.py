"""Operator 1: main text of web pages by composite text density.

Every node of the page's tree gets a link-adjusted number of characters per tag (the
composite text density of Sun, Song and Liao, 2011). Densities of children are summed,
the node with the largest sum is the core of the article, and its ancestors join it
while they are at least as dense as the body, the threshold of the path. What marks
itself as page furniture (navigation, forms, notices, ...) neither competes nor prints, unless it
holds most of the page's text: then it is the layout around the article, by class only if the page's
own article mark stands in it too.

Defined results: null, empty and textless pages give an empty text, and a null page keeps its row;
an empty table gives no rows; pages cut off anywhere are read as far as they go, an unfinished tag
at the end is dropped; a quote that is never closed ends with its tag; unclosed and misnested tags close
as browsers close them; very long and very deep pages take time in proportion to their length; equal rows
get equal results. Only the id, address and page columns are read, so extra columns never clash.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, schema_of, utf8

# Element names by their role, and words of class, id or role that mark furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg annotation annotation-xml canvas object audio video select noframes title".split())
DROPPED = frozenset("nav footer aside button dialog menu head map option label".split())
FORMS = frozenset("form fieldset".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
CLOSED_BY = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words before a furniture word that say a layout lacks or has it ("no-sidebar"), not that it is one.
STATES = frozenset("no not non has have with without hide hides show shows is was".split())
FURNITURE = frozenset("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar sidebars nav navbar navigation menu menus topbar toolbar breadcrumb breadcrumbs pager pagination footer foot cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup signin login comment comments commentlist disqus respond response responses replies reply reactions discussion discussions share sharing social related recommended recommendations widget widgets searchbox copyright complementary contentinfo skip".split())
#: Furniture words of other meanings too ("ad-hoc", "share-price"): they count in a class whose other words are about furniture or layout.
AMBIGUOUS = frozenset("ad ads adv alert banner consent cookie cookies discussion discussions foot footer head login menu menus notice notices promo promotion reactions recommended related reply replies respond response responses share sharing signin signup skip social sponsor sponsored subscription".split())
LAYOUT = frozenset("a all area bar block body bottom box btn button buttons col column container content desktop fixed float global group header icon icons inline inner item items js large left link links list main middle mobile module outer page panel primary right row secondary section side site slot small space sticky text title top unit view wrap wrapper zone".split())
HEADERS = frozenset("header masthead head".split())
ARTICLE_WORDS = frozenset("article post entry story content main body text title heading headline".split())

_OPEN = re.compile(r"<(?:(?=[a-zA-Z!?])|/)")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: One piece of a tag after its name: an attribute's name, its value, or a slash.
_PIECE = re.compile(r"\s*(?:=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]*)|[^\s=>/]+|/)")
_ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?(?=[\s/>]|$)", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

OUTPUT = schema_of(page_id="long", url="string", text="string", n_chars="long")


class Node:
    __slots__ = ("tag", "parent", "children", "skip", "soft", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, skip: bool):
        self.tag, self.parent, self.skip, self.soft = tag, parent, skip, False
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _is_furniture(token: str, in_article: bool) -> bool:
    """Whether one class, id or role names furniture."""
    words = [w.lower() for w in _WORD.findall(token)]
    if not words or words[0] in STATES:
        return False
    if any(w in FURNITURE and w not in AMBIGUOUS for w in words):
        return True
    if any(w in AMBIGUOUS for w in words) and all(w in FURNITURE or w in LAYOUT or w.isdigit() or len(w) == 1 for w in words):
        return True
    return not in_article and any(w in HEADERS for w in words) and not any(w in ARTICLE_WORDS for w in words)


def _furniture(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is furniture by its name or because it is hidden, and whether its class, id or role says so."""
    if tag in DROPPED or (tag == "header" and not in_article):
        return True, False
    soft = False
    for name, value in _ATTR.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True, False
        if tag not in ("html", "body", "main") and not soft:
            soft = any(_is_furniture(token, in_article or tag == "article") for token in value.split())
    return False, soft


def _end_of_tag(page: str, at: int, last: dict[str, int]) -> int:
    """The place of the ``>`` that ends a tag whose name ends at ``at``, or -1 if the page ends before."""
    while True:
        m = _PIECE.match(page, at)
        if m is None:
            return page.find(">", at)
        piece = m.group().lstrip()
        if piece[:1] == "=":
            value = piece[1:].lstrip()
            if value[:1] in ("'", '"') and (len(value) < 2 or value[-1] != value[0]) and last[value[0]] < m.end():
                return page.find(">", at)  # a quote that is never closed
        at = m.end()


class _Stack:
    """Open elements, with counts of their names in all and since the last table or cell."""

    def __init__(self, root: Node):
        self.nodes, self.open, self.scopes = [root], Counter(), [Counter()]
        self.articles = 0

    def push(self, node: Node) -> None:
        self.nodes.append(node)
        self.open[node.tag] += 1
        self.articles += node.tag in ("article", "main")
        if node.tag in SCOPES:
            self.scopes.append(Counter())
        self.scopes[-1][node.tag] += 1

    def close(self, k: int) -> None:
        """Close the element at place ``k`` and all inside it."""
        while len(self.nodes) > k:
            tag = self.nodes.pop().tag
            self.open[tag] -= 1
            self.articles -= tag in ("article", "main")
            self.scopes[-1][tag] -= 1
            if tag in SCOPES:
                self.scopes.pop()

    def close_last(self, tags: frozenset | set, until: frozenset | set) -> bool:
        """Close the innermost element of these names, unless one of ``until`` is inside of it."""
        if not any(self.open[t] for t in tags):
            return False
        for k in range(len(self.nodes) - 1, 0, -1):
            if self.nodes[k].tag in tags:
                self.close(k)
                return True
            if self.nodes[k].tag in until:
                return False
        return False


SCOPES = frozenset("td th table".split())
TABLE_TAGS = frozenset("table tr tbody thead tfoot html body".split())


def parse(page: str) -> Node:
    """The page's tree. Scripts, styles and their like are left out with all they hold."""
    root = Node("#root", None, False)
    stack = _Stack(root)
    last = {q: page.rfind(q) for q in "'\""}
    at, done, end = 0, 0, len(page)

    def text(upto: int) -> None:
        if upto > done:
            stack.nodes[-1].children.append(html.unescape(page[done:upto]))

    while True:
        m = _OPEN.search(page, at)
        if m is None:
            text(end)
            return root
        start, at = m.start(), m.end()
        if page.startswith("<!--", start):
            text(start)
            at = page.find("-->", start + 4)
            if at < 0:
                return root
            done = at = at + 3
            continue
        name = _NAME.match(page, at)
        if name is None:  # a declaration, an instruction, or an end tag without a name
            text(start)
            at = page.find(">", at)
            if at < 0:
                return root
            done = at = at + 1
            continue
        close = _end_of_tag(page, name.end(), last)
        text(start)
        if close < 0:
            return root
        tag, attributes = name.group().lower(), page[name.end() : close]
        done = at = close + 1
        if page[start + 1] == "/":  # an end tag: up to its start, if that is open
            if tag in TABLE_TAGS:
                stack.close_last({tag}, frozenset())
            elif stack.scopes[-1][tag] or tag in SCOPES:
                stack.close_last({tag}, SCOPES - {tag})
            continue
        empty = attributes.endswith("/")
        if tag in RAW:
            if not empty:
                m = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
                done = at = m.end() if m else end
            continue
        if tag in CLOSES_P:
            stack.close_last({"p"}, BLOCKS - {"p"})
        if tag in CLOSED_BY:
            closed, scope = CLOSED_BY[tag]
            while stack.close_last(closed, scope) and tag == "tr":
                pass
        if tag in ("html", "body") and stack.open[tag]:
            continue
        parent = stack.nodes[-1]
        hard, soft = _furniture(tag, attributes, stack.articles > 0)
        node = Node(tag, parent, hard)
        node.soft = soft
        parent.children.append(node)
        if tag not in VOID and not empty:
            stack.push(node)


MARKS = frozenset("article main h1".split())


def _skips(root: Node, by_class: bool) -> None:
    """What is left out: hidden and named furniture, and forms and furniture by class, unless they hold most of the page and the page has
    no mark of an article outside of all that; furniture by class must then hold such a mark itself."""
    nodes = _order(root)
    whole = next((x for x in nodes if x.tag == "body"), root).chars
    covered: set[int] = set()  # inside or itself furniture of any kind
    free = False  # a mark outside of it
    for node in nodes:
        node.skip = node.skip or (node.parent is not None and node.parent.skip)
        if node.skip or node.soft or node.tag in FORMS or (node.parent is not None and id(node.parent) in covered):
            covered.add(id(node))
        elif node.tag in MARKS:
            free = True
    marked: set[int] = set()
    for node in reversed(nodes):
        if not node.skip and ((node.tag in MARKS and not node.soft) or any(id(x) in marked for x in node.children if isinstance(x, Node))):
            marked.add(id(node))
    for node in nodes:
        layout = not free and 2 * node.chars >= whole
        form = node.tag in FORMS and not layout
        by_name = node.soft and by_class and not (layout and id(node) in marked)
        node.skip = node.skip or form or by_name or (node.parent is not None and node.parent.skip)


def _order(root: Node) -> list[Node]:
    """All nodes, parents before their children, without recursion: pages can be deep."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(x for x in reversed(node.children) if isinstance(x, Node))
    return out


def count(root: Node) -> list[Node]:
    """Fill in the numbers of characters, tags, link characters and link tags below each node, furniture at its face value."""
    nodes = _order(root)
    for node in reversed(nodes):
        for x in node.children:
            if isinstance(x, str):
                node.chars += len("".join(x.split()))
            else:
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags + (x.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    return nodes


def density(node: Node, share: float) -> float:
    """Composite text density: characters a tag, less for links; ``share`` is the body's share of link characters."""
    c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, max(1, node.link_tags)
    if not c:
        return 0.0
    base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
    return max(0.0, c / t * math.log(max(1.0, c / max(1, lc) * t / lt)) / max(1.0, math.log(base) if base > math.e else 1.0))


def measure(nodes: list[Node]) -> list[Node]:
    """Fill in densities and, over the children that are not left out, their sums."""
    body = next((x for x in nodes if x.tag == "body"), nodes[0])
    share = body.link_chars / max(1, body.chars)
    for node in nodes:
        node.density = density(node, share)
    for node in nodes:
        node.total = sum(x.density for x in node.children if isinstance(x, Node) and not x.skip)
    return nodes


def core(nodes: list[Node]) -> Node:
    """The subtree that holds the article."""
    body = next((x for x in nodes if x.tag == "body"), nodes[0])
    open_nodes = [x for x in nodes if not x.skip and x.chars]
    if not open_nodes:
        return body
    best = max(open_nodes, key=lambda x: x.total)
    path = []
    node: Node | None = best
    while node is not None:
        path.append(node)
        node = node.parent
    for x in path[1:]:
        if x.tag in ("body", "html", "#root"):
            # text that stands in the body itself, or several bare blocks there, is the article
            return x if x.total > best.total * 0.5 and x.density >= body.density and best.tag not in ("div", "section", "td") else best
        if x.density < body.density:
            break
        best = x
    return best


def blocks(node: Node) -> list[str]:
    """Texts of the subtree's blocks in page order, white space folded, empty ones left out."""
    out: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        text = " ".join("".join(parts).split())
        if text:
            out.append(text)
        parts.clear()

    todo: list[tuple[bool, object]] = [(True, node)]
    while todo:
        enter, x = todo.pop()
        if not enter:
            flush()
        elif isinstance(x, str):
            parts.append(x)
        elif not x.skip:
            if x.tag == "br":  # white space, not a block
                parts.append(" ")
                continue
            if x.tag in BLOCKS:
                flush()
                todo.append((False, x))
            todo.extend((True, c) for c in reversed(x.children))
    flush()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    for by_class in (True, False):
        root = parse(page)
        nodes = count(root)
        _skips(root, by_class)
        text = "\n".join(blocks(core(measure(nodes))))
        if text:
            return text
    return ""


def _extract():
    def row(page_id, url, page):
        text = main_text(utf8(page) if page else None)
        return page_id, url, text, len(text)

    return row


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row."""
    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("binary"))
    return map_rows(rows, _extract, OUTPUT)
