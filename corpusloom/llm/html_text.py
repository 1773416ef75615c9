"""Operator 9: main text of HTML pages by composite text density.

Each DOM node has a density: its characters per tag, adjusted for links, as

    C/T * log(C/L * T/LT)  to the base  ln(C/N * L + Lb/Cb * C + e)

with C characters and T tags below it, L link characters, N the other ones, LT link tags, and
b the body; a zero divisor counts as 1, and on a page without links the density is C/T. The node whose children's densities have the largest sum holds the
main text. Two thresholds come from its path to the body. Up to the highest node on the path that is at least as dense as the
body, its surroundings belong to the text too, but for parts beside the path that are less dense than the body and mostly links
(a heading or a short paragraph is not dense, but has no links). Beside that node, parts at least as
dense as the least dense node of the path are taken in, of each the subtree with the largest sum.

What is no text (scripts, styles, controls, hidden parts) is cut before. What its markup names, by
element, role, or a whole word of class or id, as a menu, header or footer of the page, sidebar, notice, advert, form or
comments of readers is left out of all that density has chosen, and can't be chosen, with two exceptions: a form, dialog or fieldset that
holds more than half of the page's text outside of links; and, on a page with no other text, what holds the largest sum.

Blocks are joined by a line feed; white space in a block is one space. Null html: empty text. Null
id, null url: kept. Repeated rows: one result each. Empty table: none. Only the id, url and html columns are read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape
from math import e, log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.batches import map_columns

# Elements of HTML by how they are parsed and shown.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul br".split()
)
_CLOSES_P = _BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "body", "html"}
#: A start tag ends open elements of the first names, up to the innermost open one of the second names.
_ENDS = {
    "li": ("li", "ul ol menu"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "tr": ("tr td th", "table"),
    "td": ("td th", "table"),
    "th": ("td th", "table"),
    "tbody": ("tbody thead tr td th", "table"),
    "tfoot": ("tbody thead tr td th", "table"),
    "option": ("option", "select"),
    "body": ("head", ""),
}
_ENDS = {k: (v[0].split(), v[1].split()) for k, v in _ENDS.items()}
_FENCE = frozenset("article aside body div html main section table ul ol dl td th button form blockquote".split())
_CUT = frozenset("script style noscript iframe template svg canvas object head title textarea select button input label".split())
# What the result leaves out: menus, headers, footers, sidebars, notices, adverts, forms and comments.
_ASIDE = frozenset("nav footer aside form menu dialog fieldset".split())
_WRAPPERS = frozenset("form dialog fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
_NAMED = re.compile(
    r"(?:(?:site|page|main|top|bottom|left|right|global|primary|secondary|reader|user|post)[-_])?"
    r"(?:menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|toolbar|header(?<=[-_]header)|masthead|footer|side-?bar|cookies?|consent|gdpr|notices?|alert|popup|modal|"
    r"ads?|adverts?|advertisements?|adsense|banner|sponsor(?:ed)?|promo(?:tion)?|newsletter|subscribe|subscription|signup|login|comments?|commentlist|disqus|respond|replies)"
    r"(?:[-_]?(?:\d+|box|bar|area|container|wrapper|wrap|section|block|list|slot|unit|thread|form|links?))*",
    re.IGNORECASE,
)
_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|"""
    r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>)))?+)*+)(?:>|\Z)""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>)))?+""")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("name", "attributes", "parent", "children", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, name: str, attributes: dict[str, str], parent: Node | None):
        self.name, self.attributes, self.parent = name, attributes, parent
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


class _Open:
    """The open elements, innermost last, and where those of each name stand among them."""

    def __init__(self, root: Node):
        self.nodes = [root]
        self.places: dict[str, list[int]] = {}
        self.fences: list[int] = []

    def push(self, node: Node) -> None:
        self.places.setdefault(node.name, []).append(len(self.nodes))
        if node.name in _FENCE:
            self.fences.append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, place: int) -> None:
        """Closes the element at a place and all inside it."""
        while len(self.nodes) > place:
            node = self.nodes.pop()
            self.places[node.name].pop()
            if node.name in _FENCE:
                self.fences.pop()

    def last(self, *names: str) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def end(self, names: list[str], fence: int) -> None:
        """Closes the outermost open element of these names inside a fence."""
        found = [x[i] for n in names if (x := self.places.get(n)) and (i := bisect_right(x, fence)) < len(x)]
        if found:
            self.cut(min(found))


def parse(html: str) -> Node:
    """The tree of a page: implied end tags close what they must, stray ones are passed over."""
    root = Node("html", {}, None)
    open_ = _Open(root)
    at = 0
    for m in iter(lambda: _TAG.search(html, at), None):
        if m.start() > at:
            open_.nodes[-1].children.append(unescape(html[at : m.start()]))
        at = m.end()
        name = (m[2] or "").lower()
        if not name or name == "html":
            continue
        if m[1]:
            place = open_.last(name)
            if place and not (name in ("p", "li") and open_.fences and open_.fences[-1] > place):
                open_.cut(place)
            continue
        if name in _CLOSES_P:
            open_.end(["p"], open_.fences[-1] if open_.fences else 0)
        if name in _ENDS:
            ended, inside = _ENDS[name]
            open_.end(ended, open_.last(*inside))
        attributes: dict[str, str] = {}
        for k, v in _ATTRIBUTE.findall(m[3]) if m[3] else ():
            attributes.setdefault(k.lower(), unescape(v[1:-1] if v[:1] in ('"', "'") else v))
        node = Node(name, attributes, open_.nodes[-1])
        open_.nodes[-1].children.append(node)
        if name in _VOID:
            continue
        if name in _RAW:
            stop = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(html, at)
            inner = html[at : stop.start() if stop else len(html)]
            node.children.append(unescape(inner) if name in ("textarea", "title") else inner)
            at = html.find(">", stop.start()) + 1 or len(html) if stop else len(html)
            continue
        open_.push(node)
    if at < len(html):
        open_.nodes[-1].children.append(unescape(html[at:]))
    return root


def _no_text(node: Node) -> bool:
    a = node.attributes
    if node.name in _CUT:
        return True
    if not a or node.name in ("body", "article", "main"):
        return False
    return "hidden" in a or a.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none", a.get("style", "")))


def _named(node: Node, in_article: bool) -> bool:
    """Whether the markup names a node as no part of an article."""
    a = node.attributes
    if node.name in _ASIDE or node.name == "header" and not in_article:
        return True
    if not a or node.name in ("body", "article", "main"):
        return False
    return a.get("role", "").lower() in _ROLES or any(_NAMED.fullmatch(word) for word in (a.get("class", "") + " " + a.get("id", "")).split())


def _prune(root: Node) -> None:
    todo = [root]
    while todo:
        node = todo.pop()
        node.children = [c for c in node.children if isinstance(c, str) or not _no_text(c)]
        todo += [c for c in node.children if not isinstance(c, str)]


def _left_out(body: Node) -> set[int]:
    """The outermost named nodes, but for forms and the like that hold more than half of the text outside of links."""
    most = (body.chars - body.link_chars) / 2
    out: set[int] = set()
    todo = [(body, False)]
    while todo:
        node, inside = todo.pop()
        if node is not body and _named(node, inside) and not (node.name in _WRAPPERS and node.chars - node.link_chars > most):
            out.add(id(node))
            continue
        inside = inside or node.name in ("article", "main")
        todo += [(c, inside) for c in node.children if not isinstance(c, str)]
    return out


def _nodes(root: Node, without: set[int] = frozenset()) -> list[Node]:
    """All nodes, each before what is below it, but for some subtrees."""
    out = [root]
    for node in out:
        out += [c for c in node.children if not isinstance(c, str) and id(c) not in without]
    return out


def _weigh(body: Node) -> list[Node]:
    """Fills in counts, densities and sums; gives all nodes from body on."""
    nodes = _nodes(body)
    for node in reversed(nodes):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        node.density = 0.0
        for c in node.children:
            if isinstance(c, str):
                node.chars += len(c) - c.count(" ") - c.count("\n")
            else:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags + (c.name == "a")
        if node.name == "a":
            node.link_chars = node.chars
    share = body.link_chars / max(1, body.chars)
    for node in reversed(nodes):
        c, t, l, lt = node.chars, node.tags or 1, node.link_chars, node.link_tags or 1
        if c:
            base = log(c / max(1, c - l) * l + share * c + e)
            node.density = max(0.0, c / t * log(c / max(1, l) * t / lt) / log(base)) if base > 1.0000001 else c / t
    return nodes


def _densest(top: Node, without: set[int] = frozenset()) -> Node:
    """The node of the largest sum of its children's densities, or of its own density if it has no children; the outermost of equal ones."""
    nodes = _nodes(top, without)
    for node in nodes:
        node.total = sum(c.density for c in node.children if not isinstance(c, str) and id(c) not in without) or node.density
    return max(nodes, key=lambda n: n.total)


def main_nodes(root: Node) -> tuple[list[Node], set[int]]:
    """The nodes that hold the main text, in page order, and what is left out of them."""
    _prune(root)
    body = next((c for c in _nodes(root) if c.name == "body"), root)
    _weigh(body)
    out = _left_out(body)
    best = _densest(body, out)
    if not any(isinstance(c, str) and c.strip() for n in _nodes(body, out) for c in n.children):
        best = _densest(body)
        up: Node | None = best
        while up is not None:
            out.discard(id(up))
            up = up.parent
        out |= {id(n) for n in _nodes(best) if n is not best and _named(n, True)}
    path = [best]
    while path[-1] is not body:
        path.append(path[-1].parent)
    least = min(n.density for n in path)
    top = next((i for i in range(len(path) - 2, 0, -1) if path[i].density >= body.density), 0)
    on_path = {id(n): i for i, n in enumerate(path)}
    found: list[Node] = []
    todo = list(reversed(body.children)) if best is not body else [body]
    while todo:
        c = todo.pop()
        if isinstance(c, str) or id(c) in out:
            continue
        if on_path.get(id(c), -1) > top:
            todo += reversed(c.children)
        elif id(c) in on_path:
            found.append(c)
        elif c.chars and c.density >= least:
            found.append(_densest(c, out))
    for node in path[1 : top + 1]:
        for c in node.children:
            if not isinstance(c, str) and id(c) not in on_path and c.density < body.density and 2 * c.link_chars > c.chars:
                out.add(id(c))
    return found, out


def blocks(node: Node, without: set[int] = frozenset()) -> list[str]:
    """The texts of the blocks below a node, in page order, but for some subtrees; none is empty."""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        text = _SPACE.sub(" ", "".join(run)).strip()
        run.clear()
        if text:
            out.append(text)

    todo: list[Node | str | None] = [node]
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            run.append(x)
        else:
            block = x.name in _BLOCK
            if block:
                end()
                todo.append(None)
            todo += [c for c in reversed(x.children) if isinstance(c, str) or id(c) not in without]
    end()
    return out


def extract(html: str) -> str:
    """The main text of a page."""
    root = parse(html)
    found, out = main_nodes(root)
    return "\n".join(b for n in found for b in blocks(n, out))


SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def main_text(df: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """id, url, text (empty if there is none) and n_chars of each page."""

    def run(columns):
        made = list(map(extract, columns[1].to_pylist()))
        yield {"id": columns[0], "url": columns[2], "text": made, "n_chars": list(map(len, made))}

    return map_columns(df.select(F.col(id_col).alias("id"), F.coalesce(html_col, F.lit("")).alias("html"), F.col(url_col).alias("url")), SCHEMA, run)
