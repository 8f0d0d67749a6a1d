"""Main text of web pages by composite text density.

Each page becomes a tree. Every node's density is its characters per tag, corrected for
links: link text counts little, and the less so the more of the page's text is linked. A
node's score is the sum of its children's densities. The subtree of the highest score is
the text, with the rest of the article or main element around it. On pages without such
an element, the least density between subtree and body is the threshold that siblings on
that path must reach to belong to the text; headings need not.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import each_batch

# Elements that never hold an article's text.
DROPPED = frozenset(
    "head title script style noscript template nav footer aside form button select option textarea "
    "input label iframe object embed svg canvas audio video dialog menu".split()
)
# Words in class, id and role that mark other parts of a page than its article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion sidebar comment comments "
    "reply replies respond disqus discussion menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent "
    "gdpr notice notices notification alert banner popup modal overlay share sharing social related recommended "
    "newsletter subscribe subscription signup login search footer header masthead toolbar widget copyright pagination "
    "contentinfo complementary dialog".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary "
    "table tbody td tfoot th thead tr ul".split()
)
# What an opening tag ends if it is open, and the elements beyond which it does not look.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "option": {"option"}}
BOUNDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
SCOPE = frozenset("article body html main section div table td th li blockquote form nav aside header footer".split())
_WORD = re.compile(r"[a-z0-9]+")
LINK_LIST = 0.66
# What a head may hold; anything else ends it.
IN_HEAD = frozenset("head title meta link base style script noscript template".split())
# Marks decide unless they would leave less than this share of a page's unlinked text.
LEAST_LEFT = 0.25


class Node:
    __slots__ = ("tag", "parent", "parts", "dropped", "holds", "chars", "tags", "link_chars", "link_tags", "density")

    def __init__(self, tag: str, parent: Node | None) -> None:
        self.tag, self.parent = tag, parent
        self.parts: list[Node | str] = []
        self.dropped = self.holds = False
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = 0.0


def _marked(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    for name, value in attrs:
        value = (value or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name in ("class", "id", "role") and MARKS.intersection(_WORD.findall(value)):
            return True
    return False


class _Tree(HTMLParser):
    """Builds the tree of a page; tolerates unclosed and stray tags."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#page", None)
        self.open = [self.root]
        self.nodes = [self.root]
        self.marked: list[Node] = []
        self.forms: list[Node] = []

    def _close(self, tags: set[str], bounds: frozenset[str] | set[str]) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                del self.open[k:]
                return
            if self.open[k].tag in bounds:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in IN_HEAD:
            self._close({"head"}, frozenset())
        if tag in BLOCKS:
            self._close({"p"}, SCOPE)
        if tag in ENDS:
            self._close(ENDS[tag], BOUNDS.get(tag, {"table"}))
        if tag == "body" and any(n.tag == "body" for n in self.open):
            return
        node = Node(tag, self.open[-1])
        node.dropped = tag in DROPPED
        if tag in ("article", "main", "h1"):
            at: Node | None = node
            while at is not None and not at.holds:
                at.holds = True
                at = at.parent
        elif tag == "form":
            self.forms.append(node)
        elif not node.dropped and tag not in ("html", "body") and (tag == "header" or _marked(tag, attrs)):
            self.marked.append(node)
        self.open[-1].parts.append(node)
        self.nodes.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag not in VOID:
            self._close({tag}, frozenset() if tag in BLOCKS else BLOCKS - {"p"})

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag == "head" and data.strip():
            self._close({"head"}, frozenset())
        self.open[-1].parts.append(data)


def _parsed(html: str) -> _Tree:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    for node in (*tree.marked, *tree.forms):
        # An article that lies in or is a marked element or a form is the page's text all the same.
        node.dropped = not node.holds
    _measure(tree.nodes)
    if any(n.tag in ("article", "main") for n in tree.nodes):
        return tree
    # Without an article one word in a class must not cost a page its text.
    left = _free(tree.root)
    hidden = [n for n in tree.marked if n.dropped]
    for node in hidden:
        node.dropped = False
    _measure(tree.nodes)
    free = {id(n): _free(n) for n in hidden}
    keep: set[int] = set()
    if hidden and left < LEAST_LEFT * _free(tree.root):
        # The one with most text stays, of equal ones the innermost, and all around it.
        at: Node | None = max(reversed(hidden), key=lambda n: free[id(n)])
        while at is not None:
            keep.add(id(at))
            at = at.parent
    for node in hidden:
        node.dropped = id(node) not in keep
    return tree


def _free(node: Node) -> int:
    """Characters outside links."""
    return node.chars - node.link_chars


def _measure(nodes: list[Node]) -> None:
    """Counts of each node, parents after children; dropped subtrees count nothing."""
    for node in nodes:
        node.chars = node.tags = node.link_chars = node.link_tags = 0
    for node in reversed(nodes):
        if node.dropped:
            node.chars = node.tags = node.link_chars = node.link_tags = 0
            continue
        node.chars += sum(len(p.strip()) for p in node.parts if isinstance(p, str))
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
        if node.parent is not None:
            up = node.parent
            up.chars, up.tags = up.chars + node.chars, up.tags + node.tags + 1
            up.link_chars, up.link_tags = up.link_chars + node.link_chars, up.link_tags + node.link_tags


def _density(node: Node, body: Node) -> float:
    """Link-adjusted characters per tag; a count of zero counts as one."""
    if not node.chars:
        return 0.0
    chars, tags = node.chars, max(node.tags, 1)
    linked, links = max(node.link_chars, 1), max(node.link_tags, 1)
    free = max(chars - node.link_chars, 1)
    share = max(body.link_chars, 1) / max(body.chars, 1)
    base = math.log(chars / free * node.link_chars + share * chars + math.e)
    return chars / tags * math.log(1 + chars / linked * tags / links) / math.log(1 + base)


def _blocks(node: Node, inside: set[int], path: set[int], threshold: float, links: bool) -> list[str]:
    """Texts of the blocks below ``node``, in page order; ``links`` keeps lists of links."""
    found: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = " ".join("".join(line).split())
        if text:
            found.append(text)
        line.clear()

    # Each entry is a part to visit, with whether all of its ancestors are taken whole.
    todo: list[tuple[Node | str | None, bool]] = [(node, id(node) in inside)]
    while todo:
        part, whole = todo.pop()
        if part is None:
            end()
        elif isinstance(part, str):
            line.append(part)
        elif not part.dropped:
            whole = whole or id(part) in inside
            if not whole and id(part) not in path and part.density < threshold and part.tag not in HEADINGS:
                continue
            listed = part.tag in ("ul", "ol", "table", "div", "section") and part.chars and part.link_chars > LINK_LIST * part.chars
            if listed and not links:
                continue
            block = part.tag in BLOCKS
            if block:
                end()
                todo.append((None, whole))
            elif part.tag == "br":
                line.append(" ")
            whole = whole or id(part) not in path
            todo.extend((p, whole) for p in reversed(part.parts))
    end()
    return found


def main_text(html: str | None) -> str:
    """The article of a page: one line for each block, blanks collapsed; empty if none.

    Character references are decoded. Menus, headers, footers, sidebars, notices, adverts,
    forms, comments of readers, scripts and styles go; nothing else does.
    """
    if not html:
        return ""
    tree = _parsed(html)
    nodes = tree.nodes
    _measure(nodes)
    body = next((n for n in nodes if n.tag == "body"), tree.root)
    if not body.chars:
        body = tree.root
    if not body.chars:
        return ""
    scores: dict[int, float] = {}
    for node in nodes:
        if not node.dropped and node.chars:
            node.density = _density(node, body)
            if node.parent is not None:
                scores[id(node.parent)] = scores.get(id(node.parent), 0.0) + node.density
    live = _live(nodes, body)
    best = max((n for n in live if id(n) in scores), key=lambda n: scores[id(n)], default=body)
    up, top = best, body
    path: set[int] = set()
    threshold = best.density
    while up is not None:
        path.add(id(up))
        threshold = min(threshold, up.density)
        if up.tag in ("article", "main") and top is body:
            top = up
        if up is body:
            break
        up = up.parent
    # An article or main element around the subtree bounds the text and belongs to it whole.
    whole = best if top is body else top
    return "\n".join(_blocks(top, {id(whole)}, path, threshold, links=top is not body))


def _live(nodes: list[Node], body: Node) -> list[Node]:
    """Nodes of the body, itself included, that hold text and lie in no dropped subtree."""
    kept: set[int] = {id(body)}
    live = [body]
    for node in nodes:
        if node.parent is not None and id(node.parent) in kept and not node.dropped and node.chars and node is not body:
            kept.add(id(node))
            live.append(node)
    return live


def extract_main_text(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with the main text of ``html_col`` in ``out_col``; that column alone goes through Python.

    A null, empty or text-free page has the empty string; repeated rows each have their
    row; an empty table gives no rows. A column of the name ``out_col`` is replaced.
    """
    at = pages.columns.index(html_col)
    kept = [i for i, c in enumerate(pages.columns) if c.lower() != out_col.lower()]
    names = [*(pages.columns[i] for i in kept), out_col]

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h.as_py()) for h in batch.column(at)]
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(texts, pa.string())], names=names)

    kinds = ", ".join(f"`{pages.columns[i]}` {pages.schema[i].dataType.simpleString()}" for i in kept)
    return pages.mapInArrow(each_batch(make), f"{kinds}, `{out_col}` string")


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of each page."""
    narrow = pages.select("page_id", "url", "html")

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h.as_py()) for h in batch.column(2)]
        sizes = pa.array([len(t) for t in texts], pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"]
        )

    kind = narrow.schema["page_id"].dataType.simpleString()
    return narrow.mapInArrow(each_batch(make), f"page_id {kind}, url string, text string, n_chars bigint")
