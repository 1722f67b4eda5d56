"""HTML extraction (8): composite text density.

A page becomes a DOM; what is never main text by its element, role or class (menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles, reader comments) is set aside. A class or id doesn't set aside what holds the page's only article or main elements,
or over half of the text that isn't links (for comments, adverts and notices nine tenths, of a page without other article),
nor do listed words behind has-, no- or with-, or before -open or -closed; inside an article, words that may name parts of it
(discussion, legal) don't count, and a form that holds the article is no form. If nothing else is left, names don't count.
For every other node the density is its characters per
tag, adjusted for links: a node whose text is mostly links scores low. A node's density sum is the sum of its children's
densities. The threshold is the least density on the path from the body to the node with the largest density sum. From the
body down, each node at or above it that isn't taken yet gives the subtree with the largest density sum in it, which is taken
whole, widened to the article or main element that holds it; then the node's children are searched likewise. Siblings that
stand between two taken ones and aren't mostly links are taken with them, and so are the headings right before them.

Text in a subtree is cut into blocks at block elements; white space inside a block becomes one space.

Defined cases: null or empty html, and pages without text, give ''; tags that are not closed end as HTML says they do
(p at the next block, li at the next li) or with their parent; end tags without a start are ignored; cut-off markup at the end
is dropped; a page without body or markup is one subtree; of nodes with one density sum the first is taken. A very long page
takes time in proportion, however deep its elements are. Each row is extracted by itself: repeated rows and repeated ids get
the same text; an empty table gives no rows. Input columns stay as they are, but for the html's and one called text, which
give way to the output's.
"""

from __future__ import annotations

import bisect
import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import fields, rowed

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?", re.S)
_VALUE_END = re.compile(r"=\s*[^\s\"'>]+\Z")
_SPACE = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas select".split())
FOREIGN = frozenset(("svg", "math"))
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: An open element of the right ends when one of the left begins.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
WITHIN = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
ASIDE = frozenset("nav footer aside button dialog menu script style noscript template textarea head title svg math iframe object canvas select".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Whole words of class or id; fixed list.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager header masthead topbar footer bottombar "
    "sidebar sidenav side aside rail widget widgets related recommended recommendations cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login "
    "comment comments disqus respond reply replies discussion share sharing social form search toolbar skip copyright legal disclaimer".split()
)
_WORD = re.compile(r"[a-z]+")
#: Such names tell how a page is laid out (has-sidebar, no-sidebar, comments-open), not what a node holds.
_WITHOUT = re.compile(r"(?<![a-z])(?:has|no|with|without)[-_]\S*|\S*[-_](?:open|closed|enabled|disabled)(?![a-z])|(?<![a-z])(?:article|chapter|entry|post|story)[-_]header(?![a-z])")
#: Comments, adverts and notices may be longer than the text beside them.
OTHERS = frozenset("comment comments disqus respond reply replies discussion ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert newsletter subscribe subscription disclaimer legal copyright".split())
#: Inside an article these may be names of its own parts.
WEAK = frozenset("copyright disclaimer discussion legal pager rail search skip".split())
MOST, NEARLY_ALL = 0.5, 0.9
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Node:
    __slots__ = ("tag", "up", "items", "aside", "chars", "tags", "link_chars", "link_tags", "density", "sum", "best", "searched", "named", "plain", "open", "holds", "own")

    def __init__(self, tag: str, up: Node | None, aside: bool, named: float = 0):
        self.tag, self.up, self.aside, self.named = tag, up, aside, named
        self.items: list[Node | str] = []
        self.searched = False


def _set_aside(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is never main text by its tag or role. inside: it lies in an article, main or section."""
    if tag in ASIDE or tag == "header" and not inside:  # an article's own header holds its title
        return True
    if not attributes or tag in ("html", "body", "article", "main", "header"):
        return False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "role" and value.strip().lower() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
    return False


def _named(tag: str, attributes: str, inside: bool) -> float:
    """The share of a page's text from which on a node isn't set aside by its class or id; 0 if they have no listed word.
    inside: it lies in an article or main element."""
    if tag == "form":
        return NEARLY_ALL
    if not attributes or tag in ("html", "body", "article", "main") or _heading(tag):
        return 0
    found: set[str] = set()
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id"):
            words = re.sub(r"([a-z])([A-Z])", r"\1-\2", a or b or c).lower()
            found.update(NAMES.intersection(_WORD.findall(_WITHOUT.sub(" ", words))))
    if inside:
        found -= WEAK
    return 0 if not found else MOST if found.isdisjoint(OTHERS) else NEARLY_ALL


def _heading(tag: str) -> bool:
    return tag in ("h1", "h2", "h3", "b", "strong", "em", "i", "span", "a", "code")


class _Open:
    """The open elements from the root down, with the places of each tag, so that none is searched for step by step."""

    def __init__(self, root: Node):
        self.nodes, self.at, self.blocks = [root], {}, []

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in BLOCKS:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, place: int) -> None:
        """Closes the element at place and all in it."""
        while len(self.nodes) > place:
            node = self.nodes.pop()
            self.at[node.tag].pop()
            if node.tag in BLOCKS:
                self.blocks.pop()

    def last(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def begin(self, tag: str) -> None:
        """Closes what a new element of this tag ends."""
        if tag in ENDS:
            least = self.last(WITHIN[tag])
            found = [x[i] for t in ENDS[tag] if (x := self.at.get(t)) and (i := bisect.bisect_right(x, least)) < len(x)]
            if found:
                self.cut(min(found))
        if tag in BLOCKS and self.blocks and self.nodes[self.blocks[-1]].tag == "p":
            self.cut(self.blocks[-1])


def parse(page: str) -> Node:
    root = Node("", None, False)
    stack = _Open(root)
    at, n, endless = 0, len(page), set()
    while at < n:
        m = _TOKEN.search(page, at)
        node = stack.nodes[-1]
        if not m:
            if (tail := page[at:]) and not re.match(r"<[A-Za-z/!?]", tail):
                node.items.append(entities.unescape(tail))
            break
        if m.start() > at:
            node.items.append(entities.unescape(page[at : m.start()]))
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if stack.at.get(tag):
                stack.cut(stack.at[tag][-1])
            continue
        if not page.endswith(">", m.start(), m.end()):
            break  # cut off inside a tag
        stack.begin(tag)
        node = stack.nodes[-1]
        inside = stack.last(("article", "main")) > 0
        aside = _set_aside(tag, m[3] or "", inside or stack.last(("section",)) > 0)
        child = Node(tag, node, aside, 0 if aside else _named(tag, m[3] or "", inside))
        node.items.append(child)
        # a slash at the end closes foreign elements only, and isn't one where it ends a value without quotes
        slash = m[3].endswith("/") and not _VALUE_END.search(m[3])
        if tag in VOID or slash and tag in FOREIGN:
            continue
        if tag in RAW:
            end = None if tag in endless else re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            if end:
                at = page.find(">", end.start()) + 1 or n
            elif slash:
                endless.add(tag)  # written as if it were closed, and never closed: what follows is the page
            else:
                at = n
        else:
            stack.push(child)
    _by_name(root)
    return root


def _by_name(root: Node) -> None:
    """Sets nodes with listed names aside, but for those that hold the page's article or main element, or most of its text."""
    nodes = _nodes(root)
    if not any(x.named for x in nodes):
        return
    for node in reversed(nodes):
        own = sum(len(x) for x in node.items if isinstance(x, str) and not x.isspace())
        rows = [x for x in node.items if isinstance(x, Node) and not x.aside]
        node.plain = 0 if node.tag == "a" else own + sum(x.plain for x in rows)
        node.open = 0 if node.tag == "a" else own + sum(x.open for x in rows if not x.named)
        node.holds = node.plain > 0 and (node.tag in ("article", "main") or any(x.holds for x in rows))
    outside, todo = False, [root]
    for node in todo:
        outside = outside or node.tag in ("article", "main") and node.open > 0
        todo += [x for x in node.items if isinstance(x, Node) and not x.aside and not x.named]
    for node in nodes:  # parents first; what lies in a node set aside is never looked at
        if node.named:
            node.aside = not (node.holds and not outside or node.plain > node.named * root.plain and not (outside and node.named == NEARLY_ALL))
    if root.plain and not any(isinstance(x, str) and not x.isspace() for node in _nodes(root) for x in node.items):
        for node in nodes:  # nothing else is left
            if node.named and node.tag != "form":
                node.aside = False


def _nodes(root: Node) -> list[Node]:
    """Those not set aside, parents first."""
    out = [root]
    for node in out:
        out += [x for x in node.items if isinstance(x, Node) and not x.aside]
    return out


def measure(nodes: list[Node]) -> None:
    for node in reversed(nodes):
        chars = tags = link_chars = link_tags = 0
        for x in node.items:
            if isinstance(x, str):
                chars += len(x) if not x.isspace() else 0
            elif not x.aside:
                chars, tags = chars + x.chars, tags + x.tags + 1
                link = x.tag == "a"
                link_chars, link_tags = link_chars + (x.chars if link else x.link_chars), link_tags + x.link_tags + link
        node.chars, node.tags, node.link_chars, node.link_tags = chars, tags, link_chars, link_tags
        node.own = any(isinstance(x, str) and not x.isspace() for x in node.items)
    body = nodes[0]
    ratio = body.link_chars / max(1, body.chars)
    for node in reversed(nodes):
        c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, max(1, node.link_tags)
        plain = max(1, c - lc)
        base = math.log(c / plain * lc + ratio * c + math.e) if c else 1.0
        node.density = c / t * math.log(max(1.0, c / max(1, lc) * t / lt) + math.e - 1, max(base, 1.0 + 1e-9)) if c else 0.0
        node.sum = sum(x.density for x in node.items if isinstance(x, Node) and not x.aside) + sum(len(x) for x in node.items if isinstance(x, str) and not x.isspace())


def main_nodes(root: Node) -> list[Node]:
    """The subtrees that hold the main text, in page order."""
    nodes = _nodes(root)
    body = next((x for x in nodes if x.tag == "body"), root)
    nodes = _nodes(body)
    measure(nodes)
    if not body.chars:
        return []
    for i, node in reversed(list(enumerate(nodes))):
        node.best = max([(node.sum, -i, node), *(x.best for x in node.items if isinstance(x, Node) and not x.aside)], key=lambda x: x[:2])
    up = max(nodes[1:] or nodes, key=lambda x: x.sum)
    least = up.density
    while up is not body and up.up:
        up = up.up
        least = min(least, up.density)
    taken: set[Node] = set()
    tried: set[Node] = set()
    for node in nodes:  # parents first
        if node is not body and (node.up in taken or not node.searched or node.density < least or node.tag == "a"):
            node.searched = False
            if node.up in taken:
                taken.add(node)
            continue
        top = node.best[2]
        if top not in tried:
            tried.add(top)
            while top is not node and top.tag not in ("article", "main") and top.up.own:
                top = top.up  # inline markup belongs to its block
            taken.add(top)
        for x in node.items:
            if isinstance(x, Node):
                x.searched = True
    for node in reversed(nodes):
        node.holds = node in taken or any(x.holds for x in node.items if isinstance(x, Node) and not x.aside)
        if node.holds and node.tag in ("article", "main"):
            taken.add(node)
    for node in nodes:
        if node is not body:
            rows = [x for x in node.items if isinstance(x, Node) and not x.aside]
            found = [i for i, x in enumerate(rows) if x in taken]
            for i in range(found[0], found[-1]) if found else ():
                if rows[i].link_chars * 2 <= rows[i].chars and rows[i].tag != "a":
                    taken.add(rows[i])  # what stands between two parts of the text belongs to it
            i = found[0] - 1 if found else -1
            while i >= 0 and rows[i].tag in HEADINGS:
                taken.add(rows[i])
                i -= 1
    wide, stack = [], [body]
    while stack:
        node = stack.pop()
        if node in taken:
            wide.append(node)
        else:
            stack += [x for x in reversed(node.items) if isinstance(x, Node) and not x.aside]
    return wide or [body]


def blocks(node: Node) -> list[str]:
    """The texts of a subtree's blocks in page order."""
    out: list[str] = []
    now: list[str] = []

    def flush() -> None:
        if text := _SPACE.sub(" ", "".join(now)).strip():
            out.append(text)
        now.clear()

    stack: list[tuple[Node, int]] = [(node, 0)]
    while stack:
        top, i = stack.pop()
        if i == 0 and top.tag in BLOCKS:
            flush()
        while i < len(top.items):
            x = top.items[i]
            i += 1
            if isinstance(x, str):
                now.append(x)
            elif x.tag == "br":
                now.append(" ")
            elif not x.aside:
                stack += [(top, i), (x, 0)]
                break
        else:
            if top.tag in BLOCKS:
                flush()
    flush()
    return out


def extract(page: str | None) -> str:
    """The main text of one page."""
    return "\n".join(b for node in main_nodes(parse(page or "")) for b in blocks(node))


def extracted(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages' columns without the html, and text."""
    keep = fields(rows := rowed(pages), (html.lower(), "text"))
    rows = rows.select(F.struct(*(keep or [F.lit(0)])).alias("row"), F.col("row").getField(html).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 128):
                part = batch.slice(at, 128)
                texts = [extract(x.as_py()) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], part.schema.names)

    out = rows.mapInArrow(run, rows.schema)
    return out.select(*(fields(out) if keep else []), "text")
