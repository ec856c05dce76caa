"""Main text of web pages by tree scoring.

A tolerant parser builds a tree. Subtrees that are never main text (by tag, role, hidden) go; so do those whose class or id
says menu, advert, comment and the like, unless next to nothing would be left and the word is one that authors also give
to the text itself. Paragraphs pass points for length and commas to their ancestors, halved with each level, discounted by link
density; the best container is kept, with siblings that score well, or the article that encloses it.

Every step is linear in the page: open elements are found by tag, not by walking up, and lengths, link lengths and commas
are summed once, bottom up.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# a quotation mark counts only after an equals sign, so an unclosed one costs one look ahead and never a second start
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:=\s*+(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
#: HTML's void elements, raw text elements, elements that start a block, and those that a new one closes.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "tbody", "thead", "tfoot"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
NO_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend"}
P_SCOPE = {"td", "th", "button", "object", "caption"}
#: What is never main text, by tag and by ARIA role.
DROP = RAW | set("head nav footer aside form button select option input label fieldset svg math canvas object audio video map dialog menu search datalist".split())
DROP_ROLES = set("navigation banner contentinfo complementary search form menu menubar toolbar dialog alertdialog alert".split())
#: Words of a class or id that name what is not main text; those that authors also give to main text; names of main text.
NOT_TEXT = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr popup modal newsletter subscribe signup login "
    "sidebar nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager toolbar comment comments commentlist disqus reply replies share sharing social "
    "footer copyright masthead".split()
)
PERHAPS = set("side rail notice notices notification discussion respond related recommended foot header topbar legal disclaimer skip widget form search promoted overlay".split())
KEEP_WORDS = set("article content main post entry story body text page".split())
COMMENTS = {"comment", "comments", "reply", "replies"}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Elements whose text earns points, and the share of a page's points under which a removal took the text itself.
SCORED = set("p pre td blockquote li dd h1 h2 h3".split())
LEFT_OVER = 0.2


class Node:
    """An element. chars, linked, commas and points are those of its subtree, once measured; own: it has text outside of blocks below."""

    __slots__ = ("tag", "attrs", "parent", "items", "depth", "chars", "linked", "commas", "points", "own")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.depth = parent.depth + 1 if parent else 0
        self.items: list[Node | str] = []


class _Open:
    """The element that is being read and its ancestors, by tag."""

    def __init__(self, root: Node):
        self.root = self.node = root
        self.by_tag: dict[str, list[Node]] = {}

    def push(self, node: Node) -> None:
        self.by_tag.setdefault(node.tag, []).append(node)
        self.node = node

    def close(self, last: Node) -> None:
        """Leave `last`, an open element, and all below it."""
        while True:
            node = self.node
            self.by_tag[node.tag].pop()
            self.node = node.parent
            if node is last:
                return

    def nearest(self, tags: Iterable[str]) -> Node | None:
        return max((s[-1] for t in tags if (s := self.by_tag.get(t))), key=lambda n: n.depth, default=None)

    def outermost(self, tags: Iterable[str], below: int) -> Node | None:
        """The outermost open element of the tags that is deeper than `below`."""
        found = None
        for t in tags:
            for n in reversed(self.by_tag.get(t, ())):  # all of these are about to be closed
                if n.depth <= below:
                    break
                if found is None or n.depth < found.depth:
                    found = n
        return found


def parse(page: str) -> Node:
    """The page's tree; malformed markup is taken as browsers mostly do: nothing raises and no text is lost."""
    root = Node("html", "", None)
    stack, at, end, match = _Open(root), 0, len(page), _TOKEN.search
    while at < end:
        m = match(page, at)
        if not m:
            stack.node.items.append(page[at:])
            break
        if m.start() > at:
            stack.node.items.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                stack.node.items.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m[1]:
            if tag in ("html", "body"):
                continue
            if last := stack.nearest((tag,)):
                stack.close(last)
            elif tag == "p":
                stack.node.items.append(Node("p", "", stack.node))
            continue
        if tag == "html" or (tag == "body" and stack.node is not root and stack.node.tag != "head"):
            continue
        if tag in NO_P and (p := stack.nearest(("p",))):  # ends an open paragraph, unless a container stands between
            wall = stack.nearest(P_SCOPE)
            if wall is None or wall.depth < p.depth:
                stack.close(p)
        if tag in CLOSES:
            wall = stack.nearest(SCOPE[tag])
            if last := stack.outermost(CLOSES[tag], wall.depth if wall else 0):
                stack.close(last)
        if stack.node.tag == "head" and tag in BLOCK:
            stack.close(stack.node)
        child = Node(tag, m[3] or "", stack.node)
        stack.node.items.append(child)
        if tag in VOID:
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*+>?", re.I).search(page, at)
            child.items.append(page[at : close.start() if close else end])
            at = close.end() if close else end
        elif not (m[3] or "").rstrip().endswith("/") or tag in BLOCK or tag in ("a", "span", "b", "i", "em", "strong"):
            stack.push(child)
    return root


def _nodes(root: Node) -> list[Node]:
    """All elements, each before its descendants."""
    out = [root]
    for node in out:  # grows while it is read
        out.extend(x for x in node.items if isinstance(x, Node))
    return out


def measure(root: Node) -> list[Node]:
    """Sum lengths, link lengths, commas and points bottom up; the nodes, each before its descendants."""
    nodes = _nodes(root)
    for node in reversed(nodes):
        chars = linked = commas = 0
        points, node.own = 0.0, False
        for x in node.items:
            if isinstance(x, str):
                n = len(x.strip())
                chars, commas, node.own = chars + n, commas + x.count(","), node.own or n > 0
            else:
                chars, linked, commas, points = chars + x.chars, linked + x.linked, commas + x.commas, points + x.points
                node.own = node.own or (x.own and x.tag not in BLOCK)
        node.chars, node.linked, node.commas = chars, chars if node.tag == "a" else linked, commas
        node.points = points + earned(node)
    return nodes


def earned(node: Node) -> float:
    """Points of a paragraph or other element with text, discounted by its link density."""
    if not node.chars or not (node.tag in SCORED or (node.own and node.tag in BLOCK)):
        return 0.0
    return (1 + node.commas + min(node.chars / 100, 3)) * (1 - node.linked / node.chars)


def _attrs(node: Node) -> dict[str, str]:
    return {m[1].lower(): next((v for v in m.groups()[1:] if v is not None), "") for m in _ATTR.finditer(node.attrs)}


def _names(node: Node) -> set[str]:
    """Lower-case words of class and id."""
    if not node.attrs:
        return set()
    a = _attrs(node)
    return {w.lower() for w in _WORDS.findall(f"{a.get('class', '')} {a.get('id', '')}")}


def _never_text(node: Node, in_article: bool) -> bool:
    """Whether tag, role or style rule the subtree out. A comment may be an article of its own inside the article."""
    if node.tag in DROP or (node.tag == "header" and not in_article):
        return True
    if node.parent is not None and node.parent.tag == "header" and in_article and node.tag in ("ul", "ol", "p") and node.linked > 0.5 * max(1, node.chars):
        return True
    if not node.attrs or node.tag in ("html", "body", "main"):
        return False
    if node.tag == "article":
        return in_article and bool(_names(node) & COMMENTS)
    a = _attrs(node)
    return "hidden" in a or a.get("aria-hidden") == "true" or bool(_HIDDEN.search(a.get("style", ""))) or a.get("role", "").lower() in DROP_ROLES


def _pruned(root: Node, gone) -> list[Node]:
    """Remove the topmost subtrees for which gone(node, inside an article) holds, in place; these subtrees."""
    todo, removed = [(root, False)], []
    while todo:
        node, inside = todo.pop()
        inside = inside or node.tag in ("article", "main")
        kept = []
        for x in node.items:
            if isinstance(x, Node):
                if gone(x, inside):
                    removed.append(x)
                    continue
                todo.append((x, inside))
            kept.append(x)
        node.items = kept
    return removed


def prune(root: Node) -> None:
    """Remove in place what is not main text; leaves the tree measured.

    Subtrees that their class or id names go, too. One whose words may name main text comes back if it outweighs all that is
    left; what is named inside it goes.
    """
    measure(root)
    _pruned(root, _never_text)
    measure(root)

    def sort_of(node: Node) -> int:
        """0: text; 1: goes but may come back; 2: goes."""
        if not node.attrs or node.tag in ("html", "body", "article", "main"):
            return 0
        words = _names(node)
        if {"article", "entry", "story"} & words and not words & (COMMENTS | {"ad", "ads", "advert", "sidebar", "footer", "nav"}):
            return 0
        return 2 if words & NOT_TEXT else int(bool(words & PERHAPS))

    nodes = _nodes(root)
    sorts = {n: s for n in nodes if (s := sort_of(n))}
    under, top = set(), []
    for n in nodes:  # the topmost named subtrees
        if n.parent in under:
            under.add(n)
        elif n in sorts:
            under.add(n)
            top.append(n)
    left = root.points - sum(n.points for n in top)
    back = {n for n in top if sorts[n] == 1 and left < LEFT_OVER * (left + n.points)}
    _pruned(root, lambda n, _: n in sorts and n not in back)
    measure(root)


def best_containers(root: Node) -> list[Node]:
    """The best container and the siblings kept with it, in page order; none if no text scores. The tree is measured."""
    score: dict[Node, float] = {}
    for node in _nodes(root):
        points = earned(node)
        if not node.chars or not (node.tag in SCORED or (node.own and node.tag in BLOCK)):
            continue
        up, share = (node.parent if node.tag in SCORED else node), 1.0
        while up is not None and share >= 0.125:
            score[up] = score.get(up, 0) + points * share
            up, share = up.parent, share / 2
    if not score:
        return []
    density = {n: s * (1 - n.linked / max(1, n.chars)) + 5 * bool(_names(n) & KEEP_WORDS) for n, s in score.items()}
    best = max(density, key=density.get)
    outer, up = None, best
    while up is not None:
        if up.tag in ("article", "main") or 'role="main"' in up.attrs:
            outer = outer if outer is not None and outer.tag == "article" else up
        up = up.parent
    if outer is not None:
        return [outer]
    if best.parent is None:
        return [best]
    kept = []
    for x in best.parent.items:
        if x is best:
            kept.append(x)
        elif isinstance(x, Node):
            good = density.get(x, 0) >= max(5, 0.2 * density[best])
            paragraph = x.tag in ("p", "h1", "h2", "h3", "pre", "blockquote") and x.chars and x.linked < 0.5 * x.chars
            if good or paragraph:
                kept.append(x)
    return kept


def blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks in page order: references decoded, white space folded, empty ones left out."""
    out, parts = [], []

    def flush() -> None:
        raw = "".join(parts)
        text = " ".join((_html.unescape(raw) if "&" in raw else raw).split())
        if text:
            out.append(text)
        parts.clear()

    todo: list[Node | str | None] = [x for n in reversed(nodes) for x in (None, n)]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            parts.append(x)
        elif x.tag in VOID:
            parts.append(" ")
            if x.tag == "hr":
                flush()
        elif x.tag in BLOCK:
            flush()
            todo.append(None)
            todo.extend(reversed(x.items))
        else:
            todo.extend(reversed(x.items))
    flush()
    return out


def main_text(page: str | None) -> str:
    root = parse(page or "")
    prune(root)
    return "\n".join(blocks(best_containers(root)))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row for each row of pages. Null or empty html, and pages without main text, give an
    empty text; null ids and urls and repeated rows pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    columns = [F.col(c).cast(t).alias(c) for c, t in (("page_id", "long"), ("url", "string"), ("html", "string"))]
    return pages.select(*columns).mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
