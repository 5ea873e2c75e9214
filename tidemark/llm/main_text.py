"""The main text of web pages by composite text density.

A page is read into a tree of elements. Parts that are no article by their
element, role or class - menus, site headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments - leave the tree. For every
other node, with C characters (LC of them in links) and T tags (LT of them
links), and LCb and Cb those of the body, the density is

    C / T * log(C / LC * T / LT) / log(ln(C / (C - LC) * LC + LCb / Cb * C + e**e))

with zeros below a bar taken as one; e**e, in place of e, keeps the last
logarithm at one or more where a page has no links. Text directly in a node
counts as a child without tags of its own. The node whose children's densities
sum highest is the main one. If it lies in an article (else in a main element),
that is the text. Otherwise the lowest density on the path from the body to it
is the threshold: from the body down, the subtree of highest sum below each node
that reaches the threshold belongs to the text too.

All lists are walked by index from the end or the start, never by recursion, and
every step over a page is linear in its length, so a page of any depth is read.

Defined results: a NULL or empty page has the empty text; a page without
elements is its own text; equal pages have equal texts; ties go to the node that
comes first; unclosed elements end with their parent; an empty table gives no
rows; columns of any name stay in ``row``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of HTML by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong"
    " sub sup time tt u var wbr img nobr ruby rt rp picture source script style template meta link input param track"
    " area base embed button select textarea iframe object svg canvas noscript audio video map".split()
)
#: elements that leave an open head open
IN_HEAD = frozenset("title meta link script style base noscript template".split())
#: an open element of the list ends where the key begins
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"),
    "td": ("td", "th"), "th": ("td", "th"),
}
#: elements that keep the ends above inside them
KEEPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
DROPPED = frozenset(
    "head script style noscript template title nav footer aside form button input select textarea iframe object"
    " embed svg canvas dialog menu noembed noframes xmp audio video map".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
#: words of class and id names, whole or at an end of the name beside - or _
COMMENTS = frozenset("comment comments commentlist respond replies disqus discussion".split())
DROPPED_NAMES = COMMENTS | frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted nav navbar"
    " navigation menu breadcrumb breadcrumbs sidebar footer cookie cookies consent gdpr notice notices notification alert"
    " popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended"
    " pagination pager widget toolbar banner masthead topbar disclaimer paywall".split()
)
SITE_NAMES = frozenset("header".split())  # dropped outside articles only

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_ATTRIBUTE_END = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s=>/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_EDGE = re.compile(r"[-_]+")


@dataclass
class Tree:
    """Nodes in the order they begin; a node's children come after it."""

    name: list[str] = field(default_factory=lambda: [""])
    parent: list[int] = field(default_factory=lambda: [-1])
    attributes: list[str] = field(default_factory=lambda: [""])
    #: pieces in page order: (node, text), text None where a block begins or ends
    pieces: list[tuple[int, str | None]] = field(default_factory=list)


def _tag_end(html: str, at: int) -> int:
    """Where the tag that is open at ``at`` ends: the place of its >, quoted values skipped; -1 without one."""
    missing = ""
    while True:
        m = _ATTRIBUTE_END.search(html, at)
        if m is None:
            return -1
        if m.group() == ">":
            return m.start()
        close = -1
        # a quote opens a value after = alone; one without an end is an ordinary character
        if m.group() not in missing and html[max(0, m.start() - 8) : m.start()].rstrip().endswith("="):
            close = html.find(m.group(), m.end())
            if close < 0:
                missing += m.group()
        at = close + 1 if close >= 0 else m.end()


def parse(html: str) -> Tree:
    """The tree of a page; what is no tag is text, an unclosed tag or comment ends with the page."""
    tree = Tree()
    names, parents, attributes, pieces = tree.name, tree.parent, tree.attributes, tree.pieces
    stack = [0]
    where: dict[str, list[int]] = {}  # heights in the stack of the open elements of a name
    blocks = [0]  # heights of the open elements that are no inline ones
    lower = html.lower() if html.isascii() else re.sub(r"[A-Z]+", lambda m: m.group().lower(), html)
    at, size = 0, len(html)

    def text(low: int, high: int) -> None:
        if low < high:
            piece = unescape(html[low:high])
            if where.get("head") and piece.strip():
                close(where["head"][-1])
            pieces.append((stack[-1], piece))

    def close(height: int) -> None:
        """End all elements from this height of the stack on."""
        while len(stack) > height:
            node = stack.pop()
            where[names[node]].pop()
            if blocks[-1] == len(stack):
                blocks.pop()
                pieces.append((stack[-1], None))

    def open_(name: str, held: str, stays: bool) -> None:
        if where.get("head") and name not in IN_HEAD:
            close(where["head"][-1])
        names.append(name)
        parents.append(stack[-1])
        attributes.append(held)
        node, block = len(names) - 1, name not in INLINE
        if block:
            pieces.append((stack[-1], None))
        if stays:
            where.setdefault(name, []).append(len(stack))
            if block:
                blocks.append(len(stack))
            stack.append(node)

    while at < size:
        mark = html.find("<", at)
        if mark < 0:
            text(at, size)
            break
        if html.startswith("<!--", mark):
            text(at, mark)
            end = html.find("-->", mark + 2 if html.startswith(("<!-->", "<!--->"), mark) else mark + 4)
            at = end + 3 if end >= 0 else size
            continue
        named = _NAME.match(lower, mark + 1)
        if named is None:
            if html.startswith(("<!", "<?", "</"), mark):
                text(at, mark)
                end = html.find(">", mark)
                at = end + 1 if end >= 0 else size
            else:
                text(at, mark + 1)
                at = mark + 1
            continue
        text(at, mark)
        end = _tag_end(html, named.end())
        if end < 0:
            break
        name, at = named.group(), end + 1
        if name[0] == "/":
            name = name[1:]
            heights = where.get(name)
            if name == "br":
                pieces.append((stack[-1], None))
            if heights and (name not in INLINE or heights[-1] > blocks[-1]):
                close(heights[-1])
            continue
        if name not in INLINE:
            open_p = where.get("p")
            if open_p and name not in VOID - {"hr"}:
                close(open_p[-1])
            if name in ENDS:
                floor = max((where[k][-1] for k in KEEPS[name] if where.get(k)), default=-1)
                ended = [where[k][-1] for k in ENDS[name] if where.get(k) and where[k][-1] > floor]
                if ended:
                    close(min(ended))
        held = html[named.end() : end]
        stays = name not in VOID and name not in RAW and not (held.endswith("/") and name in ("svg", "path", "use"))
        open_(name, held, stays)
        if name in RAW:
            # the text of these elements is no page text: it ends at their end tag
            end = lower.find("</" + name, at)
            at = end if end >= 0 else size
    close(1)
    return tree


def _names_of(attributes: str) -> tuple[str, list[str], bool]:
    """Role, words of class and id at the ends of their names, and whether the element is hidden."""
    role, found, hidden = "", [], False
    if not attributes.strip(" /"):
        return role, found, hidden
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m.group(1).lower(), (m.group(2) or m.group(3) or m.group(4) or "").lower()
        if key == "role":
            role = value.strip()
        elif key in ("class", "id"):
            for word in value.split():
                parts = [p for p in _EDGE.split(word) if p]
                if parts and parts[0] not in ("with", "has", "no"):
                    found += {word, parts[0], parts[-1]}
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            hidden = True
    return role, found, hidden


def _dropped(tree: Tree) -> list[bool]:
    """Which nodes are no part of an article, with all below them."""
    n = len(tree.name)
    holds = [name in ("article", "main") for name in tree.name]  # it or a node below it is an article
    said = [_names_of(a) for a in tree.attributes]
    remarks = [not COMMENTS.isdisjoint(s[1]) for s in said]
    for i in range(n - 1, 0, -1):
        if holds[i] and not remarks[i]:
            holds[tree.parent[i]] = True
    gone, inside = [False] * n, [False] * n
    for i in range(1, n):
        up, name, (role, words, hidden) = tree.parent[i], tree.name[i], said[i]
        inside[i] = inside[up] or name in ("article", "main")
        by_name = not DROPPED_NAMES.isdisjoint(words) or not inside[i] and not SITE_NAMES.isdisjoint(words)
        gone[i] = (
            gone[up] or hidden or name in DROPPED or remarks[i] and name not in ("html", "body")
            or role in DROPPED_ROLES or name == "header" and not inside[i] and not holds[i]
            or by_name and not holds[i] and name not in ("html", "body")
        )
    return gone


def densities(tree: Tree, gone: list[bool], body: int) -> tuple[list[float], list[float]]:
    """Density of every node, 0 for dropped ones, and the sum of its children's."""
    n = len(tree.name)
    own, chars, tags, linked, links = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for node, piece in tree.pieces:
        if piece and not gone[node]:
            own[node] += len("".join(piece.split()))
    for i in range(n - 1, -1, -1):
        if gone[i]:
            continue
        chars[i] += own[i]
        if tree.name[i] == "a":
            linked[i], links[i] = chars[i], links[i] + 1
        if i:
            up = tree.parent[i]
            chars[up] += chars[i]
            tags[up] += tags[i] + 1
            linked[up] += linked[i]
            links[up] += links[i]
    share = linked[body] / max(1, chars[body])

    def density(c: int, t: int, lc: int, lt: int) -> float:
        if c == 0:
            return 0.0
        t = max(1, t)
        return c / t * log(c / max(1, lc) * t / max(1, lt)) / log(log(c / max(1, c - lc) * lc + share * c + e**e))

    dense = [density(chars[i], tags[i], linked[i], links[i]) for i in range(n)]
    sums = [density(own[i], 1, own[i] if tree.name[i] == "a" else 0, 0) for i in range(n)]
    for i in range(1, n):
        sums[tree.parent[i]] += dense[i]
    return dense, sums


def chosen(tree: Tree, gone: list[bool]) -> list[bool]:
    """Which nodes belong to the main text."""
    n = len(tree.name)
    body = next((i for i in range(n) if tree.name[i] == "body" and not gone[i]), 0)
    dense, sums = densities(tree, gone, body)
    under = [False] * n
    for i in range(n):
        under[i] = not gone[i] and (i == body or i > 0 and under[tree.parent[i]])
    # the best node of each subtree: highest sum, the first of equals
    best = list(range(n))
    for i in range(n - 1, 0, -1):
        up = tree.parent[i]
        if under[i] and under[up] and sums[best[i]] >= sums[best[up]] and sums[best[i]] > sums[up]:
            best[up] = best[i]
    main = best[body]
    path = [main]
    while path[-1] != body:
        path.append(tree.parent[path[-1]])
    for kind in ("article", "main"):
        around = [i for i in path if tree.name[i] == kind]
        if around:
            return _with_descendants(tree, under, {around[-1]})
    threshold = min(dense[i] for i in path)
    taken, reached = set(), [False] * n
    for i in range(n):
        if under[i] and (i == body or reached[tree.parent[i]]) and dense[i] >= threshold:
            reached[i] = True
            if dense[i] > 0 or i == body:
                taken.add(best[i])
    return _with_descendants(tree, under, taken)


def _with_descendants(tree: Tree, under: list[bool], taken: set[int]) -> list[bool]:
    marked = [False] * len(under)
    for i in range(len(under)):
        marked[i] = under[i] and (i in taken or i > 0 and marked[tree.parent[i]])
    return marked


def main_text(html: str | None) -> str:
    """The main text of one page, blocks joined by one space."""
    if not html:
        return ""
    tree = parse(html)
    marked = chosen(tree, _dropped(tree))
    return " ".join("".join([" " if piece is None else piece for node, piece in tree.pieces if piece is None or marked[node]]).split())


def extracted(pages: DataFrame, html: str = "html") -> DataFrame:
    """(row, text, n_chars): each row without its page, the page's main text and the number of its code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column("html")]
            counts = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), counts], ["row", "text", "n_chars"])

    # the page itself does not come back
    rest = F.struct(*[pages[f"`{c}`"] for c in pages.columns if c != html])
    kept = pages.select(rest.alias("row"), pages[f"`{html}`"].alias("html"))
    schema = kept.drop("html").schema.add("text", "string").add("n_chars", "long")
    return kept.mapInArrow(run, schema)
