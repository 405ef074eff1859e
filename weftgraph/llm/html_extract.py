"""Main text of web pages by wrapper induction.

Induction reads every page of a host, whole. A page's block elements make a tree, in which alike siblings (blocks of one
name that hold no blocks, and named boxes of one structure) count as one repeated node. Pages with equal trees share a
layout; statistics of a layout's nodes are sums over its pages. The layouts of a host, the most frequent first, are aligned
by simple tree matching and merged into one template tree: nodes that match add up, others are inserted. So a template has
for each node on how many pages it stands, its characters and how many of them are links. A slot (the blocks at one path) is
constant if nearly all its texts are the same on nearly all pages that have it, and varying otherwise. Texts of constant slots
are template, from five pages on. A text in a varying slot is content, also if pages share it, unless it stands on twenty
pages and on nearly all of the site's. Paths whose texts come from a small pool are recycled.

A page is read with its host's template (or, if its host has fewer than three distinct pages, with that of its domain): its
tree is aligned with the template by the same matching. From the root, the reading follows the nodes that
hold the varying, unlinked text, by what the template expects of them and not by this page alone; what stands beside them
(menus, adverts, footers) is left out. Inside, lists of links that stand on most pages and boxes of recycled text go.
Names of elements and classes decide only what such evidence can't: boxes named as comments, notices or adverts go, unless
next to all of the expected text is in them. A page without a template is read by its own tree alone.

Defined results: null and empty html give an empty text, as does a page that has template texts only. Pages with a null
URL have no host and so no template. Pages whose three longest blocks are equal count as one in induction, so that copies
of a page don't make its text a template. Repeated rows get a row each. Truncated pages give the text up to their end;
broken nesting is repaired as browsers do for paragraphs, lists and tables. Layouts with equal page counts are merged in
the order of their hash; of boxes with equal expectations the first leads. White space is all that Unicode calls so,
no-break spaces included. Very long pages are read whole. Other columns of the input, whatever their names, are not
carried. An empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._common import materialize, slices
from weftgraph.llm.url_filter import host_of

#: Distinct pages that a host's template needs, and that a constant text stands on; to be left out inside of a text it stands
#: on more: in a slot of its own, and in a slot of texts that vary.
LEAST_PAGES, SLOT_PAGES, VARYING_PAGES = 3, 5, 20
#: Percent of the pages with a path that have a constant text there, and of a constant slot's texts that are constant.
CONSTANT = 90
#: Texts at a path that are recycled: so many at least, and at most this percent of them distinct.
POOL_TEXTS, POOL_PERCENT = 30, 20
#: A box beside the leading one is read too, if it is expected to hold this percent of what that one does.
BESIDE = 20
#: Percent of links in a list of links, and of its parent's pages that one of the site's own lists stands on.
LINKED, STANDING = 70, 80
#: A box is read despite its name if it is expected to hold this percent of all text around it.
NAMED = 90
#: Deeper boxes count to the one at this depth; a wider row of boxes is grouped by name before it is aligned.
DEPTH, WIDTH = 60, 100
#: Layouts of a site that one task merges; their templates are merged then.
MERGED = 1000
#: Templates that every worker is given, those of the hosts with the most pages: so many, of so many characters each, at most.
SHARED_HOSTS, SHARED_CHARS = 4_000, 8_000
#: Of the other hosts one with more pages than this, and than one in 10,000 of all, is read at several seats.
SEAT_PAGES, LARGE_HOSTS = 200, 10_000
#: Labels below a country's that registries share out, and names below which everybody may have a host.
REGISTRY_LABELS = "ac co com edu go gob gouv gov ne net nom or org sch".split()
SHARED_NAMES = "appspot.com blogspot.com github.io gitlab.io herokuapp.com livejournal.com netlify.app tumblr.com weebly.com wordpress.com".split()

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|title|textarea|noscript|template|iframe|xmp|noembed|noframes|select|svg|math|object|canvas)(?=[\s/>])[^>]*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>"
    r"|<[!?/][^>]*+(?:>|\Z)"
    r"|<[a-zA-Z][^>]*+\Z",
    re.S | re.I,
)
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)\b""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption head".split()
)
#: A start tag ends an open element of these, up to the element that bounds it.
_ENDS = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
_ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _ENDS.items()}
_BOUNDS = frozenset("article aside body button caption div footer form header html main nav section table td th li blockquote".split())

#: Elements that hold no text of an article: forms and their parts, media, the page's head.
_NO_TEXT = frozenset("form button input label dialog menu head audio video map".split())
#: Elements that may be left out as a whole: boxes. Paragraphs, headings, list items and cells never are.
_BOXES = frozenset("address aside center details div dl fieldset figure footer header hgroup nav ol section table ul menu dir main article".split())
#: Elements, roles and name parts of boxes that serve the site, for where a template can't tell.
_CHROME_TAGS = frozenset("nav footer aside".split())
_CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_CHROME_NAMES = frozenset(
    "ad ads adbox adsense adslot advert adverts advertisement advertising advertorial alert banner bottombar breadcrumb breadcrumbs "
    "comment comments commentlist consent cookie cookies copyright discussion disqus dropdown footer form gdpr hamburger "
    "login masthead menu modal nav navbar navigation navlinks newsletter notice notices notification pager pagination paywall popup "
    "promo promoted promotion rail recommended recommendations related replies respond reviews search share sharing sidebar sidenav signup "
    "skip social sponsor sponsored subscribe subscription tags toc toolbar topbar widget widgets".split()
)
_HEADER_NAMES = frozenset(("header", "heading", "head", "top"))
_HEADINGS = frozenset(("h1", "h2"))
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PLAIN = re.compile(r"[^\w-]+|\d+")


class Node:
    """An element; texts are str children. `skip`: it shows no text of its own; `named`, `headed`: by its names."""

    __slots__ = ("tag", "label", "parent", "children", "skip", "named", "headed", "box")

    def __init__(self, tag: str, label: str, parent: Node | None, skip: bool, named: bool, headed: bool):
        self.tag, self.label, self.parent, self.children, self.skip, self.named, self.headed = tag, label, parent, [], skip, named, headed
        self.box = None


def _described(tag: str, attrs: str, parent: Node) -> Node:
    label, skip, named, headed = tag, tag in _NO_TEXT, tag in _CHROME_TAGS, tag == "header"
    if attrs:
        for key, a, b, c, hidden in _ATTR.findall(attrs):
            key, value = key.lower(), a or b or c
            if hidden or key == "aria-hidden" and value == "true":
                skip = True
            elif key in ("class", "id"):
                if key == "class":
                    label = f"{tag}.{'.'.join(sorted({_PLAIN.sub('', x) for x in value.split()}))}"
                if tag in _BOXES and tag not in ("article", "main"):
                    parts = _NAME.findall(_CAMEL.sub(" ", value).lower())
                    named = named or any(p in _CHROME_NAMES for p in parts)
                    headed = headed or any(p in _HEADER_NAMES for p in parts)
            elif key == "role" and value.lower() in _CHROME_ROLES:
                named = True
            elif key == "style" and "none" in value and re.search(r"display\s*:\s*none", value):
                skip = True
    return Node(tag, label, parent, skip, named, headed)


def parse(html: str) -> Node:
    """The tree of a page; texts are str children, as written."""
    root = node = Node("", "", None, False, False, False)
    at = 0
    for m in _TOKEN.finditer(html):
        start = m.start()
        if start > at:
            node.children.append(html[at:start])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if m[2]:
            up = node
            while up is not None and up.tag != tag:
                up = up.parent
            if up is not None and up.parent is not None:
                node = up.parent
            elif tag == "p":
                node.children.append(Node("p", "p", node, False, False, False))
            continue
        if tag in _ENDS:
            ends, bounds = _ENDS[tag]
            up, last = node, None
            while up is not None and up.tag not in bounds:
                if up.tag in ends:
                    last = up
                up = up.parent
            if last is not None:
                node = last.parent
        elif tag in _BLOCK:
            up = node
            while up.tag not in _BOUNDS and up.parent is not None:
                if up.tag == "p":
                    node = up.parent
                    break
                up = up.parent
        attrs = m[4]
        child = _described(tag, attrs if attrs.strip(" /") else "", node)
        node.children.append(child)
        if tag not in _VOID and not (attrs.endswith("/") and tag not in _BLOCK):
            node = child
    if at < len(html):
        node.children.append(html[at:])
    return root


def _squeezed(pieces: list[str]) -> str:
    text = "".join(pieces)
    return " ".join((unescape(text) if "&" in text else text).split())


def blocks(root: Node) -> Iterator[tuple[str, Node, int, int]]:
    """The texts of a tree's blocks in page order: text, block element it stands in, characters of links, links."""
    pieces: list[str] = []
    owner, linked, links = root, 0, 0
    # (element, next child, its block element, whether inside a link)
    stack: list[tuple[Node, int, Node, bool]] = [(root, 0, root, False)]
    while stack:
        x, k, block, link = stack.pop()
        children = x.children
        while k < len(children):
            c = children[k]
            k += 1
            if isinstance(c, str):
                if not pieces:
                    owner = block
                pieces.append(c)
                linked += len(c.strip()) if link else 0
                continue
            tag = c.tag
            if tag == "br" or tag in ("td", "th"):
                pieces.append(" ")
            if tag in _BLOCK:
                if pieces and (text := _squeezed(pieces)):
                    yield text, owner, linked, links
                pieces, linked, links = [], 0, 0
            if c.skip:
                if tag not in _BLOCK:
                    pieces.append(" ")
                continue
            if c.children:
                links += tag == "a"
                stack.append((x, k, block, link))
                stack.append((c, 0, c if tag in _BLOCK else block, link or tag == "a"))
                break
        else:
            if x.tag in _BLOCK:
                if pieces and (text := _squeezed(pieces)):
                    yield text, owner, linked, links
                pieces, linked, links = [], 0, 0
    if pieces and (text := _squeezed(pieces)):
        yield text, owner, linked, links


class Box:
    """A node of a page's block tree: one block element, or several that count as one repeated node."""

    __slots__ = ("label", "tag", "named", "headed", "kids", "parent", "same", "place", "chars", "linked", "links", "n", "path")

    def __init__(self, node: Node, parent: Box | None):
        self.tag, self.named, self.headed, self.kids, self.parent = node.tag, node.named, node.headed, [], parent
        self.label = node.label + ("!" if node.named else "") + ("^" if node.headed else "")
        self.same, self.place, self.chars, self.linked, self.links, self.n, self.path = None, -1, 0, 0, 0, 0, ""


def _find(box: Box) -> Box:
    while box.same is not None:
        box = box.same
    return box


def _structure(box: Box) -> list:
    return [box.label, [_structure(k) for k in box.kids]]


def _collapse(box: Box) -> str:
    """Join alike children, bottom up; returns the box's structure as text."""
    marks = [_collapse(k) for k in box.kids]
    if len(box.kids) > 1:
        wide = len(box.kids) > WIDTH
        seen: dict[tuple, Box] = {}
        kept, kept_marks = [], []
        for kid, mark in zip(box.kids, marks, strict=True):
            leaf = not kid.kids
            alike = leaf or wide or "." in kid.label or kid.tag in ("li", "tr", "dd", "dt", "article", "section", "blockquote")
            key = (kid.label, "" if leaf or wide else mark)
            if alike and (first := seen.get(key)) is not None:
                _join(first, kid)
                continue
            seen[key] = kid
            kept.append(kid)
            kept_marks.append(mark)
        if len(kept) > WIDTH:  # names that differ from box to box: by element alone
            seen, narrow = {}, []
            for kid in kept:
                if (first := seen.get((kid.tag,))) is not None:
                    _join(first, kid)
                else:
                    seen[(kid.tag,)] = kid
                    kid.label = kid.tag
                    narrow.append(kid)
            kept = narrow
        if len(kept) < len(box.kids):
            box.kids = kept
            kept_marks = [_mark(k) for k in kept] if wide else kept_marks
        marks = kept_marks
    return f"{box.label}({','.join(marks)})"


def _mark(box: Box) -> str:
    return f"{box.label}({','.join(map(_mark, box.kids))})"


def _join(first: Box, other: Box) -> None:
    """other becomes part of first; their children are paired by name, in order."""
    other.same = first
    for name in ("chars", "linked", "links", "n"):
        setattr(first, name, getattr(first, name) + getattr(other, name))
    by_name: dict[str, Box] = {}
    for k in first.kids:
        by_name.setdefault(k.label, k)
    for k in other.kids:
        if (mine := by_name.get(k.label)) is not None:
            _join(mine, k)
        else:
            k.parent = first
            first.kids.append(k)
            by_name[k.label] = k


class Page:
    """A page's block tree and its texts: (text, box, hash of the path and text)."""

    def __init__(self, html: str):
        tree = parse(html)
        self.root = Box(tree, None)
        tree.box = self.root
        stack = [(c, self.root, 1) for c in reversed(tree.children) if not isinstance(c, str)]
        while stack:
            node, up, depth = stack.pop()
            if node.skip:
                continue
            if node.tag in _BLOCK and depth <= DEPTH:
                box = Box(node, up)
                up.kids.append(box)
                up, depth = box, depth + 1
            node.box = up
            stack += [(c, up, depth) for c in reversed(node.children) if not isinstance(c, str)]
        found = []
        for text, node, linked, links in blocks(tree):
            box = node.box
            box.chars += len(text)
            box.linked += min(linked, len(text))
            box.links += links
            box.n += 1
            found.append((text, box))
        _collapse(self.root)
        self.boxes: list[Box] = []
        stack = [(self.root, "")]
        while stack:
            box, path = stack.pop()
            box.place, box.path = len(self.boxes), f"{path}/{box.label}"
            self.boxes.append(box)
            stack += [(k, box.path) for k in reversed(box.kids)]
        for box in self.boxes:
            for k in box.kids:
                k.parent = box
        self.texts = [(text, _find(box)) for text, box in found]

    def structure(self) -> str:
        return json.dumps(_structure(self.root), separators=(",", ":"))


def _hash(*parts: str) -> int:
    """A signed 64-bit hash."""
    return xxhash.xxh3_64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


class Part:
    """A node of a template: its name, the pages that have it, and what its own blocks held on them."""

    __slots__ = ("label", "pages", "chars", "linked", "n", "kids", "fixed", "_whole")

    def __init__(self, label: str, pages: int = 0, chars: int = 0, linked: int = 0, n: int = 0, kids: list[Part] | None = None):
        self.label, self.pages, self.chars, self.linked, self.n, self.kids = label, pages, chars, linked, n, kids or []
        self.fixed, self._whole = 0.0, None

    def _sums(self) -> tuple[float, int, int]:
        """Worth, characters and link characters of the node and all below; held once the template is whole."""
        if self._whole is None:
            share = max(0.0, 1 - self.fixed)
            worth, chars, linked = share * (self.chars - self.linked + self.linked / 20), self.chars, self.linked
            for k in self.kids:
                a, b, c = k._sums()
                worth, chars, linked = worth + a, chars + b, linked + c
            self._whole = worth, chars, linked
        return self._whole

    def mass(self) -> float:
        return self._sums()[0]

    def whole(self) -> tuple[int, int]:
        return self._sums()[1:]

    def packed(self) -> list:
        return [self.label, self.pages, self.chars, self.linked, self.n, [k.packed() for k in self.kids]]

    @staticmethod
    def unpacked(x: list) -> Part:
        return Part(*x[:5], [Part.unpacked(k) for k in x[5]])


class Shape:
    """A node of a layout, with its place in page order."""

    __slots__ = ("label", "place", "kids")

    def __init__(self, x: list, places: Iterator[int]):
        self.label, self.place = x[0], next(places)
        self.kids = [Shape(k, places) for k in x[1]]


def _shape(structure: str) -> Shape:
    return Shape(json.loads(structure), iter(range(1 << 62)))


def layout_part(structure: str, pages: int, sums: list[tuple[int, int, int]]) -> Part:
    """A layout of so many pages as a template; sums are the characters, link characters and blocks of its nodes in page order."""
    places = iter(sums)

    def made(x: list) -> Part:
        return Part(x[0], pages, *next(places), [made(k) for k in x[1]])

    return made(json.loads(structure))


def match_trees(a, b) -> tuple[int, list]:
    """Simple tree matching of two trees whose nodes have `label` and `kids`: the size of the largest top-down, order-keeping
    alignment of nodes of equal names, and its pairs."""
    if a.label != b.label:
        return 0, []
    xs, ys = a.kids, b.kids
    table = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    found = {}
    for i, x in enumerate(xs, 1):
        for j, y in enumerate(ys, 1):
            if x.label == y.label:
                found[i, j] = match_trees(x, y)
                table[i][j] = max(table[i - 1][j], table[i][j - 1], table[i - 1][j - 1] + found[i, j][0])
            else:
                table[i][j] = max(table[i - 1][j], table[i][j - 1])
    pairs, i, j = [(a, b)], len(xs), len(ys)
    while i and j:
        if (i, j) in found and table[i][j] == table[i - 1][j - 1] + found[i, j][0]:
            pairs += found[i, j][1]
            i, j = i - 1, j - 1
        elif table[i][j] == table[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return 1 + table[len(xs)][len(ys)], pairs


class Template:
    """The merged layouts of a site, its constant texts and its recycled paths."""

    def __init__(self, root: Part | None = None, constant: set[int] | None = None, recycled: set[int] | None = None):
        self.root, self.constant, self.recycled = root, constant or set(), recycled or set()
        self.pages = root.pages if root else 0
        self._held: dict[str, dict[int, Part]] = {}

    @staticmethod
    def read(text: str | None) -> Template | None:
        if not text:
            return None
        made = json.loads(text)
        root = Part.unpacked(json.loads(made["tree"]))
        fixed: dict[int, int] = {}
        for x in made.get("fixed") or []:
            fixed[x["path"]] = fixed.get(x["path"], 0) + x["chars"]
        if fixed:
            at: dict[int, list[Part]] = {}
            stack = [(root, "")]
            while stack:
                part, path = stack.pop()
                path = f"{path}/{part.label}"
                at.setdefault(_hash(path), []).append(part)
                stack += [(k, path) for k in part.kids]
            for path, chars in fixed.items():
                total = sum(p.chars for p in at.get(path, []))
                for part in at.get(path, []):
                    part.fixed = min(1.0, chars / total) if total else 0.0
        return Template(root, set(made.get("constant") or []), set(made.get("recycled") or []))

    def merge(self, other: Part) -> None:
        """Align another template's tree, or a layout's, with this one: nodes that match add up, others are inserted."""
        if self.root is None:
            self.root = Part(other.label)
        pairs = {id(b): a for a, b in match_trees(self.root, other)[1]}
        stack = [other]
        while stack:
            b = stack.pop()
            a = pairs[id(b)]
            a.pages, a.chars, a.linked, a.n = a.pages + b.pages, a.chars + b.chars, a.linked + b.linked, a.n + b.n
            at = 0
            for kid in b.kids:
                if (mine := pairs.get(id(kid))) is None:
                    a.kids.insert(at, kid)
                    at += 1
                else:
                    at = next(i for i, k in enumerate(a.kids) if k is mine) + 1
                    stack.append(kid)
        self.pages = self.root.pages

    def aligned(self, page: Page) -> dict[int, Part]:
        """The template's node for each place of the page's tree that has one."""
        key = page.structure()
        if key not in self._held:
            if len(self._held) >= 500:
                self._held.clear()
            self._held[key] = {b.place: a for a, b in match_trees(self.root, _shape(key))[1]} if self.root else {}
        return self._held[key]


class Reading:
    """Which boxes of a page are read, by what its template expects of them."""

    def __init__(self, page: Page, template: Template | None):
        self.page, self.template, self.known = page, template, template.aligned(page) if template else {}
        own = [(b.chars - b.linked, b.linked, b.chars, b.links) for b in page.boxes]
        sums = [list(x) for x in own]
        for box in reversed(page.boxes):  # children come after their parents
            if box.parent is not None:
                up = sums[box.parent.place]
                for i, x in enumerate(sums[box.place]):
                    up[i] += x
        self.sums, self.kept, self.headings = sums, set(), set()
        for box in page.boxes:
            if box.tag in _HEADINGS and box.n:
                up = box
                while up is not None and up.place not in self.headings:
                    self.headings.add(up.place)
                    up = up.parent
        self._pick(page.root, False)

    def expected(self, box: Box) -> float:
        """Characters of text, links at a twentieth, that the box holds on a page that has it."""
        part = self.known.get(box.place)
        if part is not None and part.pages:
            return part.mass() / part.pages
        plain, linked = self.sums[box.place][:2]
        return plain + linked / 20

    def _list_of_links(self, box: Box, within: bool) -> bool:
        """A list or box of links that stands on the site's pages, and inside a text has recycled links; without a template,
        one outside of a text."""
        _, linked, chars, links = self.sums[box.place]
        if links < 3 or 100 * linked < LINKED * chars:
            return False
        part, up = self.known.get(box.place), self.known.get(box.parent.place) if box.parent is not None else None
        if part is None or up is None or up.pages < LEAST_PAGES:
            return not within
        chars, linked = part.whole()
        standing = 100 * part.pages >= STANDING * up.pages and 100 * linked >= LINKED * chars
        return standing and (not within or self._recycled(box))

    def _recycled(self, box: Box) -> bool:
        stack = [box]
        while stack:
            x = stack.pop()
            if x.n and _hash(x.path) in self.template.recycled:
                return True
            stack += x.kids
        return False

    def _site_part(self, box: Box, total: float, within: bool) -> bool:
        if box.tag not in _BOXES:
            return False
        if self._list_of_links(box, within):
            return True
        by_name = box.named or box.headed and box.place not in self.headings
        return by_name and 100 * self.expected(box) < NAMED * total

    def _pick(self, root: Box, within: bool) -> None:
        stack = [(root, within)]
        while stack:
            box, within = stack.pop()
            self.kept.add(box.place)
            within = within or box.tag in ("article", "main")
            held = [k for k in box.kids if k.kids or k.tag in _BOXES]
            worth = {k.place: self.expected(k) for k in box.kids}
            whole = self.expected(box)
            direct = whole - sum(worth[k.place] for k in held)
            # Where most text stands in paragraphs and not in boxes, the text begins.
            within = within or all(worth[k.place] <= direct for k in held)
            live = [k for k in held if not self._site_part(k, whole, within)]
            lead = max(live, key=lambda k: worth[k.place], default=None)
            for k in box.kids:
                if k not in held or k in live and (within or k is lead or self._beside(k, lead, worth)):
                    stack.append((k, within))
            if lead is not None and not within and 100 * self._own(box) < BESIDE * worth[lead.place]:
                self.kept.discard(box.place)  # stray text beside the leading box; its children are judged by themselves

    def _own(self, box: Box) -> float:
        part = self.known.get(box.place)
        return (part.chars - part.linked) / part.pages if part is not None and part.pages else box.chars - box.linked

    def _beside(self, box: Box, lead: Box, worth: dict[int, float]) -> bool:
        """Whether a box is read beside the leading one: it holds much, is of its kind, or has the title that the other lacks."""
        if 100 * worth[box.place] >= BESIDE * worth[lead.place] and (self.template or lead.tag not in ("article", "main")):
            return True
        if box.label == lead.label and ("." in box.label or box.tag in ("article", "section", "table", "blockquote")):
            return True
        return box.place in self.headings and lead.place not in self.headings and box.place < lead.place


def main_text(html: str | None, template: Template | None) -> str:
    if not html:
        return ""
    page = Page(html)
    kept = Reading(page, template).kept
    found = [(t, b) for t, b in page.texts if b.place in kept]
    if template:
        found = [
            (t, b)
            for t, b in found
            if _hash(b.path, t) not in template.constant and not (template.recycled and b.tag in _BOXES and _hash(b.path) in template.recycled)
        ]
    return "\n".join(t for t, _ in found)


def plain_text(html: str | None) -> str:
    """All text that a page shows, the site's parts included: one line for each block."""
    return "\n".join(x[0] for x in blocks(parse(html))) if html else ""


_SUMS = pa.list_(pa.struct([("k", pa.int32()), ("chars", pa.int64()), ("linked", pa.int64()), ("n", pa.int64())]))
_TEXTS = pa.list_(pa.struct([("path", pa.int64()), ("h", pa.int64()), ("chars", pa.int64())]))
_FEATURES = "host string, ident bigint, sig bigint, tree string, sums array<struct<k:int,chars:bigint,linked:bigint,n:bigint>>, texts array<struct<path:bigint,h:bigint,chars:bigint>>"


def page_features(pages: DataFrame) -> DataFrame:
    """Of each page (host, html): its identity, layout, the sums of its nodes, and its texts as hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2 << 20, "html"):
            out = []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = Page(html)
                tree = page.structure()
                longest = sorted({t for t, _ in page.texts}, key=lambda t: (-len(t), t))[:3]
                sums = [{"k": b.place, "chars": b.chars, "linked": b.linked, "n": b.n} for b in page.boxes]
                texts = {(_hash(b.path), _hash(b.path, t)): len(t) for t, b in page.texts}
                out.append((host, _hash(*longest), _hash(tree), tree, sums, [{"path": p, "h": h, "chars": n} for (p, h), n in sorted(texts.items())]))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), _SUMS, _TEXTS]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["host", "ident", "sig", "tree", "sums", "texts"])

    return pages.mapInArrow(run, _FEATURES)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(site, seat, pages, tree) from rows in order of site and seat: layouts (site, seat, pages, tree, sums), or templates, without
    sums. A worker holds one template."""
    of, template = None, None

    def done() -> pa.RecordBatch:
        tree = json.dumps(template.root.packed(), separators=(",", ":"))
        return pa.RecordBatch.from_arrays(
            [pa.array([of[0]]), pa.array([of[1]], pa.int32()), pa.array([template.pages], pa.int64()), pa.array([tree])], names=["site", "seat", "pages", "tree"]
        )

    for batch in batches:
        for site, seat, pages, tree, sums in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (site, seat) != of:
                if template is not None:
                    yield done()
                of, template = (site, seat), Template()
            template.merge(Part.unpacked(json.loads(tree)) if sums is None else layout_part(tree, pages, [(s["chars"], s["linked"], s["n"]) for s in sums]))
    if template is not None:
        yield done()


def site_of_domain(host):
    """The name under which the small hosts of a domain have a template together: the host's last two labels, or three below
    names that registries or hosting services share out. An address of numbers is its own domain."""
    registry = rf"(^|\.)({'|'.join(REGISTRY_LABELS)})\.[a-z][a-z]$"
    shared = rf"(^|\.)({'|'.join(x.replace('.', '[.]') for x in SHARED_NAMES)})$"
    name = F.when(host.rlike(r"^[0-9.:\[\]]+$"), host).when(host.rlike(registry) | host.rlike(shared), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))
    return F.concat(F.lit("*."), name)


def induce_templates(pages: DataFrame, url: str = "url", html: str = "html", merged: int = MERGED) -> DataFrame:
    """(site, pages, template) for every host of LEAST_PAGES distinct pages, and every domain that has smaller hosts, as JSON.

    A site of over `merged` layouts is merged in parts of about so many, and the parts' templates then.
    """
    rows = pages.select(host_of(F.col(f"`{url}`")).alias("host"), F.col(f"`{html}`").alias("html")).filter("host <> '' and html <> ''")
    distinct = page_features(rows).groupBy("host", "ident").agg(F.min(F.struct("sig", "tree", "sums", "texts")).alias("m"))
    distinct = materialize(distinct.select("host", "m.*"), "page-features")
    hosts = distinct.groupBy("host").agg((F.count("*") >= LEAST_PAGES).alias("own")).withColumn("domain", site_of_domain(F.col("host")))
    small = hosts.filter(~F.col("own")).select("domain").distinct().withColumn("needed", F.lit(True))
    sites = F.array_compact(F.array(F.when(F.col("own"), F.col("host")), F.when(F.col("needed"), F.col("domain"))))
    sites = hosts.join(small, "domain", "left").select("host", F.explode(sites).alias("site"))
    of_site = distinct.join(sites, "host")

    nodes = of_site.select("site", "sig", "tree", F.explode("sums").alias("s")).select("site", "sig", F.when(F.col("s.k") == 0, F.col("tree")).alias("tree"), "s.*")
    nodes = nodes.groupBy("site", "sig", "k").agg(F.count("*").alias("pages"), F.max("tree").alias("tree"), *[F.sum(c).alias(c) for c in ("chars", "linked", "n")])
    layouts = nodes.groupBy("site", "sig").agg(F.max("pages").alias("pages"), F.max("tree").alias("tree"), F.sort_array(F.collect_list(F.struct("k", "chars", "linked", "n"))).alias("sums"))
    layouts = materialize(layouts, "layouts")
    parts = layouts.groupBy("site").agg(F.ceil(F.count("*") / merged).alias("parts"), F.sum("pages").alias("all_pages"))
    layouts = layouts.join(parts, "site").withColumn("seat", F.pmod("sig", "parts").cast("int"))
    layouts = layouts.repartition("site", "seat").sortWithinPartitions("site", "seat", F.desc("pages"), "sig").select("site", "seat", "pages", "tree", "sums")
    trees = layouts.mapInArrow(_merged, "site string, seat int, pages bigint, tree string")
    trees = trees.repartition("site").sortWithinPartitions("site", F.desc("pages"), "seat").select("site", F.lit(0).alias("seat"), "pages", "tree", F.lit(None).cast("array<int>").alias("sums"))
    trees = trees.mapInArrow(_merged, "site string, seat int, pages bigint, tree string").select("site", "pages", "tree")

    texts = of_site.select("site", F.explode("texts").alias("t")).select("site", "t.*").groupBy("site", "path", "h").agg(F.count("*").alias("n"), F.max("chars").alias("chars"))
    paths = of_site.select("site", F.explode(F.array_distinct(F.transform("texts", lambda t: t["path"]))).alias("path")).groupBy("site", "path").agg(F.count("*").alias("pages"))
    pool = texts.groupBy("site", "path").agg(F.count("*").alias("d"), F.sum("n").alias("n"))
    # Texts on nearly all pages of their path, of which a path has few: over CONSTANT percent of its pages each.
    often = texts.filter(F.col("n") >= LEAST_PAGES).join(paths, ["site", "path"]).filter(100 * F.col("n") >= CONSTANT * F.col("pages"))
    slots = often.groupBy("site", "path").agg(F.sum("n").alias("fixed_n"), F.collect_list(F.struct("h", F.col("n").alias("on"), "chars")).alias("texts"))
    slots = slots.join(pool, ["site", "path"]).join(parts, "site").withColumn("own", 100 * F.col("fixed_n") >= CONSTANT * F.col("n"))
    constant = slots.select("site", "path", "own", "all_pages", F.explode("texts").alias("t")).select("site", "path", "own", "all_pages", "t.*")
    everywhere = (F.col("on") >= VARYING_PAGES) & (100 * F.col("on") >= CONSTANT * F.col("all_pages"))
    constant = constant.filter(F.col("own") | everywhere)
    constant = constant.groupBy("site").agg(
        F.sort_array(F.collect_list(F.when(F.col("on") >= SLOT_PAGES, F.col("h")))).alias("constant"),
        F.sort_array(F.collect_list(F.struct("path", (F.col("on") * F.col("chars")).alias("chars")))).alias("fixed"),
    )
    pool = pool.filter((F.col("n") >= POOL_TEXTS) & (100 * F.col("d") <= POOL_PERCENT * F.col("n")))
    pool = pool.groupBy("site").agg(F.sort_array(F.collect_list("path")).alias("recycled"))
    whole = trees.join(constant, "site", "left").join(pool, "site", "left")
    return whole.select("site", "pages", F.to_json(F.struct("tree", "constant", "fixed", "recycled")).alias("template"))


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: key, url, text, n_chars.

    The templates of the hosts with the most pages, a set of bounded size, go to every worker, and these hosts' pages stay where
    they are. All other pages are sorted by host, each host's template before its pages, so that it is sent once for a host.
    Large hosts among them, LARGE_HOSTS at most by their definition, are spread over seats, with the template at each.
    """
    made = materialize(induce_templates(pages, url, html).filter(F.col("pages") >= LEAST_PAGES), "templates")
    host = host_of(F.col(f"`{url}`"))
    counts = pages.select(host.alias("host")).filter("host <> ''").groupBy("host").count().withColumn("site", site_of_domain(F.col("host")))
    of_host = counts.join(made.select(F.col("site").alias("host"), F.col("template").alias("of_host")), "host", "left")
    of_host = of_host.join(made.select("site", F.col("template").alias("of_domain")), "site", "left")
    of_host = materialize(of_host.select("host", "count", F.coalesce("of_host", "of_domain").alias("template")), "hosts")
    shared = {r.host: r.template for r in of_host.filter(F.length("template") <= SHARED_CHARS).orderBy(F.desc("count"), "host").limit(SHARED_HOSTS).select("host", "template").collect()}
    spark = pages.sparkSession
    given = spark.sparkContext.broadcast(shared)
    near = F.broadcast(spark.createDataFrame([(h, True) for h in shared], "host string, near boolean"))

    rows = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"), host.alias("host"))
    rows = rows.join(near, "host", "left").withColumn("near", (F.col("host") == "") | F.coalesce("near", F.lit(False)))
    kind = pages.schema[key].dataType
    limit = max(SEAT_PAGES, (of_host.agg(F.sum("count")).first()[0] or 0) // LARGE_HOSTS)
    others = of_host.join(near, "host", "left_anti").withColumn("seats", F.ceil(F.col("count") / limit).cast("int"))
    first = others.filter("template is not null").select("host", F.explode(F.sequence(F.lit(0), F.col("seats") - 1)).alias("seat"), "template")
    first = first.select(F.lit(None).cast(kind).alias("key"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "host", "seat", "template")
    far = rows.filter("not near").join(F.broadcast(others.filter(F.col("seats") > 1).select("host", "seats")), "host", "left")
    far = far.withColumn("seat", F.floor(F.rand(7) * F.coalesce("seats", F.lit(1))).cast("int")).drop("seats", "near").withColumn("template", F.lit(None).cast("string"))
    far = far.withColumn("page", F.lit(1)).unionByName(first.withColumn("page", F.lit(0)))
    far = far.repartition("host", "seat").sortWithinPartitions("host", "seat", "page").select("key", "url", "html", "host", "page", "template")

    def read(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["key", "url", "text", "n_chars"])

    def in_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Template | None] = {}
        for batch in slices(batches, 4 << 20, "html"):
            texts = []
            for html, host in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if host not in held:
                    if len(held) >= 300:
                        held.clear()
                    held[host] = Template.read(given.value.get(host))
                texts.append(main_text(html, held[host]))
            yield read(batch, texts)

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, template, packed = None, None, None
        for batch in slices(batches, 4 << 20, "html"):
            texts, is_page = [], []
            for html, host, page, text in zip(*[batch.column(k).to_pylist() for k in range(2, 6)], strict=True):
                is_page.append(page == 1)
                if page == 0:
                    at = host
                    if text != packed:
                        template, packed = Template.read(text), text
                else:
                    texts.append(main_text(html, template if host == at else None))
            yield read(batch.filter(pa.array(is_page)), texts)

    result = f"key {kind.simpleString()}, url string, text string, n_chars bigint"
    out = rows.filter("near").select("key", "url", "html", "host").mapInArrow(in_place, result).unionByName(far.mapInArrow(in_order, result))
    return out.select(F.col("key").alias(key), "url", "text", "n_chars")
