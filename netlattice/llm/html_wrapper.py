"""Main-text extraction with wrappers: union-free regular expressions inferred per host.

A page is a tree of elements and texts.  A wrapper has the same shape, with
multiplicities: an element, a text slot or a group of them is required,
optional or repeated.  Wrappers are inferred by iterated alignment: a page
first folds its own adjacent repeats (single nodes, or groups of two or three)
into repeated ones; then it is aligned with the wrapper so far, child list by
child list.  Matching nodes merge, nodes on one side only become optional,
texts that differ become slots, and repeats that this brings together are
folded again.  No choice between alternatives ever arises (union-free).

Every task folds its pages into one wrapper per host; those are merged in two
steps, by host and salt, then by host, so that no host's pages meet in a task.
All pages of a host take part, and what is held is the wrapper, not the pages.

What a host's wrapper says counts once ``SUPPORT`` different pages stand behind
it (identical pages are one).  Then

* the content is the block that holds most of the text that varies and is not in
  links, or the ``article`` or ``main`` around it;
* parts that are the same on all pages that have them carry no weight in that,
  and inside the content they go if they hold a link (share bars, teasers, notes
  on the site).  Constant text without links stays: it may be a heading.

Where fewer pages are known, outermost ``article`` and ``main`` elements are the
content, else the block with most text.  Elements whose tag, role or whole class
or id name says menu, sidebar, notice, advert, form, script or comments are no
content anywhere; page headers and footers neither, but a header inside an
article or main is part of it.

Wrappers are broadcast only if their measured size is at most
``BROADCAST_CHARS``; else pages are joined with them by host and salt.

Null or empty html gives an empty text.  Null or odd URLs share one wrapper.
Unclosed and stray tags are repaired; a page without tags is all text.  Pages of
any length and nesting are read whole; long child lists are aligned at keys that
are unique in both, so that no page costs more than its length, about.  Of blocks
with equal weight the first counts.  Repeated rows are each returned, and an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import bisect
import html
import json
import re
from collections import Counter
from collections.abc import Callable, Generator, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import saved, width

BROADCAST_CHARS = 32 << 20
SALTS = 16
#: Pages that a task folds at most before it hands its wrappers on.
FOLDED = 20_000

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>",
    re.S,
)
ATTR = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

# fixed values: HTML element names
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section summary table ul".split())
#: An opening tag ends open ones of these names, unless one of the fences lies between.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"), "body": ("head",)}
FENCES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li td th dt dd pre blockquote tr ul ol dl table".split())
NOT_TEXT = frozenset("head script style nav header footer aside form noscript iframe svg canvas button select textarea input template dialog menu title object audio video map".split())
#: Class or id names that say by themselves what is not the article; whole names only: "share-price" is no share bar.
NOT_TEXT_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsored promo comment comments comment-list commentlist replies respond disqus_thread cookie-notice cookie-banner cookie-consent notice notices popup modal newsletter sidebar breadcrumb breadcrumbs nav navbar navigation menu footer masthead pagination share-buttons social-share related-posts".split())
#: Of those, the names of threads.
THREADS = frozenset("comments comment-list commentlist replies respond disqus_thread".split())
#: Furniture that is often never closed; it ends where one of the others begins.
FRAMES = frozenset("nav aside header footer menu".split())
SECTIONS = frozenset("article main section h1".split())
LISTS = frozenset("ul ol dl table menu".split())
#: Pages that must stand behind what a wrapper says.
SUPPORT = 4
#: Pairs of children that are compared one by one.
COMPARED = 250_000
NOT_TEXT_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar note".split())
WORD = re.compile(r"[a-z]+")


class Node:
    """Element, text slot (key "#") or group (key in parentheses) of a wrapper."""

    __slots__ = ("key", "low", "many", "chars", "links", "text", "pages", "seen", "children")

    def __init__(self, key: str, children: list[Node] | None = None, low: int = 1, many: bool = False, chars: int = 0, links: int = 0, text: int | None = None, pages: tuple[int, ...] = (), seen: int = 1) -> None:
        self.key, self.children, self.low, self.many = key, children or [], low, many
        self.seen = seen  # elements that have become this node
        self.chars, self.links, self.text = chars, links, text  # text: hash of all text inside, if it never varied
        self.pages = pages  # the least hashes of pages that have it, SUPPORT at most

    def joins(self, other: Node) -> None:
        """Counts of another node become part of this one's."""
        self.chars, self.links, self.seen = self.chars + other.chars, self.links + other.links, self.seen + other.seen
        if self.text != other.text:
            self.text = None
        if self.pages != other.pages:
            self.pages = tuple(sorted({*self.pages, *other.pages})[:SUPPORT])

    def constant(self) -> bool:
        return self.text is not None and len(self.pages) >= SUPPORT

    def every(self) -> list[Node]:
        """The subtree's nodes, parents first, children in order."""
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            out.append(node)
            todo += reversed(node.children)
        return out

    def packed(self) -> list:
        """Flat, for trees may be deep: nodes, parents first, each with its number of children."""
        return [[n.key, n.low, n.many, n.chars, n.links, n.text, n.pages, n.seen, len(n.children)] for n in self.every()]

    @staticmethod
    def unpacked(rows: list) -> Node:
        root = Node("")
        todo = [(root, 1)]
        for key, low, many, chars, links, text, pages, seen, n in rows:
            parent, left = todo.pop()
            if left > 1:
                todo.append((parent, left - 1))
            node = Node(key, None, low, many, chars, links, text, tuple(pages), seen)
            parent.children.append(node)
            if n:
                todo.append((node, n))
        return root.children[0]

    def shape(self) -> str:
        parts: list[str] = []
        todo: list[Node | str] = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                parts.append(x)
                continue
            parts.append(f"{x.key}{'+' if x.many else ''}")
            if x.children:
                todo.append("]")
                for i in range(len(x.children) - 1, -1, -1):
                    todo += [x.children[i], "," if i else "["]
        return "".join(parts)


#: A step that may wait for others; they are held in a list, so nesting is not bounded by Python's stack.
Step = Generator["Step", object, object]


def finished(step: Step) -> object:
    stack, value = [step], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as end:
            stack.pop()
            value = end.value
    return value


def merge(a: Node, b: Node) -> None:
    """``b`` becomes part of ``a``."""
    finished(merging(a, b))


def merging(a: Node, b: Node) -> Step:
    a.low, a.many = min(a.low, b.low), a.many or b.many
    a.joins(b)
    if a.children or b.children:
        a.children = yield aligning(a.children, b.children)


def fold(nodes: list[Node]) -> list[Node]:
    """Adjacent repeats, of one node or of groups of two or three, become repeated ones."""
    return finished(folding(nodes))


def folding(nodes: list[Node]) -> Step:
    out: list[Node] = []
    for node in nodes:
        out.append(node)
        while True:
            if len(out) > 1 and out[-1].key == out[-2].key:
                last = out.pop()
                yield merging(out[-1], last)
                out[-1].many = True
                continue
            for p in (2, 3):
                tail = out[-p:]
                if len(out) > p and out[-p - 1].key == f"({' '.join(n.key for n in tail)})":
                    group = out[-p - 1]
                    for a, b in zip(group.children, tail, strict=True):
                        yield merging(a, b)
                    del out[-p:]
                    break
                if len(out) >= 2 * p and all(a.key == b.key for a, b in zip(out[-2 * p : -p], tail, strict=True)):
                    for a, b in zip(out[-2 * p : -p], tail, strict=True):
                        yield merging(a, b)
                    parts = out[-2 * p : -p]
                    out[-2 * p :] = [Node(f"({' '.join(n.key for n in parts)})", parts, many=True, seen=2 * parts[0].seen)]
                    break
            else:
                break
    return out


def matches(a: list[Node], b: list[Node]) -> list[tuple[int, int]]:
    """A common subsequence of keys: a longest one, or for long lists one through the keys unique in both."""
    x, y = [n.key for n in a], [n.key for n in b]
    found, todo = [], [(0, len(x), 0, len(y))]
    while todo:
        i, iend, j, jend = todo.pop()
        while i < iend and j < jend and x[i] == y[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < iend and j < jend and x[iend - 1] == y[jend - 1]:
            iend, jend = iend - 1, jend - 1
            found.append((iend, jend))
        if (iend - i) * (jend - j) <= COMPARED:
            found += longest_common(x, y, i, iend, j, jend)
            continue
        once = [{k: at for at, k in enumerate(z[lo:hi], lo) if n[k] == 1} for z, lo, hi in ((x, i, iend), (y, j, jend)) for n in [Counter(z[lo:hi])]]
        anchors = rising([(at, once[1][k]) for k, at in once[0].items() if k in once[1]])
        if not anchors:
            found += greedy(x, y, i, iend, j, jend)
            continue
        found += anchors
        for (p, q), (r, t) in zip([(i - 1, j - 1), *anchors], [*anchors, (iend, jend)], strict=True):
            todo.append((p + 1, r, q + 1, t))
    return sorted(found)


def longest_common(x: list[str], y: list[str], i: int, iend: int, j: int, jend: int) -> list[tuple[int, int]]:
    best = [[0] * (jend - j + 1) for _ in range(iend - i + 1)]
    for p in range(iend - 1, i - 1, -1):
        for q in range(jend - 1, j - 1, -1):
            best[p - i][q - j] = best[p - i + 1][q - j + 1] + 1 if x[p] == y[q] else max(best[p - i + 1][q - j], best[p - i][q - j + 1])
    pairs, p, q = [], i, j
    while p < iend and q < jend:
        if x[p] == y[q]:
            pairs.append((p, q))
            p, q = p + 1, q + 1
        elif best[p - i + 1][q - j] >= best[p - i][q - j + 1]:
            p += 1
        else:
            q += 1
    return pairs


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest part of the pairs (first parts rise) whose second parts rise too."""
    tops: list[int] = []  # index of the pair that ends the best chain of each length
    ends: list[int] = []
    before: list[int] = []
    for k, (_, q) in enumerate(pairs):
        at = bisect.bisect_left(ends, q)
        before.append(tops[at - 1] if at else -1)
        tops[at : at + 1], ends[at : at + 1] = [k], [q]
    chain, k = [], tops[-1] if tops else -1
    while k >= 0:
        chain.append(pairs[k])
        k = before[k]
    return chain[::-1]


def greedy(x: list[str], y: list[str], i: int, iend: int, j: int, jend: int) -> list[tuple[int, int]]:
    """Each key with its next place on the other side."""
    places: dict[str, list[int]] = {}
    for q in range(j, jend):
        places.setdefault(y[q], []).append(q)
    pairs = []
    for p in range(i, iend):
        at = places.get(x[p], [])
        k = bisect.bisect_left(at, j)
        if k < len(at):
            pairs.append((p, at[k]))
            j = at[k] + 1
    return pairs


def aligning(a: list[Node], b: list[Node]) -> Step:
    """Merge two child lists; what only one of them has is optional."""
    out: list[Node] = []
    i = j = 0
    for x, y in [*matches(a, b), (len(a), len(b))]:
        for node in [*a[i:x], *b[j:y]]:
            node.low = 0
            out.append(node)
        if x < len(a):
            yield merging(a[x], b[y])
            out.append(a[x])
        i, j = x + 1, y + 1
    return (yield folding(out))


class Element:
    """An element of one page."""

    __slots__ = ("tag", "content", "dropped", "key", "why", "inside", "ended")

    def __init__(self, tag: str, key: str = "", why: str = "", inside: bool = False) -> None:
        self.tag, self.content, self.key, self.dropped = tag, [], key, why not in ("", "list")
        self.why = why  # what says that this is no content: tag, hidden, role, name; list: a name, if the text is links
        self.inside = inside  # an article or main, or in one
        self.ended = False  # by an end tag of its own


def named(tag: str, attrs: str, inside: bool) -> tuple[str, str]:
    """Wrapper key of an element, and what says that it is no content.

    Inside an article a header is the article's own, buttons are words, and a
    name or role says nothing about a paragraph; about a list only if its text is
    links, or if the name is that of a thread of comments.
    """
    by_tag = "tag" if tag in NOT_TEXT and not (inside and tag in ("header", "button")) else ""
    if not attrs or attrs.isspace():
        return tag, by_tag
    found = {m[0].lower(): m[1] or m[2] or m[3] for m in ATTR.findall(attrs)}
    if not found:
        return tag, by_tag
    names = f"{found.get('class', '')} {found.get('id', '')}".lower()
    key = ".".join([tag, *sorted(set(WORD.findall(names)))])
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
        return key, "hidden"
    if by_tag or tag in ("html", "body", "main"):
        return key, by_tag
    words = names.split()
    why = "role" if found.get("role", "").lower() in NOT_TEXT_ROLES else "name" if not NOT_TEXT_NAMES.isdisjoint(words) else ""
    if why and inside and tag in LISTS:
        return key, why if not THREADS.isdisjoint(words) else "list"
    return key, "" if inside and tag in LEAF | INLINE else why


def parsed(page: str) -> Element:
    """The page's tree."""
    root = Element("")
    stack, keys = [root], [""]
    opened = Counter()  # names on the stack

    def close(to: int) -> None:
        while len(stack) > to:
            stack.pop()
            opened[keys.pop()] -= 1

    at = 0
    scan = TOKEN.scanner(page)
    while m := scan.search():
        if m.start() > at:
            stack[-1].content.append(page[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag = tag.lower()
        if m["close"] or m["close2"]:
            if not opened[tag]:
                continue
            for i in range(len(keys) - 1, 0, -1):
                if keys[i] == tag:
                    stack[i].ended = True
                    close(i)
                    break
                if tag in INLINE and keys[i] not in INLINE:  # an inline end tag does not reach over a block
                    break
            continue
        if tag in CLOSES_P and opened["p"]:
            close(next(i for i in range(len(keys) - 1, 0, -1) if keys[i] == "p"))
        if tag in CLOSES and any(opened[t] for t in CLOSES[tag]):
            fences = FENCES.get(tag, ())
            low = next((i for i in range(len(keys) - 1, 0, -1) if keys[i] in fences), 0)
            if (i := next((i for i in range(low + 1, len(keys)) if keys[i] in CLOSES[tag]), 0)) > 0:
                close(i)
        attrs = m["attrs"] if m["tag"] else m["attrs2"]
        outer = stack[-1]
        key, why = named(tag, attrs, outer.inside)
        element = Element(tag, key, why, outer.inside or tag in ("article", "main") and not why)
        if tag in ("article", "main") and not why:  # a frame around the content
            for frame in stack:
                if frame.why == "name" and frame.tag != "article" and "comment" not in frame.key:
                    frame.dropped = False
        stack[-1].content.append(element)
        if tag in VOID or attrs.endswith("/") and tag not in INLINE | CLOSES_P:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>|\Z", re.I).search(page, at)
            if tag == "xmp":  # text as it stands
                element.content.append(page[at : end.start()].replace("&", "&amp;"))
            at = end.end()
            scan = TOKEN.scanner(page, at)
            continue
        stack.append(element)
        keys.append(tag)
        opened[tag] += 1
    if at < len(page):
        stack[-1].content.append(page[at:])
    mend(root)
    return root


def mend(root: Element) -> None:
    """Takes back what tags and names say where the page as a whole says otherwise.

    A form that holds an article, or more than half of the text, is a frame.
    Furniture that is never closed ends where a section begins.  A list with a
    telling name inside an article goes if most of its text is links.
    """
    order, todo = [], [(root, None)]
    while todo:
        element, parent = todo.pop()
        order.append((element, parent))
        todo += [(c, element) for c in element.content if not isinstance(c, str)]
    if not any(e.why == "list" or e.why == "tag" and (e.tag == "form" or e.tag in FRAMES and not e.ended) for e, _ in order):
        return
    chars: dict[int, int] = {}  # text of an element as far as nothing in it is dropped, but for forms
    links: dict[int, int] = {}
    holds: dict[int, bool] = {}  # an article or main, or one inside
    for element, parent in reversed(order):
        inside = [c for c in element.content if not isinstance(c, str)]
        shown = [c for c in inside if not c.dropped or c.tag == "form"]
        chars[id(element)] = sum(len(c) for c in element.content if isinstance(c, str) and not c.isspace()) + sum(chars[id(c)] for c in shown)
        links[id(element)] = chars[id(element)] if element.tag == "a" else sum(links[id(c)] for c in shown)
        holds[id(element)] = element.tag in ("article", "main") and not element.why or any(holds[id(c)] for c in inside)
        if element.why == "tag" and element.tag in FRAMES and not element.ended and parent is not None:
            k = next((k for k, c in enumerate(element.content) if not isinstance(c, str) and (c.tag in SECTIONS or holds[id(c)])), None)
            if k is not None:
                at = next(k for k, c in enumerate(parent.content) if c is element)
                parent.content[at + 1 : at + 1] = element.content[k:]
                del element.content[k:]
                holds[id(element)] = False
    for element, _ in order:
        if element.why == "list":
            element.dropped = 2 * links[id(element)] > chars[id(element)]
        elif element.why == "tag" and element.tag == "form" and (holds[id(element)] or 2 * chars[id(element)] > chars[id(root)]):
            element.dropped = False


def shaped(element: Element, page: int = 0) -> Node:
    """The element's wrapper: a node for each element and text, repeats folded; void and dropped elements are leaves.

    ``page``: a hash that tells the page from others.
    """
    top = Node(element.key, pages=(page,))
    filled: list[tuple[Node, list[Node]]] = []
    todo = [(element, top, False)]
    while todo:
        at, node, link = todo.pop()
        children: list[Node] = []
        for x in at.content:
            if isinstance(x, str):
                if x.isspace():
                    continue
                n = len(x)
                children.append(Node("#", chars=0 if link else n, links=n if link else 0, text=xxhash.xxh32_intdigest(x), pages=(page,)))
            elif x.tag not in VOID:
                child = Node(x.key, pages=(page,))
                children.append(child)
                if not x.dropped:
                    todo.append((x, child, link or x.tag == "a"))
        filled.append((node, children))
    for node, children in reversed(filled):  # what is inside comes first
        if children:
            node.text = hashes_joined([(c.key, c.text) for c in children])
            node.links = sum(c.links for c in children)
        node.children = fold(children)
    return top


def hashes_joined(parts: list[tuple[str, int | None]]) -> int:
    return xxhash.xxh32_intdigest(repr(parts))


def weights(root: Node) -> dict[int, float]:
    """By id of each node: characters of its slots outside links that vary, or of all if none varies in ``root``.

    Blocks that repeat (cards, comments) are a list, which weighs as much as one
    of them; paragraphs and the like that repeat weigh as they are.
    """
    nodes = root.every()
    varies = any(n.key == "#" and n.text is None and n.chars for n in nodes)
    lists: dict[int, float] = {}  # how many of a block there are wherever it is
    todo = [(root, root.seen, False)]
    while todo:
        n, around, group = todo.pop()
        if (n.many or group) and n.key != "#" and not n.key.startswith("(") and tag_of(n) not in LEAF | INLINE:
            lists[id(n)] = max(1, n.seen / around)
        todo += [(c, around if n.key.startswith("(") else n.seen, n.key.startswith("(")) for c in n.children]
    found: dict[int, float] = {}
    for n in reversed(nodes):
        own = n.chars if n.key == "#" and (not varies or n.text is None) else 0
        found[id(n)] = 0 if varies and n.constant() else (own + sum(found[id(c)] for c in n.children)) / lists.get(id(n), 1)
    return found


def tag_of(node: Node) -> str:
    return node.key.partition(".")[0]


def inner(node: Node) -> list[Node]:
    """Children, those of groups as well."""
    return [c for x in node.children for c in (x.children if x.key.startswith("(") else [x])]


def articles(wrapper: Node) -> set[str]:
    """Ways to outermost ``article`` and ``main`` that come once and hold more text than links: no cards, no comments.

    One that never varies counts only where the pages are copies of one another:
    nothing else does, and it holds more text than all that varies.
    """
    vary, same, text = set(), set(), 0
    todo = [(wrapper, "", False)]
    while todo:
        node, way, many = todo.pop()
        for x in node.children:
            for c, listed in [(c, True) for c in x.children] if x.key.startswith("(") else [(x, x.many)]:
                here = f"{way}/{c.key}"
                if tag_of(c) not in ("article", "main"):
                    todo.append((c, here, many or listed))
                    continue
                slots = [n for n in c.every() if n.key == "#"]
                chars = sum(n.chars for n in slots)
                if not (many or listed) and chars > sum(n.links for n in slots):
                    (same if c.constant() else vary).add(here)
                    text += chars * c.constant()
    return vary or (same if text >= weights(wrapper)[id(wrapper)] else set())


def densest(wrapper: Node) -> list[str]:
    """Keys on the way to the block that holds most of the text: into the child with the larger part as long as there is one."""
    weigh = weights(wrapper)
    path, node = [], wrapper
    while True:
        blocks = [c for c in inner(node) if c.key != "#" and tag_of(c) not in LEAF | INLINE]
        child = max(blocks, key=lambda c: weigh[id(c)], default=None)
        if child is None or weigh[id(child)] < 0.6 * weigh[id(node)] or not weigh[id(child)]:
            return path
        path.append(child.key)
        node = child


def furniture(wrapper: Node) -> set[tuple[str, int]]:
    """Outermost constant parts, as (keys on the way, hash of the text inside): those with links, and blocks and paragraphs that are no headings."""
    found, todo = set(), [(wrapper, "")]
    while todo:
        node, way = todo.pop()
        for c in inner(node):
            if c.key == "#":
                continue
            here = f"{way}/{c.key}"
            if c.constant() and (c.links or tag_of(c) in ("div", "section", "p", "ul", "ol")):
                if not any(tag_of(x) in HEADINGS for x in c.every()) or c.links:
                    found.add((here, c.text))
            else:
                todo.append((c, here))
    return found


def walked(root: Element, path: list[str]) -> list[Element]:
    """The page's elements at the end of a wrapper's path; none if the page has no such way."""
    at = [root]
    for key in path:
        at = [x for e in at for x in e.content if not isinstance(x, str) and not x.dropped and x.key == key]
    return at


def text_of(roots: list[Element]) -> str:
    parts: list[str] = []
    todo: list[Element | str] = list(reversed(roots))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(html.unescape(x) if "&" in x else x)
            continue
        inside = [c for c in reversed(x.content) if isinstance(c, str) or not c.dropped]
        todo += inside if x.tag in INLINE else [" ", *inside, " "]
    return " ".join("".join(parts).split())


def placed(root: Element) -> list[tuple[Element, str]]:
    """Outermost ``article`` and ``main`` elements with the keys on the way."""
    found, todo = [], [(root, "")]
    while todo:
        x, way = todo.pop()
        if x.dropped:
            continue
        if x.tag in ("article", "main"):
            found.append((x, way))
        else:
            todo += [(c, f"{way}/{c.key}") for c in reversed(x.content) if not isinstance(c, str)]
    return found


class Reading:
    """What a host's wrapper says about where its pages keep their content."""

    def __init__(self, wrapper: Node | None) -> None:
        known = wrapper is not None and len(wrapper.pages) >= SUPPORT
        self.path = densest(wrapper) if known else []
        self.furniture = furniture(wrapper) if known else set()
        self.articles = articles(wrapper) if known else set()

    def roots(self, root: Element) -> list[Element]:
        ways = placed(root)
        named = [x for x, _ in ways]
        if own := [x for x, way in ways if way in self.articles and text_of([x])]:
            return own
        block = walked(root, self.path) if self.path else []
        if block:
            around = [x for x in named if x in block or any(y in block for y in within(x))]
            return around or block
        return named or walked(root, densest(shaped(root))) or [root]

    def text(self, page: str | None) -> str:
        if not page:
            return ""
        root = parsed(page)
        if not self.furniture:
            return text_of(self.roots(root))
        roots = self.roots(root)
        all_of_it = text_of(roots)
        self.clear(root)
        rest = text_of(roots)
        # pages that are copies of one another have constant articles too: then the wrapper knows nothing
        return rest if 2 * len(rest) >= len(all_of_it) else all_of_it

    def clear(self, root: Element) -> None:
        """Marks the page's constant parts with links as no content."""
        ways = {way for way, _ in self.furniture}
        todo = [(root, "")]
        while todo:
            element, way = todo.pop()
            for x in element.content:
                if isinstance(x, str) or x.dropped or x.tag in VOID:
                    continue
                here = f"{way}/{x.key}"
                if here in ways and (here, shaped(x).text) in self.furniture:
                    x.dropped = True
                else:
                    todo.append((x, here))


def within(element: Element) -> Iterator[Element]:
    todo = [element]
    while todo:
        for x in todo.pop().content:
            if not isinstance(x, str):
                yield x
                todo.append(x)


def host_of(url: str | None) -> str:
    m = re.match(r"[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", (url or "").strip().lower())
    return m[1].rstrip(".") if m else ""


def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(url, html) -> a wrapper per host of this task's pages."""
    held: dict[str, dict[str, Node]] = {}
    seen: set[int] = set()
    n = 0

    def out() -> pa.RecordBatch:
        rows = []
        for host, shapes in held.items():
            wrapper, *rest = shapes.values()
            for other in rest:
                merge(wrapper, other)
            rows.append((host, json.dumps(wrapper.packed())))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["host", "wrapper"])

    for batch in batches:
        for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not page:
                continue
            host = host_of(url)
            page_hash = xxhash.xxh3_64_intdigest(page) >> 1
            if (mark := hash((host, page_hash))) in seen:  # the same page again says nothing new
                continue
            seen.add(mark)
            node = shaped(parsed(page), page_hash)
            shapes = held.setdefault(host, {})
            shape = node.shape()
            if shape in shapes:
                add(shapes[shape], node)
            else:
                shapes[shape] = node
            n += 1
            if n >= FOLDED:
                yield out()
                held, n = {}, 0
                seen.clear()
    if held:
        yield out()


def add(a: Node, b: Node) -> None:
    """Counts of a node of the same shape."""
    for x, y in zip(a.every(), b.every(), strict=True):
        x.joins(y)


def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wrappers ordered by host -> one per host."""
    host, wrapper = None, None
    for batch in batches:
        rows = []
        for h, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if h != host:
                if wrapper is not None:
                    rows.append((host, json.dumps(wrapper.packed())))
                host, wrapper = h, Node.unpacked(json.loads(w))
            else:
                merge(wrapper, Node.unpacked(json.loads(w)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["host", "wrapper"])
    if wrapper is not None:
        yield pa.RecordBatch.from_arrays([pa.array([host]), pa.array([json.dumps(wrapper.packed())])], names=["host", "wrapper"])


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper as JSON) for every host of ``pages``."""
    parts = width(pages.sparkSession)
    schema = "host string, wrapper string"
    rows = pages.select(F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    some = rows.mapInArrow(infer, schema).withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    some = some.repartition(parts, "host", "salt").sortWithinPartitions("host", "salt", "wrapper").select("host", "wrapper").mapInArrow(combine, schema)
    return some.repartition(parts, "host").sortWithinPartitions("host", "wrapper").mapInArrow(combine, schema)


def extract_with(known) -> Callable:
    """(page_id, url, html, wrapper or null) -> page_id, url, text, n_chars; ``known``: broadcast {host: wrapper} or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readings: dict[str, Reading] = {}
        for batch in batches:
            texts = []
            for url, page, wrapper in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                host = host_of(url)
                if host not in readings:
                    if len(readings) > 10_000:
                        readings.clear()
                    text = wrapper if known is None else known.value.get(host)
                    readings[host] = Reading(Node.unpacked(json.loads(text)) if text else None)
                texts.append(readings[host].text(page))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    spark = pages.sparkSession
    schema = "page_id long, url string, text string, n_chars long"
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    found = saved(spark, wrappers(rows, "url", "html"), "html-wrappers")
    if (found.agg(F.sum(F.length("wrapper"))).first()[0] or 0) <= broadcast_chars:
        known = spark.sparkContext.broadcast({r["host"]: r["wrapper"] for r in found.collect()})
        return rows.withColumn("wrapper", F.lit(None).cast("string")).mapInArrow(extract_with(known), schema)
    host = F.regexp_extract(F.trim(F.lower(F.coalesce("url", F.lit("")))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    salted = rows.withColumn("host", F.rtrim(host, F.lit("."))).withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    copies = found.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return salted.join(copies, ["host", "salt"], "left").select("page_id", "url", "html", "wrapper").mapInArrow(extract_with(None), schema)
