"""HTML extraction by minimum-cut labelling.

A page is cut into blocks of text at block-level tags. A small fixed logistic classifier prices each
block as content and as boilerplate from the block alone (its length, links, sentences and tag); the
two costs are its capacities to the terminals of a flow network. An element whose tag, role or class
names tell something about what is inside it is a node too, with that evidence once per block inside
as its capacities. Edges carry the evidence along the document tree:
- adjacency: blocks that follow each other, by an edge that weakens with their distance in the tree;
- proximity: neighbours inside one container, and each block or element and the nearest element of
  evidence around it. The latter is lopsided: text of a menu is rarely content, so parting a content
  child from a boilerplate parent costs much; an article may well hold some boilerplate.
All weights are log-odds on one scale, so that the cut decides what the classifier leaves unsure:
a short paragraph goes with its neighbours, a long comment with its comment section, and a paragraph
of an article stays although its class is called `related-work`. The maximum flow parts the
network at the cheapest labelling: content is what remains on the source's side.

Markup, scripts, styles, forms' controls and comments are never text. Character references are
decoded, white space inside a block becomes one space, blocks are trimmed and joined in page order
by one space; nothing else is dropped or capped. Null and empty pages give an empty text; broken,
unclosed or truncated markup is read as far as it goes. An attribute's quote counts only after `=`
and if it is closed; else the tag ends at its first `>`. Work and memory are linear in the page
before the cut, however deep its elements are.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import small_batches

#: Element names of HTML by their part in a page.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
SILENT = frozenset("script style head title noscript template iframe object embed svg math canvas audio video select option textarea button datalist map noframes".split())
RAW = frozenset("script style textarea title iframe noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table tbody thead tfoot tr select".split())

#: Evidence on the blocks inside an element, in log-odds of content: by tag, by role, by name.
TAG_EVIDENCE = {"article": 4.0, "main": 3.0, "nav": -10.0, "footer": -10.0, "aside": -10.0, "form": -10.0, "menu": -10.0, "dialog": -10.0, "search": -10.0, "header": -6.0, "fieldset": -6.0}
ROLE_EVIDENCE = {
    "main": 3.0, "article": 4.0, "navigation": -10.0, "banner": -6.0, "contentinfo": -10.0, "complementary": -10.0, "search": -10.0, "dialog": -10.0, "alert": -10.0, "form": -10.0,
    "menu": -10.0, "alertdialog": -10.0, "menubar": -10.0, "note": -2.0,
}
HIDDEN, GOOD = -20.0, 2.0
#: A clear and an ambiguous name of boilerplate, each as a whole class or id and as a part of one (`ad`, `ad-slot`); less of it on an element that is itself text.
CLEAR, AMBIGUOUS = (-9.0, -7.0), (-4.0, -2.5)
CLEAR_ON_TEXT, AMBIGUOUS_ON_TEXT = 0.5, 0.25
GOOD_NAME = frozenset("article content post entry story body text main maincontent articlebody postbody page hentry".split())
CLEAR_NAME = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs masthead footer colophon sidebar widget widgets "
    "share sharing social subscribe subscription newsletter signup login comment comments commentlist reply replies disqus cookie cookies consent gdpr popup modal pagination pager".split()
)
AMBIGUOUS_NAME = frozenset(
    "banner header foot side aside rail related recommended more follow respond discussion responses feedback notice notices notification alert overlay toolbar tags tag copyright legal disclaimer skip hidden search form".split()
)
TEXT_TAG = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption caption summary".split())
#: Edge weights in log-odds: neighbours on the page (by distance; times ACROSS between elements of evidence) and in a container.
ADJACENCY, ACROSS, PROXIMITY = 4.5, 0.25, 0.5
#: Content inside boilerplate (a block); boilerplate inside content: a block, an element.
BELOW_BOILERPLATE, BLOCK_BELOW, ELEMENT_BELOW = 6.0, 3.5, 2.0
_NAME = re.compile(r"[A-Za-z]+")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]|=(?:\s*(?:"[^"]*"|'[^']*'))?)*+)(?:>|\Z)""", re.S)
_SENTENCE = re.compile(r"[.!?…](?:\s|\Z)")


def evidence(tag: str, attributes: str) -> float:
    """What an element's tag and attributes say about the text inside it."""
    weight = TAG_EVIDENCE.get(tag, 0.0)
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return weight
    found = {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTRIBUTE.findall(attributes)}
    weight += ROLE_EVIDENCE.get(found.get("role", "").lower(), 0.0)
    style = found.get("style", "").lower().replace(" ", "")
    if "display:none" in style or "visibility:hidden" in style or found.get("aria-hidden", "").lower() == "true" or re.search(r"(?:^|\s)hidden(?:\s|=|$)", attributes):
        weight += HIDDEN
    if tag in ("body", "html"):
        return weight
    worst, good = 0.0, False
    for key in ("class", "id", "itemprop", "aria-label"):
        for name in found.get(key, "").split():
            words = [w.lower() for w in _NAME.findall(name)]
            part = len(words) > 1
            for word in words:
                if word in CLEAR_NAME:
                    worst = min(worst, CLEAR[part] * (CLEAR_ON_TEXT if tag in TEXT_TAG else 1))
                elif word in AMBIGUOUS_NAME:
                    worst = min(worst, AMBIGUOUS[part] * (AMBIGUOUS_ON_TEXT if tag in TEXT_TAG else 1))
                elif word in GOOD_NAME:
                    good = True
    if worst:
        return weight + worst
    return weight + (GOOD if good else 0.0)


class Element:
    """An element of evidence; `around` is the next one outside, `blocks` the number of blocks inside."""

    __slots__ = ("around", "weight", "level", "blocks")

    def __init__(self, around: Element | None, weight: float):
        self.around, self.weight, self.level, self.blocks = around, weight, around.level + 1 if around else 1, 0


class Block:
    """A block of text: the characters inside links, its element's tag, the nearest element of evidence,
    `apart` (steps in the tree from the block before) and `holder` (which container holds its element)."""

    __slots__ = ("text", "linked", "tag", "inside", "apart", "holder")

    def __init__(self, text: str, linked: int, tag: str, inside: Element | None, apart: int, holder: int):
        self.text, self.linked, self.tag, self.inside, self.apart, self.holder = text, linked, tag, inside, apart, holder


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order."""
    found: list[Block] = []
    stack: list[tuple] = []  # (tag, identity, nearest element of evidence, is block)
    at_tag: dict[str, list[int]] = {}  # places in the stack by tag
    at_block: list[int] = []  # places in the stack of block elements
    parts: list[str] = []
    linked = links = silent = headed = 0
    serial = at = lowest = depth_before = 0

    def flush() -> None:
        nonlocal linked, lowest, depth_before
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                inside, depth = stack[-1][2] if stack else None, len(at_block)
                apart = depth + depth_before - 2 * min(lowest, depth)
                holder = stack[at_block[-2]][1] if depth > 1 else 0
                found.append(Block(text, linked, stack[at_block[-1]][0] if depth else "", inside, apart, holder))
                lowest = depth_before = depth
            parts.clear()
        linked = 0

    def close(depth: int) -> None:
        nonlocal links, silent, lowest, headed
        while len(stack) > depth:
            tag, _, _, block = stack.pop()
            at_tag[tag].pop()
            if block:
                at_block.pop()
            links -= tag == "a"
            silent -= tag in SILENT
            headed -= tag in ("article", "main")
        lowest = min(lowest, len(at_block))

    def say(text: str) -> None:
        nonlocal linked
        if text and not silent:
            parts.append(text)
            if links:
                linked += len(text.strip())

    size = len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if m[1] is not None:
            say(html.escape(m[1], quote=False))
            continue
        if m[3] is None:
            continue
        tag = m[3].lower()
        if m[2]:
            if tag in BLOCK:
                flush()
            places = at_tag.get(tag)
            if places and (tag in BLOCK or tag in SILENT or not at_block or at_block[-1] <= places[-1]):
                close(places[-1])
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in RAW:
            end = _end_of(tag).search(page, at)
            at = end.end() if end else size
            if tag == "xmp" and end:
                say(html.escape(page[m.end() : end.start()], quote=False))
            continue
        block = tag in BLOCK
        if block:
            flush()
            if at_block and stack[at_block[-1]][0] == "p":
                close(at_block[-1])
            if tag in SELF_CLOSING:
                last = max((at_tag[t][-1] for t in SELF_CLOSING[tag] if at_tag.get(t)), default=-1)
                if last > max((at_tag[t][-1] for t in SCOPE if at_tag.get(t)), default=-1):
                    close(last)
        if tag in VOID or m[4].endswith("/") and tag not in BLOCK:
            continue
        serial += 1
        inside, weight = stack[-1][2] if stack else None, evidence(tag, m[4])
        if tag == "header" and headed:
            weight += 5.0  # a title's own header, not the page's
        if weight:
            inside = Element(inside, weight)
        at_tag.setdefault(tag, []).append(len(stack))
        if block:
            at_block.append(len(stack))
        stack.append((tag, serial, inside, block))
        links += tag == "a"
        silent += tag in SILENT
        headed += tag in ("article", "main")
    flush()
    return found


_ENDS: dict[str, re.Pattern] = {}


def _end_of(tag: str) -> re.Pattern:
    if tag not in _ENDS:
        _ENDS[tag] = re.compile(rf"</{tag}\b[^>]*>", re.I)
    return _ENDS[tag]


def content_odds(block: Block) -> float:
    """Log-odds that a block is content, by the block alone."""
    words = block.text.count(" ") + 1
    share = min(1.0, block.linked / max(1, len(block.text)))
    odds = min(2.5, max(-2.0, 0.85 * math.log2(words / 8))) - 0.6 - 4.0 * share * (share > 0.5)
    if block.tag in ("p", "blockquote", "pre"):
        odds += 1.0
    elif block.tag in ("h1", "h2", "h3"):
        odds += 2.0
    elif block.tag == "li":
        odds -= 0.5
    if words >= 4 and _SENTENCE.search(block.text):
        odds += 0.5
    return odds


class Network:
    """Maximum flow by blocking flows over level graphs (integer capacities)."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []

    def edge(self, a: int, b: int, there: int, back: int = 0) -> None:
        for x, y, room in ((a, b, there), (b, a, back)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(room)

    def levels(self, source: int) -> list[int]:
        level = [-1] * len(self.out)
        level[source] = 0
        waiting = deque([source])
        while waiting:
            x = waiting.popleft()
            for e in self.out[x]:
                if self.room[e] and level[self.to[e]] < 0:
                    level[self.to[e]] = level[x] + 1
                    waiting.append(self.to[e])
        return level

    def source_side(self, source: int, sink: int) -> list[int]:
        """Levels after the maximum flow: a node is on the source's side if its level is 0 or more."""
        to, room = self.to, self.room
        while (level := self.levels(source))[sink] >= 0:
            turn = [0] * len(self.out)
            path: list[int] = []
            x = source
            while True:
                if x == sink:
                    flow = min(room[e] for e in path)
                    for e in path:
                        room[e] -= flow
                        room[e ^ 1] += flow
                    back = next(i for i, e in enumerate(path) if not room[e])
                    x = to[path[back] ^ 1]
                    del path[back:]
                    continue
                while turn[x] < len(self.out[x]):
                    e = self.out[x][turn[x]]
                    if room[e] and level[to[e]] == level[x] + 1:
                        break
                    turn[x] += 1
                else:
                    if x == source:
                        break
                    x = to[path.pop() ^ 1]
                    turn[x] += 1
                    continue
                path.append(e)
                x = to[e]
        return level


def network_of(blocks: list[Block]) -> tuple[list[float], list[tuple[int, int, float, float]]]:
    """(log-odds of content of every node, edges (a, b, cost of content a with boilerplate b, and the reverse)).

    The first nodes are the blocks, in order; the others their elements of evidence."""
    odds = [content_odds(b) for b in blocks]
    edges: list[tuple[int, int, float, float]] = []
    node: dict[int, int] = {}
    elements: list[Element] = []
    for block in blocks:
        element = block.inside
        while element is not None and id(element) not in node:
            node[id(element)] = len(blocks) + len(elements)
            elements.append(element)
            element.blocks = 0
            element = element.around
        if block.inside is not None:
            block.inside.blocks += 1
    for element in sorted(elements, key=lambda e: -e.level):  # from the inside outwards, each once
        if element.around is not None:
            element.around.blocks += element.blocks
    last_in: dict[int, int] = {}
    for i, block in enumerate(blocks):
        if block.inside is not None:
            edges.append((i, node[id(block.inside)], BELOW_BOILERPLATE, BLOCK_BELOW))
        if i:
            near = ADJACENCY / (1 + block.apart) * (1 if block.inside is blocks[i - 1].inside else ACROSS)
            edges.append((i - 1, i, near, near))
        before = last_in.get(block.holder)
        if before is not None and before != i - 1:
            edges.append((before, i, PROXIMITY, PROXIMITY))
        last_in[block.holder] = i
    for element in elements:
        odds.append(element.weight * element.blocks)
        if element.around is not None:
            edges.append((node[id(element)], node[id(element.around)], BELOW_BOILERPLATE * element.blocks, ELEMENT_BELOW))
    return odds, edges


def label(blocks: list[Block], scale: int = 1000) -> list[bool]:
    """Which blocks are content, by the minimum cut (ties: boilerplate)."""
    if not blocks:
        return []
    odds, edges = network_of(blocks)
    n = len(odds)
    net = Network(n + 2)
    for i, o in enumerate(odds):
        if o > 0:
            net.edge(n, i, int(o * scale))
        else:
            net.edge(i, n + 1, int(-o * scale) + 1)
    for a, b, there, back in edges:
        if int(there * scale) or int(back * scale):
            net.edge(a, b, int(there * scale), int(back * scale))
    level = net.source_side(n, n + 1)
    return [level[i] >= 0 for i in range(len(blocks))]


def main_text(page: str | None) -> str:
    """The article of one page."""
    blocks = blocks_of(page or "")
    return " ".join(b.text for b, content in zip(blocks, label(blocks), strict=True) if content)


def extract_text(df: DataFrame, page: str = "html", text: str = "text") -> DataFrame:
    """`df` with the main text of its html column as `text`; a column of that name is replaced."""

    small_batches(df.sparkSession)

    @F.arrow_udf("string")
    def extracted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(p.as_py()) for p in batch], pa.string())

    return df.withColumn(text, extracted(F.col(page)))
