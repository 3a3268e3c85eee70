"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks, the stretches of text between block-level tags. A linear
classifier over a block's length, links, marks and surrounding elements says how much
it costs to call it boilerplate or content; these costs are the capacities from the
source and to the sink. What an element's tag, role or name says of boilerplate counts
only if the element is a part of the page: not if it holds most words of the principal
element, which is the largest article, or else main, or else the page. A name of several
words speaks by its last one (share-price is a price), or by its first one if the rest
only says what kind of box it is (share-buttons). Neighbours in the page, siblings and blocks of one section are
joined by edges that it costs to cut. The minimum cut, found by maximum flow, is
the labelling of least total cost, and the source's side is the main text.

Each page is parsed and cut on its own inside a task, in batches; nothing is shuffled.
Parsing takes time in proportion to the page, however broken it is.

Defined results: a null or empty page, or one without content, has an empty text; a tag or
character reference cut off at the end of the page is dropped or kept as written; tags
that are never closed end with the element around them; a quotation mark of an attribute
that is never closed means nothing; page ids are carried as they
are, null or repeated; an empty table gives an empty result; further columns of the
input are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements by their part in a page.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre search section summary "
    "table tbody td tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID_BLOCKS = frozenset({"hr"})
CONTENT_TAGS = frozenset({"article", "main"})
SIDE_TAGS = frozenset("aside dialog footer form head menu nav search".split())
SECTION_TAGS = frozenset("article aside body footer form header main nav section".split())
SIDE_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
CONTENT_NAMES = frozenset("article articlebody body content entry main post prose story text".split())
SIDE_NAMES = frozenset(
    "ad ads advert advertisement advertising adverts alert banner breadcrumb breadcrumbs byline captcha comment "
    "comments commentlist consent cookie cookies copyright disqus footer form gdpr header login masthead menu modal "
    "nav navbar navigation newsletter notice notices pagination paywall popup promo promos promotion recommended "
    "related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar "
    "widget widgets".split()
)
COMMENT_NAMES = frozenset("comment comments commentlist disqus replies respond".split())
BOX_WORDS = frozenset(
    "area bar block body box button buttons container content form group holder inner item items link links list "
    "outer panel region row section slot text unit wrap wrapper".split()
)
#: Elements whose text is not read as text; of the first a missing end is the page's end.
RAW_TAGS = frozenset("script style template textarea".split())
SKIPPED_TAGS = RAW_TAGS | frozenset("noscript svg math select button iframe object canvas video audio".split())

#: Weights of the classifier, in units of cost; above zero speaks for content.
WEIGHTS = {
    "always": -0.8,
    "content element": 3.0,
    "content name": 1.0,
    "side element": -9.0,
    "side name": -9.0,
    "page header": -6.0,
    "words": 0.06,
    "closing mark": 0.7,
    "linked share": -3.0,
    "heading": 0.5,
    "list item": -0.5,
}
MOST_WORDS = 40
#: Share of the page's words from which on an article is the principal element.
PRINCIPAL_SHARE = 0.25
#: Share of the principal element's words above which an element is no side part.
WHOLE_SHARE = 0.75
#: Cost of giving two labels to neighbours, to siblings, and to blocks of one section.
EDGES = {"neighbours": 0.2, "siblings": 0.8, "section": 0.4}

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)")
_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.IGNORECASE) for tag in SKIPPED_TAGS}
_STOP = re.compile(r"[>\"']")
_NAMES = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_WORDS = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"\s+")
_CLOSING = re.compile(r"[.!?…:;。！？][\"'”’»)\]]*$")


@dataclass(slots=True)
class Element:
    """A block-level element; `settle` carries down what its ancestors say."""

    tag: str
    number: int
    around: Element | None = None
    section: int = 0
    side: bool = False
    named_side: bool = False
    comments: bool = False
    content: bool = False
    named_content: bool = False
    header: bool = False
    words: int = 0


@dataclass(slots=True)
class Block:
    parent: Element
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def side_name(name: str) -> bool:
    """Whether one class or id names a side part of a page."""
    words = [w for w in _WORDS.findall(name) if not w.isdigit()]
    if not words or words[0] in ("has", "with", "no"):
        return False
    if words[-1] in SIDE_NAMES:
        # The header of a post holds its title.
        return words[-1] != "header" or CONTENT_NAMES.isdisjoint(words)
    return words[0] in SIDE_NAMES and all(w in BOX_WORDS or w in SIDE_NAMES for w in words[1:])


def _open(tag: str, attributes: str, around: Element, number: int) -> Element:
    made = Element(tag, number, around, number if tag in SECTION_TAGS else around.section)
    made.content = tag in CONTENT_TAGS
    made.side = tag in SIDE_TAGS
    made.header = tag == "header"
    if attributes.strip(" /"):
        for name, a, b, c in _NAMES.findall(attributes):
            name, value = name.lower(), (a or b or c).lower()
            if name == "role":
                made.side |= value in SIDE_ROLES
                made.content |= value in CONTENT_TAGS
            elif name in ("class", "id"):
                # The names of the page's outermost elements speak of the site, not of a part.
                if tag not in ("html", "body"):
                    sides = [x for x in value.split() if side_name(x)]
                    made.named_side |= bool(sides)
                    made.comments |= any(not COMMENT_NAMES.isdisjoint(_WORDS.findall(x)) for x in sides)
                    made.named_content |= not CONTENT_NAMES.isdisjoint(_WORDS.findall(value))
            elif name == "style":
                made.side |= "display:none" in value.replace(" ", "")
            else:
                made.side |= name == "hidden" or value == "true"
    return made


def settle(elements: list[Element], found: list[Block]) -> None:
    """Hands down what elements say of their blocks, unless they hold the principal element."""
    for block in found:
        block.parent.words += block.text.count(" ") + 1
    for e in reversed(elements[1:]):  # children after parents
        e.around.words += e.words
    whole = elements[0].words
    articles = [e for e in elements if e.content and not e.named_side and e.tag != "main"]
    articles = [e for e in articles if e.words >= PRINCIPAL_SHARE * whole]
    mains = [e for e in elements if e.tag == "main" and not e.named_side]
    principal = max(articles or mains or elements[:1], key=lambda e: e.words)
    holders, at = set(), principal
    while at is not None:
        holders.add(at.number)
        at = at.around
    inside = set()
    for e in elements:
        around = e.around
        if e is principal or (around is not None and around.number in inside):
            inside.add(e.number)
        holds = e.number in holders or (e.number in inside and e.words > WHOLE_SHARE * principal.words)
        if holds and not e.comments:
            e.side = e.named_side = e.header = False
        if around is not None:
            e.content |= around.content
            e.header = around.header or (e.header and not e.content)
            e.side |= around.side
            e.named_side |= around.named_side
            e.named_content |= around.named_content


def marks_of(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(begin, end, tag, closing, attributes) of the page's markup; no tag where text is left out.

    A tag called " " stands for a blank.
    """
    last = {mark: page.rfind(mark) for mark in "<>\"'"}
    unended: set[str] = set()
    quotes = True
    at = page.find("<")
    while at >= 0:
        end, tag, closing, attributes = at + 1, None, False, ""
        if page.startswith("<!--", at):
            close = page.find("-->", at + 4)
            end, tag = len(page) if close < 0 else close + 3, ""
        elif page.startswith(("<!", "<?"), at):
            close = page.find(">", at)
            end, tag = len(page) if close < 0 else close + 1, ""
        elif match := _TAG.match(page, at):
            name, closing = match[2].lower(), bool(match[1])
            close = None
            if name in SKIPPED_TAGS and not closing and name not in unended:
                close = _ENDS[name].search(page, match.end())
                if close is None:
                    unended.add(name)
            if close is not None:
                end, tag = close.end(), " "
            elif name in RAW_TAGS and not closing:
                end, tag = len(page), ""
            elif last[">"] > at:
                end, quotes = _tag_end(page, match.end(), last, quotes)
                tag, attributes = name, page[match.end() : end - 1]
            elif last["<"] == at:
                end, tag = len(page), ""
        if tag is not None:
            yield at, end, tag, closing, attributes
        at = page.find("<", end)


def _tag_end(page: str, begin: int, last: dict[str, int], quotes: bool) -> tuple[int, bool]:
    """Where a tag ends, and whether quotation marks can still be trusted to close."""
    at = begin
    while quotes and (stop := _STOP.search(page, at)):
        mark = stop[0]
        if mark == ">":
            return stop.end(), True
        at = stop.end()
        if stop.start() < last[mark]:
            at = page.find(mark, at) + 1
    return page.find(">", begin) + 1, False


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order, with their texts."""
    root = Element("", 0)
    elements, stack, current, found = [root], [root], Block(root), []
    opened: Counter[str] = Counter()
    links, at = 0, 0

    def add(text: str) -> None:
        if text:
            current.parts.append(text)
            if links:
                current.linked += len(text.strip())

    def end() -> None:
        nonlocal current
        text = _SPACE.sub(" ", html.unescape("".join(current.parts))).strip()
        if text:
            current.text = text
            found.append(current)
        current = Block(stack[-1])

    def close() -> str:
        tag = stack.pop().tag
        opened[tag] -= 1
        return tag

    for begin, after, tag, closing, attributes in marks_of(page):
        add(page[at:begin])
        at = after
        if tag == " " or tag == "br":
            add(" ")
        elif tag == "a":
            links = 0 if closing else 1
        elif tag in BLOCK_TAGS:
            if closing:
                if opened[tag]:
                    while close() != tag:
                        pass
            else:
                # A paragraph or item ends where the next block or item begins.
                if stack[-1].tag == "p" or stack[-1].tag in HEADINGS:
                    close()
                if tag in ("li", "tr", "td", "th", "dt", "dd") and stack[-1].tag == tag:
                    close()
                if tag == "body" and stack[-1].tag == "head":
                    close()
                if tag not in VOID_BLOCKS:
                    made = _open(tag, attributes, stack[-1], len(elements))
                    elements.append(made)
                    stack.append(made)
                    opened[tag] += 1
            links = 0
            end()
    add(page[at:])
    end()
    settle(elements, found)
    return found


def content_cost(block: Block) -> float:
    """The classifier: what it costs to call the block boilerplate, less than zero for content."""
    parent, w = block.parent, WEIGHTS
    words = block.text.count(" ") + 1
    score = w["always"] + w["words"] * min(words, MOST_WORDS)
    score += w["content element"] * parent.content + w["content name"] * parent.named_content
    score += w["side element"] * parent.side + w["side name"] * parent.named_side + w["page header"] * parent.header
    score += w["linked share"] * min(block.linked / len(block.text), 1.0)
    score += w["heading"] * (parent.tag in HEADINGS) + w["list item"] * (parent.tag == "li")
    if _CLOSING.search(block.text):
        score += w["closing mark"]
    return score


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Neighbours, and for each parent and section its successive blocks."""
    found = []
    last_child: dict[int, int] = {}
    last_in: dict[int, int] = {}
    for i, block in enumerate(blocks):
        if i:
            found.append((i - 1, i, EDGES["neighbours"]))
        for kind, key, last in (
            ("siblings", block.parent.number, last_child),
            ("section", block.parent.section, last_in),
        ):
            if key in last:
                found.append((last[key], i, EDGES[kind]))
            last[key] = i
    return found


def source_side(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Minimum cut by maximum flow: which nodes stay with the source.

    A node's cost is its capacity from the source if above zero, to the sink if below.
    """
    n = len(costs)
    source, sink = n, n + 1
    room: list[float] = []
    ends: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(ends))
        ends.append(b)
        room.append(there)
        out[b].append(len(ends))
        ends.append(a)
        room.append(back)

    for i, cost in enumerate(costs):
        if cost > 0:
            join(source, i, cost, 0.0)
        elif cost < 0:
            join(i, sink, -cost, 0.0)
    for a, b, weight in edges:
        join(a, b, weight, weight)
    tiny = 1e-12
    while True:
        # Levels from the source, then blocking flow along them.
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            at = queue.popleft()
            for e in out[at]:
                if room[e] > tiny and level[ends[e]] < 0:
                    level[ends[e]] = level[at] + 1
                    queue.append(ends[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        next_edge = [0] * (n + 2)
        path: list[int] = []
        at = source
        while True:
            if at == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(i for i, e in enumerate(path) if room[e] <= tiny)
                at = ends[path[cut] ^ 1]
                del path[cut:]
            while next_edge[at] < len(out[at]):
                e = out[at][next_edge[at]]
                if room[e] > tiny and level[ends[e]] == level[at] + 1:
                    path.append(e)
                    at = ends[e]
                    break
                next_edge[at] += 1
            else:
                if not path:
                    break
                at = ends[path.pop() ^ 1]
                next_edge[at] += 1


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    kept = source_side([content_cost(b) for b in blocks], edges_of(blocks))
    return "\n".join(b.text for b, keep in zip(blocks, kept, strict=True) if keep)


def extract_pages(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """(page_id, url, text) of every page."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    chosen = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.col(html_col).cast("string").alias("html"),
    )
    return chosen.mapInArrow(extract, "page_id LONG, url STRING, text STRING")
