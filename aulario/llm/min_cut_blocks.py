"""Main text of web pages by minimum-cut labelling of their blocks.

A page is read tag by tag into blocks of text, each with the elements around it. A linear classifier
gives every block a cost of being boilerplate and one of being content; these are the capacities to
the two terminals. Neighbouring blocks, and successive blocks of one parent element, are tied by
smoothness edges. The minimum cut of that graph is the labelling of least total cost. Blocks whose
own cost outweighs all their ties keep their preferred label in some optimum, so they are settled
first and their ties become costs of their neighbours; maximum flow decides what is left.

Scripts, styles, comments of the markup and the head hold no text. Character references are decoded
once, white space inside a block (line breaks included) becomes one space, blocks are joined by line
feeds. A null or empty page has the empty text. Markup that breaks off or is not closed is read as far
as it goes.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from aulario.llm.text import sliced

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?|[^<]+|<",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|style|hidden|aria-hidden)(?![\w-])(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME = re.compile(r"[a-z]+")

_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3"
    " h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead"
    " tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose inside is no markup, and others that are left out with all they hold.
_RAW = frozenset("script style noscript template textarea title iframe xmp".split())
_OUT = frozenset("head svg math canvas object audio video button select".split())
_CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_BARRIER = frozenset("ul ol dl table div article section main body td".split())
_FURNITURE = frozenset("nav footer aside form menu dialog".split())
_FURNITURE_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert menu form".split())
#: Words in classes and ids of page furniture and of reader comments.
_HINTS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus"
    " footer header login masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo"
    " promoted recommended related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe"
    " subscription tags toolbar widget".split()
)
_READERS = frozenset("comment comments disqus replies reply respond".split())
_CONTENT_HINTS = frozenset("article content entry main post story body text".split())


@dataclass
class Weights:
    """Costs of the classifier and of the ties; positive speaks for content."""

    bias: float = -0.6
    words: float = 1.6
    full_words: int = 30
    sentence: float = 0.4
    link: float = -3.0
    article: float = 3.0
    content_hint: float = 1.0
    furniture: float = -5.0
    hint: float = -5.0
    paragraph: float = 0.6
    heading: float = 0.5
    item: float = -0.4
    adjacent: float = 0.3
    same_parent: float = 0.6


@dataclass
class Element:
    """An open element; flags are inherited from the elements around it."""

    tag: str
    number: int
    article: bool = False
    furniture: bool = False
    content_hint: bool = False
    hidden: bool = False
    link: bool = False
    block: bool = False
    hint: Hint | None = None


@dataclass
class Hint:
    """Words in the class or id of an element that speak for furniture, and what may speak against them."""

    exact: bool
    readers: bool
    named: bool
    outer: Hint | None
    holds_article: bool = False
    words: int = 0

    def stands(self, words: int) -> bool:
        """False for a wrapper of most of the page's words that is a layout rather than a piece of furniture."""
        if 2 * self.words < words:
            return True
        if self.holds_article and not (self.exact and self.readers):
            return False
        return not self.named and (self.exact or self.readers)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    parent: int
    element: Element
    tag: str = field(default="")
    furniture_hint: bool = False


def _element(tag: str, attributes: str, number: int, up: Element) -> Element:
    e = Element(tag, number, up.article, up.furniture, up.content_hint, up.hidden, up.link or tag == "a", tag in _BLOCK, up.hint)
    framed = tag in ("article", "main")
    if tag in ("article", "main"):
        e.article = True
    elif tag in _FURNITURE or tag == "header" and not up.article:
        e.furniture = True
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name in ("class", "id"):
            parts, tokens = set(_NAME.findall(value)), set(value.split())
            if parts & _HINTS and tag not in ("body", "html", "article", "main"):
                named = bool(tokens & _CONTENT_HINTS) and not tokens & _HINTS
                e.hint = Hint(bool(tokens & _HINTS), bool(parts & _READERS), named, e.hint)
            elif parts & _CONTENT_HINTS:
                e.content_hint = True
            framed &= not parts & _HINTS
        elif name == "role":
            e.furniture |= value in _FURNITURE_ROLE
            e.article |= value in ("main", "article")
            framed |= value in ("main", "article") and e.hint is up.hint
        elif name == "style":
            e.hidden |= "display:none" in value.replace(" ", "") or "visibility:hidden" in value.replace(" ", "")
        elif name == "hidden":
            e.hidden = True
        elif name == "aria-hidden":
            e.hidden |= value == "true"
    e.hidden |= tag in _OUT
    around = up.hint if framed else None
    while around:
        around.holds_article, around = True, around.outer
    return e


def blocks(page: str) -> list[Block]:
    """The visible blocks of text of a page, in order."""
    out: list[Block] = []
    stack = [Element("", 0)]
    texts: list[tuple[str, bool]] = []
    number = 0
    raw = ""
    at = 0
    holder = stack[0]

    def flush() -> None:
        nonlocal texts
        if texts:
            text = " ".join(html.unescape("".join(t for t, _ in texts)).split())
            if text:
                n = text.count(" ") + 1
                linked = sum(len(t.split()) for t, link in texts if link)
                parent = next((e for e in reversed(stack) if e.block and e is not holder), stack[0])
                out.append(Block(text, n, min(linked, n), parent.number, holder, holder.tag))
            texts = []

    while at < len(page):
        if raw:
            end = re.compile(rf"</{raw}\s*>|</{raw}\Z", re.I).search(page, at)
            at, raw = (end.end() if end else len(page)), ""
            continue
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            text = m[0]
            if text.startswith("<!") or text.startswith("<?"):
                continue
            if not stack[-1].hidden:
                holder = next((e for e in reversed(stack) if e.block), stack[0])
                texts.append((text, stack[-1].link))
            continue
        tag = tag.lower()
        closing, attributes = (m[1], m[3]) if m[2] else (m[4], m[6])
        if closing:
            if tag in _BLOCK:
                flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in _BARRIER and tag not in _BLOCK:
                    break
            continue
        if tag in _RAW:
            raw = tag
            continue
        if tag == "br":
            texts.append((" ", False))
            continue
        if tag in _BLOCK:
            flush()
            if stack[-1].tag == "head":
                stack.pop()
            closes = _CLOSES.get(tag, ("p",))
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in closes:
                    del stack[i:]
                    break
                if stack[i].tag in _BARRIER:
                    break
        if tag not in _VOID and not attributes.endswith("/"):
            number += 1
            stack.append(_element(tag, attributes, number, stack[-1]))
    flush()
    _weigh_hints(out)
    return out


def _weigh_hints(found: list[Block]) -> None:
    """Mark the blocks inside furniture by class or id; wrappers of most of the page may not count."""
    words = sum(b.words for b in found)
    for b in found:
        hint = b.element.hint
        while hint:
            hint.words, hint = hint.words + b.words, hint.outer
    for b in found:
        hint = b.element.hint
        while hint and not hint.stands(words):
            hint = hint.outer
        b.furniture_hint = hint is not None


def preference(b: Block, w: Weights) -> float:
    """How much content speaks for itself: cost as boilerplate less cost as content."""
    e = b.element
    s = w.bias + w.words * min(1.0, b.words / w.full_words) + w.link * b.linked / b.words
    s += w.sentence * (b.text[-1] in ".!?…。")
    s += w.article * e.article + w.content_hint * (e.content_hint and not e.article)
    s += w.furniture * e.furniture + w.hint * b.furniture_hint
    s += w.paragraph * (b.tag in ("p", "blockquote", "pre")) + w.heading * (len(b.tag) == 2 and b.tag[0] == "h" and b.tag != "hr")
    return s + w.item * (b.tag == "li" and not e.article)


def ties(found: list[Block], w: Weights) -> list[tuple[int, int, float]]:
    """Smoothness edges: neighbours, and successive blocks of one parent."""
    edges = [(i - 1, i, w.adjacent) for i in range(1, len(found))]
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if b.parent in last:
            edges.append((last[b.parent], i, w.same_parent))
        last[b.parent] = i
    return edges


def minimum_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the source side of a minimum cut; a positive cost ties to the source."""
    n = len(costs)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        if a != b:
            near[a][b] = near[a].get(b, 0.0) + c
            near[b][a] = near[b].get(a, 0.0) + c
    cost, label = list(costs), [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(cost[i]) >= sum(near[i].values()):
            label[i] = cost[i] > 0
            for j, c in near[i].items():
                cost[j] += c if label[i] else -c
                del near[j][i]
                todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        # augment along shortest paths from source to sink
        source, sink = n, n + 1
        room: dict[int, dict[int, float]] = {i: dict(near[i]) for i in rest}
        room[source], room[sink] = {}, {}
        for i in rest:
            a, b = (source, i) if cost[i] > 0 else (i, sink)
            room[a][b] = abs(cost[i])
            room[b].setdefault(a, 0.0)
        while True:
            before = {source: source}
            line = deque([source])
            while line and sink not in before:
                a = line.popleft()
                for b, c in room[a].items():
                    if c > 1e-9 and b not in before:
                        before[b] = a
                        line.append(b)
            if sink not in before:
                break
            path, b = [], sink
            while b != source:
                path.append((before[b], b))
                b = before[b]
            flow = min(room[a][b] for a, b in path)
            for a, b in path:
                room[a][b] -= flow
                room[b][a] = room[b].get(a, 0.0) + flow
        for i in rest:
            label[i] = i in before
    return [bool(x) for x in label]


def main_text(page: str | None, weights: Weights | None = None) -> str:
    """Text of the blocks on the content side of the cut."""
    w = weights or Weights()
    found = blocks(page or "")
    content = minimum_cut([preference(b, w) for b in found], ties(found, w))
    return "\n".join(b.text for b, ok in zip(found, content, strict=True) if ok)


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 2):
                text = pa.array([main_text(p, weights) for p in part.column(2).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), text, pc.utf8_length(text).cast(pa.int64())], ["page_id", "url", "text", "n_chars"]
                )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
