"""Main text of web pages by tag-path ratios.

A tolerant scan turns a page into text blocks, each with its root-to-leaf tag
path. Text length (links apart) and punctuation are aggregated per path and
divided by the number of the path's blocks, smoothed over neighbouring blocks
in page order, and fused as a geometric mean weighted by the path's role: menus,
adverts, forms and the like weigh nothing, article and main elements more than
others. The container that holds most of the fused mass is the article, with
its sibling articles if it is one; its paths over the threshold give the
content, and headings go with the text under them.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read_table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr".split()
)
#: Elements whose start ends an open element of the listed kinds, up to the listed fences.
CLOSES = {
    **dict.fromkeys(["li"], ({"li"}, {"ul", "ol", "menu"})),
    **dict.fromkeys(["dt", "dd"], ({"dt", "dd"}, {"dl"})),
    **dict.fromkeys(["td", "th"], ({"td", "th"}, {"tr", "table"})),
    **dict.fromkeys(["tr"], ({"tr"}, {"table"})),
    **dict.fromkeys(["option"], ({"option"}, {"select"})),
}
#: Elements that never hold article text.
DROPPED = frozenset(
    "head nav aside footer form button select option input textarea script style noscript template iframe svg canvas object audio video map menu dialog "
    "fieldset legend datalist output progress meter math applet noframes noembed xmp".split()
)
#: Parts of class and id names, and ARIA roles, of what is not the article.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo promotion promoted nav navbar navigation menu menubar "
    "breadcrumb breadcrumbs footer header masthead topbar sidebar side rail widget widgets cookie cookies consent gdpr notice notices alert popup modal "
    "overlay newsletter subscribe subscription signup social share sharing sharebar related recommended recommendations comment comments commentlist disqus "
    "discussion reply replies respond pagination pager login signin toolbar skip hidden copyright disclaimer legal".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CONTENT = frozenset(["article", "main"])
#: Stands for all elements that are not inline, as fences.
NOT_INLINE = frozenset(["*"])
#: The role weight of what is in an article or main element, and the share of the fused mass that a container holds.
MARKED, SHARE = 1.5, 0.6
#: Blocks that make an article of a page that has nothing else.
SEVERAL = 3

_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_UP_TO = re.compile(r"[^\"'>]*")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?\"'()–—‘-”…、。！，？¿¡«»]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass(slots=True)
class Element:
    """An element that is not inline: its parent's number, the number of its tag path, and what holds for text in it."""

    parent: int
    path: int
    level: int  # 1 to 6 in a heading, else 0
    content: bool  # an article or main element
    role: float


@dataclass(slots=True)
class Block:
    """The text between two block boundaries, in one element."""

    element: int
    role: float
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


class Page:
    """The elements and text blocks of a page, in page order. Paths are numbered as in a tree, so deep pages cost no more than long ones."""

    def __init__(self) -> None:
        self.elements = [Element(-1, 0, 0, False, 1.0)]
        self.paths: dict[tuple[int, str], int] = {}
        self.blocks: list[Block] = []

    def add(self, parent: int, tag: str, role: float) -> int:
        above = self.elements[parent]
        path = self.paths.setdefault((above.path, tag), len(self.paths) + 1)
        level = int(tag[1]) if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456" else above.level
        self.elements.append(Element(parent, path, level, tag in CONTENT, role))
        return len(self.elements) - 1


def _boilerplate(tag: str, attributes: str, in_content: bool, by_name: bool = True) -> bool:
    """Whether an element and all in it is something else than the article; ``by_name``: also by words of its class or id."""
    if tag in DROPPED or (tag == "header" and not in_content):
        return True
    if not attributes.strip() or tag in ("html", "body", *CONTENT):
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "style" and _HIDDEN.search(value):
            return True
        if name == "role" and value.lower() in ROLES:
            return True
        if by_name and name in ("class", "id") and not re.fullmatch("h[1-6]", tag):
            if BOILERPLATE.intersection(w.lower() for w in _WORD.findall(value)):
                return True
    return False


def tokens(page: str) -> Iterator[tuple[str, str, str, int]]:
    """(kind, name, rest, end): 'text' with the text, 'open' and 'close' with tag and attributes. One pass from left to right.

    A caller may send a position to go on from. A quote opens a value after an
    equals sign; one that is never closed is an ordinary character.
    """
    at, size, closed = 0, len(page), {'"': True, "'": True}
    while at < size:
        low = page.find("<", at)
        if low < 0:
            yield "text", page[at:], "", size
            return
        if low > at:
            yield "text", page[at:low], "", low
        if page.startswith("<!--", low):
            end = page.find("-->", low + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith("<![CDATA[", low):
            end = page.find("]]>", low + 9)
            at = size if end < 0 else end + 3
            yield "text", page[low + 9 : size if end < 0 else end].replace("&", "&amp;"), "", at
            continue
        tag = _TAG.match(page, low + 1)
        if tag is None:
            mark = page[low + 1 : low + 2] in ("!", "?", "/")
            end = page.find(">", low) if mark else -1
            at = (size if end < 0 else end + 1) if mark else low + 1
            if not mark:
                yield "text", "<", "", at
            continue
        start = end = tag.end()
        while end < size:
            end = _UP_TO.match(page, end).end()
            if end >= size or page[end] == ">":
                break
            quote, back = page[end], end - 1
            while back >= start and page[back].isspace():
                back -= 1
            other = page.find(quote, end + 1) if back >= start and page[back] == "=" and closed[quote] else -1
            if back >= start and page[back] == "=" and other < 0:
                closed[quote] = False
            end = other + 1 if other >= 0 else end + 1
        at = min(end + 1, size)
        jump = yield "close" if tag[1] else "open", tag[2].lower(), page[start:end], at
        if jump is not None:
            at = jump
            yield "text", "", "", at  # the answer to send()


def parse(page: str, by_name: bool = True) -> Page:
    """All text blocks of a page in page order, those without a visible character left out. ``by_name``: class and id words tell what is no article."""
    out = Page()
    open_: list[tuple[str, int, bool, bool]] = []  # tag, number of the element that is not inline, is boilerplate, is in an article or main element
    count: dict[str, int] = defaultdict(int)  # open elements by tag
    links = 0
    block: Block | None = None

    def text(raw: str) -> None:
        nonlocal block
        if not raw or (block is None and not raw.strip()):
            return
        if block is None:
            number, off, marked = open_[-1][1:] if open_ else (0, False, False)
            block = Block(number, 0.0 if off else MARKED if marked else 1.0)
        raw = html.unescape(raw) if "&" in raw else raw
        block.parts.append(raw)
        if links:
            block.linked += len(raw)

    def flush() -> None:
        nonlocal block
        if block is not None:
            block.text = _SPACE.sub(" ", "".join(block.parts)).strip()
            if block.text:
                out.blocks.append(block)
            block = None

    def close(to: int) -> None:
        nonlocal links
        if any(x[0] not in INLINE for x in open_[to:]):
            flush()
        for x in open_[to:]:
            count[x[0]] -= 1
            links -= x[0] == "a"
        del open_[to:]

    def last(tags: Iterable[str], fences: Iterable[str]) -> int:
        """The place of the innermost open element of some tags, below no fence; -1 if there is none."""
        if any(count[t] for t in tags):
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] in tags:
                    return i
                if open_[i][0] in fences or (fences is NOT_INLINE and open_[i][0] not in INLINE):
                    break
        return -1

    stream = tokens(page)
    for kind, tag, rest, at in stream:
        if kind == "text":
            text(tag)
            continue
        if kind == "close":
            if count[tag]:
                close(last((tag,), ()))
            elif tag not in INLINE:
                flush()
            continue
        if tag == "br":
            text(" ") if block is not None else None
            continue
        if tag not in INLINE:
            if (i := last(("p",), NOT_INLINE)) >= 0:  # a block ends an open paragraph, and formatting left open in it
                close(i)
            if tag in CLOSES and (i := last(*CLOSES[tag])) >= 0:
                close(i)
            flush()
        if tag in VOID:
            continue
        above = open_[-1] if open_ else ("", 0, False, False)
        off = above[2] or _boilerplate(tag, rest, above[3], by_name)
        if tag in RAW:  # up to its end tag all is text of a kind that is dropped
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            stream.send(end.end() if end else len(page))
            continue
        if tag in ("svg", "path") and rest.rstrip().endswith("/"):
            continue
        if tag in INLINE and off and not above[2]:
            flush()  # an advert within a line is a block of its own
        number = above[1] if tag in INLINE else out.add(above[1], tag, 0.0 if off else 1.0)
        open_.append((tag, number, off, above[3] or tag in CONTENT))
        count[tag] += 1
        links += tag == "a"
    flush()
    return out


def blocks(page: str) -> list[Block]:
    return parse(page).blocks


def content_blocks(page: Page, threshold: float = 0.1) -> list[Block]:
    """The blocks of the article.

    ``threshold``: the share of the mean fused ratio (over blocks with a role,
    in the container) that a path needs. A heading needs a block of its own
    section that is kept. A container has blocks in elements below it: one
    paragraph that holds most of a page is not its article.
    """
    found, elements = page.blocks, page.elements
    if not any(b.role for b in found):
        return []
    sizes: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0])
    for b in found:  # per path: text outside links, punctuation, blocks
        s = sizes[elements[b.element].path]
        s[0] += max(0, len(b.text) - b.linked)
        s[1] += len(_PUNCTUATION.findall(b.text)) if b.linked < len(b.text) else 0
        s[2] += 1
    ratios = [sizes[elements[b.element].path] for b in found]
    long = [s[0] / s[2] * b.role for s, b in zip(ratios, found, strict=True)]
    marks = [(s[1] + 0.5) / s[2] * b.role for s, b in zip(ratios, found, strict=True)]
    fused = [math.sqrt(x * y) for x, y in zip(_smooth(long), _smooth(marks), strict=True)]
    mass, holds = [0.0] * len(elements), [False] * len(elements)
    for b, f in zip(found, fused, strict=True):
        if b.role:
            mass[b.element] += f * max(1, len(b.text) - b.linked)
    total = sum(mass)
    for k in range(len(elements) - 1, 0, -1):  # children have larger numbers
        if mass[k]:
            mass[elements[k].parent] += mass[k]
            holds[elements[k].parent] = True
    holders = [k for k in range(1, len(elements)) if mass[k] >= SHARE * total and mass[k] and (holds[k] or elements[k].content)]
    marked = [k for k in holders if elements[k].content]
    if marked:  # of nested ones the one with most, and the innermost of equals; its siblings are parts of one page
        heart = max(marked, key=lambda k: (mass[k], k))
        hearts = {k for k, e in enumerate(elements) if e.content and e.parent == elements[heart].parent}
    else:
        hearts = {max(holders)} if holders else {0}
    within = [k in hearts for k in range(len(elements))]
    for k in range(1, len(elements)):
        within[k] = within[k] or within[elements[k].parent]
    inside = [(b, f) for b, f in zip(found, fused, strict=True) if b.role and within[b.element]]
    by_path: dict[int, list[float]] = defaultdict(list)
    for b, f in inside:
        by_path[elements[b.element].path].append(f)
    means = {path: sum(fs) / len(fs) for path, fs in by_path.items()}
    least = threshold * sum(f for _, f in inside) / len(inside)
    kept = [means[elements[b.element].path] >= least for b, _ in inside]
    levels = [elements[b.element].level for b, _ in inside]
    following: dict[int, bool | None] = {}  # whether a block is kept in the section so far, by the levels of its headings; None: it has no blocks
    for i in range(len(inside) - 1, -1, -1):
        if levels[i]:
            own = following.get(levels[i])
            kept[i] = kept[i] if own is None else own
            following = {k: (None if k >= levels[i] else v if own is None else bool(v) or own) for k, v in following.items()}
        else:
            following = {k: bool(following.get(k)) or kept[i] for k in range(1, 7)}
    return [b for (b, _), keep in zip(inside, kept, strict=True) if keep]


def _smooth(values: list[float]) -> list[float]:
    """Each value with half of its weight on its two neighbours."""
    n = len(values)
    return [0.5 * v + 0.25 * (values[i - 1] if i else v) + 0.25 * (values[i + 1] if i + 1 < n else v) for i, v in enumerate(values)]


def main_text(page: str | None) -> str:
    """The article of a page; blocks are joined by one line feed.

    Where words of classes and ids leave nothing of a page, they were wrong
    about it: the ratios then decide without them, if content markup or
    several blocks speak for an article.
    """
    if not page:
        return ""
    kept = content_blocks(parse(page))
    if not kept:
        whole = parse(page, by_name=False)
        again = content_blocks(whole)
        if len(again) >= SEVERAL or any(e.content for e in whole.elements):
            kept = again
    return "\n".join(b.text for b in kept)


def extract_text(df: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """Replace ``html_col`` by ``text_col``, the main text of the whole page.

    A narrow step: pages are read in small Arrow batches and not shuffled. Null
    and empty pages, and pages without an article, give an empty text. Other
    columns stay; a column named ``text_col`` is replaced.
    """
    kept = [f for f in df.schema.fields if f.name not in (html_col, text_col)]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(html_col)
            texts = pa.array([main_text(v.as_py()) for v in batch.column(at)], pa.string())
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, texts], [*(f.name for f in kept), text_col])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + f"`{text_col}` string"
    return df.select(*[f.name for f in kept], html_col).mapInArrow(extract, schema)


def op1_tag_path_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
