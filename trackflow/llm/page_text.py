"""Main text of web pages by tag-path ratios.

Every piece of text has a path: the tags from the root to it, each with its first class name. Per page
and path, text length and punctuation are aggregated over its pieces and divided by their number;
the two ratios are fused (their product), smoothed over neighbouring pieces in page order, and the paths whose
smoothed score reaches a share of the page's mean are content paths. The main text is what lies in
the content element: the outermost article or main around most of the content, else the deepest division
that holds all of it. Within it every block is kept, however short; only where that is the whole page, blocks of
nothing but links (no headings) before and after all content are menus. Menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and reader comments are known by tag, role or class name and left
out first. A class name or id is evidence only: an element so named stays if it holds the page's article or main,
or most of the content that the ratios find when all but reader comments counts. Where an article or main lies
outside, parts of a name that says nothing else ("ad", not "has-ad") go in any case.

Text in links weighs nothing, unless an article or main holds nothing else: then its links are the content. Of several elements
that hold equally much the outermost main, or else the innermost division, counts. The time for a page grows with its
length, not with the depth of its elements.

White space inside a block (a line break counts as such) becomes one space, blocks are joined by an empty
line. Null and empty pages, and pages without content, give an empty text. Every row is a page of its own, repeated ones, too; an
empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.3
MOST = 0.6

# Kinds of HTML elements, and names that mark parts which are no main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
LEFT_OUT = frozenset(
    "script style title noscript template head nav footer aside form button select option textarea input iframe object "
    "svg canvas dialog menu audio video xmp".split()
)
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
LEFT_OUT_NAMES = frozenset(
    "ad ads advert advertisement adverts adsense banner sponsor sponsored promo promotion sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup "
    "login comment comments disqus respond replies share sharing social related recommended widget pagination pager toolbar".split()
)
COMMENTS = frozenset("comment comments disqus respond replies".split())
HEADERS = frozenset("header masthead".split())
CLOSED_BY = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
DIVISIONS = frozenset("div article section main body html td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPES = frozenset("ul ol dl table tbody thead tfoot div article section main body html td th blockquote".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"<]*\"|'[^'<]*'|[^>\"'])*+|[^>]*)(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")


@dataclass
class Element:
    tag: str
    name: str
    parent: Element | None
    out: bool
    main: bool
    depth: int
    named: bool = False
    wholly: bool = False
    comments: bool = False
    gone: bool = False
    mass: float = 0.0
    in_main: bool = False  # it or an element around it is one; so with the next two
    linked: bool = False
    heading: bool = False
    path: int = 0


@dataclass
class Block:
    element: Element
    pieces: list[tuple[str, Element]] = field(default_factory=list)


@dataclass
class Piece:
    path: int
    element: Element
    text: str
    linked: bool


def _opened(tag: str, rest: str, parent: Element) -> Element:
    attributes = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(rest)} if rest.strip() else {}
    names = re.findall(r"[a-z0-9]+", f"{attributes.get('class', '')} {attributes.get('id', '')}".lower())
    role = attributes.get("role", "").lower()
    main = tag in ("article", "main") or role in ("main", "article") or attributes.get("itemprop", "").lower() == "articlebody"
    out = parent.out or tag in LEFT_OUT
    named = False
    if not out and not main and tag not in ("html", "body"):
        heads = not parent.in_main and tag == "header"
        hidden = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true"
        hidden = hidden or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        out = heads or hidden or role in LEFT_OUT_ROLES
        named = bool(LEFT_OUT_NAMES.intersection(names)) or not parent.in_main and bool(HEADERS.intersection(names))
    made = Element(tag, f"{tag}.{names[0]}" if names else tag, parent, out, main, parent.depth + 1, named)
    made.in_main, made.linked, made.heading = main or parent.in_main, tag == "a" or parent.linked, tag in HEADINGS or parent.heading
    if named:
        made.comments = bool(COMMENTS.intersection(names))
        single = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split()
        made.wholly = any(all(n in LEFT_OUT_NAMES or n in HEADERS for n in re.findall(r"[a-z0-9]+", name)) for name in single if name.strip("-_"))
    return made


def parse(page: str) -> tuple[list[Block], list[Piece], list[Element]]:
    """Blocks of text, pieces with their paths and elements, in page order; named parts are in, others left out.

    What an element has from those around it is set when it opens, and paths are numbers, so a page's depth costs nothing.
    """
    root = Element("", "", None, False, False, 0)
    at, here = 0, root
    blocks: list[Block] = [Block(root)]
    pieces: list[Piece] = []
    paths: dict[tuple[int, str], int] = {}  # number of the path above and name
    held = [root]  # elements in page order, each after its parent
    open_tags: dict[str, int] = defaultdict(int)

    def leave(top: Element) -> Element:
        """Closes everything up to ``top``."""
        element = here
        while True:
            open_tags[element.tag] -= 1
            if element is top:
                return top.parent
            element = element.parent

    def said(raw: str) -> None:
        if here.out or not raw:
            return
        blocks[-1].pieces.append((raw, here))
        if not raw.isspace():
            pieces.append(Piece(here.path, here, html.unescape(raw).strip(), here.linked))

    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            said(page[at:])
            break
        said(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        block = tag not in INLINE
        if m["end"]:
            top = here if open_tags[tag] else root
            while top is not root and top.tag != tag and not (block is False and top.tag not in INLINE):
                top = top.parent
            if top is not root and top.tag == tag:
                here = leave(top)
            if block:
                blocks.append(Block(here))
            continue
        if tag == "br":
            if not here.out:
                blocks[-1].pieces.append((" ", here))
            continue
        if block:
            closes = CLOSED_BY.get(tag, frozenset())
            top = here
            while top is not root and top.tag not in closes and top.tag != "p" and (top.tag not in SCOPES or top.tag in closes):
                top = top.parent
            if top is not root and (top.tag in closes or top.tag == "p"):
                here = leave(top)
                if tag == "tr" and top.tag in ("td", "th") and here.tag == "tr":
                    here = leave(here)
        if tag not in VOID:
            made = _opened(tag, m["rest"] or "", here)
            held.append(made)
            made.path = paths.setdefault((here.path, made.name), len(paths) + 1)
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
                continue
            if not (m["rest"] or "").rstrip().endswith("/") or tag not in ("svg", "path"):
                here = made
                open_tags[tag] += 1
        if block:
            blocks.append(Block(here))
    return blocks, pieces, held


def content_paths(pieces: list[Piece]) -> set[int]:
    """The paths whose fused, smoothed ratio of text length and punctuation is high for this page."""
    length: dict[int, float] = defaultdict(float)
    points: dict[int, float] = defaultdict(float)
    number: dict[int, int] = defaultdict(int)
    for p in pieces:
        length[p.path] += 0 if p.linked else len(p.text)
        points[p.path] += 0 if p.linked else len(PUNCTUATION.findall(p.text))
        number[p.path] += 1
    fused = {p: length[p] / n * (1 + points[p] / n) for p, n in number.items()}
    row = [fused[p.path] for p in pieces]
    padded = [row[0], *row, row[-1]] if row else []
    smooth: dict[int, float] = defaultdict(float)
    for i, p in enumerate(pieces):
        smooth[p.path] += padded[i] / 4 + padded[i + 1] / 2 + padded[i + 2] / 4
    mean = sum(smooth.values()) / len(pieces) if pieces else 0.0
    return {p for p, n in number.items() if length[p] and smooth[p] / n >= THRESHOLD * mean}


def spread(elements: list[Element], own: dict[int, int], stop: bool = False) -> dict[int, int]:
    """Adds what each element has of its own (by its id) to all elements around it, with ``stop`` not through named ones."""
    total = defaultdict(int, own)
    for e in reversed(elements):
        if stop and e.named:
            total[id(e)] = 0
        elif e.parent is not None:
            total[id(e.parent)] += total[id(e)]
    return total


def weigh(elements: list[Element], pieces: list[Piece], chosen: set[int] | None = None) -> float:
    """Sets each element's mass, the length of the content in it; returns that of the page. ``chosen``: paths that are content, in links, too."""
    paths = content_paths(pieces) if chosen is None else chosen
    own: dict[int, int] = defaultdict(int)
    for p in pieces:
        if p.path in paths and (chosen is not None or not p.linked):
            own[id(p.element)] += len(p.text)
    found = spread(elements, own)
    for e in elements:
        e.mass = found[id(e)]
    return sum(own.values())


def hold_articles(elements: list[Element], pieces: list[Piece]) -> bool:
    """Ends the names of elements that hold the page's article or main; returns whether one lies in no named element."""
    mains = [e for e in elements if e.main and not e.out]
    while True:
        own: dict[int, int] = defaultdict(int)
        for p in pieces:
            own[id(p.element)] += 0 if p.linked else len(p.text)
        size = spread(elements, own, stop=True)
        outermost: dict[int, Element | None] = {}  # the outermost named element around each
        for e in elements:
            above = e.parent
            outermost[id(e)] = above and (outermost[id(above)] or (above if above.named else None))
        free, largest, tops = False, 0, {}
        for e in mains:
            top = outermost[id(e)]
            if top is None:
                free, largest = True, max(largest, size[id(e)])
            else:
                tops[id(top)] = top, max(size[id(e)], tops.get(id(top), (top, 0))[1])
        better = [top for top, n in tops.values() if n > largest and not top.comments]
        if not better and not largest:
            better = [top for top, n in tops.values() if n]
        if not better:
            return free
        for top in better:
            top.named = False


def leave_out(elements: list[Element], pieces: list[Piece]) -> None:
    """Sets what is gone: what lies in a named element, unless that holds the page's article or its content."""
    free = hold_articles(elements, pieces)
    total, replies = 0, set()
    if any(e.named and not (free and e.wholly) for e in elements):
        for e in elements:
            if e.named and e.comments or id(e.parent) in replies:
                replies.add(id(e))
        total = weigh(elements, [p for p in pieces if id(p.element) not in replies]) or weigh(elements, pieces)
    for e in elements:
        if e.named and total and e.mass >= MOST * total and not (free and e.wholly):
            e.named = False
        e.gone = e.out or e.named or e.parent is not None and e.parent.gone


def main_text(page: str) -> str:
    blocks, pieces, elements = parse(page)
    if any(e.named for e in elements):
        leave_out(elements, pieces)
        pieces = [p for p in pieces if not p.element.gone]
    total = weigh(elements, pieces)
    if not total:  # an article or main that holds nothing but links is the content still
        inside = [p for p in pieces if p.element.in_main]
        total = weigh(elements, inside, {p.path for p in inside})
    if not total:
        return ""
    mains = [e for e in elements if e.main and e.mass >= MOST * total]
    if mains:
        content = min(mains, key=lambda e: e.depth)
    else:
        content = max((e for e in elements if e.mass == total and (e.tag in DIVISIONS or not e.tag)), key=lambda e: e.depth)
    within: dict[int, bool] = {}
    for e in elements:
        within[id(e)] = e is content or e.parent is not None and within[id(e.parent)]
    texts, links = [], []
    for b in blocks:
        if within[id(b.element)]:
            text = " ".join(html.unescape("".join(raw for raw, e in b.pieces if not e.gone)).split())
            if text:
                texts.append(text)
                links.append(all(raw.isspace() or e.gone or e.linked for raw, e in b.pieces) and not b.element.heading)
    if content.tag in ("", "html", "body") and False in links:
        first, last = links.index(False), len(links) - links[::-1].index(False)
        texts = texts[first:last]
    return "\n\n".join(texts)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(t or "") for t in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], "text"])


def extract(pages: DataFrame, page: str = "html") -> DataFrame:
    """``pages`` with text; the html is left out, a column named text is replaced."""
    kept = [c for c in pages.columns if c.lower() not in (page.lower(), "text")]
    row = pages.select(F.struct(F.lit(1).alias("one"), *[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(page).cast("string").alias("html"))
    kind = row.schema["row"].dataType.simpleString()
    found = row.mapInArrow(_extract, f"row {kind}, text string")
    return found.select(*[F.col("row")[c].alias(c) for c in kept], "text")
