"""Main text of web pages by tag-path ratios.

A page is read into text blocks, each with its root-to-leaf tag path (elements
and their first class; inline markup is no step).  Per path the text length and
the punctuation of its blocks are added up and divided by their number: running
text has long, punctuated blocks under one path, menus and captions have not.
Both ratios are smoothed along the page, with Gaussian weights that fall with
distance and with how little of the path two blocks share, then averaged back to
their paths, fused, and compared with a threshold.  Blocks of a path that passes
are content.  Headings, lists and captions between them are kept by the smallest
element that holds most of the content; what the page itself marks as menu,
header, footer, sidebar, notice, advert, form or comments never is.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsift.llm import blocks as B

#: Smoothing reaches that many blocks to each side; its width; the part of the
#: highest fused ratio that a path must reach; the part of the content's mass
#: that its element holds; the part of a block in links that makes it a menu.
REACH, WIDTH, THRESHOLD, HOLDS, LINKED = 3, 1.0, 0.5, 0.7, 0.6
TARGET = 4 << 20

# Fixed values of HTML: elements whose content is not text, that have no content,
# that are inline, and that a new block closes.
RAW = frozenset(("script", "style", "template", "noscript", "iframe", "noembed", "noframes", "xmp", "textarea", "title"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s "
                    "samp small span strike strong sub sup time tt u var").split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"),
          "tfoot": ("tbody", "tr", "td", "th")}
#: where the search for an element to close ends
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
MAIN = frozenset(("article", "main"))

# Elements, roles, and words of a class or id that mark what is not
# main text.
ASIDE = frozenset("nav aside footer form button select svg math canvas object audio video dialog menu head".split())
ROLES = frozenset(("navigation banner complementary contentinfo search form dialog alert alertdialog menu menubar "
                   "toolbar tablist").split())
WORDS = frozenset((
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion comment comments "
    "commentlist disqus reply replies respond sidebar sidebars sidenav aside nav navbar navigation menu menus topbar toolbar "
    "breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices notification popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations pagination "
    "pager widget widgets skip copyright legal disclaimer hidden").split())

#: possessive, so that no input makes it go back over what it has read
_TAG = re.compile(r"""<(?:!--(?P<comment>.*?)(?P<ended>-->|\Z)|(?P<close>/)?(?P<name>[A-Za-z][^\s/>]*+)
    (?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+(?=>)|[^>]*+)>|[!?/][^>]*+>)""", re.S | re.X)
_UNENDED = re.compile(r"<[A-Za-z!?/]")
_END_OF = {tag: re.compile("</" + tag, re.I) for tag in sorted(RAW)}
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_PUNCTUATION = re.compile("[.,;:!?…。，、；：！？।؟،·¿¡—–]")
_HUMP = re.compile("(?<=[a-z])(?=[A-Z])")
_SPLIT = re.compile(r"[^a-z]+")
#: elements nested deeper are read as parts of the one at that depth
DEEPEST = 512
#: such a word beside one of WORDS says how a page is laid out, not what it holds
LAYOUT = frozenset(("with", "without", "has", "no", "layout", "page"))


def marked(names: str) -> bool:
    """Does a name among a class's or id's mark what is not main text?"""
    for name in names.split():
        words = set(_SPLIT.split(_HUMP.sub("-", name).lower()))
        if words & WORDS and not words & LAYOUT:
            return True
    return False


@dataclass
class Element:
    tag: str
    step: str
    parent: "Element | None"
    out: bool
    #: inside an article or main element
    main: bool
    depth: int = 0
    mass: float = 0.0
    heading: bool = False


@dataclass
class Block:
    element: Element
    text: str
    linked: int


@dataclass
class Reader:
    """Open elements and the blocks read so far."""

    open: list[Element] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    held: list[str] = field(default_factory=list)
    in_link: int = 0
    linked: int = 0

    def text(self, raw: str) -> None:
        self.held.append(raw)
        if self.in_link:
            self.linked += len(raw.strip())

    def flush(self) -> None:
        if self.held:
            text = " ".join(unescape("".join(self.held)).split())
            if text:
                self.blocks.append(Block(self.open[-1], text, self.linked))
            self.held, self.linked = [], 0

    def push(self, tag: str, rest: str) -> None:
        self.flush()
        up = self.open[-1] if self.open else None
        known = {n.lower(): a or b or c for n, a, b, c in _ATTRIBUTE.findall(rest)} if rest.strip(" /") else {}
        names = unescape(known.get("class", ""))
        main = bool(up and up.main) or tag in MAIN
        out = bool(up and up.out) or tag in ASIDE or known.get("role", "").lower() in ROLES or bool(
            known and tag not in MAIN and tag not in ("body", "html") and marked(
                f"{names} {unescape(known.get('id', ''))}")) or "hidden" in _bare(rest, known)
        # the header of an article gives its headings only
        heading = bool(up and up.heading) or (tag == "header" and main)
        if tag == "header" and not main:
            out = True
        if len(self.open) > DEEPEST:
            return
        first = names.split()[0] if names.split() else ""
        self.open.append(Element(tag, f"{tag}.{first}" if first else tag, up, out, main,
                                 up.depth + 1 if up else 0, 0.0, heading))

    def pop_to(self, at: int) -> None:
        self.flush()
        del self.open[at:]
        self.in_link = 0

    def start(self, tag: str, rest: str) -> None:
        if tag in ("html", "body") and any(e.tag == tag for e in self.open):
            return
        if tag not in VOID:
            self.close_for(tag)
            self.push(tag, rest)

    def close_for(self, tag: str) -> None:
        """A new block ends an open paragraph; a list item, cell or row the one before."""
        if self.open[-1].tag == "p" or (self.open[-1].tag in HEADINGS and tag in HEADINGS):
            self.pop_to(len(self.open) - 1)
        if tag in CLOSES:
            ends = SCOPES.get(tag, ("table",))
            for at in range(len(self.open) - 1, 0, -1):
                if self.open[at].tag in ends:
                    return
                if self.open[at].tag in CLOSES[tag]:
                    self.pop_to(at)
                    if tag in ("li", "dt", "dd", "option"):
                        return

    def end(self, tag: str) -> None:
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                self.pop_to(at)
                return
        self.flush()


def _bare(rest: str, known: dict[str, str]) -> set[str]:
    """Names of attributes without a value."""
    return set(_ATTRIBUTE.sub(" ", rest).lower().split()) - known.keys() if rest.strip(" /") else set()


def read_blocks(html: str) -> list[Block]:
    """Text blocks of a page in page order; character references decoded, white
    space turned into single spaces.  Comments, declarations and raw elements
    (scripts, styles ...) hold no text; what is never closed ends with the page."""
    reader = Reader([Element("html", "", None, False, False)])
    at, last = 0, html.rfind(">") + 1
    while True:
        m = _TAG.search(html, at, last)
        if m is None:
            # a tag that is never ended is none, and no text either
            rest = _UNENDED.search(html, max(at, last)) if at < len(html) else None
            reader.text(html[at:rest.start()] if rest else html[at:])
            break
        if m.start() > at:
            reader.text(html[at:m.start()])
        at = m.end()
        name = m.group("name")
        if name is None:
            if m.group("ended") == "":
                break
            continue
        tag = name.lower()
        if m.group("close"):
            if tag not in INLINE:
                reader.end(tag)
            elif tag == "a":
                reader.in_link = 0
        elif tag in RAW:
            if not m.group("rest").endswith("/"):
                end = _END_OF[tag].search(html, at)
                at = end.start() if end else len(html)
        elif tag in INLINE:
            reader.in_link = 1 if tag == "a" else reader.in_link
        elif tag in VOID:
            if tag in ("br", "hr"):
                reader.text(" ")
        else:
            reader.start(tag, m.group("rest"))
    reader.flush()
    return reader.blocks


def _path(e: Element) -> tuple[str, ...]:
    out = []
    while e is not None:
        out.append(e.step)
        e = e.parent
    return tuple(reversed(out))


def _shared(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n / max(len(a), len(b))


def path_ratios(blocks: list[Block], paths: list[tuple[str, ...]]) -> dict[tuple[str, ...], float]:
    """Fused ratio of every path, 1 for the highest."""
    total: dict[tuple[str, ...], list[int]] = defaultdict(lambda: [0, 0, 0])
    for b, p in zip(blocks, paths):
        t = total[p]
        t[0] += 1
        t[1] += len(b.text) - min(b.linked, len(b.text))
        t[2] += len(_PUNCTUATION.findall(b.text))
    ids = {p: i for i, p in enumerate(total)}
    near = np.array([[_shared(p, q) for q in ids] for p in ids]) if len(ids) <= 64 else None
    of = np.array([ids[p] for p in paths])
    ratio = np.log1p(np.array([[t[1] / t[0], t[2] / t[0]] for t in total.values()]))
    values, weights = ratio[of], np.ones(len(of))
    known = list(ids)
    for d in range(1, min(REACH, len(of) - 1) + 1):
        a, b = of[:-d], of[d:]
        like = near[a, b] if near is not None else np.array([_shared(known[x], known[y]) for x, y in zip(a, b)])
        w = np.exp(-d * d / (2 * WIDTH * WIDTH)) * like ** 2
        for into, source, k in ((slice(0, -d), b, w), (slice(d, None), a, w)):
            values[into] += k[:, None] * ratio[source]
            weights[into] += k
    values /= weights[:, None]
    n = np.bincount(of, minlength=len(ids))
    smooth = np.stack([np.bincount(of, values[:, c], len(ids)) / n for c in (0, 1)], 1)
    top = smooth.max(0)
    fused = (smooth / np.where(top > 0, top, 1.0)).mean(1)
    return {p: float(f / max(fused.max(), 1e-300)) for p, f in zip(known, fused)}


def main_blocks(blocks: list[Block]) -> list[Block]:
    """The content blocks of a page, in page order."""
    left = [b for b in blocks if not b.element.out and (not b.element.heading or b.element.tag in HEADINGS)]
    if not left:
        return []
    # an article (or main element) that holds text is the page's own statement of where it is
    inside = [b for b in left if b.element.main]
    if sum(len(b.text) for b in inside) * 2 >= sum(len(b.text) for b in left) or any(_PUNCTUATION.search(b.text) for b in inside):
        left = inside
    known: dict[int, tuple[str, ...]] = {}
    paths = [known.get(id(b.element)) or known.setdefault(id(b.element), _path(b.element)) for b in left]
    ratio = path_ratios(left, paths)
    chosen = [ratio[p] >= THRESHOLD and b.linked < LINKED * len(b.text) for b, p in zip(left, paths)]
    if not any(chosen):
        return []
    holder = _holder(left, chosen)
    return [b for b, c in zip(left, chosen) if c and _within(b.element, holder)
            or b.linked < LINKED * len(b.text) and _within(b.element, holder)]


def _within(e: Element, holder: Element) -> bool:
    while e is not None and e.depth >= holder.depth:
        if e is holder:
            return True
        e = e.parent
    return False


def _holder(blocks: list[Block], chosen: list[bool]) -> Element:
    """The smallest element, above single blocks, that holds most of the content."""
    seen, total = [], 0.0
    for b, c in zip(blocks, chosen):
        if c:
            total += len(b.text)
            e = b.element.parent or b.element
            while e is not None:
                if not e.mass:
                    seen.append(e)
                e.mass += len(b.text)
                e = e.parent
    best = max((e for e in seen if e.mass >= HOLDS * total), key=lambda e: e.depth)
    beside = Counter((id(e.parent), e.step) for e in seen)
    # parts that stand side by side under equal steps are one content
    while best.parent is not None and (best.main and best.tag not in MAIN or beside[id(best.parent), best.step] > 1):
        best = best.parent
    return best


def main_text(html: str | None) -> str:
    return " ".join(b.text for b in main_blocks(read_blocks(html))) if html else ""


def extract_main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """All columns but ``html_col``, with ``text`` (the main text, empty where there
    is none) and ``n_chars`` (its code points).  A column of the table of one of
    these names gives way.  A null page is an empty one; repeated rows each have
    a row; an empty table gives no rows; a page is read whole, however long."""
    keep = [c for c in pages.columns if c not in ("text", "n_chars", html_col)]
    schema = B.with_columns(pages.select(*keep).schema, "text string, n_chars long")

    def run(batches):
        for batch in batches:
            for s in B.slices(batch, TARGET):
                texts = [main_text(h) for h in s.column(html_col).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(s.column(c) for c in keep), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    [*keep, "text", "n_chars"])

    return pages.select(*dict.fromkeys([*keep, html_col])).mapInArrow(run, schema)


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", F.col("text"), "n_chars")
