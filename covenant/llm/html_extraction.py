"""Main text of web pages by two passes of rules over blocks.

A page is cut into blocks at block-level tags; scripts, styles, forms and what is inside elements that
are by name, role or class a menu, header, footer, sidebar, notice, advert or comment section give no
block. The first pass calls a block good or bad by its share of stop words, length and share of linked
characters, and leaves short ones open; the second gives an open block the label of the nearest
decided blocks: good if both sides are, and for a heading if what follows is. At an end of the page
the one decided side counts. Where no long block has the stop words of prose, the page is in a language
without a list here (or has no prose), and length and links alone decide.

That a block is in an <article> (or else a <main>) is one of its features. In the part that a page
marks most closely, a long block poor in stop words and a linked heading are open rather than bad, an
open block needs one good side, and without a decided one it is good unless other parts hold good
blocks. Sides are those in a part marked alike, so short blocks around an article don't follow from it.

Defined results: a null or empty page has an empty text, of 0 characters; markup left open ends with
the page; character references that name nothing stay as they are; rows repeated give the same result
each; an empty table gives an empty one; columns that clash with those added are replaced by them.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from covenant.functions.markup import markup
from covenant.llm.shared import by_bytes

_RAW = frozenset("script style noscript template svg iframe textarea select title object canvas".split())
_NAMED = re.compile(r"(?<![\w-])(class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.IGNORECASE)
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_BOILERPLATE = frozenset("nav footer aside form head menu button dialog".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold the text itself, whatever they are called.
_NEVER_BOILERPLATE = frozenset("html body main article".split())
#: Whole classes, ids, roles or labels that say that an element isn't part of the article.
_SAYS_NO = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice popup promo related respond share sharing sidebar social sponsor sponsored subscribe toolbar widget complementary contentinfo search login signup "
    "ad-banner ad-container ad-slot ad-unit ad-wrapper comment-form comment-list comments-area cookie-banner cookie-bar cookie-consent cookie-notice main-menu main-nav main-navigation nav-menu page-footer page-header "
    "related-articles related-posts share-bar share-buttons side-bar site-footer site-header site-nav site-navigation social-links social-share sharing-buttons top-nav topnav widget-area".split()
)
#: Parts of names that make an element doubtful, and those that may stand beside them in a name.
_DOUBTFUL = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner comment comments cookie cookies disqus footer gdpr modal navbar navigation newsletter popup promo related replies reply respond sidebar sidebars sponsor sponsored subscribe toolbar widget widgets".split()
)
_BESIDE = frozenset(
    "area article bar block body bottom box col column container content custom entry first footer form global group holder home inner item items large last layout left list main menu middle nav outer page panel post posts primary reader readers region right second secondary section sections site slot small "
    "sticky story stories text third thread top tree unit user view wide wrap wrapper zone".split()
)
_ENDS_P = _BLOCKS - {"body", "html", "head"}
#: Frequent words of English, French, German and Spanish.
_STOP = frozenset(
    "the of and to in is that it for on with as was be by this from at are or an not have but which you his her they their "
    "le la les de des du et un une est que qui dans pour par sur au aux ne pas avec ce se plus sont "
    "der die das und ein eine ist von zu den dem mit sich des auf für nicht im auch als es an werden aus er hat "
    "el los las y en del que por con una para se su al lo como más o pero sus le ha".split()
)
LENGTH_LOW, LENGTH_HIGH, STOP_LOW, STOP_HIGH, LINKS_HIGH = 70, 200, 0.15, 0.28, 0.33


class Block:
    __slots__ = ("doubted", "good", "heading", "linked", "parts", "text", "within")

    def __init__(self, within: int, heading: bool, doubted: bool) -> None:
        self.doubted = doubted
        self.parts: list[str] = []
        self.linked = 0
        self.within = within
        self.heading = heading
        self.text = ""
        self.good: bool | None = None


def _says_no(tag: str, attributes: str, article: bool) -> bool:
    if tag in _NEVER_BOILERPLATE:
        return False
    if tag in _BOILERPLATE or (tag == "header" and not article):
        return True
    if "=" in attributes:
        for name, value in _NAMED.findall(attributes):
            value = value.strip("\"'").lower().replace("_", "-")
            if not _SAYS_NO.isdisjoint([value.strip()] if name.lower() == "aria-label" else value.split()):
                return True
    return False


def _is_doubtful(tag: str, attributes: str) -> bool:
    """Whether a class or id is made of parts of which one names what isn't the article and the others places, as in comment-body or post-comments."""
    if "=" not in attributes or tag in ("html", "body", "main"):
        return False
    for name, value in _NAMED.findall(attributes):
        if name.lower() in ("class", "id"):
            for given in value.strip("\"'").lower().replace("_", "-").split():
                parts = [p for p in given.split("-") if p and not p.isdigit()]
                # content-sidebar and the like name a layout of both
                if parts and parts[0] not in ("content", "main", "primary") and not _DOUBTFUL.isdisjoint(parts) and all(p in _DOUBTFUL or p in _BESIDE for p in parts):
                    return True
    return False


def blocks_of(page: str) -> list[Block]:
    """Blocks outside boilerplate; ``within`` is 2 in an article, 1 in a main part, else 0."""
    out: list[Block] = []
    open_tags: list[tuple[str, int, int, bool]] = []  # name, within and doubts before it, whether it is boilerplate
    n_open: Counter[str] = Counter()
    within, bad, links, heading, doubts = 0, 0, 0, False, 0
    current: Block | None = None
    at = 0

    def add(raw: str) -> None:
        nonlocal current
        if bad or not raw:
            return
        if current is None:
            if raw.isspace():
                return
            current = Block(within, heading, doubts > 0)
            out.append(current)
        text = html.unescape(raw)
        current.parts.append(text)
        if links:
            current.linked += len(text)

    for m in markup(page, _RAW):
        add(page[at : m.start])
        at = m.end
        tag = m.name
        if tag is None:
            continue
        if tag == "br":
            if current is not None:
                current.parts.append(" ")
            continue
        if tag in _BLOCKS:
            current = None
            heading = not m.closing and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
        if tag == "a":
            links = max(0, links + (-1 if m.closing else 1))
        if tag in _VOID:
            continue
        if m.closing:
            if n_open[tag]:
                while open_tags:
                    name, within, doubts, was_bad = open_tags.pop()
                    n_open[name] -= 1
                    bad -= was_bad
                    if name == tag:
                        break
        elif tag in _BLOCKS or tag in ("span", "section", "button"):
            if tag in ("p", "li") and open_tags and open_tags[-1][0] == tag:
                name, within, doubts, was_bad = open_tags.pop()
                n_open[name] -= 1
                bad -= was_bad
            is_bad = _says_no(tag, m.attributes, within == 2)
            open_tags.append((tag, within, doubts, is_bad))
            n_open[tag] += 1
            bad += is_bad
            within = max(within, 2 if tag == "article" else 1 if tag == "main" else 0)
            doubtful = _is_doubtful(tag, m.attributes)
            # an article or main part inside a doubtful element is the text itself, and what it holds is judged anew
            doubts = doubtful if tag in ("article", "main") else doubts + doubtful
    add(page[at:])
    for b in out:
        b.text = " ".join("".join(b.parts).split())
    return [b for b in out if b.text]


def _density(b: Block) -> float:
    words = b.text.lower().split()
    return sum(w.strip(".,;:!?\"'()") in _STOP for w in words) / len(words)


def _is_linked(b: Block) -> bool:
    return b.linked / max(1, len(b.text)) > LINKS_HIGH


def _first_pass(b: Block, told: bool, marked: bool) -> None:
    """``told`` is whether stop words tell prose on this page, ``marked`` whether the page says that b is text."""
    density = _density(b)
    if _is_linked(b):
        b.good = None if marked and b.heading else False
    elif len(b.text) < LENGTH_LOW:
        b.good = None
    elif not told or density >= STOP_HIGH or (density >= STOP_LOW and len(b.text) >= LENGTH_HIGH):
        b.good = True
    elif density < STOP_LOW:
        b.good = None if marked else False


def _second_pass(blocks: list[Block], marked: bool, otherwise: bool) -> None:
    """``otherwise`` is the label of open blocks where none is decided."""
    after: list[bool | None] = []
    near: bool | None = None
    for b in reversed(blocks):
        near = near if b.good is None else b.good
        after.append(near)
    before: bool | None = None
    for b, following in zip(blocks, reversed(after), strict=True):
        if b.good is None:
            sides = [s for s in ((following,) if b.heading and following is not None else (before, following)) if s is not None]
            b.good = (any(sides) if marked else all(sides)) if sides else otherwise
        else:
            before = b.good


def _judged(blocks: list[Block]) -> bool:
    """Both passes over blocks; whether a block was good by itself."""
    most = max((b.within for b in blocks), default=0)
    told = any(len(b.text) >= LENGTH_LOW and not _is_linked(b) and _density(b) >= STOP_LOW for b in blocks)
    for b in blocks:
        b.good = None
        _first_pass(b, told, b.within == most > 0)
    good = {b.within for b in blocks if b.good}
    for within in {b.within for b in blocks}:
        _second_pass([b for b in blocks if b.within == within], within == most > 0, within == most and good <= {within})
    return bool(good)


def main_blocks(page: str | None) -> list[str]:
    blocks = blocks_of(page or "")
    sure = [b for b in blocks if not b.doubted]
    # without a block that is good by itself outside doubtful elements, the text is in one of those
    if not _judged(sure):
        sure = blocks
        _judged(sure)
    return [b.text for b in sure if b.good]


def extract(pages: DataFrame) -> DataFrame:
    """pages with text and n_chars added."""
    pages = pages.drop("text", "n_chars")
    schema = T.StructType([*pages.schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "html"):
            texts = ["\n".join(main_blocks(h)) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [f.name for f in schema.fields])

    return pages.mapInArrow(run, schema)
