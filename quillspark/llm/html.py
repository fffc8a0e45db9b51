"""HTML extraction by line-block distribution.

Markup turns into lines, one for each block, with the length of the text in it that is not mostly links. Lengths are summed over
a sliding window of lines: where the sum rises to the threshold the text surges, where a window has no text it dives. What
lies between belongs to the article, if its section (the marked article, or the element that holds its blocks) has enough
text there; the section's other lines, as short first and last paragraphs, come along. A section of one line beside a much
larger one is no part of the article, marked or not.

Elements that hold no text of an article by what they are (menus, footers, asides, scripts, controls) have no length. Names of
classes, ids and roles and forms are hints: what they call furniture has no length as long as the curve of the other lines
surges or there is a marked article; else, as in a page whose body is one form, they count like others. Where a marked article holds most of
the text, what stands outside of it has no length.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines in a window; characters in a window from which text surges (in a page that never has so many, its fullest window).
LINES, SURGE = 3, 80
#: Share of a line that links make from which it has no length; share of the largest section that one of a single line needs.
LINKED, LONELY = 0.5, 0.5
# Names of HTML elements, and words in classes and ids of page furniture.
BLOCKS = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
SKIPPED = frozenset("head title nav footer aside button select textarea option dialog menu iframe object canvas svg audio video map annotation annotation-xml".split())
RAW = "script|style|noscript|template|textarea|iframe|noembed|noframes|xmp|svg"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDED_BY_OWN_KIND = frozenset("p li dt dd option tr td th".split())
NO_BARRIER = frozenset("p li dt dd td th".split())
ARTICLES = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FURNITURE = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside widget notice notices cookie cookies consent gdpr popup modal newsletter subscribe subscription signup login comment comments reply replies disqus respond share sharing social related recommended recommendations toolbar pagination pager skip".split())
#: Furniture of the page that an article may have as a part of its text.
OUTSIDE_ONLY = frozenset("header masthead copyright legal disclaimer alert".split())
#: Words that may stand beside those in the name of a class: a name with any other word says something else.
BESIDE = frozenset("a an and the of in on for to by my our your all more top bottom left right main inner outer upper lower first last header head footer foot title body content contents area block box boxes wrap wrapper container section sections group list lists item items entry entries row col column columns grid card cards panel bar bars button buttons btn link links icon icons text thread form field fields input wide small large mobile desktop site page global primary secondary post posts article articles news story stories media user users author new latest popular feed image images video videos js ui component module region zone slot placeholder space unit sticky fixed hidden show view open close".split())
#: What makes furniture of a whole <article>, as comments and teasers may be marked so.
NO_ARTICLE = frozenset("ad ads advert advertisement sponsored promo promotion comment comments reply replies related recommended".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())

TOKEN = re.compile(rf"<!--.*?(?:-->|$)|<({RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*[^>]*>|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)", re.S | re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
SPACE = re.compile(r"\s+")


def _named(value: str, words: frozenset[str]) -> bool:
    """Whether a name of a class or id says one of the words, and nothing but such words besides."""
    for name in value.split():
        parts = {w for w in re.split(r"[^a-z]+", name) if w}
        if parts & words and parts <= words | BESIDE:
            return True
    return False


def _furniture(tag: str, attributes: str, in_article: bool) -> int:
    """2 for an element that holds no article text by what it is or that is not shown, 1 for one whose name hints at that, else 0."""
    if tag in SKIPPED or tag == "header" and not in_article:
        return 2
    hint = int(tag in ("form", "fieldset"))
    if tag in ("html", "body") or not attributes.strip():
        return hint
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and HIDDEN.search(value):
            return 2
        if name == "role" and value in ROLES:
            hint = 1
        if name in ("class", "id") and (_named(value, NO_ARTICLE if tag in ARTICLES else FURNITURE) or not in_article and tag not in ARTICLES and _named(value, OUTSIDE_ONLY)):
            hint = 1
    return hint


class Line(NamedTuple):
    """A block's text, how many of its characters are of links, whether it is page furniture (2: by what it is, 1: by a hint), the
    marked article that it stands in (0 for none), its section, and whether it is a heading."""

    text: str
    linked: int
    furniture: int
    article: int
    section: int
    heading: bool


def lines(page: str) -> list[Line]:
    """The blocks with text, in page order. The section is the outermost marked article, else the innermost open element that
    holds blocks (paragraphs, list items and cells hold none)."""
    out: list[Line] = []
    stack: list[tuple[str, int, bool, bool]] = []  # open elements: name, furniture, article, whether it is a block
    open_at: dict[str, list[int]] = defaultdict(list)  # places in the stack by name
    barriers: list[tuple[int, int]] = [(-1, 0)]  # open elements that hold blocks: place, section
    buffer: list[str] = []
    links: list[str] = []
    furniture, hinted = 0, 0
    inside = articles = sections = blocks = headings = 0

    def text_of(parts: list[str]) -> str:
        text = SPACE.sub(" ", html.unescape("".join(parts))).strip() if parts else ""
        parts.clear()
        return text

    def add(piece: str):
        buffer.append(piece)
        if open_at["a"]:
            links.append(piece)

    def flush():
        text, linked = text_of(buffer), text_of(links)
        if text:
            out.append(Line(text, len(linked), 2 if furniture else 1 if hinted else 0, articles if inside else 0, -articles if inside else barriers[-1][1], headings > 0))

    def close(at: int):
        nonlocal furniture, hinted, inside, blocks, headings
        while len(stack) > at:
            name, f, a, block = stack.pop()
            open_at[name].pop()
            furniture, hinted = furniture - (f == 2), hinted - (f == 1)
            inside, blocks, headings = inside - a, blocks - block, headings - (name in HEADINGS)
        while barriers[-1][0] >= at:
            barriers.pop()

    at = 0
    below: list[int] = []  # blocks that are open below each open element, itself counted
    for m in TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            if m[1]:
                buffer.append(" ")
            continue
        closing, attributes = m[2] or m[5], m[4] or m[7] or ""
        block = tag in BLOCKS or tag in SKIPPED
        if block:
            flush()
        if closing:
            found = open_at[tag][-1] if open_at[tag] else None
            # an end tag of an inline element closes no block that was opened in it
            if found is not None and (block or blocks == below[found]):
                close(found)
                del below[found:]
        elif tag not in VOID and not attributes.endswith("/"):
            if tag in ENDED_BY_OWN_KIND and open_at[tag] and open_at[tag][-1] >= barriers[-1][0]:
                found = open_at[tag][-1]
                close(found)
                del below[found:]
            f, a = _furniture(tag, attributes, inside > 0), tag in ARTICLES
            furniture, hinted = furniture + (f == 2), hinted + (f == 1)
            inside, blocks, headings = inside + a, blocks + block, headings + (tag in HEADINGS)
            if a and inside == 1:
                articles += 1
            if tag in BLOCKS and tag not in NO_BARRIER:
                if tag not in HEADINGS and tag not in ("tr", "option"):
                    sections += 1
                barriers.append((len(stack), barriers[-1][1] if tag in HEADINGS or tag in ("tr", "option") else sections))
            open_at[tag].append(len(stack))
            stack.append((tag, f, a, block))
            below.append(blocks)
    if at < len(page):
        add(page[at:])
    flush()
    return out


def shown(found: list[Line], window: int = LINES, surge: int = SURGE) -> list[bool]:
    """Which lines may be of the article: none of furniture, none that hints call so as long as the others surge or have a marked article, and none outside
    of marked articles that hold most of what is left."""

    def inside(allowed: int) -> list[bool]:
        marked = sum(len(x.text) for x in found if x.article and x.furniture <= allowed)
        rest = sum(len(x.text) for x in found if not x.article and x.furniture <= allowed)
        return [x.furniture <= allowed and (x.article > 0 or marked < rest or not marked) for x in found]

    plain, more = inside(0), inside(1)
    surges = lambda may: max(sums(lengths(found, may), window), default=0) >= surge
    marked = any(x.article and m for x, m in zip(found, plain))
    return more if not marked and not surges(plain) and surges(more) else plain


def lengths(found: list[Line], may: list[bool]) -> list[int]:
    """The length of each line as the curve sees it."""
    return [len(x.text) if m and x.linked < LINKED * len(x.text) else 0 for x, m in zip(found, may)]


def sums(length: list[int], window: int = LINES) -> list[int]:
    """The curve: the length of each line and of those behind it in its window."""
    out, total = [0] * len(length), 0
    for i in range(len(length) - 1, -1, -1):
        total += length[i] - (length[i + window] if i + window < len(length) else 0)
        out[i] = total
    return out


def spans(length: list[int], window: int = LINES, surge: int = SURGE) -> tuple[list[bool], int]:
    """(whether each line lies between a surge and the next dive, the threshold)."""
    curve = sums(length, window)
    least = max(1, min(surge, max(curve, default=0)))
    out, open_ = [], False
    for n in curve:
        open_ = n > 0 if open_ else n >= least
        out.append(open_)
    return out, least


def main_text(page: str | None, window: int = LINES, surge: int = SURGE) -> str:
    """The text of the article, its blocks joined by blanks; empty if there is none."""
    found = lines(page or "")
    may = shown(found, window, surge)
    length = lengths(found, may)
    between, least = spans(length, window, surge)
    sections, after = [x.section for x in found], 0
    for i in range(len(found) - 1, -1, -1):  # a heading belongs to the text that follows it
        if length[i]:
            sections[i] = after if found[i].heading and not found[i].article and after else sections[i]
            after = sections[i]
    full: dict[int, int] = defaultdict(int)
    size: dict[int, int] = defaultdict(int)
    for s, n, b in zip(sections, length, between):
        full[s] += n if b else 0
        size[s] += n > 0
    most = max(full.values(), default=0)
    kept = {s for s, n in full.items() if n >= least and (s < 0 or size[s] > 1 or n >= LONELY * most)}
    return " ".join(x.text for x, s, m in zip(found, sections, may) if m and s in kept)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages; text is the whole article, n_chars its code points.

    A null or empty page, and one that has no article text, gives an empty text. Tags may be open, cut off or badly nested, and
    time grows with a page's length however deep its elements lie. Repeated rows and null ids or urls stay; other columns are
    left out; no rows give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html_col).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
