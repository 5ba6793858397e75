"""HTML extraction by line-block distribution.

Markup is stripped to lines, one per block element.  Scripts, styles, forms and
elements that their tag, role or a class or id word by word names as menus, headers,
footers, sidebars, notices, adverts or reader comments leave a line of length 0, so they
stay visible as gaps.  Every line has a weighted length, and lengths are summed over
sliding windows of ``WINDOW`` lines.  Where the sums rise from nothing the text surges,
where they fall to nothing it dives; the lines between are kept, whatever they are, if
some window between them is over the threshold: ``SURGE`` characters, or half the
largest window on small pages.  The rule is the same on all pages.

Weights: text in links counts nothing, nor does a line that is mostly links, so lists of
links end a region but stay inside one.  Text in an element that marks the main text
(``article``, ``main``, ``role=main``, ``itemprop=articleBody``) counts ``MARKED``-fold,
links too; on a page with such marks text outside them weighs 0, as a gap.

Edge cases: null or empty html gives an empty text; unclosed tags and comments run
to where a browser would end them; character references are decoded once; rows are
kept as they come (null or repeated ids too); very long pages and malformed tags take
time in proportion to their length; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import blocks

WINDOW = 3
SURGE = 86
MARKED = 100

# The element names of HTML by role.
_RAW = "script|style|noscript|template|iframe|textarea|svg|canvas|object|select|title|math"
_BOILERPLATE = frozenset("nav footer aside form button dialog menu head label fieldset datalist".split())
_BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_SAME = frozenset("p li dt dd td th tr option".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
#: Words of class names and ids that name such blocks, and words that may stand beside
#: them; a name with any other word ("social-science") names content.
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promos promotion promoted sidebar menu nav navbar navigation footer "
    "cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription share sharing social related "
    "recommended recommendations comment comments commentlist respond reply replies disqus breadcrumb breadcrumbs widget widgets login signin signup search pagination "
    "pager toolbar masthead copyright disclaimer skip teaser teasers".split()
)
_HEADERS = frozenset("header topbar".split())
_BESIDE = frozenset(
    "side bar box block list item items link links section area wrapper wrap container content inner outer panel slot unit group row col column grid button buttons icon icons "
    "post posts article articles story stories form field input site page main global top bottom left right primary secondary fixed sticky thread count title heading body "
    "text js div id the to us me media more you may also like read our and by top1".split()
)

# a "<" outside quotes ends an unfinished tag, so no scan passes the next one
_REST = r"(?>[^<>\"']+|\"[^\"]*\"|'[^']*')*+"
_TOKEN = re.compile(
    rf"<({_RAW})\b{_REST}>.*?(?:</\1\s*>|\Z)"
    r"|<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/<>]*)({_REST})>"
    r"|([^<]+)|(<)",
    re.S | re.I,
)
_ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(raw)}


@lru_cache(maxsize=4096)
def _named(names: str) -> tuple[bool, bool]:
    """Whether a class or id names a block that is no content, and a page header."""
    low = re.sub(r"([a-z])([A-Z])", r"\1-\2", names).lower()
    out = [False, False]
    for name in low.split():
        parts = [x for x in re.split(r"[-_:]+|(?<=[a-z])(?=[0-9])", name) if x and not x.isdigit()]
        for k, core in enumerate((_NAMES, _HEADERS)):
            out[k] = out[k] or (any(x in core for x in parts) and all(x in _NAMES or x in _HEADERS or x in _BESIDE for x in parts))
    return out[0], out[1]


def lines_of(page: str) -> list[tuple[str, int, bool]]:
    """(text, characters in links, in marked main text) of every line; ("", 0, ..)
    stands for a block that is no content."""
    out: list[tuple[str, int, bool]] = []
    stack: list[str] = []
    open_tags: Counter = Counter()
    buffer: list[str] = []
    linked = 0
    # depths at which the outermost skipped, main and link elements stand
    skip = main = link = -1
    gap = False

    def flush() -> None:
        nonlocal linked, gap
        text = " ".join("".join(buffer).split())
        buffer.clear()
        if gap:
            out.append(("", 0, False))
        if text:
            out.append((text, min(linked, len(text)), main >= 0))
        linked, gap = 0, False

    def pop_to(depth: int) -> None:
        nonlocal skip, main, link
        while len(stack) > depth:
            tag = stack.pop()
            open_tags[tag] -= 1
            if tag in _BLOCK_TAGS:
                flush()
            at = len(stack)
            if at == skip:
                skip = -1
            if at == main:
                flush()
                main = -1
            if at == link:
                link = -1

    for m in _TOKEN.finditer(page):
        text = m[5] or m[6]
        if text:
            if skip >= 0:
                gap = gap or not text.isspace()
            else:
                text = html.unescape(text)
                buffer.append(text)
                if link >= 0:
                    linked += len(text.strip())
            continue
        if not m[3]:
            continue
        tag = m[3].lower()
        if m[2]:
            if open_tags[tag]:
                pop_to(next(at for at in range(len(stack) - 1, -1, -1) if stack[at] == tag))
            elif tag in _BLOCK_TAGS:
                flush()
            continue
        if tag in _BLOCK_TAGS:
            if open_tags["p"] or (tag in _CLOSES_SAME and open_tags[tag]):
                for at in range(len(stack) - 1, -1, -1):
                    if stack[at] == "p" or stack[at] == tag and tag in _CLOSES_SAME:
                        pop_to(at)
                        break
                    if stack[at] in _BLOCK_TAGS:
                        break
            flush()
        if tag == "br":
            buffer.append(" ")
        if tag in _VOID or m[4].endswith("/"):
            continue
        if skip < 0:
            attrs = _attributes(m[4]) if m[4] else {}
            named, header = _named(f"{attrs.get('class', '')} {attrs.get('id', '')}")
            role = attrs.get("role", "").lower()
            marks = tag in ("article", "main") or role == "main" or attrs.get("itemprop") == "articleBody"
            if tag not in ("html", "body") and (
                tag in _BOILERPLATE
                or role in _ROLES
                or "hidden" in attrs
                or "display:none" in attrs.get("style", "").replace(" ", "").lower()
                or (named and tag != "main")
                or (main < 0 and not marks and (header or (tag == "header" and stack[-1:] in ([], ["body"], ["html"]))))
            ):
                skip = len(stack)
            elif main < 0 and marks:
                flush()
                main = len(stack)
            if tag == "a" and link < 0:
                link = len(stack)
        stack.append(tag)
        open_tags[tag] += 1
    pop_to(0)
    flush()
    return out


def main_text(page: str | None) -> str:
    """Text between the surge and dive points of the page's lines."""
    if not page:
        return ""
    lines = lines_of(page)
    if any(inside for _, _, inside in lines):
        lines = [(t, 0, MARKED * len(t)) if inside else ("", 0, 0) for t, _, inside in lines]
    else:
        lines = [(t, a, len(t) - a if a * 2 <= len(t) else 0) for t, a, _ in lines]
    mass = [m for _, _, m in lines]
    sums = [sum(mass[i : i + WINDOW]) for i in range(len(mass))]
    threshold = min(SURGE, max(sums, default=0) // 2)
    kept, i = [], 0
    while i < len(sums):
        if not sums[i]:
            i += 1
            continue
        dive = i
        while dive < len(sums) and sums[dive]:
            dive += 1
        if max(sums[i:dive]) > threshold:
            own = [k for k in range(i, dive) if mass[k]]
            kept += [lines[k][0] for k in range(own[0], own[-1] + 1) if lines[k][0]]
        i = dive
    return "\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, html_ in blocks(batches, text_col="html"):
            out = [main_text(h) for h in html_]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    cols = [F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")]
    return pages.select(cols).mapInArrow(run, "page_id long, url string, text string, n_chars long")
