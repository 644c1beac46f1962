"""Main text of web pages by line-block distribution.

Markup is stripped to lines: each block element and line break ends a line, inline markup vanishes, and elements that
cannot hold main text (scripts, styles, menus, headers, footers, sidebars, forms) are shut out.  Each other line has a density: its length,
``BONUS`` more inside the article that a page marks, and ``OUTSIDE`` of its length outside of it.  On a page that marks no article
the text of links doesn't count, and a line that is mostly links, or whose surroundings a class, id or role value marks as other than main text
(adverts, notices, comments of readers), is faint: it has ``OUTSIDE`` of its density.  A line block is the sum of the densities of
``BLOCK`` lines.  A surge point is where a block exceeds a threshold that adapts to the page and its first line half of it; a
dive point is the next line that is shut out or faint, or where a block falls back (to ``LEAST`` where an article is marked, else to
nothing).  The main text lies from the dive point before the first surge point to the one after the last; what interrupts it is
left out alone.

Inside an article only a whole word of a class or role value marks an advert, a share list, or comments; ids, and words joined by hyphens,
are names that headings get, and shut nothing out.  Marks around an article count only if another article is left.

A null page and a page without text give an empty string.  Broken and cut-off markup is read to its end in linear time, very long
pages are read whole.  Repeated rows are extracted alike; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK = 3
LEAST = 40  #: threshold of a block's density
BONUS, OUTSIDE = 50, 0.02
#: Attributes: a quote begins a value only after its sign, and a value that is not closed runs to the end of the page.
_ATTRS = r"(?:=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))|[^>])*+"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    rf"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg|math|select|object|head)\b{_ATTRS}>.*?(?:</(?P=raw)\s*+>|\Z)"
    rf"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>{_ATTRS})(?:>|\Z)",
    re.S | re.I,
)
#: Fixed lists of element names.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER = frozenset("nav footer aside form button menu dialog header".split())
#: Elements in which a paragraph or list item of an outer element doesn't end.
HOLDERS = frozenset("ul ol table div article section main body".split())
ITEMS = frozenset("p li dt dd tr td th option".split())
#: Fixed word list: class, id and role values, or parts of them, that mark other than main text.
WORDS = "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies disqus footer form header login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related replies respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
MARKS = re.compile(rf"(?:^|[\s_-])(?:{'|'.join(WORDS)})(?:$|[\s_-])", re.I)
#: Of these, whole words count inside an article, but for those of its own head and those that name its subject.
INSIDE = frozenset(WORDS) - frozenset("banner header masthead form search login social".split())
VALUES = re.compile(r"(?:^|\s)(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+))", re.I)
SPACES = re.compile(r"\s+")


class Line(NamedTuple):
    text: str
    links: int  #: characters of links
    shut: bool  #: by an element, or inside an article by a class
    marked: bool  #: as article
    faint: bool  #: by values of elements around it, none of them inside an article


def marks(attrs: str, inside: bool) -> bool:
    """Whether class, id and role values mark other than main text."""
    found = [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in VALUES.finditer(attrs)]
    if inside:
        return any(name in ("class", "role") and not INSIDE.isdisjoint(value.lower().split()) for name, value in found)
    return any(MARKS.search(value) for _, value in found)


def lines_of(page: str) -> list[Line]:
    out: list[Line] = []
    text: list[str] = []
    # element, whether it shuts text out, is an article, makes it faint; and the place of the last holder up to it
    stack: list[tuple[str, bool, bool, bool, int]] = []
    places: dict[str, list[int]] = defaultdict(list)
    shut = marked = faint = links = 0

    def end() -> None:
        nonlocal links
        line = SPACES.sub(" ", html.unescape("".join(text))).strip()
        text.clear()
        if line:
            out.append(Line(line, links, shut > 0, marked > 0, faint > 0))
        links = 0

    def drop(upto: int) -> None:
        nonlocal shut, marked, faint
        for tag, out_, art, dim, _ in reversed(stack[upto:]):
            places[tag].pop()
            shut -= out_
            marked -= art
            faint -= dim
        del stack[upto:]

    at = 0
    for m in TOKEN.finditer(page):
        piece = page[at : m.start()] if m["cdata"] is None else page[at : m.start()] + m["cdata"]
        at = m.end()
        text.append(piece)
        if places["a"]:
            links += len(piece)
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag in BLOCKS:
            end()
        if m["close"]:
            if places[tag]:
                drop(places[tag][-1])
            continue
        if tag in VOID or m["attrs"].endswith("/"):
            continue
        holder = stack[-1][4] if stack else -1
        if tag in ITEMS and places[tag] and places[tag][-1] > holder:  # an open one of the kind ends here
            drop(places[tag][-1])
        if tag == "a" and places[tag]:
            drop(places[tag][-1])
        art = tag in ("article", "main")
        named = bool(m["attrs"]) and tag not in ("html", "body", "article", "main") and marks(m["attrs"], marked > 0)
        out_ = tag in BOILER and not (tag == "header" and marked) or named and marked > 0
        holder = len(stack) if tag in HOLDERS else stack[-1][4] if stack else -1
        places[tag].append(len(stack))
        stack.append((tag, out_, art, named and not marked, holder))
        shut += out_
        marked += art
        faint += stack[-1][3]
    text.append(page[at:])
    end()
    return out


def _blocks(density: np.ndarray) -> np.ndarray:
    """The sum of the densities of the lines from each line on."""
    return np.convolve(density, np.ones(BLOCK))[BLOCK - 1 :]


def main_lines(density: np.ndarray, run: np.ndarray, low: float) -> np.ndarray:
    """Numbers of the lines of the main text; run: a number that changes where lines were shut out."""
    block = _blocks(density)
    surge = np.flatnonzero((block > min(LEAST, block.max() - 1)) & (density > min(LEAST // 2, density.max() - 1)))
    if not len(surge):
        return surge
    dive = block <= low
    rise = _blocks(density[::-1])[::-1] <= low
    first, last = int(surge[0]), int(surge[-1])
    while first and run[first - 1] == run[first] and not rise[first - 1]:
        first -= 1
    while last + 1 < len(run) and run[last + 1] == run[last] and not dive[last + 1]:
        last += 1
    inside = np.arange(first, last + 1)
    return inside[density[inside] > low]


def main_text(page: str | None) -> str:
    """The lines of the main text, joined by line feeds."""
    lines = lines_of(page or "")
    shut, marked, faint = (np.array([getattr(line, k) for line in lines], bool) for k in ("shut", "marked", "faint"))
    size = np.array([len(line.text) for line in lines], float)
    article = marked & ~shut
    if article.any():
        if (article & ~faint).any():  # the page has an article that nothing around it marks
            shut |= faint
        barred = shut
        density = np.where(marked, size + BONUS, size * OUTSIDE)
        low = LEAST
    else:
        links = np.array([line.links for line in lines], float)
        faint |= links > 2 / 3 * size
        barred = shut | faint
        density = np.maximum(size - links, 0) * np.where(faint, OUTSIDE, 1.0)
        barred &= shut | (density <= LEAST)
        low = 0
    open_ = np.flatnonzero(~barred)
    if not len(open_):
        return ""
    run = np.cumsum(barred)[open_]
    return "\n".join(lines[k].text for k in open_[main_lines(density[open_], run, low)])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")
