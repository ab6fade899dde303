"""Main text of web pages: text-to-tag ratios of lines, smoothed and thresholded.

The standard library's parser streams a page as events. A line is the text of one block of the page. Its ratio is its
characters by the tags met in it, 0 inside elements that are never content (menus, page headers and footers, sidebars, forms,
adverts, notices, reader comments). The ratios are smoothed by a Gaussian, so that a short line among long ones counts as its
neighbours do. Lines over the threshold, a share of the standard deviation, form clusters. What is returned is the container
that holds the heaviest clusters: all its lines but those that are never content. An element around the page is content, whatever
its class says.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.common import documents, slices, text_bytes

SIGMA = 1.5
#: Content is what lies above this share of the standard deviation of the smoothed ratios.
THRESHOLD = 0.5

#: Elements whose end or start ends a line.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that hold no article text, whatever their attributes.
NEVER = frozenset("aside dialog fieldset footer head menu nav".split())
#: Such elements inside a line: what they hold is left out, the line around them goes on.
SKIPPED = frozenset("button datalist iframe noscript object option select svg template textarea".split())
#: Elements whose text the parser gives out as data, but which is none.
RAW = frozenset(["script", "style"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(["article", "main"])
#: Elements that no class, id or role marks.
PAGE = MAIN | {"html", "body"}
#: Elements that are text or lists of it, no containers of an article.
PIECES = frozenset("address blockquote caption dd details dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr legend li ol p pre summary ul".split())
#: Text and headings, which no class or id marks.
TEXTS = frozenset("blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 legend p pre summary".split())
#: A class, id or role marks an element that is never content, unless it is around the page, if all its words are of these two lists
#: and one is of the first: sidebar, cookie-notice, share-buttons, but not ad-hoc, related-work or has-sidebar.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments complementary consent "
    "contentinfo cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice overlay pagination "
    "popup promo promoted recommended related replies respond search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe toolbar widget".split()
)
NEUTRAL = frozenset(
    "area articles bar block bottom box buttons content container form global group icons inner item items left link links list main media "
    "message outer panel posts primary right row secondary section site slot sticky stories thread top unit wrap wrapper".split()
)
#: Of these, what may be longer than the article.
COMMENTS = frozenset("comment comments disqus replies respond".split())
_WORD = re.compile(r"[a-z]+")


@dataclass
class Line:
    """The text of a block, the tags met in it, whether it can be content, and the innermost container around it."""

    text: str
    tags: int
    content: bool
    owner: int | None


@dataclass
class Element:
    """A tracked element: its name, the words of MARKS that mark it (a form is marked by its name), the place of the one around it,
    whether NEVER, a main heading or `main`, or MAIN is around or itself, and what its lines hold in all: characters, those of list
    items, lines with a main heading or in `main`, lines in MAIN."""

    tag: str
    marks: frozenset[str]
    parent: int | None
    never: bool = False
    head: bool = False
    main: bool = False
    held: int = 0
    items: int = 0
    heads: int = 0
    mains: int = 0


class Lines(HTMLParser):
    """Turns parser events into lines. Only block elements are tracked; an end tag without its start is passed over.

    An element has a larger number than the one around it, so that sums go up and flags go down in one pass, however deep a page is.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.text: list[str] = []
        self.tags = 0
        self.elements: list[Element] = []
        self.open: list[tuple[str, int, int]] = []  # (name, place in elements, skipped elements open then)
        self.named: Counter[str] = Counter()  # open elements by name
        self.main: set[int] = set()
        self.raw = 0
        self.skipped: list[str] = []

    def _end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text.clear()
        if text:
            self.lines.append(Line(text, max(1, self.tags), True, self.open[-1][1] if self.open else None))
            self.tags = 0

    def _close(self, at: int) -> None:
        """Ends the open elements from a place on; what is skipped and was not closed in a block ends with it."""
        if at == len(self.open):
            return
        for name in [*(name for name, *_ in self.open[at:]), *self.skipped[self.open[at][2] :]]:
            self.named[name] -= 1
        del self.skipped[self.open[at][2] :]
        del self.open[at:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in RAW:
            self.raw += 1
            return
        if tag == "br":
            self.text.append(" ")
            return
        if tag in SKIPPED:
            self.skipped.append(tag)
            self.named[tag] += 1
            return
        if tag not in BLOCKS or tag in VOID:
            return
        self._end_line()
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th") and self.open and self.open[-1][0] == tag:
            self._close(len(self.open) - 1)  # these end where the next one starts
        if tag == "body":
            self._close(0)
            while self.skipped:
                self.named[self.skipped.pop()] -= 1
        parent = self.open[-1][1] if self.open else None
        around = self.elements[parent] if parent is not None else Element("", frozenset(), None)
        marks = _marks(tag, attrs, around.main)
        self.elements.append(Element(tag, marks, parent, around.never or tag in NEVER, around.head or tag in ("h1", "main"), around.main or tag in MAIN))
        self.open.append((tag, len(self.elements) - 1, len(self.skipped)))
        self.named[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in RAW:
            self.raw = 0
        elif tag in SKIPPED:
            while self.named[tag]:
                name = self.skipped.pop()
                self.named[name] -= 1
                if name == tag:
                    break
        elif self.named[tag]:
            at = len(self.open) - 1
            while self.open[at][0] != tag:
                at -= 1
            self._end_line()
            self._close(at)
        elif tag in BLOCKS:
            self._end_line()

    def handle_data(self, data: str) -> None:
        if not self.raw and not self.skipped:
            self.text.append(data)

    def finish(self) -> list[Line]:
        self.close()
        self._end_line()
        self._judge()
        return self.lines

    def _judge(self) -> None:
        """Says which lines can be content, and which containers of the article are met."""
        page = self._count()
        dropped: set[int | None] = set()
        outer: dict[int | None, int] = {}  # the outermost of MAIN around an element or itself
        inner: set[int | None] = set()  # what is inside an element of `main`
        for number, element in enumerate(self.elements):
            if element.parent in self.main or element.parent in inner:
                inner.add(number)
            if (
                element.parent in dropped or element.tag in NEVER or element.tag == "header" and number not in inner
                or element.marks and not _around_page(element, self.elements[outer[element.parent]] if element.parent in outer else None, page)
            ):
                dropped.add(number)
            elif element.tag in MAIN:
                self.main.add(number)
            if element.parent in outer or element.tag in MAIN:
                outer[number] = outer.get(element.parent, number)
        for line in self.lines:
            line.content = line.owner not in dropped

    def _count(self) -> Element:
        """Counts what the elements hold, and returns the page's counts. What is never content does not count, nor do comments in
        what is around them."""
        page = Element("", frozenset(), None)
        for line in self.lines:
            x = page if line.owner is None else self.elements[line.owner]
            if not x.never:
                x.held += len(line.text)
                x.items += len(line.text) if x.tag in ("li", "dt", "dd") else 0
                x.heads += x.head
                x.mains += x.main
        for x in reversed(self.elements):
            if x.marks.isdisjoint(COMMENTS):
                around = page if x.parent is None else self.elements[x.parent]
                around.held += x.held
                around.items += x.items
                around.heads += x.heads
                around.mains += x.mains
        return page


def _around_page(element: Element, main: Element | None, page: Element) -> bool:
    """If a marked element is around the page's article: it holds most of the text and the only main heading, or nearly all text, not in
    lists. `main` is around the element. Comments may hold most of the text, and have articles, without being the page's."""
    comments = not element.marks.isdisjoint(COMMENTS)
    whole, own = (page.held + element.held, 0) if comments else (page.held, 1)
    if 2 * element.held <= whole or page.mains > (main.mains if main else own * element.mains):
        return False
    if page.heads <= own * element.heads and (element.heads or own and element.mains):
        return True
    return not comments and 2 * element.items < element.held and 5 * element.held >= 4 * whole


def _marks(tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> frozenset[str]:
    """The words of MARKS in class, id or role, or the name of a form. Inside an article an id is often a heading made into a name:
    there it has to be of two words or about comments."""
    if tag in PAGE or tag in TEXTS:
        return frozenset()
    found = {"form"} if tag == "form" else set()
    for name, value in attrs:
        if name in ("class", "id", "role") and value:
            for words in map(_WORD.findall, value.lower().split()):
                own = MARKS.intersection(words)
                if own and all(w in MARKS or w in NEUTRAL or len(w) == 1 for w in words):
                    if name != "id" or not inside or len(words) > 1 or own & COMMENTS:
                        found |= own
    return frozenset(found)


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Ratios smoothed by a Gaussian cut at three deviations; beyond the ends the kernel's rest is left out."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = np.convolve(ratios, kernel)[reach : reach + len(ratios)]
    return full / np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]


def content_lines(lines: list[Line], elements: list[Element], main: set[int], sigma: float = SIGMA, threshold: float = THRESHOLD) -> list[Line]:
    """The lines of the content regions, in page order. `main` are the containers of an article."""
    if not lines:
        return []
    ratios = np.array([len(x.text) / x.tags if x.content else 0.0 for x in lines])
    level = smoothed(ratios, sigma)
    chosen = np.flatnonzero((level >= threshold * level.std()) & np.array([x.content for x in lines]))
    if not len(chosen):
        return []
    weight = [0] * len(elements)
    for at in chosen:
        if lines[at].owner is not None:
            weight[lines[at].owner] += len(lines[at].text)
    for number in range(len(elements) - 1, -1, -1):
        if elements[number].parent is not None:
            weight[elements[number].parent] += weight[number]
    marked = [n for n in main if weight[n]]
    if marked:
        heaviest = max(marked, key=lambda n: (weight[n], -n))
        # A page may have its text in several articles beside each other; teasers are much shorter.
        within = _within(elements, {n for n in marked if weight[n] >= 0.2 * weight[heaviest]})
        return [x for x in lines if x.content and x.owner is not None and within[x.owner]]
    # Without a marked container: the innermost one that holds most of the chosen text, else the page.
    whole = sum(len(lines[at].text) for at in chosen)
    home = max((n for n, w in enumerate(weight) if w and w >= 0.75 * whole and elements[n].tag not in PIECES), default=None)
    if home is None:
        return [x for x in lines if x.content]
    within, picked = _within(elements, {home}), set(chosen.tolist())
    return [x for i, x in enumerate(lines) if x.content and (i in picked or x.owner is not None and within[x.owner])]


def _within(elements: list[Element], homes: set[int]) -> list[bool]:
    """Which elements are among the homes or inside one."""
    out: list[bool] = []
    for number, element in enumerate(elements):
        out.append(number in homes or element.parent is not None and out[element.parent])
    return out


_OPEN_TAG = re.compile(r"<[A-Za-z/!][^<>]*\Z")


def main_text(html: str, sigma: float = SIGMA, threshold: float = THRESHOLD) -> str:
    """The article of a page, a line per block; empty if there is none. A tag cut off by the end of the page is no text."""
    parser = Lines()
    parser.feed(_OPEN_TAG.sub("", html))
    lines = parser.finish()
    return "\n".join(x.text for x in content_lines(lines, parser.elements, parser.main, sigma, threshold))


def extract(frame: DataFrame, html_column: str = "html", keep: tuple[str, ...] = ("page_id", "url"), sigma: float = SIGMA,
            threshold: float = THRESHOLD) -> DataFrame:
    """The kept columns and `text`, the main text of each whole page.

    A null, empty or text-free page gives the empty text. Repeated rows are kept. Other columns are ignored; a kept column may
    not be called text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256, len(keep)):
            texts = [main_text(h.decode(errors="replace"), sigma, threshold) for h in text_bytes(batch.column(len(keep)))]
            yield pa.record_batch([*batch.columns[: len(keep)], pa.array(texts, pa.string())], [*keep, "text"])

    source = documents(frame, *keep, html_column)
    shape = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[: len(keep)]] + ["text string"])
    return source.mapInArrow(run, shape)


def report(frame: DataFrame) -> DataFrame:
    """Every page with its main text and the text's number of code points."""
    return extract(frame).withColumn("n_chars", F.length("text").cast("long"))
