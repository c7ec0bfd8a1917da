"""Main text of web pages by text-to-tag ratios.

The standard library's streaming HTML parser turns a page into lines: a line
is the text of one block (paragraph, heading, list item, cell, ...) with the
number of tags inside and around it. Elements that never hold article text
(scripts, styles, navigation, forms, asides, ...) and elements whose class, id
or role names such a part (adverts, notices, menus, comments, ...) give lines
that are marked as boilerplate. On pages without an ``article`` or ``main`` a
name marks nothing that holds most of the text: there it speaks of a wrapper.

Each line's ratio of text length to tags is smoothed with a Gaussian over its
neighbours. A threshold between two clusters of the smoothed ratios (one
dimensional two-means) parts content lines from the rest. The content region
is the innermost ``article`` or ``main`` that holds the bulk of the content
lines' text, else the smallest container that holds all content lines. All
lines of the region that are not marked are the main text: so short paragraphs
beside long ones stay, and blocks outside an article go however long they are.
Beside a region that is no article, unmarked ``h1`` titles stay too.

Text: character references decoded, white space inside a block is one blank,
blocks trimmed and joined in page order by one line feed. Nothing is capped.

Defined results: a null or empty page, and a page without text, gives an empty
text; unclosed and stray tags are closed or skipped as browsers do; repeated
rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import workers_ready

SIGMA = 1.0
BULK = 0.6
MOST, MOST_REPLIES = 0.5, 0.9                 # of the text; readers' replies may well outgrow a text

# Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is never shown as text.
HIDDEN = frozenset(("script style template noscript head title textarea select option datalist svg math canvas "
                    "object iframe audio video map").split())
# Elements that hold boilerplate wherever they stand.
BOILERPLATE = frozenset("nav footer aside form menu dialog button fieldset search".split())
# Elements that begin a line of their own.
BLOCKS = frozenset(("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
                    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol "
                    "p pre search section summary table tbody td tfoot th thead tr ul").split())
# Elements that a content region may be.
CONTAINERS = frozenset("article blockquote body div main section table tbody td tr html center root".split())
# Words in class, id or role that name boilerplate.
NAMES = frozenset((
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie "
    "cookies consent gdpr notice notices alert popup modal overlay sidebar aside menu menus nav navbar navigation "
    "navigational breadcrumb breadcrumbs header masthead footer contentinfo complementary comment comments respond "
    "replies reply disqus share sharing social related recommended newsletter subscribe subscription signup login "
    "search toolbar pagination pager skip widget widgets disclaimer copyright").split())
REPLIES = frozenset("comment comments respond replies reply disqus".split())
# A name after one of these tells what else there is, not what the element is.
HAVING = frozenset("has with without no".split())
KEEPERS = frozenset(("article", "main", "body", "html"))
# An open element of the first kind is closed by a start tag of the second.
CLOSES = {
    "p": BLOCKS, "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")),
    "tr": frozenset(("tr", "tbody", "tfoot")), "td": frozenset(("td", "th", "tr", "tbody", "tfoot")),
    "th": frozenset(("td", "th", "tr", "tbody", "tfoot")), "option": frozenset(("option", "optgroup")),
    "h1": frozenset(("h1", "h2", "h3", "h4", "h5", "h6")), "head": frozenset(("body",)),
}
CLOSES |= {f"h{k}": CLOSES["h1"] for k in range(2, 7)}

_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def is_hidden(attrs: list[tuple[str, str | None]]) -> bool:
    return any(key == "hidden" or key == "aria-hidden" and value == "true" for key, value in attrs)


def boilerplate_names(attrs: list[tuple[str, str | None]], in_article: bool = False) -> set[str]:
    """The names of boilerplate in class, id or role; an article has headers of its own."""
    found: set[str] = set()
    for key, value in attrs:
        if value and key in ("class", "id", "role"):
            for name in value.split():
                words = [w.lower() for w in _NAME.findall(name)]
                found.update(w for k, w in enumerate(words) if w in NAMES and not (k and words[k - 1] in HAVING))
    return found - {"header"} if in_article else found


HARD = -1


class Lines(HTMLParser):
    """Collects the lines of a page and the containers they stand in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # Containers by number: parent and element name.
        self.parent, self.kind = [-1], ["root"]
        # Open elements: name, container number, hidden, boilerplate (HARD, the
        # number of the innermost name mark, or 0).
        self.open: list[tuple[str, int, bool, int]] = [("root", 0, False, 0)]
        # Name marks by number: the mark around, and whether it names replies.
        self.around, self.replies = [0], [False]
        self.text: list[str] = []
        self.tags = 0
        self.lines: list[tuple[str, int, int, int]] = []       # text, tags, container, boilerplate
        self.titles: set[int] = set()                         # numbers of the h1 lines
        self.articles, self.seen = 0, False                   # open now; any so far
        self.held: Counter[str] = Counter()                   # open elements by name
        self.walls = 0                                        # open elements that are boilerplate by themselves

    def end_line(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            self.text = []
            if text:
                _, box, _, boiler = self.open[-1]
                if self.held["h1"]:
                    self.titles.add(len(self.lines))
                self.lines.append((text, self.tags, box, boiler))
        self.tags = 0

    def handle_starttag(self, tag, attrs):
        _, box, hidden, boiler = self.open[-1]
        if tag in VOID:
            self.tags += 1
            if tag == "hr":
                self.end_line()
            elif tag in ("br", "wbr") and not hidden:
                self.text.append(" " if tag == "br" else "")
            return
        if tag in BLOCKS or tag in HIDDEN:
            if tag in BLOCKS:
                self.end_line()
            while len(self.open) > 1 and tag in CLOSES.get(self.open[-1][0], ()):
                self.pop()
            # A block inside inline elements closes the paragraph around them.
            if tag in BLOCKS and self.open[-1][0] not in BLOCKS:
                k = len(self.open) - 1
                while k > 0 and self.open[k][0] not in BLOCKS:
                    k -= 1
                if k > 0 and tag in CLOSES.get(self.open[k][0], ()):
                    while len(self.open) > k:
                        self.pop()
            _, box, hidden, boiler = self.open[-1]
        self.tags += 1
        if not hidden:
            hidden = tag in HIDDEN
            if tag in ("article", "main"):
                named = is_hidden(attrs) or boilerplate_names(attrs)
                if named and self.seen:                     # a reader's comment, a related article
                    boiler = HARD
                elif boiler and not self.seen and not self.walls:
                    boiler = 0                              # only a wrapper's name spoke against it
                self.seen = True
            elif boiler != HARD and tag not in KEEPERS:
                if tag in BOILERPLATE or tag == "header" and not self.articles or is_hidden(attrs):
                    boiler = HARD
                elif names := boilerplate_names(attrs, bool(self.articles)):
                    self.around.append(boiler)
                    self.replies.append(bool(names & REPLIES))
                    boiler = len(self.around) - 1
        if tag in CONTAINERS:
            self.parent.append(box)
            self.kind.append("main" if ("role", "main") in attrs or ("itemprop", "articleBody") in attrs else tag)
            box = len(self.parent) - 1
        if tag in ("article", "main"):
            self.articles += 1
        self.held[tag] += 1
        self.walls += tag in BOILERPLATE
        self.open.append((tag, box, hidden, boiler))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def pop(self) -> None:
        tag = self.open[-1][0]
        if tag in BLOCKS:
            self.end_line()
        if tag in ("article", "main"):
            self.articles -= 1
        self.held[tag] -= 1
        self.walls -= tag in BOILERPLATE
        self.open.pop()

    def handle_endtag(self, tag):
        if tag in VOID:
            if tag == "br":
                self.handle_starttag(tag, [])
            return
        self.tags += 1
        if not self.held[tag]:
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                while len(self.open) > k:
                    self.pop()
                return
            # An inline end tag never closes a block around it.
            if tag not in BLOCKS and tag not in HIDDEN and self.open[k][0] in BLOCKS:
                return

    def handle_data(self, data):
        if not self.open[-1][2]:
            self.text.append(data)

    def parse_marked_section(self, i, report=1):
        """``<![...>`` is a comment up to the next ``>``, whatever stands in it."""
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    def finish(self) -> None:
        self.close()
        while len(self.open) > 1:
            self.pop()
        self.end_line()


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; the ends use the neighbours there are."""
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    top = np.convolve(ratios, kernel)[reach:reach + len(ratios)]
    return top / np.convolve(np.ones(len(ratios)), kernel)[reach:reach + len(ratios)]


def threshold(values: np.ndarray) -> float:
    """The border between the two clusters of one-dimensional two-means."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        cut = (low + high) / 2
        below, above = values[values < cut], values[values >= cut]
        if not len(below) or not len(above):
            return cut
        new = float(below.mean()), float(above.mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def rated(page: Lines, marked: list[bool]) -> np.ndarray:
    """Which lines the smoothed ratios rate as content; marked lines never are."""
    ratios = smoothed(np.array([0.0 if b else len(t) / max(1, tags)
                                for (t, tags, _, _), b in zip(page.lines, marked, strict=True)]))
    free = ~np.array(marked)
    content = free & (ratios >= threshold(ratios))
    low, high = ratios[free & ~content], ratios[content]
    # Two means always part; lines of much the same ratio are one cluster.
    return free if len(low) and len(high) and 2 * low.mean() >= high.mean() else content


def marked_lines(page: Lines, in_article: np.ndarray) -> list[bool]:
    """Which lines are boilerplate, by element or by a name that counts."""
    boilers = [b for _, _, _, b in page.lines]
    hard = [b == HARD for b in boilers]
    live = [False] + [True] * (len(page.around) - 1)
    if len(live) > 1 and not all(hard) and not any(
            b == 0 and in_article[box] for _, _, box, b in page.lines):
        held = [0] * len(live)
        for text, _, _, b in page.lines:
            if b != HARD:
                held[b] += len(text)
        free, whole = held[0], sum(held)
        for k in range(len(live) - 1, 0, -1):               # marks come after those around them
            if page.around[k]:
                held[page.around[k]] += held[k]
            live[k] = held[k] <= (MOST_REPLIES if page.replies[k] else MOST) * whole
        if not free and all(live[1:]):                      # all text is named: the largest part counts
            live[max(range(1, len(live)), key=lambda k: (not page.replies[k], held[k]))] = False
    for k in range(1, len(live)):
        live[k] |= page.around[k] > 0 and live[page.around[k]]
    return [h or live[b] for h, b in zip(hard, boilers, strict=True)]


def content_lines(page: Lines) -> list[str]:
    lines, n = page.lines, len(page.parent)
    in_article = np.array([kind in ("article", "main") for kind in page.kind])
    for box in range(1, n):                                 # children come after their parents
        in_article[box] |= in_article[page.parent[box]]
    marked = marked_lines(page, in_article)
    if all(marked):
        return []
    content = rated(page, marked)
    if not content.any():
        content = ~np.array(marked)
    weight, count = np.zeros(n), np.zeros(n, dtype=np.int64)
    for (text, _, box, _), good in zip(lines, content, strict=True):
        if good:
            weight[box] += len(text)
            count[box] += 1
    for box in range(n - 1, 0, -1):
        weight[page.parent[box]] += weight[box]
        count[page.parent[box]] += count[box]
    # The smallest container of all content lines; then articles in it that hold the bulk.
    region = max(box for box in range(n) if count[box] == count[0])
    articles = [box for box in range(n) if page.kind[box] in ("article", "main")]
    size = np.ones(n, dtype=np.int64)                       # containers are numbered as they open, so
    for box in range(n - 1, 0, -1):                         # what one holds follows it without a gap
        size[page.parent[box]] += size[box]
    within = 0
    for box in articles:                                    # from the outside in
        if box < within + size[within] and weight[box] >= BULK * weight[within]:
            within = box
    upto = (within or region) + size[within or region]
    return [t for k, ((t, _, box, _), b) in enumerate(zip(lines, marked, strict=True))
            if ((within or region) <= box < upto or not within and k in page.titles) and not b]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.finish()
    return "\n".join(content_lines(page)) if page.lines else ""


def extract(pages: DataFrame, *, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """The ``keep`` columns with ``text`` and ``n_chars`` (code points) of every page."""
    workers_ready(pages.sparkSession)
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in range(n)), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=[*b.schema.names[:n], "text", "n_chars"])

    types = dict(pages.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "text string", "n_chars bigint"])
    return pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html_col}`").alias("_html")).mapInArrow(run, schema)
