"""Main text of web pages by text-to-tag ratio.

The standard library's HTML parser streams events; text between block boundaries is a line, with the number of tags met in
it. A line's ratio of text to tags is smoothed with a Gaussian over its neighbours, two clusters of the smoothed ratios
give the threshold, and lines above it are content. Content lines vote, with the text that isn't links, for the elements
they stand in, and the votes choose the region: the page's article (or main) elements, if these hold at least half of all
votes, else the innermost element with four fifths of them, from its first to its last content line and on to both sides
until a line of links. Structure is a prior only: elements that are seldom part of an article (navigation, notices,
adverts, comments and the like, by tag, role, class or id) don't vote, and inside the region they are left out. An element
that encloses the region is never left out, whatever it is called.

Every line of the chosen region stays, in page order, also short ones. Several articles stay all, except those that are
mostly links.

Edge cases: null or empty html, and pages without text, give ''. An element that is cut off at the end of the page counts
as closed; a tag or comment that is cut off is dropped. Elements may be nested to any depth. Where nothing votes but forms
and the like, they do, if they have 200 characters of content. Repeated rows are each extracted. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_memory, slices, small_batches

BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without text of the page.
SILENT = frozenset("audio button canvas datalist embed head iframe math noframes noscript object option script select style svg template textarea title video".split())
CONTAINERS = frozenset("article main section div body td blockquote figure details fieldset".split())
#: Elements within a line; where they are marked, their text is left out of it.
PHRASES = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var".split())
#: Elements that aren't the article's, unless an article or main begins inside them.
APART = frozenset("form header menu".split())
#: Elements whose articles, if there are any, are other texts.
OTHER = frozenset("aside dialog footer nav".split())
#: Words of a class or id, and roles, that mark the same.
APART_WORDS = frozenset("ad ads adv advert advertisement advertising adsbygoogle alert banner breadcrumb breadcrumbs consent cookie cookies copyright disclaimer dropdown footer gdpr login masthead menu modal nav navbar navigation newsletter notice notification pager pagination paywall popup promo promotion search share sharing sidebar sidenav signup skip social sponsor sponsored subscribe toc toolbar widget".split())
OTHER_WORDS = frozenset("comment comments disqus recommended related reply replies respond teaser teasers".split())
APART_ROLES = frozenset("alert banner form menu menubar search toolbar".split())
OTHER_ROLES = frozenset("complementary contentinfo dialog navigation".split())
#: A name with one of these words tells about a neighbour (has-sidebar, page-with-toc).
ABOUT = frozenset("has have with without no layout".split())
_SPLIT = re.compile(r"[^a-z0-9]+")
_CUT_TAG = re.compile(r"<[a-zA-Z/!?][^<>]*$")


@dataclass
class Line:
    text: str
    tags: int
    links: int
    node: int


def _mark(tag: str, attrs: list[tuple[str, str | None]]) -> int:
    """0: may be the article's. 1: isn't, unless an article begins inside. 2: isn't."""
    mark = 2 if tag in OTHER else 1 if tag in APART else 0
    for name, value in attrs:
        if name == "hidden":
            mark = max(mark, 1)
        if not value:
            continue
        if name in ("class", "id"):
            for own in value.lower().split():
                words = _SPLIT.split(own)
                if not OTHER_WORDS.isdisjoint(words):
                    found = 2
                elif not APART_WORDS.isdisjoint(words):
                    found = 1
                else:
                    continue
                if ABOUT.isdisjoint(words):
                    mark = max(mark, found)
        elif name == "role":
            role = value.strip().lower()
            mark = max(mark, 2 if role in OTHER_ROLES else 1 if role in APART_ROLES else 0)
        elif name == "aria-hidden" and value == "true":
            mark = max(mark, 1)
    return mark


class LineParser(HTMLParser):
    """Turns events into lines. Containers and marked elements are nodes; each node knows the one around it (an earlier
    number), and each line its innermost."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.tags, self.parents, self.marks = [""], [0], [0]
        self.open: list[tuple[str, int, bool]] = []  # tag, node around its content, silent
        self.at: dict[str, list[int]] = {}  # places of a tag in `open`
        self.node = self.silent = self.linked = 0
        self.parts: list[str] = []
        self.met = self.links = 0

    def _end_line(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append(Line(text, max(1, self.met), self.links, self.node))
            self.parts = []
        self.met = self.links = 0

    def _pop(self, down_to: int) -> None:
        while len(self.open) > down_to:
            tag, _, silent = self.open.pop()
            self.at[tag].pop()
            self.silent -= silent
            self.linked -= tag == "a"
        node = self.open[-1][1] if self.open else 0
        if node != self.node:
            self._end_line()
            self.node = node

    def _last(self, tags) -> int:
        """Place of the innermost open element of these tags, -1 if there is none."""
        return max((p[-1] for t in tags if (p := self.at.get(t))), default=-1)

    def _close(self, tags: tuple[str, ...], within=()) -> None:
        """Closes the innermost of these tags, unless one of `within` is open inside it."""
        found = self._last(tags)
        if found >= 0 and found > self._last(within):
            self._pop(found)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._end_line()
        if tag in VOID:
            self.met += 1
            return
        if tag in ("article", "main") and (outer := min((p[0] for t in ("nav", "header", "head", "menu") if (p := self.at.get(t))), default=-1)) >= 0:
            # An article doesn't begin inside navigation or a page header that was left open.
            self._pop(outer)
        if tag in ("article", "main") and self.silent:
            self._pop(next((i for i, (t, _, silent) in enumerate(self.open) if silent and t in PHRASES), len(self.open)))
        if tag in BLOCKS and tag != "br":
            self._close(("p",), _P_SCOPE)
        if tag == "li":
            self._close(("li",), ("ul", "ol", "menu", "dir"))
        elif tag in ("td", "th"):
            self._close(("td", "th"), ("table",))
        elif tag == "tr":
            self._close(("tr",), ("table",))
        elif tag in ("dt", "dd"):
            self._close(("dt", "dd"), ("dl",))
        elif tag == "body":
            self._close(("head",))
        mark = 0 if tag in ("html", "body") or tag == "header" and self._last(("article", "main")) >= 0 else _mark(tag, attrs) if attrs or tag in APART or tag in OTHER else 0
        phrase = tag in PHRASES
        if mark and not phrase and tag not in BLOCKS:
            self._end_line()
        self.met += 1
        if mark and not phrase or tag in CONTAINERS:
            self.tags.append(tag)
            self.parents.append(self.node)
            self.marks.append(mark)
            self.node = len(self.tags) - 1
        silent = tag in SILENT or bool(mark and phrase)
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, self.node, silent))
        self.silent += silent
        self.linked += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._end_line()
        self._close((tag,), () if tag in _FAR else CONTAINERS)
        self.met += 1

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)
            if self.linked:
                self.links += len(data)

    def close(self) -> None:
        super().close()
        self._end_line()


_P_SCOPE = CONTAINERS | {"table", "li", "caption", "button"}
_FAR = CONTAINERS | SILENT | APART | OTHER


def parse_lines(html: str) -> LineParser:
    parser = LineParser()
    if (at := html.rfind("<!--")) > html.rfind("-->") and html.rfind("</script", at) < 0:
        html = html[:at]
    html = _CUT_TAG.sub("", html)
    for i in range(0, len(html), 1 << 16):
        parser.feed(html[i : i + (1 << 16)])
    parser.close()
    return parser


def smoothed(values: list[float], sigma: float = 1.0) -> list[float]:
    """Gaussian-weighted mean of the neighbours within 2 sigma."""
    reach = math.ceil(2 * sigma)
    weights = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - reach), min(len(values), i + reach + 1)
        own = weights[lo - i + reach : hi - i + reach]
        out.append(sum(w * v for w, v in zip(own, values[lo:hi], strict=True)) / sum(own))
    return out


def threshold(values: list[float]) -> float:
    """Middle between the centres of two clusters (k-means in one dimension, from the extremes)."""
    low, high = min(values), max(values)
    for _ in range(50):
        middle = (low + high) / 2
        a, b = [v for v in values if v <= middle], [v for v in values if v > middle]
        if not a or not b:
            return low
        new = (sum(a) / len(a), sum(b) / len(b))
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def _inherit(page: LineParser) -> list[int]:
    """The mark that holds inside each node: the highest around it, where an article or main ends those of 1."""
    held = [0]
    for n in range(1, len(page.tags)):
        outer = held[page.parents[n]]
        held.append(max(page.marks[n], 0 if outer == 1 and page.tags[n] in ("article", "main") else outer))
    return held


def _votes(page: LineParser, lines: list[Line]) -> list[int]:
    """Text of these lines, without links, in each node and those inside it."""
    votes = [0] * len(page.tags)
    for x in lines:
        votes[x.node] += max(0, len(x.text) - x.links)
    for n in range(len(votes) - 1, 0, -1):
        votes[page.parents[n]] += votes[n]
    return votes


def _inside(page: LineParser, region: set[int]) -> list[bool]:
    """For each node, whether it is in the region, and in no marked element inside it."""
    held = [0 in region]
    for n in range(1, len(page.tags)):
        held.append(n in region or held[page.parents[n]] and not page.marks[n])
    return held


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = parse_lines(html)
    lines = page.lines
    if not lines:
        return ""
    smooth = smoothed([len(x.text) / x.tags for x in lines])
    edge = threshold(smooth)
    held = _inherit(page)
    content = [x for x, s in zip(lines, smooth, strict=True) if s >= edge and not held[x.node]]
    if not any(len(x.text) > x.links for x in content):
        content = [x for x in lines if not held[x.node]]
    votes = _votes(page, content)
    if not votes[0]:
        content = [x for x, s in zip(lines, smooth, strict=True) if s >= edge and held[x.node] < 2]
        votes = _votes(page, content)
        if votes[0] < 200:
            return ""
    for kind in ("article", "main"):
        region = _elements(page, kind, held, votes)
        if region and 2 * sum(votes[n] for n in region) >= votes[0]:
            inside = _inside(page, region)
            return " ".join([x.text for x in lines if inside[x.node]])
    # The innermost element with four fifths of the votes.
    inner = max(n for n in range(len(votes)) if 5 * votes[n] >= 4 * votes[0])
    inside = _inside(page, {inner})
    region = [x for x in lines if inside[x.node]]
    chosen = {id(x) for x in content}
    hits = [i for i, x in enumerate(region) if id(x) in chosen and 2 * x.links <= len(x.text)]
    first, last = (hits[0], hits[-1]) if hits else (0, len(region) - 1)
    while first and 2 * region[first - 1].links < len(region[first - 1].text):
        first -= 1
    while last + 1 < len(region) and 2 * region[last + 1].links < len(region[last + 1].text):
        last += 1
    return " ".join([x.text for x in region[first : last + 1] if 2 * x.links <= len(x.text)])


def _elements(page: LineParser, kind: str, held: list[int], votes: list[int]) -> set[int]:
    """The page's outermost elements of a kind that aren't marked and have votes, or at least more text than links."""
    nodes = [n for n in range(1, len(page.tags)) if page.tags[n] == kind and not held[n]]
    if not nodes:
        return set()
    text, links = [0] * len(page.tags), [0] * len(page.tags)
    for x in page.lines:
        text[x.node] += len(x.text)
        links[x.node] += x.links
    around = [False] * len(page.tags)
    own = set(nodes)
    for n in range(len(text) - 1, 0, -1):
        text[page.parents[n]] += text[n]
        links[page.parents[n]] += links[n]
    for n in range(1, len(around)):
        around[n] = around[page.parents[n]] or page.parents[n] in own
    return {n for n in nodes if not around[n] and (votes[n] or 2 * links[n] <= text[n])}


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_memory("pages")
        for batch in batches:
            for part in slices(batch, "html", 500, 8 << 20):
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    small_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
