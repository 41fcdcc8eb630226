"""Main text of web pages by text-to-tag ratio.

The standard library's parser streams events; block-level tags end a line, so a line is one block's text
with the number of tags it took and the characters that lie in links. Each line's ratio is its characters outside links per tag;
ratios are smoothed by a Gaussian over neighbouring lines, and two-means clustering of the smoothed
values gives the threshold between content and the rest. A region is what one sectioning element holds (article, main, section,
else the body); a region whose characters lie mostly in content lines is selected with all its lines, so
that short paragraphs stay; an article or main element, where a page has one, is preferred. A section inside an article or main
is judged together with it and by itself, and stays if either holds; one that is mostly links only by itself. On a page without any of these
the content lines choose the smallest container that holds most of their characters at each depth; its lines stay but for lists of links, and the page's h1.

Elements that are no content by what they are (nav, footer, script, form, ...) or by the name they go by (class or id such as ad, menu, cookie,
comment) are left out before that. A compound name counts outside article and main if one of its parts is such a name, inside if it is a class all of whose
parts are; a heading goes only by a class as it stands. An element that holds a main never goes by name, one that holds an article not by a
compound name, unless that is what lists of comments or other pages are called. Of a page without article and main nothing goes by a compound name,
and no form, that has most of the text outside links. A page that loses all its lines is read again without names.

Null, empty and markup-free pages give what text there is: null and empty give an empty text, a page
without tags its whole text as one block. Unclosed, crossed and truncated markup is read as far as it goes, what never ends as text, in time that grows
with the page's length. Bytes that are no UTF-8 are read as U+FFFD. Repeated rows get
equal results; ties of the clustering fall to content. Only the named columns are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import as_bytes, as_text, in_batches, lean, table

# Element names by their role in HTML.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr "
    "html li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
DROPPED = frozenset("aside button canvas datalist dialog footer form head iframe menu nav noscript object script search select style svg template textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
REGION = frozenset("article main section body".split())
# What boilerplate containers are called in class, id or role.
NAMED = frozenset(
    "ad ads advert advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer disqus "
    "footer gdpr header masthead menu modal nav navbar navigation newsletter notice notification pager pagination paywall popup privacy promo promoted promotion related "
    "reply replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget".split()
)
#: Of these, what an article's own title block is called, too.
TITLED = frozenset("header banner masthead".split())
#: Of these, what holds articles that are not the page's own.
OTHERS = frozenset("comment comments commentlist disqus promo promoted promotion related reply replies respond sponsor sponsored".split())
#: Of these, what readers write.
READERS = frozenset("comment comments commentlist disqus reply replies respond".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: p and these end when one of the same kind, or for p any block, begins.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SIGMA = 2.0
#: Readings of one page at most, each of which spares what holds most of the text.
READINGS = 8
#: A box that holds this share of the content around it is descended into.
MAJOR = 0.75
CONTAINERS = frozenset("page html body div center dl fieldset form section table tbody td tr article main figure details".split())


@dataclass
class Line:
    text: str
    tags: int
    link_chars: int
    region: int
    box: int


class _Events(HTMLParser):
    """Turns parser events into lines; `skip` is the depth of the stack at which a dropped element began.

    Elements are counted as they start; those of `spared` do not go by name, none does without `named`. `holders` gets those that went by name though they hold an article or main,
    `lost` the characters outside links that went with an element for a weak reason. Every block element is a box; a line is of the innermost open one.
    What each event costs does not grow with the depth of the stack: `where` has the depths of each open name, `blocks` those of all that end a search, `solid` those of block elements.
    """

    def __init__(self, named: bool = True, spared: frozenset[int] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.named, self.spared, self.holders = named, spared, set()
        self.count, self.why = 0, ""
        self.lines: list[Line] = []
        self.kinds: list[str] = ["page"]
        self.homes: list[int] = [0]
        self.stack: list[tuple[str, int, int]] = []
        self.where: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.solid: list[int] = []
        self.lost: Counter[int] = Counter()
        self.boxes: list[tuple[str, int]] = [("page", -1)]
        self.box = 0
        self.skip: int | None = None
        self.region, self.links, self.tags, self.link_chars = 0, 0, 0, 0
        self.held: list[str] = []

    def flush(self) -> None:
        if self.held:
            text = " ".join("".join(self.held).split())
            if text:
                self.lines.append(Line(text, self.tags, self.link_chars, self.region, self.box))
            self.held.clear()
        self.tags = self.link_chars = 0

    def _pop(self, to: int) -> None:
        """Close what is open above depth `to`."""
        while len(self.stack) > to:
            tag, region, _ = self.stack.pop()
            self.where[tag].pop()
            self.region = region
            self.links -= tag == "a"
            if self.blocks and self.blocks[-1] == len(self.stack):
                self.blocks.pop()
                if tag in BLOCK:
                    self.solid.pop()
                if tag in BLOCK and (self.skip is None or len(self.stack) < self.skip):
                    self.box = self.boxes[self.box][1]
        if self.skip is not None and len(self.stack) <= self.skip:
            self.skip = None

    def _push(self, tag: str) -> None:
        depth = len(self.stack)
        self.stack.append((tag, self.region, self.count))
        self.where.setdefault(tag, []).append(depth)
        self.links += tag == "a"
        if tag in BLOCK or tag in DROPPED or tag in CLOSES:
            self.blocks.append(depth)
            if tag in BLOCK:
                self.solid.append(depth)
            if tag in BLOCK and self.skip is None:
                self.boxes.append((tag, self.box))
                self.box = len(self.boxes) - 1

    def _inside(self) -> bool:
        return bool(self.where.get("article") or self.where.get("main"))

    def _close_before(self, tag: str) -> None:
        names = CLOSES.get(tag, ())
        while self.blocks:
            depth = self.blocks[-1]
            name = self.stack[depth][0]
            if not (name in names or name == "p" and tag in BLOCK):
                return
            self._pop(depth)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        block = tag in BLOCK
        if block:
            if self.skip is None:
                self.flush()
            # inside a dropped element, too: its own end may be an implied one
            self._close_before(tag)
        self.tags += 1
        if tag in VOID:
            if tag == "br" and self.skip is None:
                self.held.append(" ")
            return
        self.count += 1
        if self.skip is None:
            kept = not self.named or self.count in self.spared
            if tag == "form" and not self._inside():
                # some pages stand in one form as a whole
                why = "" if kept else "compound"
            else:
                why = "kind" if tag in DROPPED else _boilerplate(tag, attrs, self._inside(), not kept) if attrs else ""
            if not why and tag == "header" and not self._inside():
                why = "kind"
            if why:
                self.flush()
                self.skip, self.why = len(self.stack), why
        elif tag == "main" and self.why != "kind" or tag == "article" and self.why == "compound":
            for depth in range(len(self.stack) - 1, self.skip - 1, -1):
                if self.stack[depth][2] in self.holders:
                    break
                self.holders.add(self.stack[depth][2])
        self._push(tag)
        if tag in REGION and self.skip is None:
            home = self.homes[self.region]
            self.kinds.append(tag)
            self.homes.append(home if tag == "section" and self.kinds[home] in ("article", "main") else len(self.homes))
            self.region = len(self.kinds) - 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack and self.stack[-1][0] == tag and tag in ("script", "style"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        open_at = self.where.get(tag)
        # the end tag of an inline element ends none outside the innermost block
        if not open_at or tag not in BLOCK and self.solid and open_at[-1] < self.solid[-1]:
            return
        if tag in BLOCK and self.skip is None:
            self.flush()
        self._pop(open_at[-1])

    def handle_data(self, data: str) -> None:
        if self.skip is None:
            self.held.append(data)
            if self.links > 0:
                self.link_chars += len(data)
        elif self.why in ("compound", "others") and not self.links and self.weak():
            self.lost[self.stack[self.skip][2]] += len(data) - data.count(" ")

    def weak(self) -> bool:
        """Whether what is open inside the dropped element is no content by its kind, too."""
        return not any(self.where.get(t) for t in ("script", "style", "select", "option", "noscript", "template"))


def _boilerplate(tag: str, attrs: list[tuple[str, str | None]], inside: bool, named: bool) -> str:
    """Why an element goes by its attributes: "kind" (hidden), "name" (one of NAMED as it stands, or what only readers' texts are called), "compound" (a part of a name), "others" (one that other pages' lists have, too), or "" if it does not."""
    if tag in ("html", "body"):
        return ""
    inside = inside or tag in ("article", "main")
    found = ""
    for key, value in attrs:
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return "kind"
        if named and key in ("class", "id", "role") and value and not (tag in HEADINGS and key == "id"):
            names = re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().split()
            for name in names:
                if name in NAMED and not (inside and name in TITLED):
                    found = "name"
                elif tag not in ("article", "main") and tag not in HEADINGS and not found:
                    parts = {p for p in re.split(r"[^a-z]+", name) if p}
                    counted = parts & (NAMED - TITLED)
                    if counted and (not inside or key == "class" and counted == parts):
                        found = "compound" if parts.isdisjoint(OTHERS) else "others" if parts.isdisjoint(READERS) or len(names) > 1 else "name"
    return found


def smoothed(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines, with the kernel renormalised at the ends."""
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(ratio, kernel, "full")[reach : reach + len(ratio)] / np.convolve(np.ones(len(ratio)), kernel, "full")[reach : reach + len(ratio)]


def two_means(values: np.ndarray) -> float:
    """The threshold midway between the two cluster means."""
    low, high = float(values.min()), float(values.max())
    for _ in range(32):
        cut = (low + high) / 2
        above = values >= cut
        if above.all() or not above.any():
            break
        new = float(values[~above].mean()), float(values[above].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


_SPECIAL = re.compile(r"""(>)|=\s*(["'])""")
_CLOSING = {"script": re.compile(r"</\s*script\s*>", re.I), "style": re.compile(r"</\s*style\s*>", re.I)}
_NAME = re.compile(r"[a-zA-Z][^\t\n\r\f />\x00]*")


def calm(html: str) -> str:
    """`html` with each `<` written as a reference whose tag, comment or declaration never ends; in time that grows with its length.

    The parser would look for the end of each of those through all the rest of the page. A tag ends at the first `>` outside quoted
    values; which quotes and ends follow one another is looked up once for each place, as tags that never end share their ends.
    """
    places = [(m.start(), m.end(), m[2]) for m in _SPECIAL.finditer(html)]
    starts = [p[0] for p in places]
    endless: set[int] = set()
    last_end, comments = html.rfind(">"), [(m.start(), m.end()) for m in re.finditer(r"--\s*>", html)]
    out, done, pos = [], 0, 0
    while (i := html.find("<", pos)) >= 0:
        pos = i + 1
        name = _NAME.match(html, pos)
        if name is not None:
            end, way, k = -1, [], bisect_left(starts, name.end())
            while k < len(places) and k not in endless:
                start, stop, quote = places[k]
                if quote is None:
                    end = stop
                    break
                way.append(k)
                close = html.find(quote, stop)
                if close < 0:
                    break
                k = bisect_left(starts, close + 1)
            if end >= 0:
                pos = end
                closing = _CLOSING.get(name[0].lower())
                if closing is not None:
                    m = closing.search(html, end)
                    pos = m.end() if m else len(html)
                continue
            endless.update(way)
        elif html.startswith("<!--", i):
            k = bisect_left(comments, (i + 4, 0))
            if k < len(comments):
                pos = comments[k][1]
                continue
        elif html[pos : pos + 1] in ("/", "!", "?"):
            if last_end > i:
                continue
        else:
            continue
        out += [html[done:i], "&lt;"]
        done = i + 1
    return "".join([*out, html[done:]]) if out else html


def _read(html: str, named: bool = True, spared: frozenset[int] = frozenset()) -> _Events:
    parser = _Events(named, spared)
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser


def _events(html: str) -> _Events:
    """The page read so that nothing that holds its article, or most of its text, goes by a weak reason."""
    html = calm(html)
    parser = _read(html)
    if parser.holders:
        parser = _read(html, spared=frozenset(parser.holders))
    spared: set[int] = set(parser.spared)
    for _ in range(READINGS):
        of_article = any(parser.kinds[parser.homes[x.region]] in ("article", "main") for x in parser.lines)
        whole = sum(len(x.text) - x.text.count(" ") - x.link_chars for x in parser.lines) + parser.lost.total()
        most = [e for e, n in parser.lost.items() if 2 * n > whole]
        if of_article or not most:
            break
        spared.update(most)
        parser = _read(html, spared=frozenset(spared))
    else:
        return _read(html, named=False)
    return parser if parser.lines else _read(html, named=False)


def _in_container(parser: _Events, content: np.ndarray) -> list[bool]:
    """For a page without sectioning: the lines of the smallest container that holds most of the content, headings of the page, and no lists of links."""
    weight, lines = [0] * len(parser.boxes), [0] * len(parser.boxes)
    for x, c in zip(parser.lines, content.tolist(), strict=True):
        weight[x.box] += c * max(0, len(x.text) - x.link_chars)
        lines[x.box] += 1
    heaviest: dict[int, int] = {}
    for b in range(len(parser.boxes) - 1, 0, -1):  # a box comes after the one around it
        kind, around = parser.boxes[b]
        weight[around] += weight[b]
        lines[around] += lines[b]
        if kind in CONTAINERS and lines[b] > 1 and (around not in heaviest or weight[b] >= weight[heaviest[around]]):
            heaviest[around] = b
    box = 0
    while box in heaviest and weight[heaviest[box]] >= MAJOR * max(1, weight[box]):
        box = heaviest[box]
    within = [False] * len(parser.boxes)
    for b, (_, around) in enumerate(parser.boxes):
        within[b] = b == box or around >= 0 and within[around]
    return [(within[x.box] or parser.boxes[x.box][0] == "h1") and x.link_chars * 2 <= len(x.text) for x in parser.lines]


def main_text(html: str) -> str:
    parser = _events(html)
    lines = parser.lines
    if not lines:
        return ""
    ratio = np.array([max(0, len(x.text) - x.link_chars) / max(1, x.tags) for x in lines])
    smooth = smoothed(ratio)
    content = smooth >= min(two_means(smooth), float(np.median(smooth)) + 1e-9)
    size, in_content, linked = Counter(), Counter(), Counter()
    for x, c in zip(lines, content, strict=True):
        size[x.region] += len(x.text)
        in_content[x.region] += c * (len(x.text) - x.link_chars)
        linked[x.region] += x.link_chars
    # the region with which each is judged: a section of an article or main with that, unless it is mostly links
    whole = {r: r if linked[r] * 2 > size[r] else parser.homes[r] for r in size}
    whole_size, whole_content = Counter(), Counter()
    for r, w in whole.items():
        whole_size[w] += size[r]
        whole_content[w] += in_content[r]
    preferred = {r for r in size if parser.kinds[parser.homes[r]] in ("article", "main")}
    if not preferred and all(parser.kinds[r] in ("page", "body") for r in size):
        chosen_lines = _in_container(parser, smooth >= two_means(smooth))
        if any(chosen_lines):
            return "\n".join(x.text for x, c in zip(lines, chosen_lines, strict=True) if c)
    chosen = {r for r in (preferred or size) if in_content[r] * 2 >= size[r] or whole_content[whole[r]] * 2 >= whole_size[whole[r]]}
    chosen = chosen or preferred
    if chosen:
        return "\n".join(x.text for x in lines if x.region in chosen)
    return "\n".join(x.text for x, c in zip(lines, content, strict=True) if c)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points of text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in in_batches(as_bytes(batch.column(2)), 4_000_000):
                texts = [main_text(as_text(h)) for h in part]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), batch.column(1).slice(at, len(part)), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return base.mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
