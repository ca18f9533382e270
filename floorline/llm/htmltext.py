"""HTML extraction: parser events to lines, text-to-tag ratios smoothed by a Gaussian, content regions told by a threshold."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import bounded_batches

#: Standard deviation, in lines, of the smoothing.
SIGMA = 1.0
#: Share of the standard deviation of smoothed ratios above which a line counts as content.
LEVEL = 0.5

# Names of HTML elements by what they do to the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HIDDEN = frozenset("head script style noscript template svg math iframe object embed select textarea button canvas audio video dialog title option datalist".split())
ASIDE = frozenset("nav header footer aside form menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert alertdialog dialog".split())
#: Words of class names and ids that mark what isn't the article.
NAMES = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer discussion disqus footer form login masthead menu modal nav navbar navigation newsletter notice notices notification popup promo promoted related replies reply respond search share sharing sidebar sidebars signup social sponsor sponsored subscribe toolbar widget".split())
#: Of them, those that an article may be about; and words that say nothing of their own beside such a word.
TOPICS = frozenset("banner comment comments consent disclaimer discussion form login menu notice notices notification related replies reply respond search share sharing signup social sponsor subscribe".split())
NEUTRAL = frozenset("area bar block body bottom box btn button buttons container content field group icon icons inner item items left line link links list outer panel post posts right row section slot tab text title top unit wrap wrapper".split())
CONTENT = frozenset("article main".split())
CONTAINERS = BLOCK & frozenset("article aside body dd details dialog div fieldset footer form header html main menu nav section table td th".split())
#: Of them, those that mark an ``article`` element too: a reader's comment, a teaser for another page.
NAMES_OF_ARTICLES = frozenset("ad ads advert comment comments promo related replies reply respond sponsored teaser".split())
#: Elements whose end tag the standard lets authors leave out, with the elements that end them.
IMPLIED = {"p": BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option", "optgroup"])}

_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")
#: The next piece of a page: a comment, a declaration, a tag with its quoted values, text, or a < that begins none of them. What
#: isn't closed goes on to the page's end. No piece is looked at twice.
_PIECE = re.compile(r"""(?P<skip><!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z))|(?P<tag></?[a-zA-Z](?:[^>=]++|=\s*+(?:'[^']*+'|"[^"]*+")?)*+(?:>|\Z))|(?P<text>[^<]++)|(?P<lone>(?:<(?![a-zA-Z/!?]))++)|<""", re.S)
#: Elements whose content holds no tags, and where it ends.
_RAW = {tag: re.compile(f"</{tag}(?=[\\s/>])[^>]*+(?:>|\\Z)", re.I) for tag in ("script", "style")}
_NAME = re.compile("<([a-zA-Z]+)")


def _named(value: str, marks: frozenset[str], inside: bool) -> bool:
    """Whether a class or id holds a marking word. Within an article a name of several words, such as ``social-history``, may be the
    article's own: if what marks it can be a topic, all its other words have to mark as well or to say nothing."""
    names = [[w.lower() for w in _SPLIT.split(name) if w] for name in value.split()]
    for words in names:
        found = [w for w in words if w in marks]
        if found and (not inside or not all(w in TOPICS for w in found) or all(w in marks or w in NEUTRAL for w in words)):
            return True
    return False


def _marked(tag: str, attrs: list[tuple[str, str | None]], inside: bool = False) -> bool:
    if tag in ASIDE:
        return True
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and (value or "").lower() in ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value or ""):
            return True
        if name in ("class", "id") and tag not in ("html", "body", "main") and _named(value or "", NAMES_OF_ARTICLES if tag == "article" else NAMES, inside):
            return True
    return False


class Line(NamedTuple):
    """A block's text, the tags met with it, how much of it is links, what the markup says of it, and its container."""

    text: str
    tags: int
    linked: int
    off: bool
    inside: bool
    container: int


class Lines(HTMLParser):
    """Parser events to a line for each block. Each event takes a time that doesn't grow with the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.words: list[str] = []
        self.tags = self.linked = self.links = self.containers = 0
        self.open: list[tuple] = []  # tag, and the state before it
        self.places: dict[str, list[int]] = {}  # of each tag, where it is open
        self.blocks: list[int] = []
        self.state = (False, False, False, 0)  # hidden, off, in an article, container

    def _end_line(self) -> None:
        text = _SPACE.sub(" ", "".join(self.words)).strip()
        if text:
            self.lines.append(Line(text, self.tags, self.linked, *self.state[1:]))
            self.tags = self.linked = 0
        self.words = []

    def read(self, html: str) -> None:
        """The whole page, a piece at a time: the parser never waits for the end of one, nor reads it again."""
        at = 0
        while at < len(html):
            piece = _PIECE.match(html, at)
            at = piece.end()
            if piece["tag"] and not piece["tag"].endswith(">"):
                return  # a tag without an end
            if piece["tag"]:
                self.feed(piece["tag"])
                name = _NAME.match(piece["tag"])
                if name and name[1].lower() in _RAW:
                    end = _RAW[name[1].lower()].search(html, at)
                    at = end.end() if end else len(html)
                    self.feed(f"</{name[1]}>")
            elif not piece["skip"]:
                self.feed(piece["text"] or "&lt;" * len(piece[0]))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        while self.open and tag in IMPLIED.get(self.open[-1][0], ()):
            self._close(len(self.open) - 1)
        if tag in BLOCK or tag in HIDDEN:
            self._end_line()
        self.tags += 1
        if tag == "br":
            self.words.append("\n")
        if tag in VOID:
            return
        hidden, off, inside, container = self.state
        # a header within the article is the article's own
        off = off or (_marked(tag, attrs, inside) and not (tag == "header" and inside and not off and not _marked("", attrs)))
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in BLOCK:
            self.blocks.append(len(self.open))
        self.open.append((tag, *self.state))
        self.containers += tag in CONTAINERS
        self.state = (hidden or tag in HIDDEN, off, inside or tag in CONTENT or ("role", "main") in attrs, self.containers if tag in CONTAINERS else container)
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close(self, at: int) -> None:
        if any(t[0] in BLOCK or t[0] in HIDDEN for t in self.open[at:]):
            self._end_line()
        self.state = self.open[at][1:]
        while len(self.open) > at:
            tag = self.open.pop()[0]
            self.places[tag].pop()
            self.links -= tag == "a"
            if tag in BLOCK:
                self.blocks.pop()

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self._end_line()
        if not self.places.get(tag):
            return
        at = self.places[tag][-1]
        if tag in BLOCK or tag in HIDDEN or not self.blocks or self.blocks[-1] < at:
            self._close(at)  # else a stray end tag of an inline element, which doesn't end the block around it

    def handle_data(self, data: str) -> None:
        if not self.state[0]:
            self.words.append(data)
            self.linked += len(data) if self.links else 0

    def result(self) -> list[Line]:
        self._end_line()
        return self.lines


def ratio(line: Line) -> float:
    """Text to tags: letters that aren't links, in logarithms, for one very long paragraph would raise the floor above all
    others. What the markup sets aside has no text of the page's own."""
    return 0.0 if line.off else float(np.log1p(max(0, len(line.text) - line.linked) / max(line.tags, 1)))


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = max(1, int(np.ceil(2 * sigma)))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    weight = np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]
    return np.convolve(ratios, kernel)[reach : reach + len(ratios)] / weight


def _density(lines: list[Line], ratios: np.ndarray, region: list[int], at: int) -> float:
    """Mean ratio of a region, long lines counting more."""
    sizes = np.array([len(line.text) if where == at else 0 for line, where in zip(lines, region, strict=True)])
    return float((sizes * ratios).sum() / sizes.sum())


def extract_text(html: str | None, sigma: float = SIGMA, level: float = LEVEL) -> str:
    """The main text of a page: its content blocks joined by blank lines; empty if there is none.

    Lines whose ratio, raw or smoothed, comes above the threshold are seeds, unless they have no text of their own or are mostly
    links. A container with a seed is a content region, and all its lines that have such text are content: a short paragraph
    between long ones is no less part of it. Articles are one region; beside it another counts only if its text is as dense.
    """
    parser = Lines()
    parser.read(html or "")
    parser.close()
    lines = parser.result()
    if not lines:
        return ""
    ratios = np.array([ratio(line) for line in lines])
    smooth = smoothed(ratios, sigma)
    floor = level * float(smooth.std())
    own = [2 * line.linked < len(line.text) and r > 0 for line, r in zip(lines, ratios, strict=True)]
    region = [-1 if line.inside else line.container for line in lines]
    seeds = {at for at, r, s, mine in zip(region, ratios, smooth, own, strict=True) if mine and max(r, s) >= floor}
    if -1 in seeds:
        seeds = {at for at in seeds if at == -1 or _density(lines, ratios, region, at) >= _density(lines, ratios, region, -1)}
    # of an article whatever isn't set aside, links too
    kept = [at in seeds and (mine or (at == -1 and not line.off)) for line, at, mine in zip(lines, region, own, strict=True)]
    return "\n\n".join(line.text for line, k in zip(lines, kept, strict=True) if k)


def extract(pages: DataFrame, *, html: str = "html", keep: tuple = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` of each row with ``text``. Null and empty pages have an empty text; none is dropped.

    Repeated rows come back as often as they came; an empty table gives no rows. Other columns may have any names.
    """
    bounded_batches(pages.sparkSession)
    keep = [c for c in keep if c != "text"]
    schema = T.StructType([*(pages.schema[c] for c in keep), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract_text(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*keep, "text"])

    return pages.select(*(F.col(f"`{c}`") for c in [*keep, html])).mapInArrow(run, schema)
