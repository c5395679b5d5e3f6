"""Main text of web pages: parser events, text-to-tag ratios, smoothing and a threshold.

``html.parser`` events are read once. Text between block tags is a line with its number
of tags; lines below menus, notices, forms and the like are marked by tag, role, class
and id. A marked region that holds most of the running text by the smoothed ratios is the
page's wrapper: its mark doesn't count. The text-to-tag ratios of the other lines are
smoothed with a Gaussian, and the lines above the ratios' threshold are the content
cluster. Articles that hold most of the cluster are the text, but teasers beside a larger
one; without them, the lines that the cluster spans are, short ones beside it too, from the
headline on where little stands before it, up to the next line of links.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import blocks, bounded, texts

#: Names of HTML elements and roles (fixed values of the format).
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav noscript ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINER = frozenset("article body div main section table td".split())
CLOSES_P = BLOCK - {"html", "head", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "title"}
UNREAD = frozenset("script style noscript template svg iframe object canvas audio video head title".split())
APART = frozenset("nav footer aside form menu dialog button select textarea".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words in class and id values that mark what is no article text, also inside an article.
STRONG = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar cookie cookies consent gdpr popup modal "
    "newsletter subscribe subscription comment comments commentlist disqus reply replies related recommended notice notices share sharing pagination pager".split()
)
#: Words that mark it outside articles only.
MARKS = STRONG | frozenset(
    "promotion banner header masthead footer aside rail widget overlay signup login social search form copyright legal skip".split()
)
#: Words beside them that change nothing; with any other word, such as in form-factor or related-work, the value is no mark.
NEUTRAL = frozenset(
    "main page site global top bottom left right inner outer box block blocks container wrapper wrap area section bar list item items links link content primary secondary module panel zone slot unit "
    "region holder group row col column grid text title the and of by for in on js c l m u fixed sticky mobile desktop small large post posts article articles entry story news us my user users form login buttons button icons icon".split()
)
#: With one of these, a header is the article's own.
OWN_HEADER = frozenset("article entry post story content text title".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Marks that no amount of text lifts: menus by tag or role, and what isn't shown.
FIXED = frozenset("nav footer menu dialog button select textarea".split())
FIXED_ROLES = frozenset("navigation alert alertdialog dialog menu menubar toolbar".split())
#: Words for what readers wrote, which is running text too: only an article in it lifts them.
REPLIES = frozenset("comment comments commentlist disqus replies reply".split())
HEADER = frozenset(("header",))
SMOOTH = 1.0
PEER = 0.25  # of the largest article's content: what another article holds at least that is no teaser
RUNNING = 10.0  # characters a tag, smoothed, of running text in a marked region
NONE, FOR_GOOD = 0, -1  # marks; others are numbers of regions


class Lines(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int, int]] = []  # tag, unread, mark, container
        self.parts: list[str] = []
        self.tags = 0
        self.lines: list[tuple[str, int, int, int]] = []  # text, tags, mark, container
        self.linked: set[int] = set()  # lines that are mostly links
        self.heads: set[int] = set()  # lines in a headline of the first level
        self.link = 0
        self.regions: list[tuple[int, bool]] = [(NONE, False)]  # the mark around it, whether only an article lifts it
        self.containers: list[tuple[str, int]] = [("", -1)]  # tag, the container around it
        self.state = (False, NONE, 0)
        self.where: dict[str, list[int]] = {}  # places in ``open`` by tag

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                if 2 * self.link > len(text):
                    self.linked.add(len(self.lines))
                if self.where.get("h1"):
                    self.heads.add(len(self.lines))
                self.lines.append((text, self.tags, self.state[1], self.state[2]))
                self.tags = 0
            self.link = 0
            self.parts.clear()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        unread, marked, within = self.state
        if tag in BLOCK:
            self.flush()
            if tag in CLOSES_P:
                self.close_to("p", ("table", "td", "th", "button"))
            if tag in ("li", "dd", "dt", "option", "tr", "td", "th"):
                self.close_to(tag, ("ul", "ol", "dl", "table"))
            unread, marked, within = self.state
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        unread = unread or tag in UNREAD
        if marked != FOR_GOOD and (attrs or tag in APART or tag == "header"):
            mark = self.mark_of(tag, attrs)
            if mark and tag not in BLOCK:  # within a block: this text goes, the block's own stays
                unread = True
            elif mark == "fixed":
                marked = FOR_GOOD
            elif mark:
                self.regions.append((marked, mark == "replies"))
                marked = len(self.regions) - 1
        if tag in CONTAINER:
            self.containers.append((tag, within))
            within = len(self.containers) - 1
        self.state = (unread, marked, within)
        self.where.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, *self.state))

    def mark_of(self, tag: str, attrs: list[tuple[str, str | None]]) -> str:
        """How a tag is marked: not (empty), fixed, replies, or some other way."""
        if tag in FIXED:
            return "fixed"
        article = bool(self.where.get("article") or self.where.get("main"))
        found = "tag" if tag in APART or (tag == "header" and not article) else ""
        if tag in ("html", "body", "article", "main"):
            return found
        headline = tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        for name, value in attrs:
            value = value or ""
            if name in ("class", "id"):
                for token in value.split():
                    words = {w.lower() for w in _WORD.findall(token)}
                    own = words & (STRONG if article else MARKS)
                    if not own or any(w not in MARKS and w not in NEUTRAL and not w.isdigit() for w in words) or (own == HEADER and (headline or words & OWN_HEADER)):
                        continue
                    found = "replies" if own & REPLIES or found == "replies" else "word"
            elif name == "role" and value.lower() in ROLES:
                if value.lower() in FIXED_ROLES:
                    return "fixed"
                found = found or "role"
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                return "fixed"
            elif name == "style" and "display:none" in value.replace(" ", "").lower():
                return "fixed"
        return found

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.flush()
        self.close_to(tag)

    def close_to(self, tag: str, stop: tuple[str, ...] = ()) -> None:
        """Close the innermost open ``tag`` and what is open in it, unless one of ``stop`` stands between."""
        places = self.where.get(tag)
        if not places or any(self.where[t][-1] > places[-1] for t in stop if self.where.get(t)):
            return
        i = places[-1]
        if any(t in BLOCK for t, *_ in self.open[i:]):  # the end of an inline element ends no block
            self.flush()
        for t, *_ in self.open[i:]:
            self.where[t].pop()
        del self.open[i:]
        self.state = self.open[-1][1:] if self.open else (False, NONE, 0)

    def handle_data(self, data: str) -> None:
        if not self.state[0]:
            self.parts.append(data)
            if self.where.get("a"):
                self.link += len(data)


def smoothed(ratios: np.ndarray, sigma: float = SMOOTH) -> np.ndarray:
    """Gaussian smoothing over lines; the ends repeat."""
    reach = max(1, int(3 * sigma))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, reach, mode="edge"), weights / weights.sum(), mode="valid")


def ratios(lines: list[tuple]) -> np.ndarray:
    """Smoothed text-to-tag ratios of lines (text, tags, ...)."""
    return smoothed(np.array([len(x[0]) for x in lines], float) / np.maximum(1, [x[1] for x in lines]))


def lifted(parser: Lines) -> set[int]:
    """Marks that don't count: none, and regions that hold most of the running text, as do all around them.

    Most is what it is for the content region: 0.8 of the text, or half of it in an article.
    """
    out = {NONE}
    lines = [x for x in parser.lines if x[2] != FOR_GOOD]
    if len(parser.regions) == 1 or not lines:
        return out
    smooth = ratios(lines)
    least = max(RUNNING, min(smooth.std(), smooth.max()) if len(lines) > 1 else 0.0)
    named = [False] * len(parser.containers)  # inside an article, as a number of its outermost one
    for c, (tag, around) in enumerate(parser.containers):
        named[c] = (around >= 0 and named[around]) or (c if tag in ("article", "main") else False)
    mass = np.zeros(len(parser.regions))
    articles: list[dict[int, float]] = [{} for _ in parser.regions]
    best = np.zeros(len(parser.regions))  # the largest part of an article in each
    total = 0.0
    for (text, _, mark, c), ratio in zip(lines, smooth):
        if ratio < least:
            continue
        total += len(text)
        mass[mark] += len(text)
        if named[c]:
            articles[mark][named[c]] = articles[mark].get(named[c], 0.0) + len(text)
    for r in range(len(parser.regions) - 1, 0, -1):  # what a region holds is held by those around it
        around = parser.regions[r][0]
        mass[around] += mass[r]
        if len(articles[r]) > len(articles[around]):
            articles[r], articles[around] = articles[around], articles[r]
            swapped = articles[around]
            best[r] = max(swapped.values())
        else:
            best[r] = max(articles[r].values(), default=0.0)
        for k, v in articles[r].items():
            articles[around][k] = articles[around].get(k, 0.0) + v
    outside = any(n for (_, _, mark, c), n in zip(lines, smooth >= least) if mark == NONE and named[c])
    for r, (around, replies) in enumerate(parser.regions):  # regions are listed after those around them
        if r and around in out and total > 0:
            held = best[r] >= 0.5 * total
            if held or (mass[r] >= 0.8 * total and not replies and not outside):
                out.add(r)
    return out


def _articles(parser: Lines, mass: np.ndarray) -> list[int]:
    """The outermost articles that hold content, but teasers beside a larger one; else the innermost ``main`` that holds most."""
    around = [-1] * len(parser.containers)  # the outermost article that each container stands in
    for c, (tag, up) in enumerate(parser.containers):
        around[c] = around[up] if up >= 0 and around[up] >= 0 else c if tag == "article" else -1
    outer = [c for c in range(len(parser.containers)) if around[c] == c and mass[c] > 0]
    if outer:
        largest = max(mass[c] for c in outer)
        return [c for c in outer if mass[c] >= PEER * largest]
    return [c for c, (tag, _) in enumerate(parser.containers) if tag == "main" and mass[c] >= 0.5 * mass[0]][-1:]


def main_text(html: str) -> str:
    """The page's article: its blocks, white space made one, joined by an empty line."""
    parser = Lines()
    parser.feed(html)
    if parser.rawdata.startswith("<"):  # a tag or comment that the page's end cuts off is no text
        parser.rawdata = ""
    parser.close()
    parser.flush()
    counted = lifted(parser)
    lines = [(i, *x) for i, x in enumerate(parser.lines) if x[2] in counted]
    if not lines:
        return ""
    size = np.array([len(x[1]) for x in lines], float)
    smooth = smoothed(size / np.maximum(1, [x[2] for x in lines]))
    content = smooth >= min(smooth.std(), smooth.max()) if len(lines) > 1 else np.ones(1, bool)
    mass = np.zeros(len(parser.containers))
    np.add.at(mass, [x[4] for x in lines], size * content)
    for c in range(len(parser.containers) - 1, 0, -1):  # containers are listed after those around them
        mass[parser.containers[c][1]] += mass[c]
    total = mass[0]
    named = _articles(parser, mass) if total > 0 else []
    if sum(mass[c] for c in named) >= 0.5 * total > 0:  # all of the articles that hold most of the content
        inside = np.zeros(len(parser.containers), bool)
        inside[named] = True
        for c in range(1, len(parser.containers)):
            inside[c] |= inside[parser.containers[c][1]]
        return "\n\n".join(x[1] for x in lines if inside[x[4]])
    # else the lines from the first to the last of the content cluster, whatever containers they stand in,
    # and those before and after up to one of links
    chosen = np.flatnonzero(content)
    if not len(chosen):
        return ""
    first, last = int(chosen[0]), int(chosen[-1])
    while first > 0 and lines[first - 1][0] not in parser.linked:
        first -= 1
    # what stands before the headline, and is little, is a column beside the text
    before = np.cumsum(size * content) - size * content
    first = max([first, *(i for i, x in enumerate(lines) if x[0] in parser.heads and i <= last and before[i] <= 0.25 * total)])
    while last + 1 < len(lines) and lines[last + 1][0] not in parser.linked:
        last += 1
    return "\n\n".join(x[1] for x in lines[first : last + 1])


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each page; null and empty pages have the empty text.

    A narrow map, a page at a time, in time linear in a page's length, however deep its tags
    are nested; repeated rows are repeated, other columns are not read.
    """
    source = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "html"):
            found = [main_text(h) for h in texts(block, "html")]
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return bounded(source).mapInArrow(run, "page_id long, url string, text string, n_chars long")
