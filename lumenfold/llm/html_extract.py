"""Main text of HTML pages by the distribution of text over line blocks.

Markup is stripped to lines, one for each block-level element; what names itself as something else than the
article (navigation, headers of the page, footers, sidebars, adverts, forms, scripts, styles, notices, comments of
readers) loses its text first. The lengths of text outside links are summed over sliding windows of `window` lines;
where the sum rises over the threshold the text surges, where it falls to nothing it dives, and lines between surge
and dive are text. Marks of an article (<article>, <main> or a declared role) refine the edges: marked lines are
text, so that short ones at the edges stay, and unmarked lines beside them are text if they surge on their own.
Where no sum of a page reaches the threshold, its marked lines are the text; without marks the threshold is half of
the page's largest sum.

Defined results: null and empty pages, and pages without main text (no text outside links, or unmarked and neither
two words nor a full stop), give the empty text; an unclosed or cut tag
ends with the page; bytes that aren't UTF-8 are replaced; repeated rows are each extracted; the empty table gives the empty table; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate

# HTML elements that begin a block, that have no content, and that never hold article text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main "
    "menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("aside audio button canvas datalist dialog embed footer form head iframe input label map math menu meter nav noscript object optgroup option progress script search select style svg template textarea title video".split())
CLOSES_P = BLOCKS - {"body", "html", "head", "caption", "dd", "dt", "li", "legend", "option", "summary", "tbody", "td", "tfoot", "th", "thead", "tr", "title"}
# Words in class, id or role that name something else than the article, and those that name the article.
OTHER = frozenset(
    "ad ads advert adverts advertisement advertising advertorial adsense banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies copyright disqus footer gdpr "
    "header masthead menu menubar modal nav navbar navigation newsletter notice notification notices pager pagination popup promo promoted promotion recommendation recommended recommendations related replies reply respond "
    "share sharing sidebar sidebars signup skip social sponsor sponsored sponsors subscribe subscription teaser toolbar topbar widget widgets".split()
)
ARTICLE = frozenset({"article", "main"})
# A start tag of these ends an open element of the others, within the stops.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
# Parts of a class name that make it the name of something around or within the article.
AROUND = frozenset("article body container content entry has layout main no page post story text with without wrap wrapper".split())
SPACE = re.compile(r"\s+")
SAYS = re.compile(r"\S\s+[^\s<]|[.!?…。！？]$")  # a tag cut by the end of the page says nothing


class Lines(HTMLParser):
    """The lines of a page: text, characters in links, whether inside the marked article."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool]] = []  # element, dropped, article
        self.dropped = self.inside = self.links = 0
        self.text: list[str] = []
        self.linked = 0
        self.lines: list[tuple[str, int, bool]] = []

    def flush(self) -> None:
        line = SPACE.sub(" ", "".join(self.text)).strip()
        if line:
            self.lines.append((line, self.linked, self.inside > 0))
        self.text, self.linked = [], 0

    def _pop(self, at: int) -> None:
        """Closes all elements from that one on."""
        for tag, dropped, article in reversed(self.open[at:]):
            if tag in BLOCKS:
                self.flush()
            self.dropped -= dropped
            self.inside -= article
            self.links -= tag == "a"
        del self.open[at:]

    def _last(self, tags: set[str] | frozenset[str], stops: set[str] = frozenset()) -> int | None:
        for k in reversed(range(len(self.open))):
            if self.open[k][0] in tags:
                return k
            if self.open[k][0] in stops:
                return None
        return None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSES_P and (at := self._last({"p"}, {"button", "table", "td", "th", "article", "section", "div", "li"})) is not None:
            self._pop(at)
        if tag in IMPLIED and (at := self._last(*IMPLIED[tag])) is not None:
            self._pop(at)
        if tag == "a" and (at := self._last({"a"}, {"td", "th", "table"})) is not None:
            self._pop(at)
        if tag == "br":
            self.text.append(" ")
        if tag in BLOCKS:
            self.flush()
        if tag in VOID:
            return
        named = dict(attrs)
        names = [set(re.findall(r"[a-z]+", x)) for x in " ".join(named.get(k) or "" for k in ("class", "id", "role")).lower().split()]
        hidden = "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in (named.get("style") or "").replace(" ", "").lower()
        header = tag == "header" and not self.inside
        dropped = tag in DROPPED or header or hidden or (any(x & OTHER and not x & AROUND for x in names) and tag not in ("html", "body", "article", "main"))
        article = tag in ARTICLE or bool({named.get("role"), named.get("itemprop")} & {"main", "article", "articleBody"})
        self.open.append((tag, dropped, article))
        self.dropped += dropped
        self.inside += article
        self.links += tag == "a"

    def handle_endtag(self, tag: str) -> None:
        if tag == "p" and self._last({"p"}) is None:
            self.flush()
        elif (at := self._last({tag})) is not None and (tag in BLOCKS or not any(t in BLOCKS for t, _, _ in self.open[at + 1 :])):
            self._pop(at)

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.text.append(data)
            if self.links:
                self.linked += len(data)

    def finish(self) -> list[tuple[str, int, bool]]:
        self.close()
        self._pop(0)
        self.flush()
        return self.lines


def between_surges(lengths: list[int], window: int, surge: int) -> tuple[int, int] | None:
    """First line of the first surge and end of the last dive, by the windowed sums; None without a surge."""
    n = len(lengths)
    total = [0]
    for x in lengths:
        total.append(total[-1] + x)
    sums = [total[min(n, k + window)] - total[k] for k in range(n)]
    first = next((k for k in range(n) if sums[k] >= surge and lengths[k]), None)
    if first is None:
        return None
    last = max(k for k in range(n) if lengths[k] and (total[k + 1] - total[max(0, k + 1 - window)]) >= surge)
    return first, last + 1


def stretches(values: list[bool]) -> Iterator[tuple[bool, int, int]]:
    """Runs of equal values: value, begin, end."""
    at = 0
    for value, run in groupby(values):
        begin, at = at, at + sum(1 for _ in run)
        yield value, begin, at


def chosen(lengths: list[int], marked: list[bool], window: int, surge: int, says: bool) -> list[bool]:
    """Which lines are text; lengths: of text outside links; says: whether they say something without marks."""
    found = between_surges(lengths, window, surge)
    if not found and says and not any(marked):
        peak = max(sum(lengths[k : k + window]) for k in range(len(lengths)))
        found = between_surges(lengths, window, max(1, peak // 2))
    a, b = found or (0, 0)
    kept = [a <= k < b or m for k, m in enumerate(marked)]
    for text, i, j in stretches([n > 0 or m for n, m in zip(lengths, marked)]):
        if not text and j - i >= window:  # the sum falls to nothing
            kept[i:j] = [False] * (j - i)
    if any(marked[a:b]):
        for mark, i, j in stretches(marked):
            if not mark and not between_surges(lengths[i:j], window, surge):
                kept[i:j] = [False] * (j - i)
    return kept


def extract(html: str, window: int = 3, surge: int = 80) -> str:
    """The main text of the whole page, blocks joined by two line feeds."""
    parser = Lines()
    parser.feed(html)
    lines = parser.finish()
    lengths = [0 if 2 * linked > len(t) else len(t) - linked for t, linked, _ in lines]
    says = any(n and SAYS.search(t) for (t, _, _), n in zip(lines, lengths))
    kept = chosen(lengths, [inside for _, _, inside in lines], window, surge, says)
    return "\n\n".join(t for (t, _, _), keep in zip(lines, kept) if keep)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, window: int = 3, surge: int = 80) -> DataFrame:
    """A row for each page: page_id, url, text, n_chars."""
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    made = annotate(rows, "html", "text string", lambda texts: {"text": [extract(t.decode(errors="replace"), window, surge) for t in texts]})
    return made.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
