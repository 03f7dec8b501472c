"""Operator 2: main text of web pages from parser events and text-to-tag ratios.

The standard library's parser streams a page's events into lines (one per
block: white space collapsed, trimmed); a line knows its text, its tags, its
link text and the container it stands in.  End tags that HTML lets a page
leave out (p, li, dt, dd, tr, td, th) are supplied.  Lines in page furniture
are left out: menus, footers, asides, buttons, scripts, hidden elements in
themselves; headers, forms and elements whose class or id names furniture (by
a whole token or its last word) unless they hold the article or most of the
page's text; a page without articles on which nothing is left keeps all.  Over
the other lines the text-to-tag ratio is smoothed with a Gaussian and split by
threshold clustering (two means in one dimension; means that lie close
together are one cluster, so uneven paragraphs are not parted); the containers
that hold the lines of the high cluster are the content regions (any number of them),
and all their lines are kept, short ones too, unless they are mostly links.
Article and main elements are evidence only: their lines gain a factor of two,
one whose text is mostly in the high cluster is a region as a whole, and
articles beside it with a like ratio too.  Headings go with the line below.

One pass per row in the tasks that read the pages, no shuffle; memory is that
of one page.  Rows: null and empty html give an empty text; text without any
markup is kept whole; repeated rows are kept; an empty table gives no rows;
extra columns are not read; broken markup never raises.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA = 1.0
#: Share of a container's text that may be link text before it is a menu.
LINK_SHARE = 0.5
#: Clusters of lines whose mean ratios (logarithms) are nearer than this are one.
APART = float(np.log(4))
#: What a line inside an article or main element gains (logarithm of its ratio).
ARTICLE_BONUS = float(np.log(2))
#: An article beside a chosen one is chosen from this share of its ratio on.
SIBLING_RATIO = 0.25

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
SILENT = frozenset("script style noscript template svg head title iframe object canvas math".split())
FURNITURE = frozenset("nav footer aside button select textarea input dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
HINTS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar "
                  "navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent notice notices popup modal overlay "
                  "comment comments reply replies disqus discussion share sharing social related recommended newsletter subscribe "
                  "subscription signup login search pagination toolbar widget".split())
#: Words of HINTS that never enclose a page's text where it has an article.
FIRM = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent popup modal overlay "
                 "comment comments reply replies disqus newsletter subscribe signup sidebar navbar breadcrumb breadcrumbs".split())
STATES = frozenset("has have no not non with without is hide show".split())
TITLES = frozenset("header masthead banner".split())
PIECES = frozenset("article post entry content story section title".split())
SECTIONS = frozenset("html body article main section div td th center blockquote li dd".split())
FLOW = frozenset("blockquote li dd td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Starts that end an open paragraph, and elements that open items do not reach out of.
ENDS_P = frozenset("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
                   "h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
SCOPES = frozenset("article aside blockquote button caption dl fieldset figure footer form header main menu nav object ol section table td th "
                   "ul".split())
ITEMS = {"p": "p", "li": "li", "dd": "dd", "dt": "dd", "td": "td", "th": "td", "tr": "tr"}
_WORDS = re.compile(r"[a-z]+")


def _hinted(value: str, in_article: bool) -> str:
    """The furniture word that a class or id names: a whole token, or its last
    word; not tokens that say what an element has ("has-sidebar"), nor the
    title block of an article."""
    for token in value.split():
        words = _WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower())
        if words and words[-1] in HINTS and words[0] not in STATES:
            if words[-1] in TITLES and (in_article or any(w in PIECES for w in words)):
                continue
            return words[-1]
    return ""


def _furniture(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> int:
    """2: furniture in itself, 0: none, else by evidence that the page may
    outweigh (3: adverts and comments, 1: others)."""
    if tag in FURNITURE:
        return 2
    if tag in INLINE or tag in ("html", "body", "article", "main"):
        return 0
    level = int(tag in ("form", "fieldset") or tag == "header" and not in_article)
    for k, v in attrs:
        if k == "hidden" or k == "aria-hidden" and v == "true":
            return 2
        if not v:
            continue
        if k == "role" and (role := v.strip().lower()) in ROLES:
            if role not in ("form", "banner"):
                return 2
            level = max(level, int(role == "form" or not in_article))
        if tag in HEADINGS or not (k == "class" or k == "id"):
            continue
        word = _hinted(v, in_article)
        if word and not (k == "id" and (tag == "section" or in_article) and word not in FIRM):  # ids of sections are anchors
            level = max(level, 3 if word in FIRM else 1)
    return level


class PageLines(HTMLParser):
    """Collects lines (text, tags, link characters, box, is a heading) and the
    tree of their boxes; a node covers the lines lo..hi, parents come first."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, bool]] = []
        self.parent, self.tag, self.article, self.level, self.lo, self.hi = [0], [""], [""], [0], [0], [0]
        self._open: list[tuple[str, int, dict[str, int]]] = []  # tag, what it switches (1 hidden, 2 node), items open before it
        self._items: dict[str, int] = {}  # place of the open p, li, ... in this scope
        self._count: dict[str, int] = {}
        self._hidden = 0
        self._nodes = [0]
        self._articles = 0
        self._headings = 0
        self._links = 0
        self._text: list[str] = []
        self._tags = 0
        self._link_chars = 0

    def flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.lines.append((text, self._tags, self._link_chars, self._nodes[-1], self._headings > 0))
        self._text, self._tags, self._link_chars = [], 0, 0

    def finish(self) -> None:
        self.flush()
        for node in self._nodes:
            self.hi[node] = len(self.lines)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in INLINE:
            self.flush()
        self._close_items(tag)
        self._tags += 1
        if tag in VOID:
            return
        level = _furniture(tag, attrs, self._articles > 0)
        hides = tag in SILENT or level == 2
        role = next((v for k, v in attrs if k == "role"), None)
        article = tag if tag in ("article", "main") else role if role in ("article", "main") else ""
        node = tag in SECTIONS or article != "" or level & 1 == 1
        if node:
            self._nodes.append(len(self.parent))
            self.parent.append(self._nodes[-2])
            self.tag.append(tag)
            self.article.append(article)
            self.level.append(level)
            self.lo.append(len(self.lines))
            self.hi.append(len(self.lines))
            self._articles += article != ""
        self._open.append((tag, int(hides) + 2 * node, self._items))
        if tag in SCOPES:
            self._items = {"tr": self._items["tr"]} if tag in ("td", "th") and "tr" in self._items else {}
        if tag in ITEMS:
            self._items = {**self._items, ITEMS[tag]: len(self._open) - 1}
        self._count[tag] = self._count.get(tag, 0) + 1
        self._hidden += hides
        self._headings += tag in HEADINGS
        self._links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in INLINE:
            self.flush()
        self._tags += 1

    def _close_items(self, tag: str) -> None:
        """End tags that HTML lets a page leave out."""
        for item in (["p"] if tag in ENDS_P else []) + ([ITEMS[tag]] if tag in ITEMS and tag != "p" else []):
            if (at := self._items.get(item, -1)) >= 0:
                while len(self._open) > at:
                    self._pop()

    def _pop(self) -> str:
        name, kind, self._items = self._open.pop()
        self._count[name] -= 1
        self._hidden -= kind & 1
        if kind & 2:
            node = self._nodes.pop()
            self.hi[node] = len(self.lines)
            self._articles -= self.article[node] != ""
        self._headings -= name in HEADINGS
        self._links -= name == "a"
        return name

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        if self._count.get(tag):
            while self._pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not self._hidden:
            self._text.append(data)
            if self._links > 0:
                self._link_chars += len(data)


def smoothed(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing with the kernel renormalised at the ends."""
    radius = int(np.ceil(2 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    ones = np.convolve(np.ones(values.size), kernel)[radius:radius + values.size]
    return np.convolve(values, kernel)[radius:radius + values.size] / ones


def high_cluster(values: np.ndarray, apart: float = 0.0) -> np.ndarray:
    """Threshold between two means, moved until it rests; all values if they
    are equal, or if the two means lie less than `apart` from each other."""
    cut = values.mean()
    for _ in range(50):
        high = values >= cut
        if high.all() or not high.any():
            return np.ones(values.size, dtype=bool)
        new = (values[high].mean() + values[~high].mean()) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    high = values >= cut
    if high.all() or not high.any() or values[high].mean() - values[~high].mean() < apart:
        return np.ones(values.size, dtype=bool)
    return high


def _totals(values, keep) -> np.ndarray:
    """Prefix sums over the lines, those not kept as 0."""
    return np.concatenate([[0], np.cumsum(np.where(keep, values, 0))])


def choose_lines(page: PageLines, keep: np.ndarray) -> np.ndarray:
    """Which of the page's lines (only those of `keep`) the clusters choose."""
    lines, parent, tag = page.lines, page.parent, page.tag
    size = np.array([len(x[0]) for x in lines])
    tags = np.array([max(x[1], 1) for x in lines])
    links = np.array([x[2] for x in lines])
    box = np.array([x[3] for x in lines])
    n = len(parent)
    within = [False] * n  # in an article or main element
    for e in range(n):
        within[e] = page.article[e] != "" or (e > 0 and within[parent[e]])
    high = np.zeros(size.size, dtype=bool)
    ratio = np.log1p(size[keep] / tags[keep])
    bonus = np.where(np.array(within)[box[keep]], ARTICLE_BONUS, 0.0)
    value = smoothed(ratio) + bonus
    high[keep] = cluster = high_cluster(value, APART)
    # a box needs a line that is high by itself too, not only by its neighbours in other boxes
    alone = np.zeros(size.size, dtype=bool)
    alone[keep] = cluster & (cluster.all() or ratio + bonus >= (value[cluster].mean() + value[~cluster].mean()) / 2)
    if not alone.any():
        alone = high

    own_text, own_links, own_high = (np.bincount(box[keep], w[keep], n) for w in (size, links, alone))
    linked = own_links > LINK_SHARE * own_text
    lo, hi = np.array(page.lo), np.array(page.hi)
    text, link, tagged, best = ((t := _totals(w, keep))[hi] - t[lo] for w in (size, links, tags, size * high))
    # articles whose text is mostly of the high cluster are regions as a whole, and so are those beside them with a like ratio
    holds = [False] * n
    for e in range(n - 1, 0, -1):
        holds[parent[e]] |= holds[e] or (page.article[e] == "article" and text[e] > 0)
    whole = [page.article[e] != "" and not (page.article[e] == "main" and holds[e]) and 2 * best[e] > text[e]
             and link[e] <= LINK_SHARE * text[e] for e in range(n)]
    beside: dict[int, float] = {}
    for e in range(n):
        if whole[e] and page.article[e] == "article":
            beside[parent[e]] = max(beside.get(parent[e], 0.0), text[e] / max(tagged[e], 1))
    for e in range(n):
        if page.article[e] == "article" and parent[e] in beside and text[e] and link[e] <= LINK_SHARE * text[e]:
            whole[e] = whole[e] or text[e] / max(tagged[e], 1) >= SIBLING_RATIO * beside[parent[e]]
    region = [False] * n
    inside = [False] * n
    for e in range(n):
        whole[e] = whole[e] or (e > 0 and whole[parent[e]])
        inside[e] = bool(not linked[e] and own_high[e]) or (e > 0 and tag[e] in FLOW and inside[parent[e]])
        region[e] = not linked[e] and (whole[e] or inside[e])
    chosen = keep & np.array(region)[box]
    # a heading belongs to the line it stands over, where its box holds that line
    after = -1
    for i in range(size.size - 1, -1, -1):
        if not keep[i]:
            continue
        if not lines[i][4]:
            after = i
        elif not chosen[i] and after >= 0 and chosen[after] and lo[box[i]] <= after < hi[box[i]] and links[i] <= LINK_SHARE * size[i]:
            chosen[i] = True
    return chosen


def outside_furniture(page: PageLines) -> np.ndarray:
    """Lines that no furniture holds by the evidence of words and elements.
    An element that holds the article, or most of the page's text, is spared;
    if nothing is left on a page without articles, all lines count."""
    n, size = len(page.parent), np.array([len(x[0]) for x in page.lines])
    box = np.array([x[3] for x in page.lines])
    lo, hi = np.array(page.lo), np.array(page.hi)
    total = np.concatenate([[0], np.cumsum(size)])
    text, whole = total[hi] - total[lo], total[-1]
    doubtful = [False] * n  # inside something whose words outweigh the articles in it
    own = [False] * n  # inside an article or main element
    for e in range(1, n):
        doubtful[e] = doubtful[page.parent[e]] or page.level[e] > 0 and (page.level[e] == 3 or 2 * text[e] <= whole)
        own[e] = own[page.parent[e]] or page.article[e] != ""
    own, doubtful = np.array(own), np.array(doubtful)
    clear = own & ~doubtful
    counted = clear if clear[box].any() else own
    of_articles = _totals(size, counted[box])
    held = of_articles[hi] - of_articles[lo]
    articles_to = np.cumsum([a != "" for a in page.article])
    last = np.arange(n)  # last node below each
    for e in range(n - 1, 0, -1):
        last[page.parent[e]] = max(last[page.parent[e]], last[e])
    furniture = [False] * n
    for e in range(1, n):
        if page.level[e] and not furniture[page.parent[e]]:
            outside = of_articles[-1] - held[e]
            others = articles_to[-1] - (articles_to[last[e]] - articles_to[e - 1])
            most = 2 * text[e] > whole and (others == 0 if page.level[e] == 3 else 4 * outside < text[e])
            furniture[e] = not (held[e] > outside or most)
        else:
            furniture[e] = furniture[page.parent[e]]
    keep = ~np.array(furniture)[box]
    return keep if keep.any() or articles_to[-1] else np.ones(size.size, dtype=bool)


def main_blocks(html: str | None) -> list[str]:
    """Blocks of the main text in page order."""
    if not html:
        return []
    page = PageLines()
    page.feed(html)
    page.close()
    page.finish()
    if not page.lines:
        return []
    keep = outside_furniture(page)
    if not keep.any():
        return []
    chosen = choose_lines(page, keep)
    return [x[0] for x, c in zip(page.lines, chosen) if c]


def _extract(batches):
    for batch in batches:
        text = [" ".join(main_blocks(h)) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()),
                                          pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    return df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long")
