"""Main text of HTML pages by text-to-tag ratio.

The standard library's streaming parser turns a page into lines, one for each block of text. The ratio of a line is
its text, without that of links, over its tags. Ratios are smoothed along the page by a Gaussian and split into two
clusters by a threshold. The lines of the upper cluster choose the content region: the article element, or else the
smallest element, that holds most of their text. In the region the clusters judge what could be something else:
rows of bare links go where they are in the lower cluster, and an element whose class or id sounds like a notice, a sidebar and
the like goes unless its own ratio is that of the upper one. Names alone decide for adverts and reader comments, whose prose no ratio
tells from the author's, and outside an article. Short lines, headings among them, stay.

Elements are numbered as they open and know the one around them, so sums over the tree are one pass, however deep it is.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: Fixed values of HTML: elements without an end tag, elements that begin a block, and those that never are content.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table "
    "tbody td tfoot th thead title tr ul".split()
)
NEVER = set("aside button dialog footer form head header iframe input menu nav noscript script select style svg template textarea title".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Nouns of class, id and role: of what never is the article, and of what mostly isn't.
CERTAIN = set("ad ads advert adverts advertisement advertising sponsor sponsored sponsors comment comments disqus replies respond".split())
LIKELY = set(
    "banner promo promotion cookie cookies consent gdpr notice notices alert alerts sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead "
    "footer share sharing social related recommended recommendations newsletter subscribe subscription popup modal overlay widget complementary contentinfo".split()
)
#: Parts of a name: what only says that something is a container, and what says what another element has.
HOLDERS = set("list box area section wrapper wrap container block bar links items thread form panel region group row".split())
BEFORE = set("has no with without is".split())
#: A paragraph ends where one of these begins.
CLOSES_P = BLOCK - {"html", "head", "body", "title", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "legend", "caption", "summary"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
#: Standard deviation of the smoothing, in lines; share of the content's text that the region must hold.
SIGMA, MOST = 1.5, 0.9
#: Characters, without links, of an element that may be prose in spite of its name; links of a row of links.
PROSE, ROW = 80, 3
SPACE = re.compile(r"\s+")


def named(value: str, inside: bool) -> int:
    """What a class, id or role says: 2 certainly not the article, 1 likely not, 0 nothing. inside: within an article, which has a header of its own."""
    most = 0
    for token in value.lower().split():
        parts = re.split("[-_]+", token)
        if parts[0] in BEFORE:
            continue
        while len(parts) > 1 and parts[-1] in HOLDERS:
            parts.pop()
        if parts[-1] in CERTAIN:
            most = 2
        elif parts[-1] in LIKELY and not (inside and parts[-1] == "header"):
            most = max(most, 1)
    return most


class Lines(HTMLParser):
    """Lines (text, tags, link characters, links, element) and the tree of elements from parser events. Element 0 is the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # of each element: name, the element around it, whether it or one around it is never content, what its name says, whether an article is around it
        self.kind, self.up, self.skip, self.mark, self.inside = ["page"], [0], [False], [0], [False]
        self.stack: list[int] = [0]
        self.open: Counter[str] = Counter()
        self.lines: list[tuple[str, int, int, int, int]] = []
        self.text: list[str] = []
        self.tags = self.linked = self.links = self.in_link = 0

    def flush(self) -> None:
        if self.text:
            text = SPACE.sub(" ", "".join(self.text)).strip(" ")
            if text:
                self.lines.append((text, self.tags, self.linked, self.links, self.stack[-1]))
                self.tags = self.linked = self.links = 0
            self.text = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag == "a":
            self.in_link += 1
            self.links += 1
        if tag in BLOCK or tag in NEVER:
            self.flush()
            if tag in CLOSES_P:
                self._close({"p"}, until={"table", "td", "th", "button", "div", "section", "article", "main", "li", "blockquote", "body"})
            if tag in SAME:
                self._close(SAME[tag], until={"ul", "ol", "dl", "table", "select", "menu"})
        if tag in VOID:
            return
        around = self.stack[-1]
        inside = self.inside[around]
        # an article's own header holds its title
        never = tag in NEVER and not (tag == "header" and inside)
        may = tag not in ("html", "body", "article", "main", *HEADINGS)
        self.stack.append(len(self.kind))
        self.open[tag] += 1
        self.kind.append(tag)
        self.up.append(around)
        self.skip.append(self.skip[around] or never)
        self.mark.append(max([named(v, inside) for k, v in attrs if k in ("class", "id", "role") and v], default=0) if may else 0)
        self.inside.append(inside or tag in ("article", "main"))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _pop(self, to: int) -> None:
        for n in self.stack[to:]:
            self.open[self.kind[n]] -= 1
        del self.stack[to:]

    def _close(self, names: set[str], until: set[str]) -> None:
        if any(self.open[n] for n in names):
            for i in range(len(self.stack) - 1, 0, -1):
                name = self.kind[self.stack[i]]
                if name in names:
                    return self._pop(i)
                if name in until or name in NEVER:
                    return

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "a":
            self.in_link = max(0, self.in_link - 1)
        if tag in BLOCK or tag in NEVER:
            self.flush()
        if self.open[tag]:
            for i in range(len(self.stack) - 1, 0, -1):
                name = self.kind[self.stack[i]]
                if name == tag:
                    return self._pop(i)
                # an inline end tag closes no block
                if tag not in BLOCK and tag not in NEVER and name in BLOCK:
                    return

    def handle_data(self, data: str) -> None:
        # text of skipped elements only counts as a line, script and style not even that
        if self.kind[self.stack[-1]] in ("script", "style"):
            return
        self.text.append(data)
        if self.in_link:
            self.linked += len(data)

    def sums(self, values: list[float]) -> list[float]:
        """The sum of the lines' values in each element and all that it holds."""
        out = [0.0] * len(self.kind)
        for line, v in zip(self.lines, values, strict=True):
            out[line[4]] += v
        for n in range(len(out) - 1, 0, -1):
            out[self.up[n]] += out[n]
        return out

    def settle(self) -> None:
        """A name says nothing where its element holds most of the page's text that no other name covers: what wraps an article may name its layout."""
        cover = [0] * len(self.kind)
        for n in range(1, len(cover)):
            cover[n] = n if self.mark[n] else cover[self.up[n]] if self.kind[n] not in ("article", "main") else 0
        own = [0.0] * len(cover)
        for text, _, _, _, n in self.lines:
            if not self.skip[n]:
                own[cover[n]] += len(text)
        heap = [(-own[n], n) for n in range(1, len(own)) if self.mark[n]]
        heapq.heapify(heap)
        outer = [cover[u] for u in self.up]
        while heap:
            size, n = heapq.heappop(heap)
            if -size != own[n] or not self.mark[n]:
                continue
            if not own[n] or own[n] < MOST * (own[n] + own[0]):
                break
            self.mark[n] = 0
            to = outer[n]
            while to and not self.mark[to]:
                to = outer[to]
            own[to] += own[n]
            if to:
                heapq.heappush(heap, (-own[to], to))


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    reach = math.ceil(3 * sigma)
    kernel = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        near = [(kernel[j - i + reach], values[j]) for j in range(max(0, i - reach), min(len(values), i + reach + 1))]
        out.append(sum(k * v for k, v in near) / sum(k for k, _ in near))
    return out


def threshold(values: list[float]) -> float:
    """Midway between the means of two clusters of values; below all values if the means are near each other."""
    low, high = min(values), max(values)
    for _ in range(20):
        cut = (low + high) / 2
        below, above = [v for v in values if v < cut], [v for v in values if v >= cut]
        new = (sum(below) / len(below) if below else low, sum(above) / len(above) if above else high)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2 if 2 * low < high else min(values)


def extract(html: str) -> str:
    page = Lines()
    page.feed(html)
    page.close()
    page.flush()
    page.settle()
    lines = page.lines
    if not lines:
        return ""
    gone = list(page.skip)
    plain = [0 if gone[n] else max(0, len(text) - linked) for text, _, linked, _, n in lines]
    ratio = [p / (line[1] + 1) for p, line in zip(plain, lines, strict=True)]
    even = smoothed(ratio)
    cut = threshold(even)
    # named elements, by the ratio of all that they hold
    prose, tags = page.sums(plain), page.sums([line[1] for line in lines])
    for n in range(1, len(gone)):
        by_ratio = page.mark[n] == 1 and page.inside[n] and prose[n] >= PROSE and prose[n] / (tags[n] + 1) >= cut
        gone[n] = gone[n] or gone[page.up[n]] or (page.mark[n] > 0 and not by_ratio)
    content = [i for i, line in enumerate(lines) if even[i] >= cut and not gone[line[4]]]
    content = content or [i for i, line in enumerate(lines) if not gone[line[4]]]
    if not content:
        return ""
    chosen = set(content)
    weight = page.sums([len(line[0]) if i in chosen else 0 for i, line in enumerate(lines)])
    # the innermost article element that holds most of the content, else the smallest element that does; elements are numbered outside in
    holders = [n for n in range(1, len(weight)) if page.kind[n] in BLOCK and weight[n] >= MOST * weight[0]]
    articles = [n for n in holders if page.kind[n] == "article"] or [n for n in holders if page.kind[n] == "main"]
    region = max(articles or [n for n in holders if page.kind[n] != "p"], default=0)
    held = [False] * len(weight)
    held[region] = True
    for n in range(region + 1, len(held)):
        held[n] = held[page.up[n]]
    inside = [i for i, line in enumerate(lines) if held[line[4]] and not gone[line[4]]]
    if not articles and page.kind[region] in ("page", "html", "body"):
        # no element for the content: from its first line, and the headings that lead to it, to its last
        first = content[0]
        while first and (gone[lines[first - 1][4]] or _heading(page, lines[first - 1][4])):
            first -= 1
        inside = [i for i in inside if first <= i <= content[-1] or even[i] >= cut]
    bare = {i for i in inside if ratio[i] < cut and lines[i][2] >= MOST * len(lines[i][0].replace(" ", ""))}
    rows: set[int] = set()
    run: list[int] = []
    for i in [*inside, -1]:
        if i not in bare or (run and i != run[-1] + 1):
            if sum(lines[j][3] for j in run) >= ROW:
                rows.update(run)
            run = []
        if i in bare:
            run.append(i)
    return "\n".join(lines[i][0] for i in inside if i not in rows)


def _heading(page: Lines, n: int) -> bool:
    while n and page.kind[n] not in BLOCK:
        n = page.up[n]
    return page.kind[n] in HEADINGS


def _run(batches):
    schema = pa.schema([("text", pa.string())])
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            text = pa.array([extract(h) if h else "" for h in part.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], text], schema=pa.schema([*list(part.schema)[:-1], schema.field(0)]))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text: the main text of each row of pages, blocks joined by \\n.

    Null or empty html, and pages without text: an empty text. Broken markup is read as far as it goes, to the end of
    the page. Null ids and URLs are kept, repeated rows each get their row. Columns other than these three are
    ignored. An empty table gives an empty result.
    """
    prepare(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_run, "page_id long, url string, text string")


def op9_html_text(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
