"""Navigation discovery: which links of a page stand in its menus, header and footer, and in what
order they are to be followed.

One parser pass turns a page into nested intervals; what lies in what is then a matter of
comparing numbers, so everything after it is joins and windows of a page's own rows."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import urls as U
from ..functions.resolve import resolve
from ..functions.sqltext import SPARK
from . import crawl

# Elements without content. Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input keygen link menuitem meta param source track wbr basefont bgsound command frame image isindex nextid spacer".split())
SILENT = frozenset(("script", "style", "template"))
#: Elements that are regions by their name, and parts of a class or id that make any element one.
REGIONS = frozenset(("nav", "header", "footer", "main", "body"))
MENU_WORDS = ("menu", "nav")
MENUS_EACH = 5
SECONDARY = 50


class _Intervals(HTMLParser):
    """Opens and closes elements as a lenient tree builder does: an end tag closes the nearest
    open element of its name and all within it; one without such an element is nothing."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.clock, self.open, self.depth_of, self.out, self.links, self.silent = 0, [], {}, [], [], 0

    def handle_starttag(self, tag, attrs):
        self.clock += 1
        named: dict[str, str] = {}
        for k, v in attrs:
            named[k] = v or ""
        link = tag == "a" and "href" in named
        region = tag in REGIONS or "content" in (named.get("id"), *named.get("class", "").split()) or any(w in named.get(k, "") for w in MENU_WORDS for k in ("class", "id"))
        row = None
        if link or region:
            row = [self.clock, None, len(self.open), tag, named.get("id"), named.get("class"), named.get("href") if tag == "a" else None, None]
            self.out.append(row)
        if tag in VOID:
            self._close(row, [])
            return
        text: list[str] | None = [] if link else None
        self.open.append((tag, row, text))
        self.depth_of[tag] = self.depth_of.get(tag, 0) + 1
        self.silent += tag in SILENT
        if link:
            self.links.append(text)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.clock += 1
        if self.depth_of.get(tag, 0):
            while self._pop() != tag:
                pass

    def handle_data(self, data):
        if self.links and not self.silent and (piece := data.strip()):
            for text in self.links:
                text.append(piece)

    def finish(self):
        self.close()
        self.clock += 1
        while self.open:
            self._pop()
        return self.out

    def _pop(self) -> str:
        tag, row, text = self.open.pop()
        self.depth_of[tag] -= 1
        self.silent -= tag in SILENT
        if text is not None:
            self.links = [x for x in self.links if x is not text]
        self._close(row, text)
        return tag

    def _close(self, row, text):
        if row:
            row[1] = self.clock
            row[7] = "".join(text) if text is not None else None


def elements(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, open, close, depth, tag, element_id, class, href, text): a page's links and its regions,
    in one parser pass. Element x lies in element y exactly if y.open < x.open < y.close.

    Regions are elements of certain names, with `content` as id or class, or with `menu` or
    `nav` anywhere in either. text is a link's, its pieces stripped and put together. Null
    html has no elements. Rows that share a key are refused nowhere, but their elements mix."""
    kind = dict(pages.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "open", "close", "depth", "tag", "element_id", "class", "href", "text"]
        kinds = (pa.int32(), pa.int32(), pa.int32(), *[pa.string()] * 5)
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(1)):
                parser = _Intervals()
                parser.feed(text.as_py() or "")
                found = parser.finish()
                rows += found
                at += [i] * len(found)
            columns = list(zip(*rows)) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=names)

    found = pages.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInArrow(run, f"key {kind}, open int, close int, depth int, tag string, element_id string, class string, href string, text string")
    return found.withColumnRenamed("key", key)


def _has(word: str, name: str) -> Column:
    return F.contains(F.coalesce(F.col(name), F.lit("")), F.lit(word))


def _regions(found: DataFrame, key: str) -> DataFrame:
    """One row for each page: the intervals that links are looked for in, in their order.

    The first header, the first footer, and of each of four selectors the elements among its
    first five that aren't nav, header or footer; for the second tier the first main, or
    else what has the id, or else the class, `content`; then the body. Navs aren't here: links
    of all of them come in the order of the page."""
    span = F.struct("open", "close")
    first = lambda test: F.min(F.when(test, span))
    token = F.array_contains(F.split(F.coalesce("class", F.lit("")), r"\s+"), "content")
    selectors = [(w, at) for at in ("class", "element_id") for w in MENU_WORDS]
    menus = []
    for k, (w, at) in enumerate((w, at) for at in ("class", "element_id") for w in MENU_WORDS):
        five = F.slice(F.array_sort(F.collect_list(F.when(_has(w, at), F.struct("open", "close", "tag")))), 1, MENUS_EACH)
        menus.append(F.filter(five, lambda m: ~m["tag"].isin("nav", "header", "footer")).alias(f"menu{k}"))
    return found.groupBy(key).agg(
        first(F.col("tag") == "header").alias("header"), first(F.col("tag") == "footer").alias("footer"), *menus,
        F.coalesce(first(F.col("tag") == "main"), first(F.col("element_id") == "content"), first(token)).alias("content"), first(F.col("tag") == "body").alias("body"),
    )


def _inside(region: Column) -> Column:
    return region.isNotNull() & (region["open"] < F.col("open")) & (F.col("open") < region["close"])


def links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", sitemap_found: str | None = None) -> DataFrame:
    """(key, rank, url, norm, text, source, page_type, confidence, priority): the links that a crawl
    takes from each page, in order.

    First tier: links in nav elements, then in the first header, the first footer, and menus by
    class or id. Second tier, only where sitemap_found (a column) isn't true: links in the main
    content, then in the body, at most SECONDARY of them by priority. A link counts once, where
    it comes first; only internal http(s) pages count. Both tiers go by priority, then tier, then
    place. source is nav, header, footer, menu, content or body.

    A page's rows meet in windows by page, never by site, and are as many as its html has
    elements."""
    site = pages.select(key, F.col(url).alias("page_url_"), (F.coalesce(F.col(sitemap_found), F.lit(False)) if sitemap_found else F.lit(True)).alias("first_only_"))
    found = elements(pages, key, html)
    upto = W.partitionBy(key).orderBy("open").rowsBetween(W.unboundedPreceding, -1)
    covered = F.max(F.when(F.col("tag") == "nav", F.col("close"))).over(upto) > F.col("open")
    anchors = found.withColumn("in_nav", F.coalesce(covered, F.lit(False))).where("href is not null").select(key, "open", "href", "text", "in_nav")
    placed = anchors.join(_regions(found, key), key).join(site, key)
    stages = [(F.col("in_nav"), "nav", F.lit(0)), (_inside(F.col("header")), "header", F.lit(0)), (_inside(F.col("footer")), "footer", F.lit(0))]
    for k in range(2 * len(MENU_WORDS)):
        place = F.array_position(F.transform(f"menu{k}", lambda m: (m["open"] < F.col("open")) & (F.col("open") < m["close"])), True)
        stages.append((place > 0, "menu", place))
    stages += [(_inside(F.col("content")), "content", F.lit(0)), (_inside(F.col("body")), "body", F.lit(0))]
    where = F
    for k, (test, name, within) in enumerate(stages):
        where = where.when(test & (~F.col("first_only_") if name in ("content", "body") else F.lit(True)), F.struct(F.lit(k).alias("stage"), within.cast("int").alias("within"), F.lit(name).alias("source")))
    valid = ~F.rlike(F.col("href"), F.lit("^(#|javascript:|mailto:|tel:)"))
    resolved = placed.withColumn("at", where).where(F.col("at").isNotNull() & valid).select(key, "open", "text", "at", F.col("page_url_"), resolve(F.col("page_url_"), F.col("href")).alias("url"))
    own = resolved.where(f"{U.is_internal(SPARK, 'url', U.netloc(SPARK, 'page_url_'))} and not {U.is_skipped(SPARK, 'url')}").withColumn("norm", F.expr(U.normalize(SPARK, "url")))
    once = own.groupBy(key, "norm").agg(F.min(F.struct("at", "open", "url", "text")).alias("x")).select(key, "norm", "x.at", "x.open", "x.url", F.col("x.text").alias("anchor"))
    typed = crawl.classify(once).withColumn("priority", F.expr(U.priority(SPARK, "page_type"))).withColumn("tier", F.when(F.col("at.source").isin("content", "body"), 2).otherwise(1))
    order = [F.col("priority").desc(), "tier", "at", "open"]
    capped = typed.withColumn("of_tier", F.row_number().over(W.partitionBy(key, "tier").orderBy(*order))).where(f"tier = 1 or of_tier <= {SECONDARY}")
    ranked = capped.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order)))
    return ranked.select(key, "rank", "url", "norm", F.col("anchor").alias("text"), F.col("at.source").alias("source"), "page_type", "confidence", "priority")
