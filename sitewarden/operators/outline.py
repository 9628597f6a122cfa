"""Products named by a page's own structure: sections and headings, by an outline of the page."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.functions import udtf

from .navigation import SILENT, VOID

# What product sections are called, labels and parts of labels that name no product, and how much of a page is read.
SECTION = "product|feature|solution|service"
HEADING = "product|feature|solution|service|what we|our"
NO_LABEL = ("learn more", "read more", "get started", "view all", "see all")
NO_PART = ("home", "about", "contact", "blog", "login")
NO_HEADING = ("products", "features", "solutions", "services")
NO_PAGE_HEADING = ("about", "contact", "home", "menu", "navigation", "footer", "header")
NO_SECTION_HEADING = NO_PAGE_HEADING + ("overview", "features")
NO_PRODUCT = ("policy", "career", "grievance", "disclosure", "guideline", "corporate information", "connect with us", "email", "hiring", "we're hiring", "contact", "about", "blog")
SECTIONS, SECTION_LINKS, SECTION_HEADINGS, HEADINGS, AROUND, CONTENT, MOST = 10, 20, 10, 10, 15, 10, 20
FEW_SECTIONS, FEW_HEADINGS, PAGE_HEADINGS = 5, 5, 10

HOLDERS = ("section", "div", "article")
LEVELS = {f"h{k}": k for k in range(1, 7)}


class _Node:
    """An open element: its interval, how many children it has, and whether its text is one string."""

    __slots__ = ("tag", "span", "row", "children", "single")

    def __init__(self, tag: str, at: int, row: dict | None):
        self.tag, self.span, self.row, self.children, self.single = tag, [at, at], row, 0, False


class _Outline(HTMLParser):
    """A page's product sections, headings and links, each with the interval of the nearest element
    that holds it, and headings with the heading above them (a stack of open levels)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.clock, self.open, self.rows, self.heads, self.silent = 0, [], [], [], 0

    def handle_starttag(self, tag, attrs):
        self.clock += 1
        named = {}
        for k, v in attrs:
            named[k] = v or ""
        kind = "heading" if tag in LEVELS else "link" if tag == "a" and "href" in named else "section" if tag in ("section", "div") and re.search(SECTION, named.get("class", ""), re.I) else None
        row = None
        if kind:
            above = None
            if kind == "heading":
                while self.heads and self.heads[-1][0] >= LEVELS[tag]:
                    self.heads.pop()
                above = self.heads[-1][1] if self.heads else None
                self.heads.append((LEVELS[tag], self.clock))
            holder = next((x.span for x in reversed(self.open) if x.tag in HOLDERS), None)
            row = {"kind": kind, "level": LEVELS.get(tag), "under": above, "holder": holder, "text": [], "href": named.get("href") if kind == "link" else None}
            self.rows.append(row)
        node = _Node(tag, self.clock, row)
        if self.open:
            self.open[-1].children += 1
        self.open.append(node)
        if row:
            row["node"] = node
        if tag in VOID:
            self._end()
        else:
            self.silent += tag in SILENT

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.clock += 1
        if any(x.tag == tag for x in self.open):
            while self._end() != tag:
                pass

    def handle_data(self, data):
        if self.silent:
            return
        for x in self.open:
            if x.row:
                x.row["text"].append(data)
        if self.open:
            self.open[-1].children += 1
            self.open[-1].single = True

    def handle_comment(self, data):
        if self.open:
            self.open[-1].children += 1

    def _end(self) -> str:
        node = self.open.pop()
        node.span[1] = self.clock
        self.silent -= node.tag in SILENT
        node.single &= node.children == 1
        if self.open and node.single:
            self.open[-1].single = True
        elif self.open:
            self.open[-1].single = False
        return node.tag

    def finish(self) -> list[dict]:
        self.close()
        self.clock += 1
        while self.open:
            self._end()
        return self.rows


def _intervals(html: str | None) -> Iterator[tuple]:
    parser = _Outline()
    parser.feed(html or "")
    for r in parser.finish():
        node, held = r["node"], r["holder"] or (None, None)
        text = "".join(t.strip() for t in r["text"]) if r["kind"] != "section" else None
        yield node.span[0], node.span[1], r["kind"], r["level"], r["under"], held[0], held[1], node.single, text, r["href"]


@udtf(returnType="open int, close int, kind string, level int, under int, holder int, holder_close int, single boolean, text string, href string")
class Outline:
    """The rows of one page: sections, headings, links. under is the heading above a heading,
    holder and holder_close the nearest section, div or article around an element; single:
    whether an element's text is one string, with no more than elements around it."""

    def eval(self, html: str):
        yield from _intervals(html)


def outlines(pages: DataFrame, key: str = "site_id", html: str = "html") -> DataFrame:
    """(key, open, close, kind, level, under, holder, holder_close, single, text, href): the outline of each page
    (key, html), by a table function. A section tree follows from under, containment from
    open and close. A null page has no rows; a page is one call, however long."""
    spark: SparkSession = pages.sparkSession
    spark.udtf.register("page_outline", Outline)
    return spark.sql("SELECT p.key_, o.* FROM {pages} AS p, LATERAL page_outline(p.html_) AS o", pages=pages.select(F.col(key).alias("key_"), F.col(html).alias("html_"))).withColumnRenamed("key_", key)


def _none_of(text: Column, parts: tuple[str, ...]) -> Column:
    return ~F.rlike(text, F.lit("|".join(parts)))


def _contained(found: DataFrame, key: str, sections: DataFrame) -> DataFrame:
    """found with the sections (key, at, from_, to_) that it lies in, one row for each. A page's sections
    are a bounded array, so that its rows aren't joined with each other."""
    listed = sections.groupBy(key).agg(F.collect_list(F.struct("at", "from_", "to_")).alias("sections_"))
    inside = F.filter("sections_", lambda s: (s["from_"] < F.col("open")) & (F.col("open") < s["to_"]))
    return found.join(listed, key).withColumn("s", F.explode(inside)).drop("sections_").select("*", "s.at").drop("s")


def _first(found: DataFrame, by: list[str], most: int) -> DataFrame:
    return found.withColumn("k_", F.row_number().over(W.partitionBy(*by).orderBy("open"))).where(F.col("k_") <= most)


def _once(found: DataFrame, key: str, order: list) -> DataFrame:
    """Of equal names, whatever their case, the first in order."""
    return found.groupBy(key, F.lower("name").alias("k")).agg(F.min(F.struct(*order, "name", "source")).alias("x")).select(key, "x.*")


def content_products(outline: DataFrame, key: str = "site_id") -> DataFrame:
    """(key, ord, name, source) from home pages: labels of links and headings in product sections, then
    what stands around headings that speak of products. The first CONTENT names of a page, in
    this order: section, its links before its headings, place; each name once."""
    headings = outline.where("kind = 'heading' and level between 2 and 4").withColumn("low", F.lower("text"))
    sections = _first(outline.where("kind = 'section'"), [key], SECTIONS).select(key, F.col("k_").alias("at"), F.col("open").alias("from_"), F.col("close").alias("to_"))
    fits = F.length("text").between(3, 50)
    links = _first(_contained(outline.where("kind = 'link'"), key, sections), [key, "at"], SECTION_LINKS).withColumn("low", F.lower("text"))
    links = links.where(fits & ~F.col("low").isin(*NO_LABEL) & _none_of(F.col("low"), NO_PART)).select(key, F.lit(0).alias("pass"), "at", F.lit(0).alias("part"), "open", F.col("text").alias("name"))
    heads = _first(_contained(headings, key, sections), [key, "at"], SECTION_HEADINGS)
    heads = heads.where(fits & ~F.col("low").isin(*NO_HEADING)).select(key, F.lit(0).alias("pass"), "at", F.lit(1).alias("part"), "open", F.col("text").alias("name"))
    speaking = _first(headings.where(F.col("single") & F.rlike(F.col("low"), F.lit(HEADING))), [key], HEADINGS).where("holder is not null")
    spans = speaking.select(key, F.col("k_").alias("at"), F.col("holder").alias("from_"), F.col("holder_close").alias("to_"), F.col("text").alias("title"))
    items = _contained(outline.where("kind = 'link' or (kind = 'heading' and level between 3 and 4)"), key, spans)
    items = _first(items, [key, "at"], AROUND).join(spans.select(key, "at", "title"), [key, "at"]).withColumn("low", F.lower("text"))
    items = items.where(fits & (F.col("text") != F.col("title")) & ~F.col("low").isin(*NO_LABEL)).select(key, F.lit(1).alias("pass"), "at", F.lit(0).alias("part"), "open", F.col("text").alias("name"))
    named = links.unionByName(heads).unionByName(items).withColumn("source", F.lit("homepage_content"))
    once = _once(named, key, ["pass", "at", "part", "open"])
    order = W.partitionBy(key).orderBy("pass", "at", "part", "open")
    return once.withColumn("ord", F.row_number().over(order)).where(F.col("ord") <= CONTENT).select(key, "ord", "name", "source")


def heading_products(outline: DataFrame, key: str = "site_id") -> DataFrame:
    """(key, ord, name, source) from product pages: the names among the first headings of the second
    and third level, each once."""
    heads = _first(outline.where("kind = 'heading' and level between 2 and 3"), [key], PAGE_HEADINGS)
    good = heads.where((F.length("text") > 3) & (F.length("text") < 100) & _none_of(F.lower("text"), NO_PAGE_HEADING))
    return _once(good.select(key, F.col("k_").alias("ord"), F.col("text").alias("name"), F.lit("page_headings").alias("source")), key, ["ord"])


def section_products(outline: DataFrame, key: str = "site_id") -> DataFrame:
    """(key, ord, name, source) from home pages, for sites that nothing else names products of: the
    first headings of the first product sections."""
    sections = _first(outline.where("kind = 'section'"), [key], FEW_SECTIONS).select(key, F.col("k_").alias("at"), F.col("open").alias("from_"), F.col("close").alias("to_"))
    heads = _first(_contained(outline.where("kind = 'heading' and level between 2 and 4"), key, sections), [key, "at"], FEW_HEADINGS)
    good = heads.where((F.length("text") > 3) & (F.length("text") < 60) & _none_of(F.lower("text"), NO_SECTION_HEADING))
    order = W.partitionBy(key).orderBy("at", "open")
    return good.select(key, F.row_number().over(order).alias("ord"), F.col("text").alias("name"), F.lit("homepage_section").alias("source"))


def extract(home: DataFrame, product_pages: DataFrame, menu: DataFrame, links: DataFrame, key: str = "site_id") -> DataFrame:
    """(key, rank, name, source): at most MOST products of each site, by tiers.

    1. menu (key, ord, name): what the navigation names.
    2. Sites without any: content_products() of home (key, html).
    3. In any case heading_products() of product_pages (key, html), without names that are there.
    4. Sites without any so far: section_products() of home, else links (key, ord, name), the
       names that the home page's links give (research.products()).
    Names that are no products go in the end, before the cap. The tiers meet by site, with a
    bounded number of rows each."""
    front, inner = outlines(home, key), outlines(product_pages, key)
    named = menu.select(key, F.lit(1).alias("tier"), "ord", "name", F.lit("navigation").alias("source"))
    without = lambda rows, *others: rows.join(others[0].select(key).distinct(), key, "left_anti") if len(others) == 1 else without(without(rows, others[0]), *others[1:])
    content = without(content_products(front, key), named).select(key, F.lit(2).alias("tier"), "ord", "name", "source")
    both = named.unionByName(content)
    taken = both.select(key, F.lower("name").alias("low_")).distinct()
    heads = heading_products(inner, key).withColumn("low_", F.lower("name")).join(taken, [key, "low_"], "left_anti").select(key, F.lit(3).alias("tier"), "ord", "name", "source")
    some = both.unionByName(heads)
    sections = without(section_products(front, key), some).select(key, F.lit(4).alias("tier"), "ord", "name", "source")
    rest = without(links.select(key, F.lit(5).alias("tier"), "ord", "name", F.lit("homepage_html").alias("source")), some, sections)
    every = some.unionByName(sections).unionByName(rest).where(_none_of(F.lower("name"), NO_PRODUCT))
    return every.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy("tier", "ord"))).where(F.col("rank") <= MOST).select(key, "rank", "name", "source")
