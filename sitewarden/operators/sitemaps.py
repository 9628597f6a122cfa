"""Sitemap discovery: which files of a site are asked, and the urls that they and their children list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import tags as T, urls as U
from ..functions.resolve import resolve
from ..functions.sqltext import SPARK
from . import crawl

#: Tried in order until one has urls. Fixed values.
STANDARD = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/sitemaps.xml")
FROM_ROBOTS, CHILDREN, LEVELS, MOST = 3, 3, 2, 100
_LOC = r"(?i)<loc>\s*(https?://[^<]+?)\s*</loc>"


def in_robots(files: DataFrame) -> DataFrame:
    """(site_id, ord, url): the sitemaps that robots files (site_id, content) name, in order."""
    lines = files.select("site_id", F.posexplode(F.split("content", "\n")).alias("line_", "line")).withColumn("line", F.trim(F.regexp_replace("line", r"[\r\t]", " ")))
    named = lines.where(F.rlike(F.col("line"), F.lit(r"(?i)^sitemap\s*:"))).withColumn("url", F.trim(F.regexp_replace("line", r"^[^:]*:", "")))
    return named.select("site_id", F.row_number().over(W.partitionBy("site_id").orderBy("line_")).alias("ord"), "url").where(F.col("ord") <= FROM_ROBOTS)


def candidates(sites: DataFrame, robots: DataFrame, homes: DataFrame) -> DataFrame:
    """(site_id, stage, ord, url): files to ask. Stage 0 is what robots files name, stages 1 to 4
    the standard places, stage 5 what the home page links to as its sitemap. sites: (site_id,
    root), robots: (site_id, content), homes: (site_id, html)."""
    standard = F.posexplode(F.array(*[F.concat(F.col("root"), F.lit(p)) for p in STANDARD])).alias("ord", "url")
    tried = sites.select("site_id", standard).select("site_id", (F.col("ord") + 1).alias("stage"), F.lit(1).alias("ord"), "url")
    linked = homes.join(sites, "site_id").select("site_id", "root", T.first_attribute(T.tags(F.col("html"), "link"), "href", ("rel", "sitemap")).alias("href")).where("href <> ''")
    named = in_robots(robots.join(sites.select("site_id"), "site_id", "left_semi")).select("site_id", F.lit(0).alias("stage"), "ord", "url")
    return named.unionAll(tried).unionAll(linked.select("site_id", F.lit(len(STANDARD) + 1).alias("stage"), F.lit(1).alias("ord"), resolve(F.col("root"), F.col("href")).alias("url")))


def listed(asked: DataFrame, files: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(site_id, stage, ord, place, url): the urls of candidates(), from files (site_id, url,
    content), with their place among those of one candidate.

    An index stands for its first CHILDREN files, which may be indexes themselves, `levels` of
    them at most (the protocol allows one); each level is one join of what is still open, so a site costs no more than
    CHILDREN ** levels files. Of one candidate the first MOST urls count, in the order of the
    indexes and files; of one file no more than that are taken, wherever it stands."""
    open_ = asked.select("site_id", "stage", "ord", F.array().cast("array<int>").alias("place"), "url")
    out = None
    for level in range(levels + 1):
        held = open_.join(files, ["site_id", "url"]).withColumn("index_", F.contains(F.lower("content"), F.lit("<sitemapindex")))
        locs = F.slice(F.regexp_extract_all("content", F.lit(_LOC), F.lit(1)), 1, F.when(F.col("index_"), CHILDREN).otherwise(MOST))
        each = held.select("site_id", "stage", "ord", "place", "index_", F.posexplode(locs).alias("at_", "loc"))
        each = each.select("site_id", "stage", "ord", F.concat("place", F.array(F.col("at_"))).alias("place"), "index_", crawl.unescape_xml(F.col("loc")).alias("url"))
        found = each.where("not index_").drop("index_")
        out = found if out is None else out.unionAll(found)
        open_ = each.where("index_").drop("index_")
    order = W.partitionBy("site_id", "stage", "ord").orderBy("place")
    return out.withColumn("n_", F.row_number().over(order)).where(F.col("n_") <= MOST).drop("n_")


def discovered(sites: DataFrame, urls: DataFrame) -> DataFrame:
    """(site_id, rank, url, page_type, confidence, priority) of each site's sitemap urls to crawl, of
    listed().

    All that robots files name counts if any of it has urls; else the first standard place
    that has, else the file that the home page links to. Then the site's own host only (no
    subdomains), no urls that are never pages, each once, by priority and order; MOST of them."""
    first = urls.groupBy("site_id").agg(F.min("stage").alias("stage"))
    own = urls.join(first, ["site_id", "stage"]).join(sites.select("site_id", "root"), "site_id").withColumn("url", F.trim("url"))
    own = own.where(f"url <> '' and {U.domain(SPARK, 'url')} = {U.domain(SPARK, 'root')} and not {U.is_skipped(SPARK, 'url')}")
    once = own.groupBy("site_id", "url").agg(F.min(F.struct("ord", "place")).alias("at"))
    typed = crawl.classify(once, anchor=None).withColumn("priority", F.expr(U.priority(SPARK, "page_type")))
    order = W.partitionBy("site_id").orderBy(F.col("priority").desc(), "at")
    return typed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= MOST).select("site_id", "rank", "url", "page_type", "confidence", "priority")
