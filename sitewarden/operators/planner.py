"""The crawl planner: seeds, robots, sitemaps and menus to queues, queues to pages, until a site's
budget is used up or it has what a scan needs. And the plain crawl by breadth under a page cap.

Nothing is fetched here: what a url answers is a row of an attempt log, and a plan says which of
these rows a crawl would have asked for, in what order, and what it keeps of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import html as H, tags as T, urls as U
from ..functions.resolve import resolve
from ..functions.sqltext import SPARK
from ..session import saved
from . import attempts, crawl, navigation, sitemaps

BUDGET, LEAST = 19, 10
ENOUGH = "All required + high-value pages found"


def seeds(sites: DataFrame) -> DataFrame:
    """(site_id, url, root, norm) of sites (site_id, url) as users type them."""
    cleaned = sites.select("site_id", F.expr(U.clean_url(SPARK, "url")).alias("url"))
    # The host keeps its case, as files of the root are asked for as the seed is written.
    return cleaned.select("site_id", "url", F.regexp_extract("url", r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1).alias("root"), F.expr(U.normalize(SPARK, "url")).alias("norm"))


def answers(asked: DataFrame, fetched: DataFrame, rules: DataFrame) -> DataFrame:
    """asked (site_id, url, ...) with what outcomes() and robots rules say: status, body, page_type,
    confidence, canonical, error_type, message, retries. A url that the rules forbid is `blocked`,
    one that was never tried `unknown`."""
    known = fetched.select("site_id", "url", "status", "final_url", "content_type", "body", "error_type", "message", "retries")
    # A site's rules are one row, and its queue is bounded: the join moves a few rows a site.
    both = crawl.allowed(asked, rules).join(known, ["site_id", "url"], "left")
    missing = F.col("status").isNull()
    kind = F.when(~F.col("allowed"), "blocked").when(missing, "unknown").otherwise(F.col("error_type"))
    said = F.when(~F.col("allowed"), "Blocked by robots.txt").when(missing, "not fetched").otherwise(F.col("message"))
    page = F.col("allowed") & (F.col("status") < 400) & F.contains(F.lower("content_type"), F.lit("text/html")) & F.col("error_type").isNull()
    seen = both.withColumn("page_", F.coalesce(page, F.lit(False)))
    title = F.expr(f"CASE WHEN page_ THEN {H.title(SPARK, 'body')} ELSE '' END")
    href = F.when(F.col("page_"), T.first_attribute(T.tags(F.col("body"), "link"), "href", ("rel", "canonical")))
    read = seen.select(
        *asked.columns, F.when(F.col("allowed") & ~missing, F.col("status")).otherwise(0).alias("status"), F.when(F.col("page_"), F.col("body")).otherwise("").alias("body"),
        kind.alias("error_type"), said.alias("message"), F.when(F.col("allowed"), F.coalesce("retries", F.lit(0))).otherwise(0).alias("retries"), "page_", title.alias("title_"),
        F.when(href != "", resolve(F.col("final_url"), href)).alias("canonical"),
    )
    typed = crawl.classify(read, anchor=None, title="title_")
    return typed.select(*asked.columns, "status", "body", F.when(F.col("page_"), F.col("page_type")).otherwise("other").alias("page_type"), F.when(F.col("page_"), F.col("confidence")).otherwise(0.0).alias("confidence"), "canonical", "error_type", "message", "retries")


def until_enough(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """pages (site_id, ord, canonical, page_type, confidence, status, error_type) of each site up to the
    first, beyond the home page (ord 0), at which the crawl has enough: `least` pages that
    weren't blocked, both required policies at a confidence of 0.7, and a page of a
    high-value type that was answered with 200. With `stopped`, whether there is such a page.

    What a crawl has of a type is the most confident page so far, the first of equal ones,
    leaving out pages whose canonical was there before. Windows by site, over no more
    rows than a budget and the home page."""
    twin = W.partitionBy("site_id", "canonical").orderBy("ord")
    new = F.col("canonical").isNull() | (F.row_number().over(twin) == 1)
    run = W.partitionBy("site_id").orderBy("ord").rowsBetween(W.unboundedPreceding, W.currentRow)
    own = lambda t: F.col("new_") & (F.col("page_type") == t)
    required = [F.coalesce(F.max(F.when(own(t), F.col("confidence"))).over(run) >= 0.7, F.lit(False)) for t in crawl.REQUIRED]
    high = [F.coalesce(F.max_by("status", F.when(own(t), F.struct(F.col("confidence"), -F.col("ord")))).over(run) == 200, F.lit(False)) for t in crawl.HIGH_VALUE]
    enough = (F.count_if(F.coalesce(F.col("error_type") != "blocked", F.lit(True))).over(run) >= least) & (F.col("ord") > 0)
    for x in required:
        enough &= x
    some = high[0]
    for x in high[1:]:
        some |= x
    marked = pages.withColumn("new_", new).withColumn("stop_", F.when(enough & some, F.col("ord"))).drop("new_")
    cut = marked.withColumn("until_", F.min("stop_").over(W.partitionBy("site_id"))).where("until_ is null or ord <= until_")
    return cut.withColumn("stopped", F.col("until_").isNotNull()).drop("stop_", "until_")


def _first_queue(homes: DataFrame, maps: DataFrame, has_map: DataFrame) -> DataFrame:
    """(site_id, src, rank, url, norm, source): sitemap urls, then the home page's links."""
    listed = maps.select("site_id", F.lit(0).alias("src"), "rank", "url", F.expr(U.normalize(SPARK, "url")).alias("norm"), F.lit("sitemap").alias("source"))
    flagged = homes.join(has_map.withColumn("sitemap_", F.lit(True)), "site_id", "left")
    menu = navigation.links(flagged.select("site_id", "url", F.col("body").alias("html"), "sitemap_"), "site_id", sitemap_found="sitemap_")
    source = F.when(F.col("source").isin("nav", "header", "footer"), "nav_primary").otherwise("nav_secondary")
    return listed.unionByName(menu.select("site_id", F.lit(1).alias("src"), "rank", "url", "norm", source.alias("source")))


def _deeper_queue(pages: DataFrame) -> DataFrame:
    """The same of the pages of a later round, in their order."""
    own = pages.where("body <> ''").select(F.struct("site_id", "ord").alias("page"), "url", F.col("body").alias("html"))
    menu = navigation.links(own, "page")
    return menu.select("page.site_id", F.col("page.ord").alias("src"), "rank", "url", "norm", F.lit("nav_primary").alias("source"))


def plan(sites: DataFrame, log: DataFrame, budget: int = BUDGET, least: int = LEAST, rounds: int = 1) -> tuple[DataFrame, DataFrame]:
    """What a crawl of every site (site_id, url) fetches and keeps, from a log of attempts
    (attempts.outcomes()): pages and a summary.

    pages: (site_id, ord, url, source, depth, status, page_type, confidence, canonical, error_type,
    message, retries, kept), the home page first. kept: what the crawl's page graph holds in
    the end (crawl.admit()).
    summary: (site_id, discovered, attempted, fetched, success, failed, skipped, retried, timeouts, sitemap_found,
    sitemap_urls, stopped, reason).

    1. The home page. If robots rules forbid it, or it isn't answered with html, that is all.
    2. The queue: urls of the sitemap, then of the menus (without a sitemap of other links too),
       each once by normalised url, never the home page again; the first `budget` of them.
    3. Robots rules, answers, types, canonicals; the crawl ends early once it has enough.
    4. With more rounds, sites that neither have enough nor used up their budget go on with
       the menu links of the round's pages that they haven't met. It ends when no site is open.

    State between rounds is a table of pages (a budget's worth for each site) and one of urls
    met. A site of millions of links costs a bounded rank, cut in every partition before the
    shuffle; urls met are joined by site and url. Sites without a fetched home page have one row.
    An empty table of sites gives no rows."""
    start = seeds(sites)
    raw = attempts.raw_bodies(log)
    fetched = saved(attempts.outcomes(log), "outcomes")
    robots = start.join(raw.withColumnRenamed("url", "file"), "site_id").where("file = concat(root, '/robots.txt')").select("site_id", "content")
    rules = saved(crawl.robots_rules(robots), "rules")
    home = answers(start.select("site_id", "url", "root", "norm"), fetched, rules)
    home = saved(home.withColumns({"ord": F.lit(0), "source": F.lit("root"), "depth": F.lit(0), "fine": F.col("error_type").isNull() & (F.col("body") != ""), "page_type": F.lit("home"), "confidence": F.lit(1.0)}), "homes")
    fine = home.where("fine")
    html = fine.select("site_id", F.col("body").alias("html"))
    roots = fine.select("site_id", "root")
    listed = saved(sitemaps.listed(saved(sitemaps.candidates(roots, robots, html), "sitemap-files"), raw), "listed")
    maps, has_map = saved(sitemaps.discovered(roots, listed), "sitemaps"), listed.select("site_id").distinct()
    met = fine.select("site_id", "norm")
    columns = ["site_id", "ord", "url", "source", "depth", "status", "body", "page_type", "confidence", "canonical", "error_type", "message", "retries"]
    pages, queue, found, used = home.select(*columns), _first_queue(fine, maps, has_map), None, None
    for depth in range(1, rounds + 1):
        once = queue.groupBy("site_id", "norm").agg(F.min(F.struct("src", "rank", "url", "source")).alias("x")).select("site_id", "norm", "x.*")
        new = saved(once.join(met, ["site_id", "norm"], "left_anti"), "candidates")
        counted = new.groupBy("site_id").agg(F.count("*").alias("n"))
        found = counted if found is None else found.unionAll(counted)
        ranked = new.withColumn("k", F.row_number().over(W.partitionBy("site_id").orderBy("src", "rank"))).where(F.col("k") <= budget)
        if used is not None:
            ranked = ranked.join(used, "site_id").where(F.col("k") + F.col("last") <= budget).withColumn("k", F.col("k") + F.col("last")).drop("last")
        asked = ranked.select("site_id", F.col("k").alias("ord"), "url", "source", F.lit(depth).alias("depth"))
        got = answers(asked, fetched, rules).select(*columns)
        pages = saved(until_enough(pages.unionByName(got), least), "pages")
        if depth == rounds:
            break
        open_ = pages.groupBy("site_id").agg(F.max("ord").alias("last"), F.bool_or("stopped").alias("stopped")).where(~F.col("stopped") & (F.col("last") < budget)).drop("stopped")
        used = saved(open_.join(fine.select("site_id"), "site_id", "left_semi"), "open")
        if used.isEmpty():
            break
        met = met.unionAll(new.select("site_id", "norm"))
        queue = _deeper_queue(pages.where(F.col("depth") == depth).join(used, "site_id", "left_semi"))
        pages = pages.drop("stopped")
    kept = crawl.admit(pages).select("site_id", "ord", F.lit(True).alias("kept"))
    out = pages.join(kept, ["site_id", "ord"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    return out.drop("body", "stopped"), _summary(pages, home, found, maps, has_map, budget)


def _summary(pages: DataFrame, home: DataFrame, found: DataFrame, maps: DataFrame, has_map: DataFrame, budget: int) -> DataFrame:
    queued = F.col("ord") > 0
    blocked = F.coalesce(F.col("error_type") == "blocked", F.lit(False))
    timeout = F.coalesce(F.contains(F.lower("message"), F.lit("timeout")), F.lit(False))
    own = pages.groupBy("site_id").agg(
        F.count_if(queued).alias("attempted"), F.count_if(queued & ~blocked).alias("got"), F.count_if(queued & (F.col("status") == 200)).alias("success"),
        F.count_if(queued & ~blocked & (F.col("status") != 200)).alias("failed"), F.count_if(queued & blocked).alias("blocked"), F.count_if(queued & (F.col("retries") > 0)).alias("retried"),
        F.count_if(queued & timeout).alias("timeouts"), F.bool_or("stopped").alias("stopped"),
    )
    seen = found.groupBy("site_id").agg(F.sum("n").alias("n"))
    listed = maps.groupBy("site_id").agg(F.count("*").alias("sitemap_urls"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    all_ = (
        home.select("site_id", "fine", F.col("error_type").isNull().alias("answered")).join(own, "site_id", "left").join(seen, "site_id", "left").join(listed, "site_id", "left")
        .join(has_map.withColumn("has_", F.lit(True)), "site_id", "left")
    )
    discovered = F.when(F.col("fine"), zero("n") + 1).otherwise(0)
    fetched = F.when(F.col("answered"), 1).otherwise(0) + zero("got")
    left = F.when(F.col("fine"), F.greatest(F.lit(0), zero("n") - zero("attempted"))).otherwise(0)
    text = left.cast("string")
    most = F.lit(budget + 1)
    reason = (
        F.when(F.col("stopped"), ENOUGH).when(fetched >= most, f"Page budget limit reached ({budget + 1} pages)")
        .when(left > 0, F.concat(F.lit(f"Page budget limit reached ({budget + 1} pages), "), text, F.lit(" pages not attempted"))).otherwise("None (crawl completed normally)")
    )
    return all_.select(
        "site_id", discovered.alias("discovered"), zero("attempted").alias("attempted"), fetched.cast("long").alias("fetched"), zero("success").alias("success"), zero("failed").alias("failed"),
        (zero("blocked") + left).alias("skipped"), zero("retried").alias("retried"), zero("timeouts").alias("timeouts"), F.coalesce("has_", F.lit(False)).alias("sitemap_found"), zero("sitemap_urls").alias("sitemap_urls"),
        F.coalesce("stopped", F.lit(False)).alias("stopped"), reason.alias("reason"),
    )


def by_breadth(roots: DataFrame, links: DataFrame, fetched: DataFrame, depth: int = 1, max_pages: int = 0) -> DataFrame:
    """(site_id, rank, url, depth): the pages that a crawl by breadth gets from each site, in order.

    roots: (site_id, url); links: (site_id, src, link_ord, dst); fetched: (site_id, url, status).
    The root has depth 1; links are followed below `depth`, only to the root's own host and
    port, as they are written. A url is tried once, where it is met first. Only pages answered with
    200 count and have links; a site ends at `max_pages` of them (0: no cap).

    Level by level: links of a level's pages, each url once at its first place, an anti join with
    the urls met, then the answers. Under a cap, successes are ranked and cut at what is left,
    which Spark does in every partition first, so a hub with a million links sends a cap's worth
    of each. Place is the parent's rank and the link's number, so rank is carried on."""
    cap = max_pages if max_pages > 0 else None
    host = lambda c: F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    home = roots.select("site_id", "url", host("url").alias("host"))
    hosts = home.select("site_id", "host")
    met = home.select("site_id", "url")
    level = home.select("site_id", "url", F.lit(0).cast("long").alias("parent"), F.lit(0).cast("long").alias("link_ord"))
    done, counts = None, None
    for d in range(1, depth + 1):
        good = level.join(fetched.where("status = 200").select("site_id", "url").distinct(), ["site_id", "url"], "left_semi")
        rank = F.row_number().over(W.partitionBy("site_id").orderBy("parent", "link_ord"))
        got = good.withColumn("rank", rank)
        if cap:
            got = got.where(F.col("rank") <= cap)
        if counts is not None:
            got = got.join(counts, "site_id", "left").withColumn("rank", F.col("rank") + F.coalesce("n", F.lit(0))).drop("n")
            if cap:
                got = got.where(F.col("rank") <= cap)
        got = saved(got.select("site_id", F.col("rank").cast("long").alias("rank"), "url", F.lit(d).alias("depth")), "level")
        done = got if done is None else done.unionAll(got)
        if d == depth or got.isEmpty():
            break
        counts = done.groupBy("site_id").agg(F.max("rank").alias("n"))
        out = got.select("site_id", F.col("url").alias("src"), F.col("rank").alias("parent")).join(links, ["site_id", "src"]).join(hosts, "site_id").where(host("dst") == F.col("host"))
        first = out.groupBy("site_id", F.col("dst").alias("url")).agg(F.min(F.struct("parent", "link_ord")).alias("x")).select("site_id", "url", "x.parent", F.col("x.link_ord").cast("long").alias("link_ord"))
        level = saved(first.join(met, ["site_id", "url"], "left_anti"), "frontier")
        met = met.unionAll(level.select("site_id", "url"))
    return done


def monitored(crawled: DataFrame, matches: DataFrame) -> DataFrame:
    """(site_id, pages_crawled, total_keyword_matches) of by_breadth() and matches (site_id, url, n)."""
    hits = matches.groupBy("site_id", "url").agg(F.sum("n").alias("n"))
    return crawled.join(hits, ["site_id", "url"], "left").groupBy("site_id").agg(F.count("*").alias("pages_crawled"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_keyword_matches"))
