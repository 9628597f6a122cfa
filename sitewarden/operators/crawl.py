"""What to crawl, in which order, and what a crawl admits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import urls as U
from ..functions.sqltext import SPARK

HIGH_VALUE = ("about", "contact", "pricing", "product", "solutions", "faq")
REQUIRED = ("privacy_policy", "terms_conditions")


def classify(links: DataFrame, url: str = "url", anchor: str | None = "anchor", title: str | None = None) -> DataFrame:
    """links with page_type and confidence. `skip` for urls that are never pages; else the
    type with the largest score, the first of equal ones, `other` if none scores.

    What all patterns read is a column before they do. The types' scores meet in one array, so that each is in the plan once, whatever filter is
    pushed down to it; page_type is never null."""
    texts = [(n, t, share) for n, t, share in (("anchor_", anchor, 0.3), ("title_", title, 0.2)) if t]
    inputs = {"route_": F.expr(f"lower({U.path(SPARK, url)})"), "content_": F.expr(U.is_content(SPARK, url)), **{n: F.lower(F.coalesce(F.col(t), F.lit(""))) for n, t, _ in texts}}
    scores = U.scores_of(SPARK, "route_", "content_", [(n, share) for n, _, share in texts])
    ranked = F.array(*[F.struct(F.expr(s).alias("score"), F.lit(-i).alias("o"), F.lit(k).alias("name")) for i, (k, s) in enumerate(scores)])
    scored = links.withColumns(inputs).withColumns({"best_": F.array_max(ranked), "skip_": F.expr(U.is_skipped(SPARK, url))})
    score = F.col("best_.score")
    kind = F.when(F.col("skip_"), "skip").when(score > 0, F.col("best_.name"))
    return scored.select(*links.columns, F.coalesce(kind, F.lit("other")).alias("page_type"), F.when(F.col("skip_"), 1.0).otherwise(F.round(score, 2)).alias("confidence"))


def link_candidates(links: DataFrame) -> DataFrame:
    """Internal, valid links by normalised url: the best scored of a site's equal urls, the first
    of equal ones."""
    wanted = links.where(f"{U.is_valid_link(SPARK, 'url')} and not {U.is_skipped(SPARK, 'url')}")
    order = W.partitionBy("site_id", "norm").orderBy(F.col("confidence").desc(), "link_ord")
    kept = classify(wanted).withColumn("norm", F.expr(U.normalize(SPARK, "url"))).withColumn("rank_", F.row_number().over(order)).where("rank_ = 1")
    return kept.drop("rank_").withColumn("priority", F.expr(U.priority(SPARK, "page_type")))


def queue(candidates: DataFrame, budget: int = 19) -> DataFrame:
    """The first `budget` candidates of every site by priority, then by order of discovery."""
    order = W.partitionBy("site_id").orderBy(F.col("priority").desc(), "link_ord")
    return candidates.withColumn("rank_", F.row_number().over(order)).where(F.col("rank_") <= budget)


def merge_queues(sitemap: DataFrame, nav: DataFrame, fetched: DataFrame | None = None) -> DataFrame:
    """Both queues (site_id, norm, ...), the sitemap's first, without urls that were fetched."""
    both = sitemap.withColumn("src_ord", F.lit(0)).unionByName(nav.withColumn("src_ord", F.lit(1)), allowMissingColumns=True)
    if fetched is not None:
        both = both.join(fetched.select("site_id", "norm").distinct(), ["site_id", "norm"], "left_anti")
    order = W.partitionBy("site_id", "norm").orderBy("src_ord", "link_ord")
    return both.withColumn("rank_", F.row_number().over(order)).where("rank_ = 1").drop("rank_")


def admit(pages: DataFrame) -> DataFrame:
    """Pages (site_id, ord, url, canonical, page_type, confidence, status) that a crawl keeps:
    of equal canonicals the first; then by type the most confident, the first of equal ones; of
    `other` pages the last of each url. A page that loses to a better one of its type has
    still taken its canonical."""
    first = W.partitionBy("site_id", F.coalesce("canonical", F.concat(F.lit("#"), F.col("ord").cast("string")))).orderBy("ord")
    survivors = pages.withColumn("seen_", F.row_number().over(first)).where("seen_ = 1").drop("seen_")
    other = F.col("page_type") == "other"
    key = F.when(other, F.concat(F.lit("u:"), F.col("url"))).otherwise(F.concat(F.lit("t:"), F.col("page_type")))
    best = W.partitionBy("site_id", key).orderBy(F.when(other, -F.col("ord").cast("double")).otherwise(-F.col("confidence")), "ord")
    return survivors.withColumn("best_", F.row_number().over(best)).where("best_ = 1").drop("best_")


def early_exit(pages: DataFrame, least: int = 10) -> DataFrame:
    """Pages of each site up to the first at which the crawl has `least` of them, both required
    policies with a confidence of 0.7, and a high-value page. Running values, by order of
    the queue: the flags read the crawl as it stands, not as it ends."""
    run = W.partitionBy("site_id").orderBy("ord").rowsBetween(W.unboundedPreceding, W.currentRow)
    has = [F.max(F.when((F.col("page_type") == t) & (F.col("confidence") >= 0.7), 1).otherwise(0)).over(run) for t in REQUIRED]
    high = F.max(F.when(F.col("page_type").isin(*HIGH_VALUE) & (F.col("status") == 200), 1).otherwise(0)).over(run)
    stop = (F.count("*").over(run) >= least) & (has[0] + has[1] == 2) & (high == 1)
    marked = pages.withColumn("stop_", F.when(stop, F.col("ord")))
    return marked.withColumn("until_", F.min("stop_").over(W.partitionBy("site_id"))).where("until_ is null or ord <= until_").drop("stop_", "until_")


def summary(pages: DataFrame) -> DataFrame:
    """Counters for each site: attempted, successful, blocked, failed, required pages found."""
    need = [F.max(F.when((F.col("page_type") == t) & (F.col("confidence") >= 0.7), 1).otherwise(0)) for t in REQUIRED]
    return pages.groupBy("site_id").agg(
        F.count("*").alias("attempted"), F.count_if(F.col("status") == 200).alias("success"), F.count_if(F.col("status").isin(401, 403, 429)).alias("blocked"),
        F.count_if((F.col("status") != 200) & ~F.col("status").isin(401, 403, 429)).alias("failed"), (need[0] + need[1] == 2).alias("has_required"),
    )


def type_counts(pages: DataFrame) -> DataFrame:
    return pages.where("status = 200").groupBy("site_id", "page_type").agg(F.count("*").alias("n"))


def gate(home: DataFrame) -> DataFrame:
    """home pages (site_id, status, error) with the outcome of a scan that can't go on, or ok."""
    error = F.coalesce("error", F.lit(""))
    outcome = (
        F.when(F.col("status").isNull(), "DNS_FAIL").when(F.col("status").isin(401, 403), "HTTP_403").when((F.col("status") == 0) & error.contains("SSL"), "SSL_ERROR")
        .when(F.col("status") == 0, "TIMEOUT").when(F.col("status") >= 400, F.concat(F.lit("HTTP_"), F.col("status").cast("string"))).otherwise("ok")
    )
    return home.withColumn("outcome", outcome).withColumn("retryable", F.col("outcome").isin("DNS_FAIL", "TIMEOUT") | (F.col("status") >= 500))


def error_type(message: Column, status: Column) -> Column:
    """The class of a fetch error, by the first test that fits."""
    low = F.lower(message)
    return (
        F.when(low.contains("timeout") | low.contains("timed out"), "timeout").when(low.contains("ssl") | low.contains("certificate"), "ssl")
        .when(low.contains("dns") | low.contains("nodename nor servname") | low.contains("name resolution"), "dns")
        .when(status.isin(403, 429), "blocked").when(status >= 400, "http_error").otherwise("unknown")
    )


def robots_rules(files: DataFrame) -> DataFrame:
    """(site_id, agent, kind, pattern, ord) of robots files (site_id, content). A rule belongs to
    the last user-agent line above it; empty patterns are no rules."""
    lines = files.select("site_id", F.posexplode(F.split("content", "\n")).alias("ord", "line")).withColumn("line", F.trim(F.regexp_replace("line", r"[\r\t]", " ")))
    parsed = lines.where("line <> '' and not startswith(line, '#') and contains(line, ':')").select(
        "site_id", "ord", F.lower(F.trim(F.regexp_extract("line", "^([^:]*):", 1))).alias("kind"), F.trim(F.regexp_extract("line", "^[^:]*:(.*)$", 1)).alias("value")
    )
    run = W.partitionBy("site_id").orderBy("ord").rowsBetween(W.unboundedPreceding, W.currentRow)
    agent = F.last(F.when(F.col("kind") == "user-agent", F.lower("value")), ignorenulls=True).over(run)
    rules = parsed.withColumn("agent", agent).where("kind in ('allow', 'disallow') and value <> '' and agent is not null")
    return rules.select("site_id", "agent", "kind", F.col("value").alias("pattern"), "ord")


def allowed(urls: DataFrame, rules: DataFrame, agent: str = "*") -> DataFrame:
    """urls (site_id, url) with `allowed`: any fitting Allow rule admits, else any fitting
    Disallow rule forbids, else it is admitted. `*` in a pattern is any text; without it
    a pattern is a prefix. A site's rules are one row, so urls aren't multiplied."""
    mine = rules.where(F.col("agent") == agent)
    by_site = mine.groupBy("site_id").agg(*[F.collect_list(F.when(F.col("kind") == k, F.lower("pattern"))).alias(k) for k in ("allow", "disallow")])
    route = F.expr(f"lower(coalesce(nullif({U.path(SPARK, 'url')}, ''), '/'))")
    fits = lambda rules_: F.exists(F.coalesce(rules_, F.array().cast("array<string>")), lambda p: F.when(F.contains(p, F.lit("*")), F.rlike(route, F.concat(F.lit("^"), F.replace(p, F.lit("*"), F.lit(".*"))))).otherwise(F.startswith(route, p)))
    return urls.join(by_site, "site_id", "left").select(*[urls[c] for c in urls.columns], F.when(fits(F.col("allow")), True).otherwise(~fits(F.col("disallow"))).alias("allowed"))


def unescape_xml(text: Column) -> Column:
    """text with XML's five named entities resolved, and the decimal references of two of them."""
    # The ampersand comes last: what it opens then is no escape any more.
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("#39", "'"), ("#38", "&amp"), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char + ";" if char == "&amp" else char))
    return text


def sitemap_urls(files: DataFrame, cap: int = 100) -> DataFrame:
    """(site_id, ord, url) of sitemap files (site_id, content), the first `cap` of each, with
    XML's escapes resolved."""
    found = F.regexp_extract_all("content", F.lit(r"<loc>\s*(https?://[^<]+?)\s*</loc>"), 1)
    return files.select("site_id", F.posexplode(F.slice(found, 1, cap)).alias("ord", "url")).withColumn("url", unescape_xml(F.col("url")))


def sitemap_queue(urls: DataFrame, cap: int = 100) -> DataFrame:
    """(site_id, rank_, url, page_type, priority): of each site's sitemap urls (site_id, base, ord,
    url) the distinct ones of just its own host (no subdomains, every `www.` left out) that
    are pages, by priority and then order, the first `cap`. Priority comes before the cap.
    A bounded rank, which Spark cuts in every partition before it shuffles."""
    own = urls.withColumn("url", F.trim("url")).where(f"url <> '' and {U.domain(SPARK, 'url')} = {U.domain(SPARK, 'base')} and not {U.is_skipped(SPARK, 'url')}")
    distinct = own.groupBy("site_id", "url").agg(F.min("ord").alias("ord"))
    typed = classify(distinct, anchor=None).withColumn("priority", F.expr(U.priority(SPARK, "page_type")))
    order = W.partitionBy("site_id").orderBy(F.col("priority").desc(), "ord")
    return typed.withColumn("rank_", F.row_number().over(order)).where(F.col("rank_") <= cap).select("site_id", "rank_", "url", "page_type", "priority")


def breadth_first(roots: DataFrame, links: DataFrame, depth: int = 3) -> DataFrame:
    """(node, depth): nodes reachable from roots (node) over links (src, dst) in at most `depth`
    steps, with their least distance. One join a level, each with the nodes that are new."""
    seen = roots.select("node").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for k in range(1, depth + 1):
        found = frontier.join(links, frontier["node"] == links["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = found.join(seen, "node", "left_anti").withColumn("depth", F.lit(k))
        seen = seen.unionByName(frontier)
    return seen
