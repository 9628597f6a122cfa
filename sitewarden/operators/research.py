"""Products named by links, keyword monitoring over a crawl, plain reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import urls as U
from ..functions.sqltext import SPARK

# Words of names that are no products.
NO_PRODUCT = ("policy", "career", "grievance", "disclosure", "guideline", "corporate information", "connect with us", "email", "hiring", "we're hiring", "contact", "about", "blog")
# Labels that are no names, and path parts of lists.
NO_NAME = ("go to", "learn more", "read more", "view all", "see all", "all")
LISTS = ("/category", "/tag", "/archive", "/page")
PRODUCT_PATHS = ("/product", "/products", "/shop", "/solution", "/solutions", "/service", "/services", "/platform", "/item")


def products(links: DataFrame, most: int = 20, enough: int = 15) -> DataFrame:
    """(site_id, rank_, name, tier) of links (site_id, link_ord, url, anchor, in_menu): names from
    the products menu, then from product urls, then, if these are fewer than `enough`, short
    labels of other pages. Equal names count once, the first; at most `most` for a site."""
    # Each step is an element of an array: what is exploded isn't put into the plan again by later filters.
    parts = F.struct(F.expr(f"lower({U.path(SPARK, 'url')})").alias("route"), F.btrim(F.coalesce("anchor", F.lit(""))).alias("label"))
    rows = links.withColumn("p", F.explode(F.array(parts))).select("site_id", "link_ord", "in_menu", "p.*")
    last = F.translate(F.regexp_extract("route", r"([^/]+)/*$", 1), "-_", "  ")
    short = F.col("label").rlike(r"^\S+(\s+\S+){0,4}$") & ~F.lower("label").rlike("|".join(NO_NAME)) & ~F.col("route").rlike("|".join(LISTS)) & (F.char_length("route") > 1)
    by_path = F.col("route").rlike("|".join(PRODUCT_PATHS)) & (last != "")
    made = F.when(F.col("in_menu") & (F.col("label") != ""), F.struct(F.lit(1).alias("tier"), F.col("label").alias("name"))).when(by_path, F.struct(F.lit(2).alias("tier"), F.initcap(last).alias("name"))).when(short, F.struct(F.lit(3).alias("tier"), F.col("label").alias("name")))
    good = F.filter(F.array(made), lambda x: x.isNotNull() & F.char_length(x["name"]).between(2, 50) & ~F.lower(x["name"]).rlike("|".join(NO_PRODUCT)))
    named = rows.withColumn("x", F.explode(good)).select("site_id", "link_ord", "x.*")
    first = named.groupBy("site_id", F.lower("name").alias("k")).agg(F.min_by(F.struct("link_ord", "tier", "name"), "link_ord").alias("r")).select("site_id", "r.*")
    real = F.count_if(F.col("tier") < 3).over(W.partitionBy("site_id"))
    order = W.partitionBy("site_id").orderBy("tier", "link_ord")
    kept = first.withColumn("real", real).where((F.col("tier") < 3) | (F.col("real") < enough))
    return kept.withColumn("rank_", F.row_number().over(order)).where(F.col("rank_") <= most).select("site_id", "rank_", "name", "tier")


def keyword_monitor(pages: DataFrame, keywords: tuple[str, ...], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_matches, matched, excerpt) of each page: keywords that it holds, in order, and its
    first 500 characters."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(low, F.lower(k)))
    body = F.coalesce(text, F.lit(""))
    cut = F.when(F.char_length(body) > 500, F.concat(F.left(body, F.lit(500)), F.lit("..."))).otherwise(body)
    return pages.select(key, F.size(found).alias("n_matches"), F.array_join(found, ",").alias("matched"), cut.alias("excerpt"))


def research_report(findings: DataFrame, key: str = "site_id") -> DataFrame:
    """(key, report): Markdown with one line for each finding (site_id, ord, title, body)."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", "title", "body"))), lambda x: F.concat(F.lit("- **"), x["title"], F.lit("**: "), x["body"]))
    return findings.groupBy(key).agg(F.concat(F.lit("# Research "), F.first(F.col(key).cast("string")), F.lit("\n"), F.array_join(lines, "\n")).alias("report"))


def query_plan(topics: DataFrame, templates: tuple[str, ...]) -> DataFrame:
    """(topic, ord, query): each topic put into every template (`{}` is its place)."""
    made = F.array(*[F.struct(F.lit(i).alias("ord"), F.replace(F.lit(t), F.lit("{}"), F.col("topic")).alias("query")) for i, t in enumerate(templates)])
    return topics.withColumn("q", F.explode(made)).select("topic", "q.*")


def first_match_policies(links: DataFrame, patterns: tuple[tuple[str, str], ...]) -> DataFrame:
    """The older scan: for each policy the first link whose url or label fits its pattern."""
    text = F.concat_ws(" ", F.lower("url"), F.lower("anchor"))
    hits = F.filter(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in patterns]), lambda x: x.isNotNull())
    return links.withColumn("policy", F.explode(hits)).groupBy("site_id", "policy").agg(F.min_by("url", "link_ord").alias("url"))
