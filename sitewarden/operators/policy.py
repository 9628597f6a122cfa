"""Detection of policy pages among a site's links, and their reconciliation with the crawl."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import urls as U
from ..functions.sqltext import SPARK
from ..rules import pages as P, policies as R


def _candidates(rows: DataFrame, pairs: list[tuple[str, Column]], *columns: str) -> DataFrame:
    """One row for each policy whose expression (a struct or null) isn't null."""
    made = F.filter(F.array(*[F.struct(F.lit(k).alias("policy"), c.alias("c")) for k, c in pairs]), lambda x: x["c"].isNotNull())
    return rows.withColumn("x", F.explode(made)).select(*columns, "x.policy", "x.c.*")


def _scored(route: Column, text: Column) -> list[tuple[str, Column]]:
    """By policy the best pattern for a link: a path match counts whole, a text match 0.8."""
    out = []
    for policy, patterns in R.SCORED:
        hits = []
        for k, (pattern, weight) in enumerate(patterns):
            by_path, by_text = route.rlike(pattern), text.rlike(f"(?i){pattern}")
            made = lambda conf, how: F.struct(F.lit(conf).alias("confidence"), F.lit(-k).alias("rule"), F.lit(how).alias("method"))  # noqa: B023, E731
            hits.append(F.when(by_path, made(float(weight), "url_pattern")).when(by_text, made(weight * 0.8, "anchor_text")))
        out.append((policy, F.array_max(F.array_compact(F.array(*hits)))))
    return out


def detect(links: DataFrame) -> DataFrame:
    """(site_id, policy, url, method, confidence): for each site the link that shows a policy.

    First the best scored link, the first of equal ones; for policies that have none, the
    first link that fits a fallback pattern (60); then exact navigation labels (75). Links of
    content pages take no part in the first two. Each link is scanned once for all
    policies; only hits become rows."""
    rows = links.withColumns({
        "route": F.expr(f"lower({U.path(SPARK, 'url')})"), "label": F.trim(F.coalesce("anchor", F.lit(""))), "content": F.expr(U.is_content(SPARK, "url")),
    })
    plain = rows.where("not content")
    keep = ("site_id", "link_ord", "url")
    scored = _candidates(plain, _scored(F.col("route"), F.col("label")), *keep)
    first = scored.groupBy("site_id", "policy").agg(F.max_by(F.struct("url", "method", (F.col("confidence") * 100).alias("confidence")), F.struct("confidence", -F.col("link_ord"), "rule")).alias("r"))
    fallback = []
    for policy, patterns in R.FALLBACK:
        anywhere = "(?i)" + "|".join(f"(?:{p})" for p in patterns)
        fallback.append((policy, F.when(F.col("label").rlike(anywhere), F.struct(F.lit("anchor_text").alias("method"))).when(F.col("route").rlike(anywhere), F.struct(F.lit("url_pattern").alias("method")))))
    second = _candidates(plain, fallback, *keep).groupBy("site_id", "policy").agg(F.min_by(F.struct("url", "method", F.lit(60.0).alias("confidence")), "link_ord").alias("r"))
    labels = [(p, F.when(F.lower("label").isin(*names), F.struct(F.lit("nav_dropdown").alias("method")))) for p, names in R.NAV_LABELS.items()]
    third = _candidates(rows, labels, *keep).groupBy("site_id", "policy").agg(F.min_by(F.struct("url", "method", F.lit(75.0).alias("confidence")), "link_ord").alias("r"))
    every = first.withColumn("pass_", F.lit(1)).unionByName(second.withColumn("pass_", F.lit(2))).unionByName(third.withColumn("pass_", F.lit(3)))
    best = every.groupBy("site_id", "policy").agg(F.min_by("r", "pass_").alias("r"))
    return best.select("site_id", "policy", F.col("r.url").alias("url"), F.col("r.method").alias("method"), F.round("r.confidence", 6).alias("confidence"))


def reconcile(detected: DataFrame, crawled: DataFrame, statuses: DataFrame) -> DataFrame:
    """Detected policies with the crawl's word: crawled (site_id, page_type, url, status) fills
    in and, when its page is there (200), overrides; a link whose known status isn't 200, or
    that isn't http, doesn't count as found. statuses: (site_id, url, status)."""
    types = crawled.sparkSession.createDataFrame(list(R.PAGE_TYPE_OF.items()), "policy string, page_type string")
    graph = crawled.join(F.broadcast(types), "page_type").select("site_id", "policy", F.col("url").alias("page_url"), F.col("status").alias("page_status"))
    known = statuses.groupBy("site_id", "url").agg(F.max(F.when(F.col("status") == 200, 1).otherwise(0)).alias("ok"))
    both = detected.join(graph, ["site_id", "policy"], "full").join(known, ["site_id", "url"], "left")
    taken = F.col("page_status") == 200
    own = F.col("url").rlike("^https?://") & (F.coalesce("ok", F.lit(1)) == 1)
    return both.select(
        "site_id", "policy", F.coalesce(taken | own, F.lit(False)).alias("found"), F.when(taken, F.col("page_url")).when(own, F.col("url")).alias("url"),
        F.when(taken, "page_graph").when(own, F.col("method")).alias("method"), F.when(taken, 100.0).when(own, F.col("confidence")).alias("confidence"),
    )


def display_state(policy: Column, found: Column, product_url: Column) -> Column:
    """found, missing, or n/a: shipping and refunds don't apply where nothing is sold."""
    sells = F.coalesce(product_url, F.lit("")).rlike("/shop|/store|/cart|/checkout")
    return F.when(found, "found").when(policy.isin("shipping_delivery", "returns_refund") & ~sells, "n/a").otherwise("missing")


assert {k for k, _ in R.SCORED} == set(R.PAGE_TYPE_OF) and P.TTL
