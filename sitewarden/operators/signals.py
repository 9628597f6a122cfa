"""Signals: classes, evidence, alerts, small rules over one site's facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.sqltext import SPARK, Dialect, cases
from ..rules import context as R
from ..rules.signals import ADDRESS, MISSION, OFFERINGS



def signal_class_sql(signal: str) -> str:
    """authoritative, advisory or informational; advisory for unknown signals."""
    return cases([(f"{signal} = '{k}'", f"'{v}'") for k, v in R.SIGNALS.items()], "'advisory'")


def can_decide(signal: Column) -> Column:
    """Only authoritative signals decide pass or fail."""
    return F.when(signal.isin(*[k for k, v in R.SIGNALS.items() if v == "authoritative"]), True).otherwise(False)


def evidence(source_url: Column, rule: Column, snippet: Column, confidence: Column, severity: Column) -> Column:
    """An evidence struct: confidence clamped to 0..100; without confidence and severity 0 and
    info; downgraded to that, with missing_fields, if a required field is null or empty."""
    bare = confidence.isNull() & severity.isNull()
    missing = F.coalesce(source_url, F.lit("")).eqNullSafe("") | F.coalesce(rule, F.lit("")).eqNullSafe("") | F.coalesce(snippet, F.lit("")).eqNullSafe("")
    return F.struct(
        source_url.alias("source_url"), rule.alias("triggering_rule"), snippet.alias("evidence_snippet"),
        F.when(missing | bare, 0.0).when(confidence.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), confidence))).alias("confidence"), F.when(missing | bare, "info").otherwise(severity).alias("severity"), missing.alias("missing_fields"),
    )


def redirect_alert(count: Column) -> Column:
    """An alert for more than one redirect; it doesn't fail the site."""
    return F.when(count > 1, F.struct(F.lit("EXCESSIVE_REDIRECTS").alias("code"), F.lit("Performance").alias("type"), F.concat(count.cast("string"), F.lit(" redirects detected.")).alias("description")))


def payment_terms(facts: DataFrame) -> DataFrame:
    """(site_id, passes, actions) of facts (site_id, has_returns, has_terms, has_shipping,
    mentions_product): passes with refunds and terms, else what to add."""
    ok = F.col("has_returns") & F.col("has_terms")
    wanted = F.array_compact(F.array(
        F.when(~F.col("has_returns"), "Refund/Return Policy is missing. Please add a clear Refund Policy page."),
        F.when(~F.col("has_terms"), "Terms & Conditions are missing. Please add a Terms of Service page."),
        F.when(~F.col("has_shipping") & F.col("mentions_product"), "Shipping Policy is recommended for e-commerce sites."),
    ))
    return facts.select("site_id", ok.alias("passes"), F.when(ok, "").otherwise(F.array_join(wanted, " ")).alias("actions"))


def product_indicators_sql(d: Dialect, text: str) -> dict[str, str]:
    has = lambda *words: "(" + " OR ".join(f"contains({text}, {d.text(w)})" for w in words) + ")"
    return {"has_products": has("product", "shop"), "has_pricing": has("price", "$", "₹"), "has_cart": has("add to cart", "buy now"), "ecommerce_platform": has("shopify", "woocommerce")}


def product_indicators(pages: DataFrame, key: str = "doc_id", text: str = "page_text") -> DataFrame:
    return pages.select(key, *[F.expr(e).alias(n) for n, e in product_indicators_sql(SPARK, text).items()])


def about_facts_sql(d: Dialect, text: str) -> dict[str, str]:
    """summary (first 1,000 characters), mission and offerings (first pattern that fits), address."""
    first = lambda patterns: "coalesce(" + ", ".join(f"nullif({d.extract(text, p)}, '')" for p in patterns) + ")"
    return {
        "summary": f"CASE WHEN length({text}) > 1000 THEN concat(left({text}, 1000), '...') WHEN length({text}) > 50 THEN {text} END",
        "mission": first(MISSION), "offerings": first(OFFERINGS), "address": f"nullif({d.extract(text, ADDRESS, 0)}, '')",
    }


def about_facts(pages: DataFrame, key: str = "doc_id", text: str = "page_text") -> DataFrame:
    return pages.select(key, *[F.expr(e).alias(n) for n, e in about_facts_sql(SPARK, text).items()])


def age_band(days: Column) -> Column:
    """The label shown for a domain's age (its bounds differ from the score's)."""
    return F.when(days > 1095, "Good").when(days > 365, "Moderate").otherwise("Low")
