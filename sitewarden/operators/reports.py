"""Reports: alerts as issues, the whole report model as JSON, and the same as Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.sqltext import SPARK
from ..rules import policies as P
from . import compliance as C, signals

VERSION = "v2.1.1"
# The fixes of alerts, and what a summary says.
ALERT_FIXES = {"NO_HTTPS": "Enable HTTPS with valid SSL certificate", "SSL_ERROR": "Fix SSL certificate configuration", "DOMAIN_TOO_NEW": "Wait for domain age to mature or provide additional verification", "REDIRECT_DETECTED": "Ensure direct access to content without redirects"}
OTHER_FIX = "Review and fix compliance issue"
ENDINGS = (" critical issue(s) require attention.", " critical issue(s) must be resolved before approval.")


def _none() -> Column:
    return F.lit(None).cast("string")


def alerts(sites: DataFrame, key: str = "site_id") -> DataFrame:
    """(key, ord, code, type, description) of sites (key, redirect_count, https, ssl_error, age_days):
    more than one redirect, no HTTPS, a failed handshake (its error), a domain of less than
    a year. Nulls raise no alert."""
    made = F.array(
        signals.redirect_alert(F.col("redirect_count")),
        F.when(~F.col("https"), F.struct(F.lit("NO_HTTPS").alias("code"), F.lit("Security").alias("type"), F.lit("Site is not served over HTTPS.").alias("description"))),
        F.when(F.col("ssl_error").isNotNull(), F.struct(F.lit("SSL_ERROR").alias("code"), F.lit("Security").alias("type"), F.concat(F.lit("SSL Handshake failed: "), F.col("ssl_error")).alias("description"))),
        F.when(F.col("age_days") < 365, F.struct(F.lit("LOW_VINTAGE").alias("code"), F.lit("Risk").alias("type"), F.concat(F.lit("Domain is only "), F.col("age_days").cast("string"), F.lit(" days old (less than 1 year).")).alias("description"))),
    )
    return sites.select(key, F.posexplode(made).alias("ord", "alert_")).where("alert_ is not null").select(key, "ord", "alert_.*")


def _issue(ord_: Column, kind: str, group: str, title: Column, category: Column, expectation: Column, keyword: Column, policy: Column, fix: Column) -> Column:
    return F.struct(ord_.cast("int").alias("ord"), F.lit(kind).alias("kind"), F.lit(group).alias("group"), title.alias("title"), category.alias("category"), expectation.alias("expectation"), keyword.alias("keyword"), policy.alias("policy"), fix.alias("fix"))


def all_issues(facts: DataFrame, raised: DataFrame, findings: DataFrame, key: str = "site_id") -> DataFrame:
    """(key, ord, severity, category, title, required, reason, fix): alerts, missing policies, restricted
    content and placeholder text, in this order, each with its severity in words.

    facts are compliance.facts_of(), raised alerts(), findings risk.findings(). Findings of one
    category and keyword are one issue, on however many pages, so a site has no more issues
    than there are rules, whatever its size. Sites without issues have no row."""
    null, contexts = _none(), facts.select(key, "primary_context")
    ssl = F.col("code").isin("NO_HTTPS", "SSL_ERROR")
    fix = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ALERT_FIXES.items() for x in kv]), F.col("code")), F.lit(OTHER_FIX))
    title = F.concat(F.lit("Compliance issue: "), F.col("code"))
    of_alert = raised.select(key, F.when(ssl, _issue(F.col("ord"), "ssl_missing", "COMPLIANCE", title, F.col("code"), null, null, null, fix)).otherwise(_issue(F.col("ord"), "compliance_failure", "COMPLIANCE", title, F.col("code"), null, null, null, fix)).alias("issue_"))
    missing = [
        F.when(~F.col(f"found_{k}"), _issue(F.lit(10 + n), "policy_missing", "POLICY", F.lit(f"{name} missing"), null, F.expr(C.expectation_sql(SPARK, k)), null, F.lit(name), F.lit(f"Add {name} page accessible from site navigation")))
        for n, (k, name) in enumerate(P.SCORED_POLICIES)
    ]
    dummy = F.when(F.col("has_dummy"), _issue(F.lit(1_000_000), "dummy_text", "QUALITY", F.lit("Dummy/placeholder text detected"), null, null, null, null, F.lit("Replace placeholder text with actual content before going live")))
    own = facts.select(key, F.explode(F.array_compact(F.array(*missing, dummy))).alias("issue_"))
    words = findings.groupBy(key, "category", "keyword").agg(F.min("kw_ord").alias("kw_ord"))
    content = words.select(key, _issue(F.col("kw_ord") + 100, "restricted_content", "CONTENT_RISK", F.concat(F.lit("Restricted content detected: "), F.col("category")), F.col("category"), null, F.col("keyword"), null, F.concat(F.lit("Review content for '"), F.col("keyword"), F.lit("' - may require special compliance"))).alias("issue_"))
    every = of_alert.unionByName(own).unionByName(content).join(contexts, key, "left").select(key, "issue_.*", F.coalesce("primary_context", F.lit("UNKNOWN")).alias("context"))
    severity = C.severity(F.col("kind"), F.col("category"), F.col("expectation"), F.col("context"))
    why = C.reason(F.col("kind"), F.col("category"), F.col("expectation"), F.col("context"), F.lit(0), F.col("keyword"), F.col("policy"))
    return every.select(key, "ord", severity.alias("severity"), F.col("group").alias("category"), "title", (severity == "HIGH").alias("required"), why.alias("reason"), "fix")


def model(sites: DataFrame, scores: DataFrame, found: DataFrame, contexts: DataFrame, mcc: DataFrame, key: str = "site_id") -> DataFrame:
    """(key, meta, summary, issues, scores, context, mcc, recommendations) as nested columns, a row for
    each site (key, url, scanned_at).

    scores: compliance.score(); found: all_issues(); contexts: (key, primary_context, confidence,
    status, surface); mcc: (key, mcc, description, band, confidence, keywords), nulls or no row
    without one. A site passes with a rating above Poor and no critical issue."""
    listed = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "severity", "category", "title", "required", "reason", "fix"))).alias("issues"), F.count_if(F.col("severity") == "HIGH").alias("critical"))
    both = sites.join(scores, key, "left").join(listed, key, "left").join(contexts, key, "left").join(mcc, key, "left")
    critical, rating, score = F.coalesce("critical", F.lit(0)), F.coalesce("rating", F.lit("Unknown")), F.coalesce("total_score", F.lit(0))
    passes = (rating != "Poor") & (rating != "Unknown") & (critical == 0)
    ok = (rating != "Poor") & (rating != "Unknown")
    words = F.concat(F.lower(rating), F.lit(" rating (score: "), score.cast("string"), F.lit("/100). "))
    says = (
        F.when(passes, F.concat(F.lit("This site is compliant with a "), words, F.lit("No critical issues found.")))
        .when(ok, F.concat(F.lit("This site is partially compliant with a "), words, critical.cast("string"), F.lit(ENDINGS[0])))
        .otherwise(F.concat(F.lit("This site is not compliant with a "), words, critical.cast("string"), F.lit(ENDINGS[1])))
    )
    empty = F.array().cast("array<string>")
    of = lambda level, n: F.transform(F.slice(F.filter(F.col("issues"), lambda i: i["severity"] == level), 1, n), lambda i: i["fix"])
    fixes = F.coalesce(F.array_distinct(F.concat(of("HIGH", 3), of("MEDIUM", 2))), empty)
    plain = F.coalesce(F.transform("issues", lambda i: i.dropFields("ord")), F.array().cast("array<struct<severity:string,category:string,title:string,required:boolean,reason:string,fix:string>>"))
    host = F.coalesce(F.nullif(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")), F.lit("unknown"))
    primary = F.coalesce("primary_context", F.lit("UNKNOWN"))
    return both.select(
        key,
        F.struct(F.concat(F.lit("scan-"), F.col(key).cast("string")).alias("scan_id"), F.col("scanned_at").cast("string").alias("scanned_at"), F.col("url").alias("target_url"), host.alias("domain"), primary.alias("business_context"), F.lit(VERSION).alias("report_version")).alias("meta"),
        F.struct(score.alias("overall_score"), rating.alias("rating"), passes.alias("pass"), critical.alias("critical_issues"), says.alias("recommendation")).alias("summary"),
        plain.alias("issues"),
        F.struct(score.alias("overall"), *[F.coalesce(f"{n}_score", F.lit(0)).alias(n) for n in ("technical", "policy", "trust")]).alias("scores"),
        F.struct(primary.alias("primary"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("status", F.lit("UNDETERMINED")).alias("status"), F.coalesce("surface", F.lit("UNKNOWN")).alias("surface")).alias("context"),
        F.when(F.col("mcc").isNotNull(), F.struct(F.col("mcc").alias("code"), "description", F.col("band").alias("category"), F.col("mcc_confidence").alias("confidence"), F.coalesce("keywords", empty).alias("keywords"))).alias("mcc"),
        fixes.alias("recommendations"),
    )


def as_json(reports: DataFrame, key: str = "site_id") -> DataFrame:
    return reports.select(key, F.to_json(F.struct(*[c for c in reports.columns if c != key])).alias("report"))


def as_markdown(reports: DataFrame, key: str = "site_id") -> DataFrame:
    """(key, report): the model as Markdown; issues by HIGH (all of it), MEDIUM (no reason), LOW (reason only)."""
    line = lambda label, x: F.concat(F.lit(f"- **{label}**: "), x.cast("string"))
    percent = lambda x: F.concat(F.format_number(x * 100, 2), F.lit("%"))
    s = "summary."

    def issue_lines(level: str) -> Column:
        own = F.filter("issues", lambda i: i["severity"] == level)
        parts = {
            "HIGH": lambda i: (F.concat(F.lit("  - Category: "), i["category"]), F.concat(F.lit("  - Required: "), F.when(i["required"], "Yes").otherwise("No")), F.concat(F.lit("  - Reason: "), F.coalesce(i["reason"], F.lit(""))), F.concat(F.lit("  - Fix: "), i["fix"])),
            "MEDIUM": lambda i: (F.concat(F.lit("  - Category: "), i["category"]), F.concat(F.lit("  - Fix: "), i["fix"])),
            "LOW": lambda i: (F.concat(F.lit("  - Reason: "), F.coalesce(i["reason"], F.lit(""))),),
        }[level]
        each = F.transform(own, lambda i: F.concat_ws("\n", F.concat(F.lit("- **"), i["title"], F.lit("**")), *parts(i), F.lit("")))
        return F.when(F.size(own) > 0, F.concat(F.lit(f"### {level} Severity\n\n"), F.array_join(each, "\n")))

    m = F.col("mcc")
    mcc = F.when(m.isNull(), "- No MCC classification available").otherwise(F.concat_ws("\n", F.concat(F.lit("- **Primary MCC**: "), m["code"], F.lit(" - "), F.coalesce(m["description"], F.lit(""))), line("Category", F.coalesce(m["category"], F.lit(""))), line("Confidence", percent(m["confidence"])), F.when(F.size(m["keywords"]) > 0, F.concat(F.lit("- **Keywords Matched**: "), F.array_join(m["keywords"], ", ")))))
    fixes = F.transform("recommendations", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    blocks = [
        F.lit("# Site Compliance Report\n"), F.lit("## Overview\n"), line("URL", F.col("meta.target_url")), line("Scan Date", F.coalesce("meta.scanned_at", F.lit(""))), line("Scan ID", F.col("meta.scan_id")), line("Business Context", F.col("meta.business_context")),
        F.concat(F.lit("- **Overall Score**: "), F.col(s + "overall_score").cast("string"), F.lit("/100 ("), F.col(s + "rating"), F.lit(")")), F.concat(F.lit("- **Status**: "), F.when(F.col(s + "pass"), "✅ Pass").otherwise("❌ Fail"), F.lit("\n")),
        F.lit("## Executive Summary\n"), F.concat(F.col(s + "recommendation"), F.lit("\n")), F.when(F.col(s + "critical_issues") > 0, F.concat(F.lit("**Critical Issues**: "), F.col(s + "critical_issues").cast("string"), F.lit("\n"))),
        F.when(F.size("issues") > 0, "## Issues Identified\n").otherwise("No issues identified.\n"), issue_lines("HIGH"), issue_lines("MEDIUM"), issue_lines("LOW"),
        F.lit("## Compliance Breakdown\n"), line("Overall Score", F.concat(F.col("scores.overall").cast("string"), F.lit("/100"))),
        *[line(label, F.concat(F.col(f"scores.{n}").cast("string"), F.lit(f"/{most}"))) for label, n, most in (("Technical", "technical", 30), ("Policy", "policy", 40), ("Trust & Risk", "trust", 30))],
        F.lit("\n## Business Context\n"), line("Primary Context", F.col("context.primary")), line("Confidence", percent(F.col("context.confidence"))), line("Status", F.col("context.status")), line("Frontend Surface", F.col("context.surface")),
        F.lit("\n## MCC Classification\n"), mcc, F.when(F.size("recommendations") > 0, F.concat(F.lit("\n## Recommendations\n\n"), F.array_join(fixes, "\n"))), F.concat(F.lit("\n---\n\n*Report Version "), F.col("meta.report_version"), F.lit("*")),
    ]
    return reports.select(key, F.concat_ws("\n", *blocks).alias("report"))
