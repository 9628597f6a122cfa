"""Alerts as issues, and golden reports by hand."""

import json

from sitewarden.operators import reports
from sitewarden.rules import policies as P


def facts_of(spark, rows):
    """rows: (site_id, context, has_dummy, missing policies)."""
    names = [k for k, _ in P.SCORED_POLICIES]
    schema = "site_id long, primary_context string, context_status string, has_dummy boolean, " + ", ".join(f"found_{k} boolean" for k in names)
    return spark.createDataFrame([(i, c, "DETERMINED", d, *[k not in gone for k in names]) for i, c, d, gone in rows], schema)


def test_alerts(spark):
    rows = [(1, 3, False, None, 100), (2, 1, True, "certificate expired", 365), (3, None, None, None, None), (4, 2, True, None, 0)]
    got = reports.alerts(spark.createDataFrame(rows, "site_id long, redirect_count int, https boolean, ssl_error string, age_days int")).orderBy("site_id", "ord").collect()
    assert [(r["site_id"], r["code"], r["type"], r["description"]) for r in got] == [
        (1, "EXCESSIVE_REDIRECTS", "Performance", "3 redirects detected."), (1, "NO_HTTPS", "Security", "Site is not served over HTTPS."), (1, "LOW_VINTAGE", "Risk", "Domain is only 100 days old (less than 1 year)."),
        (2, "SSL_ERROR", "Security", "SSL Handshake failed: certificate expired"), (4, "EXCESSIVE_REDIRECTS", "Performance", "2 redirects detected."), (4, "LOW_VINTAGE", "Risk", "Domain is only 0 days old (less than 1 year)."),
    ]


def made(spark):
    first = P.SCORED_POLICIES[0]
    facts = facts_of(spark, [(1, "ECOMMERCE", True, [first[0]]), (2, "UNKNOWN", False, [])])
    raised = spark.createDataFrame([(1, 0, "EXCESSIVE_REDIRECTS"), (1, 1, "SSL_ERROR")], "site_id long, ord int, code string")
    findings = spark.createDataFrame([(1, f"u{k}", "gambling", "casino", 5) for k in range(50)], "site_id long, page_url string, category string, keyword string, kw_ord int")
    return first, reports.all_issues(facts, raised, findings)


def test_issues(spark):
    first, found = made(spark)
    rows = [tuple(r)[2:] for r in found.where("site_id = 1").orderBy("ord").collect()]
    assert rows[0] == ("MEDIUM", "COMPLIANCE", "Compliance issue: EXCESSIVE_REDIRECTS", False, "EXCESSIVE_REDIRECTS failure may impact compliance", "Review and fix compliance issue")
    assert rows[1] == ("HIGH", "COMPLIANCE", "Compliance issue: SSL_ERROR", True, "HTTPS is required for all payment processing sites", "Fix SSL certificate configuration")
    assert rows[2][1:3] == ("POLICY", f"{first[1]} missing") and rows[2][5] == f"Add {first[1]} page accessible from site navigation"
    assert rows[3][:4] == ("HIGH", "CONTENT_RISK", "Restricted content detected: gambling", True) and "casino" in rows[3][5]
    assert rows[4][:3] == ("MEDIUM", "QUALITY", "Dummy/placeholder text detected") and len(rows) == 5
    assert found.where("site_id = 2").count() == 0


def test_golden_report(spark):
    _, found = made(spark)
    sites = spark.createDataFrame([(1, "https://a.example/x", "2024-01-01"), (2, "https://b.example/", "2024-01-02"), (3, None, None)], "site_id long, url string, scanned_at string")
    scores = spark.createDataFrame([(1, 10, 30, 20, 60, "Fair"), (2, 30, 40, 25, 95, "Good")], "site_id long, technical_score int, policy_score int, trust_score int, total_score int, rating string")
    contexts = spark.createDataFrame([(1, "ECOMMERCE", 0.875, "DETERMINED", "WEB")], "site_id long, primary_context string, confidence double, status string, surface string")
    mcc = spark.createDataFrame([(2, "5734", "Software stores", "Retail", 0.5, ["software", "cloud"])], "site_id long, mcc string, description string, band string, mcc_confidence double, keywords array<string>")
    built = reports.model(sites, scores, found, contexts, mcc)
    docs = {r["site_id"]: json.loads(r["report"]) for r in reports.as_json(built).collect()}
    assert docs[1]["summary"] == {"overall_score": 60, "rating": "Fair", "pass": False, "critical_issues": docs[1]["summary"]["critical_issues"], "recommendation": f"This site is partially compliant with a fair rating (score: 60/100). {docs[1]['summary']['critical_issues']} critical issue(s) require attention."}
    assert docs[2]["summary"]["recommendation"] == "This site is compliant with a good rating (score: 95/100). No critical issues found." and docs[2]["issues"] == [] and docs[2]["mcc"]["code"] == "5734"
    assert docs[3]["meta"]["domain"] == "unknown" and docs[3]["summary"]["rating"] == "Unknown" and not docs[3]["summary"]["pass"] and docs[3]["context"]["primary"] == "UNKNOWN"
    high = [i for i in docs[1]["issues"] if i["severity"] == "HIGH"]
    medium = [i for i in docs[1]["issues"] if i["severity"] == "MEDIUM"]
    assert docs[1]["recommendations"] == list(dict.fromkeys([i["fix"] for i in high[:3]] + [i["fix"] for i in medium[:2]]))
    texts = {r["site_id"]: r["report"] for r in reports.as_markdown(built).collect()}
    assert texts[2] == "\n".join([
        "# Site Compliance Report\n", "## Overview\n", "- **URL**: https://b.example/", "- **Scan Date**: 2024-01-02", "- **Scan ID**: scan-2", "- **Business Context**: UNKNOWN", "- **Overall Score**: 95/100 (Good)", "- **Status**: ✅ Pass\n",
        "## Executive Summary\n", "This site is compliant with a good rating (score: 95/100). No critical issues found.\n", "No issues identified.\n",
        "## Compliance Breakdown\n", "- **Overall Score**: 95/100", "- **Technical**: 30/30", "- **Policy**: 40/40", "- **Trust & Risk**: 25/30",
        "\n## Business Context\n", "- **Primary Context**: UNKNOWN", "- **Confidence**: 0.00%", "- **Status**: UNDETERMINED", "- **Frontend Surface**: UNKNOWN",
        "\n## MCC Classification\n", "- **Primary MCC**: 5734 - Software stores", "- **Category**: Retail", "- **Confidence**: 50.00%", "- **Keywords Matched**: software, cloud", "\n---\n\n*Report Version v2.1.1*",
    ])
    assert "### HIGH Severity\n\n- **Compliance issue: SSL_ERROR**\n  - Category: COMPLIANCE\n  - Required: Yes\n  - Reason: HTTPS is required for all payment processing sites\n  - Fix: Fix SSL certificate configuration\n" in texts[1] and "- **Confidence**: 87.50%" in texts[1] and "- No MCC classification available" in texts[1]
