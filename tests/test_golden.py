"""Values that are known by hand, as in scoring rules and url handling."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from sitewarden.functions import urls as U
from sitewarden.functions.sqltext import SPARK
from sitewarden.operators import changes, compliance, crawl, mcc, pages, research, risk, signals, tasks
from sitewarden.rules import mcc as MR, pages as PR, policies as PO, risk as RR, tech as TR
from sitewarden.sources import files
from sitewarden.streaming import events


def one(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())], list(cols)).select(F.expr(expr).alias("x")).first()["x"]


def test_rule_sizes():
    assert len(PR.PAGE_PATTERNS) == 12 and sum(len(u) for _, u, _ in PR.PAGE_PATTERNS) == 58 and sum(len(t) for _, _, t in PR.PAGE_PATTERNS) == 40
    assert sum(len(p) for _, p in PO.SCORED) == 42 and len(PR.CONTENT_URLS) == 14 and len(PR.SKIP_URLS) == 11
    assert len(MR.MCC) == 26 and sum(len(r[4]) for r in MR.MCC) == 135
    assert len(TR.CMS) == 7 and len(TR.ANALYTICS) == len(TR.PAYMENTS) == len(TR.FRAMEWORKS) == len(TR.HOSTING) == 6


@pytest.mark.parametrize("url,want", [
    ("https://Example.com/page#section", "https://example.com/page"), ("https://example.com/about/", "https://example.com/about"), ("https://example.com/", "https://example.com/"),
    ("HTTPS://EXAMPLE.com/P?utm=1&page=2&a=3&id=9&product=", "https://example.com/P?id=9&page=2"), ("https://e.com", "https://e.com/"), ("https://e.com/a;v=1?id=2&id=1", "https://e.com/a?id=2&id=1"),
])
def test_normalize(spark, url, want):
    assert one(spark, U.normalize(SPARK, "u"), u=url) == want


@pytest.mark.parametrize("url,want", [("https://www.example.com/a", True), ("https://blog.example.com", True), ("https://example.com", True), ("https://other.com", False), ("https://notexample.com", False)])
def test_internal(spark, url, want):
    assert one(spark, U.is_internal(SPARK, "u", "'example.com'"), u=url) is want


@pytest.mark.parametrize("url,kind,least", [
    ("https://e.com/privacy-policy", "privacy_policy", 0.9), ("https://e.com/terms-and-conditions", "terms_conditions", 0.9), ("https://e.com/about-us", "about", 0.9), ("https://e.com/pricing", "pricing", 0.9),
    ("https://e.com/a.pdf", "skip", 1.0), ("javascript:void(0)", "skip", 1.0), ("https://e.com/zzz", "other", 0.0), ("https://e.com/blog/privacy-policy", "blog", 0.9),
])
def test_classify(spark, url, kind, least):
    got = crawl.classify(spark.createDataFrame([(url, "")], "url string, anchor string")).first()
    assert got["page_type"] == kind and got["confidence"] >= least


def test_classify_nulls(spark):
    rows = crawl.classify(spark.createDataFrame([(None, None), ("", "")], "url string, anchor string")).collect()
    assert {r["page_type"] for r in rows} == {"other"}


@pytest.mark.parametrize("msg,status,want", [("Connection timed out", None, "timeout"), ("SSL: bad certificate", None, "ssl"), ("DNS lookup", None, "dns"), ("x", 403, "blocked"), ("x", 404, "http_error"), ("x", None, "unknown")])
def test_error_types(spark, msg, status, want):
    assert spark.createDataFrame([(msg, status)], "m string, s int").select(crawl.error_type(F.col("m"), F.col("s"))).first()[0] == want


FACTS = "site_id int, ssl_ok boolean, age_days int, has_dummy boolean, primary_context string, context_status string, found_privacy_policy boolean, found_terms_condition boolean, found_returns_refund boolean, found_contact_us boolean, n_crypto int, n_gambling int, n_adult int, n_pharmacy int"


@pytest.mark.parametrize("context,found,crypto,want", [
    ("BLOCKCHAIN_INFRASTRUCTURE", (True, True, False, False), 1, (40, 30, 100, "Good")), ("ECOMMERCE_MERCHANT", (True, True, False, True), 0, (30, 30, 90, "Good")),
    ("SAAS_PRODUCT", (True, True, False, True), 0, (40, 30, 100, "Good")), ("ECOMMERCE_MERCHANT", (True, True, True, True), 1, (40, 25, 95, "Good")),
])
def test_compliance(spark, context, found, crypto, want):
    row = (1, True, 2000, False, context, "DETERMINED", *found, crypto, 0, 0, 0)
    got = compliance.score(spark.createDataFrame([row], FACTS)).first()
    assert (got["policy_score"], got["trust_score"], got["total_score"], got["rating"]) == want


def test_severities_and_reasons(spark):
    """Every kind of issue: severity and reason by hand."""
    rows = [
        ("ssl_missing", None, None, "FINTECH", None, None, None), ("ssl_error", None, None, "FINTECH", None, None, None), ("domain_age_low", None, None, "X", 10, None, None), ("domain_age_low", None, None, "X", 200, None, None),
        ("domain_age_low", None, None, "X", 400, None, None), ("policy_missing", None, "required", "X", None, None, "Privacy Policy"), ("policy_missing", None, "optional", "X", None, None, "Refund Policy"),
        ("policy_missing", None, "n/a", "X", None, None, "Refund Policy"), ("restricted_content", "crypto", None, "FINTECH_INFRASTRUCTURE", None, "bitcoin", None), ("restricted_content", "crypto", None, "X", None, "bitcoin", None),
        ("restricted_content", "gambling", None, "X", None, "casino", None), ("restricted_content", "forex", None, "X", None, "fx", None), ("dummy_text", None, None, "X", None, None, None),
        ("compliance_failure", "ssl_valid", None, "X", None, None, None), ("compliance_failure", "redirects", None, "X", None, None, None),
    ]
    df = spark.createDataFrame(rows, "kind string, category string, expectation string, context string, age int, keyword string, policy string").coalesce(1)
    c = {n: F.col(n) for n in df.columns}
    got = df.select(compliance.severity(c["kind"], c["category"], c["expectation"], c["context"], c["age"]).alias("s"), compliance.reason(c["kind"], c["category"], c["expectation"], c["context"], c["age"], c["keyword"], c["policy"]).alias("r")).collect()
    assert [r["s"] for r in got] == ["HIGH", "HIGH", "HIGH", "MEDIUM", "LOW", "HIGH", "MEDIUM", "LOW", "LOW", "MEDIUM", "HIGH", "MEDIUM", "MEDIUM", "HIGH", "MEDIUM"]
    want = {
        2: "Domain age < 6 months indicates high risk for payment processing", 5: "Privacy Policy is required for X businesses", 6: "Refund Policy is optional for X but recommended", 7: "Refund Policy is not applicable for X",
        8: "Crypto content is expected for FINTECH_INFRASTRUCTURE businesses", 9: "Crypto content detected in X context may require review", 11: "Restricted keyword 'fx' detected in forex category",
        13: "ssl_valid failure prevents payment processing", 14: "redirects failure may impact compliance",
    }
    assert {k: got[k]["r"] for k in want} == want and all(r["r"] for r in got)


def test_recommendations_in_order(spark):
    """The first three HIGH issues and the first two MEDIUM ones, in issue order, each fix once."""
    rows = [(1, 5, "HIGH", "d"), (1, 0, "HIGH", "z"), (1, 1, "HIGH", "y"), (1, 2, "HIGH", "z"), (1, 9, "MEDIUM", "b"), (1, 8, "MEDIUM", "y"), (1, 10, "MEDIUM", "a"), (1, 3, "LOW", "l"), (2, 0, "LOW", "l")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "site_id int, ord int, severity string, fix string, title string")
    assert [tuple(r) for r in compliance.recommendations(df).collect()] == [(1, "z; y; b")]
    assert [r["severity"] for r in compliance.by_severity(df.where("site_id = 1")).collect()] == ["HIGH"] * 4 + ["MEDIUM"] * 3 + ["LOW"]


def test_sitemap_queue(spark):
    """Own host only, pages only, each url once, priority before the cap."""
    urls = ["https://e.com/x", " https://e.com/x ", "https://blog.e.com/privacy", "https://e.com/a.pdf", "", "https://www.e.com/privacy-policy", None, "https://o.com/pricing"]
    df = spark.createDataFrame([(1, "https://www.E.com", i, u) for i, u in enumerate(urls)], "site_id int, base string, ord int, url string")
    assert [(r["rank_"], r["url"]) for r in crawl.sitemap_queue(df).orderBy("rank_").collect()] == [(1, "https://www.e.com/privacy-policy"), (2, "https://e.com/x")]
    assert [r["url"] for r in crawl.sitemap_queue(df, 1).collect()] == ["https://www.e.com/privacy-policy"]


SNAP = "id long, target_url string, scan_timestamp timestamp, page_hashes map<string,string>, pricing_model string, product_count int"


def test_change_intelligence(spark):
    t = dt.datetime(2024, 1, 1)
    h = lambda home, privacy: {"home": home, "privacy_policy": privacy}
    rows = [(1, "u", t, h("a", "p"), "Subscription", 1), (2, "u", t + dt.timedelta(1), h("b", "q"), "Subscription", 1), (3, "u", t + dt.timedelta(2), h("b", "q"), "Subscription", 1), (4, "u", t + dt.timedelta(3), h(None, "q"), None, 1)]
    got = {r["id"]: r for r in changes.intelligence(spark.createDataFrame(rows, SNAP)).collect()}
    assert got[1]["overall_severity"] == "none" and got[1]["summary"] == "No significant changes detected"
    assert got[2]["overall_severity"] == "critical" and "1 critical" in got[2]["summary"] and "1 minor" in got[2]["summary"] and got[2]["recommended_action"].startswith("Re-run legal")
    assert got[3]["overall_severity"] == "minor" and got[3]["confidence"] == 1.0
    assert got[4]["summary"].startswith("Detected 1 critical, 1 minor changes") and "Subscription to Unknown" in got[4]["summary"]


def test_every_page_of_the_map(spark):
    """Each key of the current map is compared; rules of terms, product and pricing pages fire."""
    t = dt.datetime(2024, 1, 1)
    old = {"home": "1", "privacy_policy": "1", "terms_conditions": "1", "product": "1", "pricing": "1", "about": "1", "gone": "1"}
    new = {"home": "2", "privacy_policy": "2", "terms_conditions": "2", "product": "2", "pricing": "2", "about": "2", "fresh": "1"}
    snaps = spark.createDataFrame([(1, "u", t, old, None, 3), (2, "u", t + dt.timedelta(1), new, None, 3), (3, "u", t + dt.timedelta(2), None, None, 3)], SNAP)
    got = {r["where_"]: (r["severity"], r["business_impact"], r["confidence"]) for r in changes.enrich(changes.detect(snaps)).collect()}
    assert got == {
        "home": ("minor", "Routine marketing refresh", 0.7), "privacy_policy": ("critical", "Legal & compliance risk exposure", 1.0), "terms_conditions": ("critical", "Contractual terms update risk", 1.0),
        "product": ("moderate", "Core offering scope or messaging evolution", 0.85), "pricing": ("critical", "Fundamental revenue model shift detected", 0.95), "about": ("minor", "General content update", 0.6),
    }
    row = {r["id"]: r for r in changes.intelligence(snaps).collect()}
    assert row[2]["summary"].startswith("Detected 3 critical, 1 moderate, 2 minor changes — dominated by ") and row[2]["confidence"] == 0.85
    assert row[3]["summary"] == "No changes detected." and row[1]["confidence"] is None
    more = changes.append(snaps, spark.createDataFrame([(4, "u", {"home": "3", "about": ""}, None, 3)], "id long, target_url string, page_hashes map<string,string>, pricing_model string, product_count int"), F.lit(t + dt.timedelta(3)))
    assert changes.latest(more).first()["page_hashes"] == {"home": "3"} and more.columns == snaps.columns


def test_keyword_table(spark):
    """All categories and keywords, each found in a text that holds it, and nothing in others."""
    assert len(RR.RESTRICTED) == 50 and sum(len(w) for _, w in RR.RESTRICTED) == 396
    words = [k for _, ws in RR.RESTRICTED for k in ws]
    rows = [(1, str(i), f"before {k} after") for i, k in enumerate(words)] + [(2, "plain", "an ordinary page")]
    got = {}
    for r in risk.findings(spark.createDataFrame(rows, "site_id int, page_url string, page_text string")).collect():
        got.setdefault(r["page_url"], set()).add(r["keyword"])
    assert all(k in got[str(i)] for i, k in enumerate(words)) and "plain" not in got


def test_keyword_hits_by_brute_force(spark):
    """The anchors change nothing: hits equal plain tests of every keyword."""
    rng = random.Random(5)
    pieces = sorted({w for _, ws in RR.RESTRICTED for k in ws for w in k.replace("-", " ").split()})
    texts = [" ".join("".join(rng.choice([w, w[:-1], w + "s", w + rng.choice(pieces)]) for _ in range(1)) for w in rng.choices(pieces, k=12)) for _ in range(150)] + ["", None]

    def holds(text, k):
        plain = k.replace("-", " ")
        return k in text or plain in text or (" " in plain and re.search(r"\b" + r"\b.*\b".join(map(re.escape, plain.split())) + r"\b", text) is not None)

    want = {(str(i), n) for i, t in enumerate(texts) if t for n, k in enumerate(k for _, ws in RR.RESTRICTED for k in ws) if holds(t, k)}
    found = risk.findings(spark.createDataFrame([(1, str(i), t) for i, t in enumerate(texts)], "site_id int, page_url string, page_text string"))
    assert {(r["page_url"], r["kw_ord"]) for r in found.collect()} == want and len(want) > 50


@pytest.mark.parametrize("html,cms", [
    ('<meta name="shopify" content="x">', "Shopify"), ('<script src="https://cdn.shopify.com/a.js">', "Shopify"), ('<meta name="generator" content="WordPress 6">', "WordPress"), ("<p>shopify</p>", "Custom"),
])
def test_cms(spark, html, cms):
    assert pages.technologies(spark.createDataFrame([(1, html)], "page_id int, html string")).first()["cms"] == cms


def test_sitemap_escapes(spark):
    xml = "<loc> https://e.com/?a=1&amp;b=2&#38;c=&quot;x&quot; </loc><loc>https://e.com/&amp;lt;</loc>"
    assert [r["url"] for r in crawl.sitemap_urls(spark.createDataFrame([(1, xml)], "site_id int, content string")).orderBy("ord").collect()] == ['https://e.com/?a=1&b=2&c="x"', "https://e.com/&lt;"]


def test_unknown_change(spark):
    row = changes.enrich(spark.createDataFrame([("u", 1, 0, "new_thing", "x", "minor", "d")], "target_url string, id long, ord int, type string, where_ string, severity string, description string")).first()
    assert row["business_impact"] == "Unclassified change detected" and row["severity"] == "minor"


def test_admission_and_required(spark):
    rows = [(1, 0, "u0", "c", "about", 0.5, 200), (1, 1, "u1", "c", "about", 0.9, 200), (1, 2, "u2", None, "about", 0.8, 200), (1, 3, "u3", None, "other", 0.0, 200), (1, 4, "u3", None, "other", 0.0, 200)]
    got = crawl.admit(spark.createDataFrame(rows, "site_id int, ord int, url string, canonical string, page_type string, confidence double, status int"))
    assert sorted(r["ord"] for r in got.collect()) == [2, 4]


def test_robots(spark):
    content = "User-agent: *\nDisallow: /private\nAllow: /private/open\nUser-agent: bot\nUser-agent: *\nDisallow: /a*b\nDisallow:\n# x\nbad line"
    rules = crawl.robots_rules(spark.createDataFrame([(1, content)], "site_id int, content string"))
    urls = spark.createDataFrame([(1, "https://e.com" + p) for p in ("/private/x", "/private/open/y", "/axxb", "/z", "")] + [(2, "https://f.com/private")], "site_id int, url string")
    assert {r["url"][13:]: r["allowed"] for r in crawl.allowed(urls, rules).where("site_id = 1").collect()} == {"/private/x": False, "/private/open/y": True, "/axxb": False, "/z": True, "": True}
    assert crawl.allowed(urls, rules).where("site_id = 2").first()["allowed"] is True


def test_keywords(spark):
    df = spark.createDataFrame([(1, "a", "women play sports betting with herbal drugs"), (1, "b", "online\ncasino"), (2, "c", "")], "site_id int, page_url string, page_text string")
    got = {(r["page_url"], r["category"], r["keyword"]) for r in risk.findings(df).collect()}
    assert {("a", "gambling", "sports-betting"), ("a", "pharmacy", "herbal drugs"), ("a", "drugs", "herbal drugs"), ("b", "gambling", "casino")} <= got and ("b", "gambling", "online-casino") not in got
    assert not [x for x in got if x[0] == "c"]
    assert risk.site_scores(df).where("site_id = 2").first()["risk_score"] == 0


def test_keyword_table_is_a_parameter(spark, tmp_path):
    (tmp_path / "k.json").write_text('{"x": ["foo-bar"]}')
    df = spark.createDataFrame([(1, "a", "foo bar")], "site_id int, page_url string, page_text string")
    assert [r["category"] for r in risk.findings(df, RR.load_keywords(str(tmp_path / "k.json"))).collect()] == ["x"]


def test_stuck_null_branch(spark):
    t = dt.datetime(2024, 1, 1, 12)
    rows = [(1, "a", "processing", t - dt.timedelta(hours=2), t), (2, "a", "processing", None, t - dt.timedelta(hours=2)), (3, "a", "processing", None, t), (4, "a", "completed", t - dt.timedelta(hours=9), t)]
    df = spark.createDataFrame(rows, "id int, action string, status string, started_at timestamp, created_at timestamp")
    assert sorted(r["id"] for r in tasks.stuck_tasks(df, F.lit(t)).collect()) == [1, 2]


def test_links(spark):
    html = '<nav><ul><li><a href="/about">About <b>Us</b></a></ul></nav><p><b>x<a href="#t">t</a><a href="mailto:x@y.z">m</a><a href="p?q=1">P<script>var t="</p>";</script>'
    rows = pages.extract_links(spark.createDataFrame([(1, "https://e.com/d/", html), (2, None, None)], "page_id long, url string, html string")).collect()
    assert [(r["url"], r["region"]) for r in rows] == [("https://e.com/about", "nav"), ("https://e.com/d/p?q=1", "body")] and rows[0]["anchor"] == "about us"


def test_sources(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "s1.txt").write_text("User-agent: *\nDisallow: /x")
    assert files.robots_files(spark, str(tmp_path / "r")).first()["site_id"] == "s1"
    (tmp_path / "c.json").write_text('[{"mcc": "5411", "description": "Grocery"}, {"mcc": "5812"}]')
    assert files.code_table(spark, str(tmp_path / "c.json")).count() == 2
    assert mcc.parse_code_lines(spark.createDataFrame([("5411 Grocery",), ("no",)], "value string")).collect()[0]["description"] == "Grocery"
    body = '{"events":[{"eventAction":"registration","eventDate":"2020-01-01T00:00:00Z"},{"eventAction":"registration","eventDate":"2021-01-01"}],"nameservers":[{"ldhName":"NS1.X"}],"secureDNS":{"delegationSigned":true}}'
    got = files.registry_facts(spark.createDataFrame([(1, body), (2, "bad")], "site_id int, body string"), F.to_date(F.lit("2020-01-31"))).orderBy("site_id").collect()
    assert got[0]["age_days"] == 30 and got[0]["name_servers"] == ["ns1.x"] and got[0]["signed"] and got[1]["registered"] is None
    df = spark.createDataFrame([('```json\n{"a":1}\n```', "<html><head><t>", "https://e.com")], "t string, h string, u string")
    r = df.select(files.tolerant_json(F.col("t")).alias("j"), files.with_base(F.col("h"), F.col("u")).alias("b"), files.networks(F.lit("{a,b}")).alias("n")).first()
    assert r["j"] == '{"a":1}' and r["b"] == '<html><head><base href="https://e.com"><t>' and r["n"] == ["a", "b"]


def test_evidence(spark):
    rows = [("u", "r", "s", 120.0, None), ("u", "r", "s", None, "critical"), ("u", "r", "s", None, None), ("", "r", "s", 50.0, "critical"), (None, "r", "s", 50.0, None)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d double, e string")
    got = [r["x"] for r in df.select(signals.evidence(*(F.col(c) for c in "abcde")).alias("x")).collect()]
    assert [(g["confidence"], g["severity"], g["missing_fields"]) for g in got] == [(100.0, None, False), (None, "critical", False), (0.0, "info", False), (0.0, "info", True), (0.0, "info", True)]


def test_products(spark):
    rows = [(1, 0, "https://e.com/x", "Card Kit", True), (1, 1, "https://e.com/products/pay-link", "", False), (1, 2, "https://e.com/y", "Our careers", False), (1, 3, "https://e.com/z", "Team", False), (1, 4, "https://e.com/w", "card kit", False), (2, 0, None, None, False)]
    got = [(r["site_id"], r["name"], r["tier"]) for r in research.products(spark.createDataFrame(rows, "site_id int, link_ord int, url string, anchor string, in_menu boolean")).orderBy("site_id", "rank_").collect()]
    assert got == [(1, "Card Kit", 1), (1, "Pay Link", 2), (1, "Team", 3)]


def test_stuck_alerts_and_messages(spark, tmp_path):
    """A processing task that the watermark leaves behind is reported once; a finished one isn't."""
    t0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [[(1, "processing", t0), (2, "processing", t0)], [(2, "completed", t0 + dt.timedelta(minutes=10))], [(3, "completed", t0 + dt.timedelta(hours=9))], [(4, "completed", t0 + dt.timedelta(hours=10))]]
    for k, part in enumerate(rows):
        spark.createDataFrame(part, "id long, status string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("id long, status string, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = events.run_to_end(events.stuck_alerts(events.timed(stream, "1 minute")), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert [r["id"] for r in out.collect()] == [1]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.json").write_text('{"taskId":"1","action":"site_scan","input":{"topic":"x","filters":{"business_name":"b"}}}\nnot json\n{"other":1}\n')
    got = events.run_to_end(events.task_source(spark, f"{tmp_path}/m"), f"{tmp_path}/o2", f"{tmp_path}/c2")
    assert [r["taskId"] for r in got.collect()] == ["1"]


def test_all_restricted_categories(spark):
    assert len(RR.RESTRICTED) == 50 and sum(len(words) for _, words in RR.RESTRICTED) == 396 and len(dict(RR.RESTRICTED)) == 50
    assert set(RR.CRITICAL_IF_CORROBORATED) | set(RR.PENALTY) <= set(dict(RR.RESTRICTED))
    every = [(c, k) for c, words in RR.RESTRICTED for k in words]
    pages_ = spark.createDataFrame([(n, f"u{n}", f"we have {k} here") for n, (_, k) in enumerate(every)], "site_id int, page_url string, page_text string")
    found = {(r["site_id"], r["category"], r["keyword"], r["kw_ord"]) for r in risk.findings(pages_).collect()}
    assert {(n, c, k, n) for n, (c, k) in enumerate(every)} <= found
    two = spark.createDataFrame([(1, "a", "underage"), (1, "b", "underage"), (2, "a", "underage")], "site_id int, page_url string, page_text string")
    assert sorted((r["site_id"], r["category"], r["severity"]) for r in risk.corroborate(risk.findings(two)).collect()) == [(1, "child_pornography", "critical")] * 2 + [(2, "child_pornography", "moderate")]
    assert {r["site_id"]: r["risk_score"] for r in risk.site_scores(two).collect()} == {1: 40, 2: 20}
