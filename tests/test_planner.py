"""The crawl planner, sitemaps, attempts and the crawl by breadth against plain queues."""

import os
import random

import plain_site as P
import pytest
from sitewarden.operators import attempts, planner, sitemaps
from sitewarden.plans import catalogue
from sitewarden.session import release
from sitewarden.sources.views import read_table, view

LOG = "site_id long, url string, attempt int, status int, failure string, final_url string, content_type string, body string"
PATHS = ["/privacy-policy", "/terms", "/terms-of-service", "/about-us", "/contact", "/pricing", "/products", "/solutions", "/faq", "/docs", "/blog/1", "/x", "/y?id=3", "/data-protection", "/refund-policy", "/a.pdf", "/deep/one"]


def site(rng, k):
    """(seed, url -> attempts) of a made-up site."""
    root = f"https://www.s{k}.example"
    urls = [root + p for p in rng.sample(PATHS, rng.randint(2, len(PATHS)))] + [f"{root}/item/{n}" for n in range(rng.choice([0, 3, 40]))]
    rng.shuffle(urls)

    def html(depth=0):
        part = lambda n: "".join(f"<a href='{rng.choice(urls).removeprefix(root if rng.random() < 0.7 else '')}'>{rng.choice(['Privacy Policy', 'terms', 'About us', 'x', ''])}</a>" for _ in range(n))
        canonical = rng.choice(["", "", f"<link rel=canonical href='{rng.choice(urls).removeprefix(root)}'>"])
        linked = rng.choice(["", "<link href=/map.xml rel='sitemap'>"])
        return f"<html><head><title>{rng.choice(['Home', 'Privacy policy', 'FAQ', 'About us'])}</title>{canonical}{linked}</head><body><nav>{part(rng.randint(0, 6))}</nav><div class=menu>{part(2)}</div><main>{part(rng.randint(0, 25))}</main><footer>{part(rng.randint(0, 5))}</footer></body></html>"

    def tries():
        r = rng.random()
        ok = (200, None, "text/html; charset=utf-8", html())
        if r < 0.6:
            return [ok]
        return rng.choice([[(404, None, "text/html", "<p>no</p>")], [(503, None, "text/html", ""), ok], [(500, None, "", "")] * 2, [(None, "timeout", None, None), ok], [(None, "timeout", None, None)] * 2, [(None, "Connection reset", None, None)] * 3, [(200, None, "application/json", "{}")], [(410, None, "text/html", "gone")], [ok, (500, None, "", "")], [(503, None, "", "")]])

    log = {u: tries() for u in urls if rng.random() < 0.9}
    log[f"{root}/"] = [(200, None, "text/html", html())] if rng.random() < 0.9 else tries()
    if rng.random() < 0.5:
        log[f"{root}/robots.txt"] = [(rng.choice([200, 200, 404]), None, "text/plain", rng.choice(["User-agent: *\nDisallow: /item\nAllow: /item/1\n", "User-agent: *\nDisallow: /terms*\n", "user-agent: other\ndisallow: /\n", "User-agent: *\nDisallow: /\n"]) + rng.choice(["", f"Sitemap: {root}/one.xml\nSITEMAP: {root}/two.xml\r\n", f"Sitemap: {root}/none.xml\n"]))]
    listing = lambda us: "<urlset>" + "".join(f"<url><loc> {u} </loc></url>" for u in us) + "</urlset>"
    index = lambda us: "<sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in us) + "</sitemapindex>"
    some = lambda: rng.sample(urls, rng.randint(1, len(urls))) + rng.choice([[], ["https://elsewhere.example/terms", urls[0]]])
    for name in ("one.xml", "two.xml", "sitemap.xml", "sitemap-index.xml", "map.xml", "child.xml"):
        if rng.random() < 0.3:
            body = rng.choice([listing(some()), listing([]), index([f"{root}/child.xml", f"{root}/gone.xml", f"{root}/two.xml", f"{root}/one.xml"]), index([f"{root}/sitemap.xml", f"{root}/child.xml"])])
            log[f"{root}/{name}"] = [(200, None, "application/xml", body)]
    return f"{root}/", log


def tables(spark, sites):
    rows = [(k, u, n, *t[:2], None, *t[2:]) for k, (_, log) in sites.items() for u, ts in log.items() for n, t in enumerate(ts)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame([(k, seed) for k, (seed, _) in sites.items()], "site_id long, url string"), spark.createDataFrame(rows, LOG).repartition(3)


@pytest.mark.parametrize("rounds", [1, 3])
def test_plan_as_a_queue(spark, rounds):
    rng = random.Random(rounds)
    sites = {k: site(rng, k) for k in range(60)}
    pages, summary = planner.plan(*tables(spark, sites), rounds=rounds)
    by = {}
    for r in pages.orderBy("site_id", "ord").collect():
        assert r["ord"] == len(by.setdefault(r["site_id"], []))
        by[r["site_id"]].append((r["url"], r["source"], r["depth"], r["status"], r["page_type"], r["confidence"], r["canonical"], r["error_type"], r["retries"], r["kept"]))
    totals = {r["site_id"]: r for r in summary.collect()}
    stopped = 0
    for k, (seed, log) in sites.items():
        want, total = P.plan(seed, log, rounds=rounds)
        assert by[k] == [(p["url"], p["source"], p["depth"], p["status"], p["page_type"], p["confidence"], p["canonical"], p["error"], p["retries"], p["kept"]) for p in want], k
        assert {n: totals[k][n] for n in total} == total, k
        stopped += total["stopped"]
    assert 0 < stopped < 60 and {r["sitemap_found"] for r in totals.values()} == {True, False} and len({r["reason"].rstrip("0123456789 pagesnotattempted") for r in totals.values()}) >= 2


def test_a_giant_site_and_odd_ones(spark):
    root = "https://big.example"
    nav = "".join(f"<a href=/item/{k}>x</a>" for k in range(30_000))
    giant = {f"{root}/": [(200, None, "text/html", f"<nav>{nav}<a href=/privacy>p</a></nav>")]} | {f"{root}/item/{k}": [(200, None, "text/html", "<p>")] for k in range(0, 30_000, 3)}
    sites = {1: (f"{root}/", giant), 2: ("https://none.example/", {}), 3: ("https://empty.example/", {"https://empty.example/": [(200, None, "text/html", "")]}), 4: ("https://json.example/", {"https://json.example/": [(200, None, "application/json", "{}")]})}
    typed = {"https://a.example": [(200, None, "text/html", "<nav><a href=about-us>About us</a><a href='/'>home</a></nav>")], "https://a.example/about-us": [(200, None, "text/html", "<title>About us</title>")]}
    pages, summary = planner.plan(*tables(spark, sites | {5: ("url: a.example", typed)}))
    got, totals = {}, {r["site_id"]: r for r in summary.collect()}
    for r in pages.orderBy("site_id", "ord").collect():
        got.setdefault(r["site_id"], []).append((r["url"], r["page_type"], r["kept"]))
    for k, (seed, log) in (sites | {5: ("https://a.example", typed)}).items():
        want, total = P.plan(seed, log)
        assert got[k] == [(p["url"], p["page_type"], p["kept"]) for p in want]
        assert {n: totals[k][n] for n in total} == total
    assert got[5] == [("https://a.example", "home", True), ("https://a.example/about-us", "about", True)]
    none = planner.plan(*(t.limit(0) for t in tables(spark, sites)))
    assert none[0].count() == 0 and none[1].count() == 0


def test_attempts(spark):
    rng = random.Random(4)
    kinds = [(200, None, "text/html", "ok"), (404, None, "text/html", "no"), (410, None, "text/html", "gone"), (500, None, "text/html", "x"), (503, None, "", ""), (None, "timeout", None, None), (None, "SSL: certificate", None, None), (302, None, "text/html", ""), (200, None, "image/png", "b")]
    log = {f"u{k}": [rng.choice(kinds) for _ in range(rng.randint(1, 4))] for k in range(200)}
    _, table = tables(spark, {1: ("x", log)})
    got = {r["url"]: r for r in attempts.outcomes(table).collect()}
    for u, tries in log.items():
        want = P.answer({u: tries}, u)
        r = got[u]
        error = {"SSL: certificate": "ssl"}.get(tries[want["retries"]][1], want["error"])
        assert (r["status"], r["body"], r["error_type"], r["retries"], r["waited_ms"]) == (want["status"], want["body"], error, want["retries"], 2000 * (2 ** want["retries"] - 1)), u
        assert r["pending"] == (len(tries) == 1 and (tries[0][1] is not None or tries[0][0] >= 500))
    row = attempts.counters(attempts.outcomes(table)).first()
    assert row["urls"] == 200 and row["retried"] == sum(r["retries"] for r in got.values()) and row["timeouts"] == sum("timeout" in (r["message"] or "") for r in got.values()) > 0
    assert {r["message"] for r in got.values()} == {None, "HTTP 404", "HTTP 410 Gone", "HTTP 500 after 0 retries", "HTTP 503 after 0 retries", "HTTP 500 after 1 retries", "HTTP 503 after 1 retries", "Page timeout (12s) after 0 retries", "Page timeout (12s) after 1 retries", "SSL: certificate"}
    more = attempts.outcomes(table, max_retries=2)
    assert more.agg({"retries": "max"}).first()[0] == 2


def test_sitemap_levels_and_limits(spark):
    root = "https://m.example"
    urlset = lambda us: "<urlset>" + "".join(f"<loc>{u}</loc>" for u in us) + "</urlset>"
    index = lambda us: "<SitemapIndex>" + "".join(f"<loc>{u}</loc>" for u in us) + "</SitemapIndex>"
    files = {f"{root}/sitemap.xml": index([f"{root}/i{k}.xml" for k in range(5)]), f"{root}/i0.xml": index([f"{root}/sitemap.xml", f"{root}/a.xml"]), f"{root}/i1.xml": urlset([f"{root}/b/{k}" for k in range(70)]), f"{root}/i2.xml": urlset([f"{root}/c/{k}&amp;x" for k in range(70)]), f"{root}/a.xml": urlset([f"{root}/terms", f"{root}/x.pdf", "https://sub.m.example/", f"{root}/terms"]), f"{root}/i3.xml": urlset([f"{root}/never"])}
    sites, homes = spark.createDataFrame([(1, root)], "site_id long, root string"), spark.createDataFrame([(1, "")], "site_id long, html string")
    table = spark.createDataFrame([(1, u, c) for u, c in files.items()], "site_id long, url string, content string")
    robots = table.where("false").select("site_id", "content")
    listed = lambda files_: sitemaps.listed(sitemaps.candidates(sites, robots, homes), files_)
    got = [r["url"] for r in sitemaps.discovered(sites, listed(table)).orderBy("rank").collect()]
    want = P.sitemap_urls(root, "", [], files)[0]
    assert got == [u.replace("&amp;", "&") for u in want] and len(got) <= 100
    assert sitemaps.discovered(sites, listed(table.limit(0))).count() == 0


@pytest.mark.parametrize("depth, most", [(1, 0), (2, 5), (4, 12), (4, 0), (6, 3)])
def test_breadth_as_a_queue(spark, depth, most):
    rng, links, fetched, roots, want = random.Random(depth * 10 + most), [], [], [], {}
    for s in range(12):
        host = f"https://h{s}.example:80"
        urls = [f"{host}/{k}" for k in range(40)]
        own = {u: [rng.choice(urls + [f"https://h{s}.example/{rng.randint(0, 9)}", "https://x.example/"]) for _ in range(rng.randint(0, 6))] for u in urls}
        good = {u for u in urls if rng.random() < 0.75} | ({urls[0]} if s else set())
        links += [(s, u, k, v) for u, vs in own.items() for k, v in enumerate(vs)]
        fetched += [(s, u, 200 if u in good else 404) for u in urls]
        roots.append((s, urls[0]))
        want[s] = P.breadth(urls[0], own, good, depth, most)
    hub = [(99, "https://hub.example/", k, f"https://hub.example/{k}") for k in range(20_000)]
    links += hub
    fetched += [(99, "https://hub.example/", 200)] + [(99, u, 200 if k % 2 else 500) for _, _, k, u in hub]
    roots.append((99, "https://hub.example/"))
    want[99] = P.breadth("https://hub.example/", {"https://hub.example/": [u for *_, u in hub]}, {u for _, u, s in fetched if s == 200}, depth, most)
    got = planner.by_breadth(spark.createDataFrame(roots, "site_id long, url string"), spark.createDataFrame(links, "site_id long, src string, link_ord int, dst string").repartition(3), spark.createDataFrame(fetched, "site_id long, url string, status int"), depth, most)
    by = {s: [] for s in want}
    for r in got.orderBy("site_id", "rank").collect():
        assert r["rank"] == len(by[r["site_id"]]) + 1
        by[r["site_id"]].append((r["url"], r["depth"]))
    assert by == want
    matches = spark.createDataFrame([(s, u, 2) for s, u, _ in fetched], "site_id long, url string, n int")
    totals = {r["site_id"]: (r["pages_crawled"], r["total_keyword_matches"]) for r in planner.monitored(got, matches).collect()}
    assert totals == {s: (len(v), 2 * len(v)) for s, v in want.items() if v}


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_registered_plans(spark):
    """The queries over the hosts of pages against a plain crawl of each host."""
    log = {}
    for r in view(spark, SF, "crawl_log").orderBy("site_id", "url", "attempt").collect():
        log.setdefault(r["site_id"], {}).setdefault(r["url"], []).append((r["status"], r["failure"], r["content_type"], r["body"]))
    seeds = {r["site_id"]: r["url"] for r in view(spark, SF, "crawl_sites").collect()}
    got = {}
    for r in catalogue.QUERIES["crawl_plan_rounds"](spark, SF).orderBy("site_id", "ord").collect():
        got.setdefault(r["site_id"], []).append((r["url"], r["depth"], r["status"], r["page_type"], r["error_type"], r["kept"]))
    totals = {r["site_id"]: r for r in catalogue.QUERIES["crawl_plan_summary"](spark, SF).collect()}
    for k, seed in seeds.items():
        want, _ = P.plan(seed, log[k], rounds=3)
        assert got[k] == [(p["url"], p["depth"], p["status"], p["page_type"], p["error"], p["kept"]) for p in want]
        _, total = P.plan(seed, log[k])
        assert {n: totals[k][n] for n in total} == total
    release(spark)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_registered_navigation(spark):
    pages = read_table(spark, SF, "pages").collect()
    got = {}
    for r in catalogue.QUERIES["nav_discovery"](spark, SF).orderBy("page_id", "rank").collect():
        got.setdefault(r["page_id"], []).append((r["url"], r["text"], r["source"], r["page_type"], r["confidence"]))
    for p in pages:
        assert got.get(p["page_id"], []) == [(x["url"], x["text"], x["source"], x["page_type"], x["confidence"]) for x in P.navigation(p["html"], p["url"], p["page_id"] % 2 == 0)]
