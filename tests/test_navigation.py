"""Navigation discovery against a walk over the page's tree."""

import random

import pytest
from plain_site import navigation as plain
from sitewarden.operators import navigation as N

BASE = "https://www.shop.example/start/"
# Queries without escapes: those, normalising keeps as they are.
HREFS = ["/", "/privacy-policy", "terms", "../about-us", "/contact/", "https://shop.example/pricing", "//help.shop.example/faq", "https://other.example/x", "#top", "mailto:a@b", "tel:1", "javascript:void(0)", "/a.pdf", "/blog/privacy-policy", "/item?id=2&x=1", "/item?id=2", "/p#frag", "/refund-policy", "?page=3", "/products/", "/PRODUCTS", "docs"]
TEXTS = ["Privacy Policy", "terms", "Our <b>Story</b>", "", "Contact us", "a &amp; b", "<script>x</script>Shop", " Plans\n and pricing "]


def page(rng):
    def block(depth):
        out = []
        for _ in range(rng.randint(1, 4)):
            r = rng.random()
            if r < 0.5 or depth > 4:
                out.append(f"<a href='{rng.choice([h for h in HREFS if '?' not in h])}/{rng.randint(0, 30)}'>{rng.choice(TEXTS)}</a>" if rng.random() < 0.5 else f"<a class=nav-link href='{rng.choice(HREFS)}'>{rng.choice(TEXTS)}</a>")
            elif r < 0.6:
                out.append(rng.choice(["text", "<br>", "<img src=x>", "<a name=n>no link</a>", "</div>", "<p>", "<!-- <nav><a href=/no>no</a></nav> -->", "<a href=/open>open <b>link"]))
            else:
                tag = rng.choice(["nav", "header", "footer", "div", "div", "ul", "main", "section"])
                attr = rng.choice(["", "", " class='main-menu'", " id=sitenav", " class='x content'", " id=content", " class=navbar id=menu", " id='topmenu'"])
                out.append(f"<{tag}{attr}>{block(depth + 1)}" + (f"</{tag}>" if rng.random() < 0.9 else ""))
        return "".join(out)

    return f"<html><head><title>t</title></head><body>{block(0)}{block(0)}</body></html>" if rng.random() < 0.9 else block(0)


def got(spark, pages, flags=None):
    rows = [(i, BASE, h, bool(flags and flags[i])) for i, h in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, found boolean")
    out = N.links(df, sitemap_found="found" if flags else None).orderBy("page_id", "rank").collect()
    by = {i: [] for i in range(len(pages))}
    for r in out:
        assert r["rank"] == len(by[r["page_id"]]) + 1
        by[r["page_id"]].append({k: r[k] for k in ("url", "norm", "text", "source", "page_type", "confidence")})
    return by


@pytest.mark.parametrize("seed", [1, 2])
def test_as_a_walk_over_the_tree(spark, seed):
    rng = random.Random(seed)
    pages = [page(rng) for _ in range(250)]
    flags = [k % 3 == 0 for k in range(len(pages))]
    first, both = got(spark, pages), got(spark, pages, flags)
    for i, h in enumerate(pages):
        assert first[i] == plain(h, BASE), h
        assert both[i] == plain(h, BASE, flags[i]), h
    assert {x["source"] for v in both.values() for x in v} == {"nav", "header", "footer", "menu", "content", "body"}


def test_limits(spark):
    six = "".join(f"<div class=menu><a href=/m{k}>m</a></div>" for k in range(7))
    rest = "".join(f"<a href=/r{k}>r</a>" for k in range(80))
    navs = "".join(f"<nav><a href=/n{k}>n</a></nav>" for k in range(30))
    html = f"<body>{navs}<header><a href=/h1>1</a></header><header><a href=/h2>2</a></header>{six}{rest}</body>"
    out = got(spark, [html], [False])[0]
    assert out == plain(html, BASE, False)
    sources = [x["source"] for x in out]
    assert (sources.count("nav"), sources.count("header"), sources.count("menu"), sources.count("body")) == (30, 1, 5, 50)


def test_intervals(spark):
    df = spark.createDataFrame([(1, "<nav><a href=x>A<b>b</b></a><div class=content></div></nav><a href>y"), (2, None), (3, "")], "page_id long, html string")
    rows = {(r["page_id"], r["open"]): r for r in N.elements(df).collect()}
    nav, a, div, last = (rows[1, k] for k in sorted(k for p, k in rows if p == 1))
    assert nav["open"] < a["open"] < a["close"] < div["open"] < div["close"] < nav["close"] < last["open"]
    assert (a["text"], a["href"], a["depth"], div["class"], last["href"], last["text"]) == ("Ab", "x", 1, "content", "", "y")
    assert {p for p, _ in rows} == {1}
    empty = df.where("page_id > 9").selectExpr("page_id", "'https://a/' AS url", "html")
    assert N.links(empty).count() == 0
