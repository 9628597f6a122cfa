"""Products from headings and sections against a walk over the page's tree, and golden pages of every tier."""

import random
import re

from plain_site import Node, Tree
from sitewarden.operators import outline as O


def string(node):
    """The one string that an element is, or None."""
    if len(node.kids) != 1:
        return None
    kid = node.kids[0]
    return string(kid) if isinstance(kid, Node) else kid


def find(node, tags, most, fits=lambda x: True):
    return [x for x in node.walk() if x.tag in tags and fits(x)][:most]


def plain_content(html):
    root, out = Tree(html).root, []

    def add(name):
        if not any(x.lower() == name.lower() for x in out):
            out.append(name)

    for s in find(root, ("section", "div"), 10, lambda x: re.search(O.SECTION, x.attrs.get("class", ""), re.I)):
        for a in find(s, ("a",), 20, lambda x: "href" in x.attrs):
            t = a.text()
            if 3 <= len(t) <= 50 and t.lower() not in O.NO_LABEL and not any(w in t.lower() for w in O.NO_PART):
                add(t)
        for h in find(s, ("h2", "h3", "h4"), 10):
            if 3 <= len(h.text()) <= 50 and h.text().lower() not in O.NO_HEADING:
                add(h.text())
    for h in find(root, ("h2", "h3", "h4"), 10, lambda x: string(x) and re.search(O.HEADING, string(x), re.I)):
        p = h.parent
        while p and p.tag not in O.HOLDERS:
            p = p.parent
        for x in find(p, ("a", "h3", "h4"), 15, lambda x: x.tag != "a" or "href" in x.attrs) if p else ():
            if 3 <= len(x.text()) <= 50 and x.text() != h.text() and x.text().lower() not in O.NO_LABEL:
                add(x.text())
    return out[:10]


def plain_headings(html):
    out = []
    for h in find(Tree(html).root, ("h2", "h3"), 10):
        t = h.text()
        if 3 < len(t) < 100 and not any(w in t.lower() for w in O.NO_PAGE_HEADING) and not any(x.lower() == t.lower() for x in out):
            out.append(t)
    return out


def page(rng):
    names = ["Payroll", "Cards", "Our products", "Learn more", "Home", "What we do", "Features", "payroll", "Invoices & more", "ab", "Login", "Long " * 15, "Solutions for <b>shops</b>", "<span>Our services</span>", "Contact", "Hiring", ""]

    def block(depth):
        out = []
        for _ in range(rng.randint(1, 5)):
            r = rng.random()
            if r < 0.3:
                k = rng.randint(1, 5)
                out.append(f"<h{k}>{rng.choice(names)}</h{k}>")
            elif r < 0.6:
                out.append(f"<a href=/x>{rng.choice(names)}</a>")
            elif depth < 4:
                tag = rng.choice(["div", "section", "article", "ul", "p"])
                out.append(f"<{tag}{rng.choice(['', '', ' class=product-list', ' class=Features', ' class=x'])}>{block(depth + 1)}" + f"</{tag}>" * (rng.random() < 0.9))
            else:
                out.append("text<br>")
        return "".join(out)

    return "<body>" + "".join(block(0) for _ in range(4)) + "</body>"


def test_as_a_walk_over_the_tree(spark):
    rng = random.Random(6)
    pages = [page(rng) for _ in range(250)] + ["", "<p>no</p>"]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(pages)] + [(999, None)], "site_id long, html string").repartition(3)
    made = O.outlines(df).cache()
    for f, plain in ((O.content_products, plain_content), (O.heading_products, plain_headings)):
        got = {}
        for r in f(made).orderBy("site_id", "ord").collect():
            got.setdefault(r["site_id"], []).append(r["name"])
        for i, h in enumerate(pages):
            assert got.get(i, []) == plain(h), h
    made.unpersist()


def test_section_tree(spark):
    html = "<h1>a</h1><h2>b</h2><h3>c</h3><h2>d</h2><h4>e</h4><h1>f</h1>"
    rows = O.outlines(spark.createDataFrame([(1, html)], "site_id long, html string")).orderBy("open").collect()
    at = {r["open"]: r["text"] for r in rows}
    assert [(r["text"], at.get(r["under"])) for r in rows] == [("a", None), ("b", "a"), ("c", "b"), ("d", "a"), ("e", "d"), ("f", None)]


def test_golden_pages_of_all_tiers(spark):
    sections = "<div class=product-grid><h3>Alpha Pay</h3><a href=/b>Beta Cards</a><a href=/c>Learn more</a></div>"
    home = [(1, sections), (2, sections), (3, "<p>nothing</p>"), (4, "<section class=services><h2>Tax</h2><h3>About tax</h3><h4>Filing help</h4><h2>Features</h2></section>"), (5, "<a href=/x>x</a>"), (6, None)]
    inner = [(1, "<h2>Gamma Loans</h2><h2>alpha menu</h2><h3>Careers policy</h3>"), (2, "<h2>BETA CARDS</h2><h3>Delta</h3>"), (3, "<h2>Only here</h2>")]
    menu = [(1, 1, "Nav One"), (1, 2, "We're hiring"), (1, 3, "Nav Two")]
    links = [(3, 1, "Link three"), (5, 1, "Link five"), (5, 2, "Our blog"), (5, 3, "Link six")]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    out = O.extract(frame(home, "site_id long, html string"), frame(inner, "site_id long, html string"), frame(menu, "site_id long, ord int, name string"), frame(links, "site_id long, ord int, name string"))
    got = {}
    for r in out.orderBy("site_id", "rank").collect():
        got.setdefault(r["site_id"], []).append((r["name"], r["source"]))
    assert got == {
        1: [("Nav One", "navigation"), ("Nav Two", "navigation"), ("Gamma Loans", "page_headings")],
        2: [("Beta Cards", "homepage_content"), ("Alpha Pay", "homepage_content"), ("Delta", "page_headings")],
        3: [("Only here", "page_headings")],
        4: [("Tax", "homepage_content"), ("Filing help", "homepage_content")],
        5: [("Link five", "homepage_html"), ("Link six", "homepage_html")],
    }
    short = frame([(7, "<div class=feature><h2>" + "x" * 55 + "</h2></div>")], "site_id long, html string")
    none = frame([], "site_id long, ord int, name string")
    assert [r["source"] for r in O.extract(short, short.limit(0), none, none).collect()] == ["homepage_section"]
