"""The tag tokenizer against html.parser and html.unescape."""

import html
import random
from html.entities import html5
from html.parser import HTMLParser

from pyspark.sql import functions as F
from sitewarden.functions import tags as T


class Plain(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out = []

    def handle_starttag(self, tag, attrs):
        self.out.append((tag, {k: v or "" for k, v in attrs}))


def plain(text):
    p = Plain()
    p.feed(text)
    p.close()
    return p.out


def got(spark, texts, *names):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, html string").select("i", T.tags(F.col("html"), *names).alias("t"))
    return [r["t"] and [(x["tag"], x["attrs"]) for x in r["t"]] for r in df.orderBy("i").collect()]


PAGES = [
    "<link href=/x rel=canonical>", "<LINK REL='canonical' HREF='/y?a=1&amp;b=2'/>", '<meta content="a > b" name=description>', "<meta name = robots content = 'noindex'>",
    "<img src=a.png alt>", "<a href='x' href='y' title=\"it's\">t</a>", "<!-- <a href=no> --><a href=yes>", "<script src=a.js>if (a<b) document.write('<a href=no>')</script><a href=yes>",
    "<style>p:before{content:'<b>'}</style><p>", "a < b <c d=e>", "<br/><br /><hr>", "</a><a\nhref\n=\n'x'\n>", "<a href=x/y/>", "<p class='a b' id=c data-x='&lt;&#65;&#x42;&copy&hellip;'>", "no tags", "",
    "<a href='unclosed>text", "<textarea><b>", "<input disabled value=''>", "<a title='\n\t x'>", "<svg viewBox='0 0 1 1'><path d=M0/></svg>", "<!doctype html><html lang=en>", "<a href=?q=1&x=2>",
]


def test_pages(spark):
    assert got(spark, [*PAGES, None]) == [*map(plain, PAGES), None]


def test_random_tags(spark):
    rng = random.Random(5)
    values = ["a", "/x/y", "a b", "a>b", "<", "", "&amp;", "&lt;x&gt;", "&eacute;", "&#233;", "&#xE9;", "é", "a=b", "x/", "&nbsp;", "&unknown;", "&"]

    def attribute():
        name, v = rng.choice(["href", "REL", "name", "content", "data-a", "x:y", "Alt"]), rng.choice(values)
        kinds = [f'{name}="{v}"', f"{name}='{v}'", f"{name} = \"{v}\"", name]
        if v and not any(c in v for c in " >\"'"):
            kinds.append(f"{name}={v}")
        return rng.choice(kinds)

    def page():
        parts = []
        for _ in range(rng.randint(1, 6)):
            tag = rng.choice(["a", "LINK", "meta", "p", "h1"])
            parts.append(f"<{tag}{''.join(rng.choice([' ', '  ', chr(10)]) + attribute() for _ in range(rng.randint(0, 4)))}{rng.choice(['', ' ', ' /'])}>" + rng.choice(["", "text", "</p>", "<!-- <a> -->"]))
        return "".join(parts)

    pages = [page() for _ in range(1500)]
    assert got(spark, pages) == list(map(plain, pages))
    assert got(spark, pages, "link", "meta") == [[x for x in plain(p) if x[0] in ("link", "meta")] for p in pages]


def test_every_entity(spark):
    texts = [f"a&{n}b" for n in html5] + [f"&#{n};" for n in (0, 1, 9, 10, 13, 11, 65, 127, 128, 129, 150, 159, 160, 0x1F600, 0xD800, 0xFFFE, 0x10FFFF, 0x110000, 10**12)]
    texts += ["&#x41 &#X42;", "&", "&&", "& amp;", "&amp", "&ampx", "&notit;", "&notin;", "&;", "&#;", "&#x;", "a&b&c", "&" + "x" * 40 + ";", "&lt&gt"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.unescape(F.col("t")).alias("u")).orderBy("i").collect()
    wrong = [(t, r["u"], html.unescape(t)) for t, r in zip(texts, rows) if r["u"] != html.unescape(t)]
    assert not wrong, wrong[:8]


def test_first_attribute_and_long_pages(spark):
    page = "<link rel='Alternate Canonical' href=/c><link rel=canonical href=/second>" + "<p x='" + "y" * 300_000 + "'>" + "<i a=1 b=2>" * 20_000
    df = spark.createDataFrame([(page,), ("<p>",), (None,)], "html string")
    rows = df.select(T.first_attribute(T.tags(F.col("html"), "link"), "href", ("rel", "canonical")).alias("c"), F.size(T.tags(F.col("html"))).alias("n")).collect()
    assert [r["c"] for r in rows] == ["/c", None, None] and [r["n"] for r in rows[:2]] == [20_003, 1]


def test_seo_reads_tags_in_any_form(spark):
    from sitewarden.operators import pages

    html = "<head><title>t</title><meta content='d' name=description><LINK href=/x rel=canonical><meta content=NoIndex name='robots'></head>"
    rows = [(1, html, True, True), (2, "<meta name=description>", True, True), (3, None, False, False)]
    got = {r["page_id"]: r for r in pages.seo_score(spark.createDataFrame(rows, "page_id long, html string, sitemap_found boolean, robots_txt_found boolean")).collect()}
    assert (got[1]["desc_len"], got[1]["has_canonical"], got[1]["indexable"]) == (1, True, False)
    assert (got[2]["desc_len"], got[2]["has_canonical"], got[2]["indexable"]) == (0, False, True)
