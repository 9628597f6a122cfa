"""Pages: features, links, technologies, contacts."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import html as H, sqltext as S, tags as G
from ..functions.sqltext import SPARK
from ..rules import tech as T


def seo_score(pages: DataFrame) -> DataFrame:
    """(page_id, title_len, desc_len, h1, has_canonical, indexable, seo_score, band). What meta and
    link tags say is read whatever the order and the quotes of their attributes."""
    plain = {n: e for n, e in H.seo_columns(SPARK).items() if n in ("title_len", "h1")}
    read = pages.select("page_id", "sitemap_found", "robots_txt_found", *[F.expr(e).alias(n) for n, e in plain.items()], G.tags(F.col("html"), "meta", "link").alias("tags_"))
    said = lambda attr, *fits: F.coalesce(G.first_attribute(F.col("tags_"), attr, *fits), F.lit(""))
    parts = read.select(
        "page_id", "sitemap_found", "robots_txt_found", *plain, F.length(said("content", ("name", "description"))).alias("desc_len"),
        (said("href", ("rel", "canonical")) != "").alias("has_canonical"), (~F.contains(F.lower(said("content", ("name", "robots"))), F.lit("noindex"))).alias("indexable"),
    )
    scored = parts.withColumn("seo_score", F.expr(H.seo_score_sql()))
    band = F.when(F.col("seo_score") >= 80, "good").when(F.col("seo_score") >= 50, "fair").otherwise("poor")
    return scored.select("page_id", "title_len", "desc_len", "h1", "has_canonical", "indexable", "seo_score", band.alias("band"))


def content_hashes(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.expr(H.content_hash(SPARK, "html")).alias("content_hash"))


class _Links(HTMLParser):
    """Collects links with the region that they stand in and their text."""

    REGIONS = ("nav", "header", "footer", "main", "article")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.out, self.text = [], [], None

    def handle_starttag(self, tag, attrs):
        if tag in self.REGIONS:
            self.stack.append(tag)
        elif tag == "a":
            self._end()
            if href := dict(attrs).get("href"):
                self.text = [href, self.stack[0] if self.stack else "body", []]

    def handle_endtag(self, tag):
        if tag == "a":
            self._end()
        elif tag in self.stack:
            while self.stack.pop() != tag:
                pass

    def handle_data(self, data):
        if self.text:
            self.text[2].append(data)

    def _end(self):
        if self.text:
            href, region, parts = self.text
            self.out.append((href, region, " ".join("".join(parts).split()).lower()))
            self.text = None


def extract_links(pages: DataFrame) -> DataFrame:
    """(page_id, link_ord, href, url, region, anchor) of a page's links in order: resolved against
    the page's url; fragments, scripts, mail, phone and data links left out. An HTML parser in
    Arrow batches, as regions nest; nothing but the html and its url crosses over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "link_ord", "href", "url", "region", "anchor"]
        for batch in batches:
            rows = []
            for page, base, html in zip(*(c.to_pylist() for c in batch.columns)):
                parser = _Links()
                parser.feed(html or "")
                parser.close()
                parser._end()
                n = 0
                for href, region, anchor in parser.out:
                    low = href.strip().lower()
                    if not low or low.startswith(("#", "javascript:", "mailto:", "tel:", "data:")):
                        continue
                    try:
                        url = urljoin(base or "", href.strip())
                    except ValueError:
                        continue
                    if url.startswith(("http://", "https://")):
                        rows.append((page, n, href, url, region, anchor))
                        n += 1
            cols = list(zip(*rows)) if rows else [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, link_ord int, href string, url string, region string, anchor string")


def link_counts_sql(d: S.Dialect, html: str = "html") -> str:
    """How many links with an href stand in the html, without a parser."""
    return d.size(f"regexp_extract_all({H.without_code(d, html)}, {d.text('(?i)<a [^>]*href=')}, 0)")


def tech_columns_sql(d: S.Dialect, html: str = "html") -> dict[str, str]:
    """cms, analytics, payments, frameworks (joined names) and hosting of a page."""
    def hit(patterns: tuple[str, ...]) -> str:
        return d.match(html, "(?i)" + "|".join(f"(?:{p})" for p in patterns))

    cms = [(" OR ".join([d.match(html, f'(?i)<meta[^>]*name="{meta}"' + (f"[^>]*{content}" if content else "")), hit((*scripts, *plain))]), d.text(name)) for name, (meta, content), scripts, plain in T.CMS]
    lists = {k: d.join(d.filter(d.array([f"CASE WHEN {hit(p)} THEN {d.text(n)} ELSE '' END" for n, p in table]), "x", "x <> ''"), ",") for k, table in (("analytics", T.ANALYTICS), ("payments", T.PAYMENTS), ("frameworks", T.FRAMEWORKS))}
    return {"cms": S.cases(cms, "'Custom'"), **lists, "hosting": S.cases([(hit(p), d.text(n)) for n, p in T.HOSTING], "NULL")}


def technologies(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", *[F.expr(e).alias(n) for n, e in tech_columns_sql(SPARK).items()])


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+?[0-9][0-9() -]{7,14}[0-9]"
SOCIAL = r"https?://(?:www\.)?(?:facebook|twitter|linkedin|instagram|youtube)\.com/[A-Za-z0-9_./-]+"


def contacts_sql(d: S.Dialect, text: str) -> dict[str, str]:
    return {n: f"nullif({d.extract(text, p, 0)}, '')" for n, p in (("email", EMAIL), ("phone", PHONE), ("social", SOCIAL))}


def contacts(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, email, phone, social): the first of each in the text."""
    return rows.select(key, *[F.expr(e).alias(n) for n, e in contacts_sql(SPARK, text).items()])


def business_name(footer: Column, title: Column, og: Column, given: Column) -> Column:
    """The given name, else the one after © in the footer, the title up to a hyphen, og:site_name."""
    mark = F.nullif(F.trim(F.regexp_extract(footer, r"©\s*(?:\d{4})?\s*([A-Za-z][A-Za-z0-9 &.]*)", 1)), F.lit(""))
    return F.coalesce(F.nullif(given, F.lit("")), mark, F.nullif(F.trim(F.split_part(title, F.lit("-"), F.lit(1))), F.lit("")), F.nullif(og, F.lit("")))


def lead_score_sql(d: S.Dialect, text: str) -> str:
    low = f"lower({text})"
    return S.cases([(d.match(low, "excellent|strong|perfect"), "9"), (d.match(low, "good|qualified|promising"), "7"), (d.match(low, "moderate|potential"), "5")], "3")


def lead_scores(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, score, subject) of messages."""
    subject = F.trim(F.regexp_extract("text", r"(?im)^\s*subject:(.*)$", 1))
    return conversations.select("conv_id", "turn", F.expr(lead_score_sql(SPARK, "coalesce(text, '')")).alias("score"), F.when(F.coalesce(subject, F.lit("")) == "", "Follow-up from our conversation").otherwise(subject).alias("subject"))


def keyword_context(rows: DataFrame, keyword: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sent, before, sentence, after): sentences that hold the keyword (marked with **),
    with their neighbours."""
    sents = F.filter(F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\x01"), "\x01"), lambda s: s != "")
    low = keyword.lower()
    at = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: F.contains(F.lower(F.get("s", i)), F.lit(low)))
    split = rows.select(key, sents.alias("s")).where(F.size("s") > 0).select(key, "s", F.explode(at).alias("sent"))
    mark = F.regexp_replace(F.get("s", F.col("sent")), f"(?i)({keyword})", "**$1**")
    return split.select(key, "sent", F.get("s", F.col("sent") - 1).alias("before"), mark.alias("sentence"), F.get("s", F.col("sent") + 1).alias("after"))
