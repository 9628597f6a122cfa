"""Features of HTML as expressions: no parser, no Python worker.

Comments, scripts and styles go first, so that tags within them don't count."""

from __future__ import annotations

from .sqltext import Dialect

_DROP = r"(?s)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<noscript[^>]*>.*?</noscript>"
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def without_code(d: Dialect, html: str) -> str:
    return d.replace(html, _DROP, "\x01")


def unescape(d: Dialect, x: str) -> str:
    for entity, char in _ENTITIES:
        x = f"replace({x}, {d.text(entity)}, {d.text(char)})"
    return x


def visible_text(d: Dialect, html: str) -> str:
    """The text of all elements, trimmed piece by piece and joined by blanks."""
    pieces = d.split(d.replace(html, _DROP + r"|<[^>]+>", "\x01"), "\x01")
    clean = d.transform(pieces, "x", d.replace(unescape(d, "x"), r"^[\s\x{00a0}]+|[\s\x{00a0}]+$", ""))
    return d.join(d.filter(clean, "y", "y <> ''"), " ")


def content_hash(d: Dialect, html: str, most: int = 10_000) -> str:
    """SHA-256 of the first characters of the visible text; null without html."""
    return f"CASE WHEN {html} IS NULL OR {html} = '' THEN NULL ELSE {d.sha256(f'left({visible_text(d, html)}, {most})')} END"


def title(d: Dialect, html: str) -> str:
    inner = d.extract(without_code(d, html), r"(?is)<title[^>]*>(.*?)</title>")
    return d.replace(unescape(d, inner), r"^\s+|\s+$", "")


def h1_count(d: Dialect, html: str) -> str:
    return d.size(f"regexp_extract_all({without_code(d, html)}, {d.text('(?i)<h1[ >]')}, 0)")


def meta_content(d: Dialect, html: str, name: str) -> str:
    return d.extract(html, f'(?is)<meta[^>]*name="{name}"[^>]*content="([^"]*)"')


def canonical(d: Dialect, html: str) -> str:
    return d.extract(html, '(?is)<link[^>]*rel="canonical"[^>]*href="([^"]*)"')


def seo_columns(d: Dialect, html: str = "html") -> dict[str, str]:
    """Named expressions that the score is made of."""
    return {
        "title_len": f"length({title(d, html)})", "desc_len": f"length({meta_content(d, html, 'description')})", "h1": h1_count(d, html),
        "has_canonical": f"{canonical(d, html)} <> ''", "indexable": f"NOT contains(lower({meta_content(d, html, 'robots')}), 'noindex')",
    }


def seo_score_sql() -> str:
    """Over seo_columns(), sitemap_found and robots_txt_found: 0 to 100."""
    return (
        "CASE WHEN title_len > 0 THEN 10 ELSE 0 END + CASE WHEN title_len BETWEEN 30 AND 60 THEN 10 ELSE 0 END + CASE WHEN desc_len > 0 THEN 10 ELSE 0 END"
        " + CASE WHEN desc_len BETWEEN 120 AND 160 THEN 10 ELSE 0 END + CASE WHEN h1 = 1 THEN 15 WHEN h1 > 0 THEN 5 ELSE 0 END + CASE WHEN has_canonical THEN 10 ELSE 0 END"
        " + CASE WHEN indexable THEN 15 ELSE 0 END + CASE WHEN sitemap_found THEN 10 ELSE 0 END + CASE WHEN robots_txt_found THEN 10 ELSE 0 END"
    )
