"""Url expressions."""

from __future__ import annotations

from ..rules import pages as R
from .sqltext import Dialect, cases

_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://"


def scheme(d: Dialect, url: str) -> str:
    return f"lower({d.extract(url, _SCHEME)})"


def netloc(d: Dialect, url: str) -> str:
    return f"lower({d.extract(url, _SCHEME + '([^/?#]*)', 2)})"


def path(d: Dialect, url: str) -> str:
    """The path without parameters, query and fragment, case kept."""
    return d.extract(url, _SCHEME + "[^/?#]*([^?#;]*)", 2)


def domain(d: Dialect, url: str) -> str:
    return f"replace({netloc(d, url)}, 'www.', '')"


def is_internal(d: Dialect, url: str, base: str) -> str:
    """Same domain or a subdomain of base, every `www.` left out."""
    own, other = domain(d, url), f"replace(lower({base}), 'www.', '')"
    ends = f"endswith({own}, concat('.', {other}))" if d.spark else f"ends_with({own}, concat('.', {other}))"
    return f"({own} = {other} OR {ends})"


def is_valid_link(d: Dialect, href: str) -> str:
    """Whether an href can lead to a page: no fragment, script, mail, phone or data link, no blank."""
    return f"NOT ({d.match(f'lower({href})', '^(#|javascript:|mailto:|tel:|data:)')} OR {d.match(href, '^[ \\t\\r\\n]*$')})"


def clean_url(d: Dialect, url: str) -> str:
    """A url as users type it: `url:` dropped, all after a comma of a web address dropped, https by default."""
    bare = d.replace(d.replace(d.replace(url, r"^[ \t\r\n]+", ""), r"[ \t\r\n]+$", ""), r"^(?i)url:[ \t]*" if d.spark else r"(?i)^url:[ \t]*", "")
    first = f"CASE WHEN {d.match(bare, '^https?://')} AND contains({bare}, ',') THEN {d.extract(bare, '^([^,]*)')} ELSE {bare} END"
    return f"CASE WHEN {d.match(first, '^https?://')} THEN {first} ELSE concat('https://', {first}) END"


def normalize(d: Dialect, url: str) -> str:
    """The url that duplicates share: host in lower case, no slashes at the path's end, only the
    preserved parameters with a value, sorted by name (values of one name in their order), no
    fragment. Percent escapes stay as they are; what has no scheme stays as it is."""
    query = d.extract(url, r"^[^?#]*\?([^#]*)")
    names = ", ".join(f"'{p}'" for p in R.PRESERVED_PARAMS)
    one = f"lower({d.extract('x', '^([^=]*)')}) IN ({names}) AND {d.match('x', '^[^=]*=.')}"
    # Name, place and pair in one string: its order is that of the names, then of the places.
    place = "lpad(CAST(i AS VARCHAR(9)), 6, '0')"
    keyed = d.transform(d.filter(d.split(query, "&"), "x", one), "x, i", f"concat({d.extract('x', '^([^=]*)')}, chr(1), {place}, chr(1), x)")
    pairs = d.join(d.transform(d.sort(keyed), "y", d.extract("y", r"^[^\x01]*\x01[^\x01]*\x01(.*)$")), "&")
    route = f"coalesce(nullif({d.replace(path(d, url), '/+$', '')}, ''), '/')"
    return f"CASE WHEN {d.match(url, _SCHEME)} THEN concat({scheme(d, url)}, '://', {netloc(d, url)}, {route}, CASE WHEN {pairs} = '' THEN '' ELSE concat('?', {pairs}) END) ELSE {url} END"


def _any(patterns: tuple[str, ...]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def is_skipped(d: Dialect, url: str) -> str:
    return d.match(f"lower({url})", _any(R.SKIP_URLS))


def is_content(d: Dialect, url: str) -> str:
    return d.match(f"lower({url})", _any(R.CONTENT_URLS))


def type_scores(d: Dialect, url: str, anchor: str | None = None, title: str | None = None) -> list[tuple[str, str]]:
    """scores_of() with its inputs written out."""
    texts = [(f"lower(coalesce({t}, ''))", share) for t, share in ((anchor, 0.3), (title, 0.2)) if t]
    return scores_of(d, f"lower({path(d, url)})", is_content(d, url), texts)


def scores_of(d: Dialect, route: str, content: str, texts: list[tuple[str, float]]) -> list[tuple[str, str]]:
    """(page type, confidence) expressions, one for each type: the first matching url pattern's
    weight, plus a share of the first matching weight of each text (0.3 of the anchor's, 0.2
    of the title's), each sum capped at 1. route is the path and texts are in lower case."""
    out = []
    for kind, by_url, by_text in R.PAGE_PATTERNS:
        score = cases([(d.match(route, p), d.double(w)) for p, w in by_url], d.double(0))
        for text, share in texts:
            score = f"least({d.double(1)}, {score} + {cases([(d.match(text, p), d.double(w)) for p, w in by_text], d.double(0))} * {d.double(share)})"
        out.append((kind, f"CASE WHEN {content} THEN {d.double(0)} ELSE {score} END" if kind in R.POLICY_LIKE else score))
    return out


def priority(d: Dialect, kind: str) -> str:
    return cases([(f"{kind} = '{k}'", str(v)) for k, v in R.PRIORITY.items()], "10")


def ttl_seconds(d: Dialect, kind: str) -> str:
    return cases([(f"{kind} = '{k}'", str(v)) for k, v in R.TTL.items()], str(R.TTL["other"]))
