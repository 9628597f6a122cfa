"""Start tags of HTML with their attributes, as expressions: any order, any or no quotes, every entity.

`tags()` gives an array of (tag, attrs) in the order of the page. Nothing is parsed into a
tree; what needs nesting has `operators.navigation`."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, functions as F

from .sqltext import bound

# What isn't markup: comments, and what stands in elements of raw text, whose own tags stay.
_COMMENT = r"(?s)<!--(?:>|->|.*?--!?>)"
_RAW = r"(?is)(<(script|style)(?:[\s/](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)?>).*?(?=</\2[\s/>])"
# A name, and attributes in which only quoted values hold a `>`.
_ATTRIBUTE = r"[^\s/>=\"'][^\s/>=\"']*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)?+"
_REST = rf"(?:[\s/]++|{_ATTRIBUTE})*+>"
_TAG = rf"<[a-zA-Z][^\s/>]*+{_REST}"
_CODE = r"^#(?:[xX]([0-9a-fA-F]+)|([0-9]+));?"


def _literal(pairs: dict[str, str]) -> Column:
    """A map as one literal of the plan, however many entries it has."""
    return F.from_json(F.lit(json.dumps(pairs)), "map<string,string>")


def _legacy() -> str:
    """The names that count without a semicolon, the longest first."""
    return "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))


def _code_point(n: Column) -> Column:
    """The character that a numeric reference stands for: windows-1252 where that has one for a
    control code, U+FFFD for what is no character, nothing for what must not be in a text."""
    latin = {}
    for b in range(0x80, 0xA0):
        try:
            latin[b] = bytes([b]).decode("cp1252")
        except UnicodeDecodeError:
            latin[b] = chr(b)
    table = F.create_map(*[F.lit(x) for kv in latin.items() for x in kv])
    plain = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    gone = n.between(0x1, 0x8) | n.between(0xE, 0x1F) | n.between(0x7F, 0x9F) | n.between(0xFDD0, 0xFDEF) | (n == 0xB) | (n % 0x10000 >= 0xFFFE)
    return (
        F.when(n == 0, "�").when(n == 13, "\r").when(n.between(0x80, 0x9F), F.element_at(table, n.cast("int")))
        .when(n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "�").when(gone, "").otherwise(plain)
    )


def unescape(text: Column) -> Column:
    """text with all character references resolved: every named one of HTML, those without a
    semicolon where HTML allows it, and numeric ones. Like html.unescape."""
    names, legacy = {n[:-1]: v for n, v in html5.items() if n.endswith(";")}, {n: v for n, v in html5.items() if not n.endswith(";")}
    known, short = _literal(names), _literal(legacy)

    def one(piece: Column) -> Column:
        """What follows an ampersand."""
        code = F.coalesce(F.conv(F.nullif(F.regexp_extract(piece, _CODE, 1), F.lit("")), 16, 10), F.nullif(F.regexp_extract(piece, _CODE, 2), F.lit("")))
        number = F.when(F.length(F.ltrim(code, F.lit("0"))) > 9, F.lit(0x110000)).otherwise(code.cast("long"))
        name = F.regexp_extract(piece, r"^([^\t\n\f <&#;]{1,32});", 1)
        full = F.element_at(known, name)
        some = F.regexp_extract(piece, rf"^({_legacy()})", 1)
        return (
            F.when(code.isNotNull(), F.concat(_code_point(number), F.regexp_replace(piece, _CODE, "")))
            .when((name != "") & full.isNotNull(), F.concat(full, F.substring(piece, F.length(name) + 2, F.length(piece))))
            .when(some != "", F.concat(F.element_at(short, some), F.substring(piece, F.length(some) + 1, F.length(piece))))
            .otherwise(F.concat(F.lit("&"), piece))
        )

    def resolved(pieces: Column) -> Column:
        return F.concat(F.element_at(pieces, 1), F.array_join(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), one), ""))

    return F.when(F.contains(text, F.lit("&")), bound(F.split(text, "&"), resolved)).otherwise(text)


def without_raw(html: Column) -> Column:
    """html without comments and without what scripts and styles hold."""
    return F.regexp_replace(F.regexp_replace(html, _COMMENT, ""), _RAW, "$1")


def tags(html: Column, *names: str) -> Column:
    """array<struct<tag string, attrs map<string, string>>> of the start tags, or of those named.

    Names of tags and attributes are in lower case; of attributes of one name the last counts;
    one without a value has the empty string. Character references in values are resolved.
    A tag that never closes, or in which a quote is left open, is none. Null html has null."""
    wanted = rf"(?i)<(?:{'|'.join(names)})(?=[\s/>]){_REST}" if names else _TAG
    found = F.regexp_extract_all(without_raw(html), F.lit(wanted), F.lit(0))

    def attributes(tag: Column) -> Column:
        # Attributes without the tag's name; a value that ends in a slash keeps it if it is unquoted.
        body = F.regexp_replace(F.regexp_replace(tag, r"^<[^\s/>]*", ""), r">$", "")
        each = F.regexp_extract_all(body, F.lit(_ATTRIBUTE), F.lit(0))

        def last(pairs: Column) -> Column:
            return F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda o: o["name"] == p["name"]))

        return F.map_from_entries(bound(F.transform(each, _pair), last))

    return F.transform(found, lambda t: F.struct(F.lower(F.regexp_extract(t, r"^<([^\s/>]*)", 1)).alias("tag"), attributes(t).alias("attrs")))


def _pair(attribute: Column) -> Column:
    value = F.regexp_replace(F.regexp_extract(attribute, r"(?s)^[^\s/>=]+\s*=\s*(.*)$", 1), "(?s)^([\"'])(.*)\\1$", "$2")
    return F.struct(F.lower(F.regexp_extract(attribute, r"^([^\s/>=]+)", 1)).alias("name"), bound(value, unescape).alias("value"))


def first_attribute(found: Column, wanted: str, *fits: tuple[str, str]) -> Column:
    """Of tags() the attribute `wanted` of the first tag whose attributes named in `fits` are (in
    lower case, as one of their words) the given values; null if there is none."""
    def good(t: Column) -> Column:
        tests = [F.array_contains(F.split(F.lower(F.coalesce(F.element_at(t["attrs"], k), F.lit(""))), r"\s+"), v) for k, v in fits]
        out = tests[0]
        for x in tests[1:]:
            out = out & x
        return out

    return F.element_at(F.get(F.filter(found, good), F.lit(0))["attrs"], wanted)
