"""Relative references, resolved against the address of the page that they stand on."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .sqltext import bound

_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.-]*):"


def _parts(url: Column) -> Column:
    """(scheme in lower case, host with its port, path, parameters of its last segment, query, fragment)."""
    clean = F.regexp_replace(F.regexp_replace(url, r"[\t\r\n]", ""), r"^[\x00-\x20]+", "")
    rest = F.regexp_replace(clean, _SCHEME, "")
    after = F.regexp_replace(rest, r"(?s)^//[^/?#]*", "")
    route = F.regexp_extract(after, r"(?s)^([^?#]*)", 1)
    return bound(
        F.struct(F.lower(F.regexp_extract(clean, _SCHEME, 1)).alias("scheme"), F.regexp_extract(rest, r"(?s)^//([^/?#]*)", 1).alias("host"), after.alias("after"), route.alias("route")),
        lambda p: F.struct(
            p["scheme"].alias("scheme"), p["host"].alias("host"), F.regexp_extract(p["route"], r"(?s)^((?:.*/)?[^/;]*)", 1).alias("path"),
            # Without a lone semicolon: empty parameters leave no mark.
            F.regexp_replace(F.regexp_replace(p["route"], r"(?s)^(?:.*/)?[^/;]*", ""), r"^;$", "").alias("params"),
            F.regexp_extract(p["after"], r"(?s)^[^?#]*\?([^#]*)", 1).alias("query"), F.regexp_extract(p["after"], r"(?s)#(.*)$", 1).alias("fragment"),
        ),
    )


def _joined(scheme: Column, host: Column, route: Column, query: Column, fragment: Column) -> Column:
    slash = F.when((route != "") & ~F.startswith(route, F.lit("/")), "/").otherwise("")
    return F.concat(
        scheme, F.lit("://"), host, slash, route, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise("")
    )


def _without_dots(route: Column, base: Column) -> Column:
    """The path that `route` leads to from the path `base`, both without parameters. The stack of
    segments is a fold: `..` takes the last one off, `.` does nothing, anything else goes on it."""
    own = F.split(route, "/")
    folder = F.split(F.when(F.endswith(base, F.lit("/")) | (base == ""), base).otherwise(F.regexp_extract(base, r"(?s)^(.*/)?[^/]*$", 1)), "/")
    # A folder's last, empty segment makes room for what follows; it goes with all empty ones between.
    both = F.concat(folder, own)
    kept = F.when(F.startswith(route, F.lit("/")), own).otherwise(bound(both, lambda segs: F.filter(segs, lambda s, i: (s != "") | (i == 0) | (i == F.size(segs) - 1))))
    empty = F.array().cast("array<string>")

    def folded(segs: Column) -> Column:
        stack = F.aggregate(segs, empty, lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == ".", acc).otherwise(F.concat(acc, F.array(s))))
        return F.concat(stack, F.when(F.element_at(segs, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(empty))

    return F.coalesce(F.nullif(F.array_join(bound(kept, folded), "/"), F.lit("")), F.lit("/"))


def resolve(base: Column, ref: Column) -> Column:
    """The address that `ref` names on the page `base`, an http(s) address.

    RFC 3986 as browsers and urllib do it: a reference with another scheme stays as it is; one
    with a host keeps its path; otherwise dots are resolved, empty segments within the path
    vanish from a relative one, parameters (`;x`) of the last segment stay out of that, and an empty path is the
    base's. An empty query or fragment leaves no mark. Null if either is null.

    All of it is expressions, so links need no Python worker."""
    def named(x: Column) -> Column:
        b, r = x["b"], x["r"]
        with_params = lambda p: F.concat(p["path"], p["params"])
        merged = F.concat(_without_dots(r["path"], b["path"]), r["params"])
        return (
            F.when((r["scheme"] != "") & (r["scheme"] != b["scheme"]), x["ref"])
            .when(r["host"] != "", _joined(b["scheme"], r["host"], with_params(r), r["query"], r["fragment"]))
            .when(x["bare"], _joined(b["scheme"], b["host"], with_params(b), F.when(r["query"] != "", r["query"]).otherwise(b["query"]), r["fragment"]))
            .otherwise(_joined(b["scheme"], b["host"], merged, r["query"], r["fragment"]))
        )

    parts = bound(F.struct(_parts(base).alias("b"), _parts(ref).alias("r"), ref.alias("ref")), lambda x: F.struct(x["b"].alias("b"), x["r"].alias("r"), x["ref"].alias("ref"), ((x["r"]["path"] == "") & (x["r"]["params"] == "")).alias("bare")))
    return F.when(base.isNotNull() & ref.isNotNull(), F.when(ref == "", base).otherwise(bound(parts, named)))
