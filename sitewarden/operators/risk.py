"""Restricted content: findings by page, corroboration by site, scores."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.sqltext import Dialect
from ..rules import risk as R


def keyword_test(d: Dialect, text: str, keyword: str) -> str:
    """The keyword as it is, with blanks for hyphens, or its words in order on one line."""
    plain = keyword.replace("-", " ")
    tests = [f"contains({text}, {d.text(k)})" for k in dict.fromkeys((keyword, plain))]
    if " " in plain:
        tests.append(d.match(text, r"\b" + r"\b.*\b".join(re.escape(w) for w in plain.split()) + r"\b"))
    return "(" + " OR ".join(tests) + ")"


def _trie(words: list[str]) -> str:
    """A regular expression for any of the words, with common beginnings shared."""
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def text(node: dict) -> str:
        if "" in node:
            return ""
        parts = [re.escape(c) + text(n) for c, n in sorted(node.items())]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return text(root)


def anchors(keywords) -> dict[str, str]:
    """For each keyword a word that any text with it holds: its longest, or a shorter anchor within
    that. No anchor is a part of another."""
    longest = {k: max(k.replace("-", " ").split(), key=len) for _, words in keywords for k in words}
    least = [w for w in set(longest.values()) if not any(v != w and v in w for v in longest.values())]
    return {k: next(v for v in sorted(least) if v in w) for k, w in longest.items()}


def keyword_hits(text: Column, keywords=R.RESTRICTED) -> Column:
    """An array of (kw_ord, category, keyword, pos) of the keywords that a text holds.

    One regular expression finds all anchors in one pass over the text; only keywords whose
    anchor is there are looked for, so the table's size hardly counts. The table is one
    literal; the regex of a keyword of several words runs only where its words occur."""
    rows, anchor = [], anchors(keywords)
    for n, (c, k) in enumerate((c, k) for c, words in keywords for k in words):
        plain = k.replace("-", " ")
        pattern = r"\b" + r"\b.*\b".join(re.escape(w) for w in plain.split()) + r"\b" if " " in plain else None
        rows.append({"kw_ord": n, "category": c, "keyword": k, "plain": plain if plain != k else None, "words": plain.split(), "pattern": pattern, "anchor": anchor[k]})
    # One text that is folded to a literal: a call for each of its fields takes seconds to build.
    table = F.from_json(F.lit(json.dumps(rows)), "array<struct<kw_ord: int, category: string, keyword: string, plain: string, words: array<string>, pattern: string, anchor: string>>")
    # A look-ahead takes no text away, so that anchors which overlap are all found.
    words = sorted(set(anchor.values()))
    starts = re.escape("".join(sorted({w[0] for w in words})))
    seen = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=[{starts}])(?=({_trie(words)}))"), 1))
    spread = lambda r: r["pattern"].isNotNull() & F.forall(r["words"], lambda w: F.contains(text, w)) & F.coalesce(F.rlike(text, r["pattern"]), F.lit(False))
    holds = lambda r: F.contains(text, r["keyword"]) | F.coalesce(F.contains(text, r["plain"]), F.lit(False)) | spread(r)
    # The anchors are an argument of a lambda, so that they are made once for a text.
    found = F.flatten(F.transform(F.array(seen), lambda s: F.when(F.size(s) > 0, F.filter(table, lambda r: F.array_contains(s, r["anchor"]) & holds(r))).otherwise(F.filter(table, lambda r: F.lit(False)))))
    return F.transform(found, lambda r: F.struct(r["kw_ord"].alias("kw_ord"), r["category"].alias("category"), r["keyword"].alias("keyword"), F.call_function("instr", text, r["keyword"]).alias("pos")))


def snippet(text: Column, pos: Column, length: Column, margin: int = 100, most: int = 200) -> Column:
    """The text around a place, trimmed and cut to `most` characters."""
    start = F.greatest(pos - margin, F.lit(1))
    cut = F.btrim(F.substring(text, start, pos + length + margin - start), F.lit(" \t\r\n"))
    return F.when(F.char_length(cut) > most, F.concat(F.substring(cut, 1, most - 3), F.lit("..."))).otherwise(cut)


def findings(pages: DataFrame, keywords=R.RESTRICTED, text: str = "page_text", keep: tuple[str, ...] = ("site_id", "page_url")) -> DataFrame:
    """One row for each keyword that a page holds: keep..., category, keyword, kw_ord, pos,
    snippet. Texts are lower case. Keywords are literals of the plan: pages are
    scanned once, and nothing is joined or multiplied but the hits."""
    col = F.col(text)
    # The optimizer would put a filter on the hits before a plain explode, and scan each page twice.
    rows = pages.withColumn("f", F.explode_outer(keyword_hits(col, keywords))).where("f is not null")
    quote = F.when(F.col("f.pos") > 0, snippet(col, F.col("f.pos"), F.char_length("f.keyword"))).otherwise(F.concat(F.lit("Keyword '"), F.col("f.keyword"), F.lit("' found in "), F.col("f.category"), F.lit(" category")))
    return rows.select(*keep, "f.kw_ord", "f.category", "f.keyword", "f.pos", quote.alias("snippet"))


def corroborate(found: DataFrame) -> DataFrame:
    """findings with `corroborated` (the keyword is on several pages of the site) and severity.
    Least and greatest url differ exactly if there are two, so the window keeps no set."""
    w = W.partitionBy("site_id", "category", "keyword")
    several = F.min("page_url").over(w) != F.max("page_url").over(w)
    critical = several & F.col("category").isin(*R.CRITICAL_IF_CORROBORATED)
    return found.withColumn("corroborated", several).withColumn("severity", F.when(critical, "critical").otherwise("moderate"))


def has_lorem(text: Column) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in R.LOREM))


def placeholder_patterns(pages: DataFrame, key: str = "site_id") -> DataFrame:
    """(key, patterns): which placeholder patterns a site's pages hold, as a sorted set of at most
    as many as there are patterns; sites without any have no row."""
    text = F.col("page_text")
    hits = F.filter(F.array(*[F.when(text.rlike(p), F.lit(i)) for i, p in enumerate(R.LOREM)]), lambda i: i.isNotNull())
    found = pages.select(key, F.explode(hits).alias("i")).groupBy(key).agg(F.sort_array(F.collect_set("i")).alias("at"))
    return found.select(key, F.transform("at", lambda i: F.get(F.array(*map(F.lit, R.LOREM)), i)).alias("patterns"))


def site_scores(pages: DataFrame, keywords=R.RESTRICTED) -> DataFrame:
    """(site_id, n_findings, has_dummy, risk_score, risk_band): 20 for each finding and 50 for
    placeholder text. Findings are counted in the page, so that only counts are shuffled."""
    col = F.col("page_text")
    n = F.size(keyword_hits(col, keywords))
    per = pages.select("site_id", n.alias("n"), has_lorem(col).alias("dummy")).groupBy("site_id").agg(F.sum("n").alias("n_findings"), F.bool_or("dummy").alias("has_dummy"))
    score = F.col("n_findings") * 20 + F.when(F.col("has_dummy"), 50).otherwise(0)
    return per.withColumn("risk_score", score).withColumn("risk_band", F.when(score >= 100, "high").when(score >= 50, "moderate").otherwise("low"))


def by_category(found: DataFrame) -> DataFrame:
    """(site_id, category, keywords, n): distinct keywords in table order, as one string."""
    return found.groupBy("site_id", "category").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("kw_ord", "keyword"))), lambda x: x["keyword"]), ",").alias("keywords"), F.count("*").alias("n"))
