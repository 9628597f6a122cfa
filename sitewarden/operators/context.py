"""Business context of a site, from the text of its pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.sqltext import SPARK, Dialect, cases
from ..rules import context as R


def evidence_sql(d: Dialect, text: str) -> dict[str, str]:
    """Named expressions: hits of each family, whitepaper, github, cart, login."""
    out = {f"n_{k}": d.size(d.found(text, words)) for k, words in R.EVIDENCE.items()}
    return out | {
        "has_whitepaper": f"contains({text}, 'whitepaper')", "has_github": f"contains({text}, 'github')",
        "has_cart": f"(contains({text}, 'add to cart') OR contains({text}, 'buy now') OR contains(left({text}, 5000), 'cart'))",
        "login_detected": f"(contains(left({text}, 2000), 'login') OR contains(left({text}, 2000), 'sign in'))",
        "pricing_model": pricing_sql(d, text), "audience": audience_sql(d, text),
    }


def pricing_sql(d: Dialect, text: str) -> str:
    has = lambda *words: "(" + " OR ".join(f"contains({text}, {d.text(w)})" for w in words) + ")"
    return cases([
        (has("subscription", "monthly", "per month"), "'Subscription'"), (has("one-time", "one time"), "'One-time'"),
        (f"({has('free')} AND {has('trial', 'freemium')})", "'Freemium'"), (has("quote", "contact us", "enterprise"), "'Quote-based'"), (has("price", "$", "₹"), "'Fixed Price'"),
    ], "'Not identified'")


def audience_sql(d: Dialect, text: str) -> str:
    has = lambda *words: "(" + " OR ".join(f"contains({text}, {d.text(w)})" for w in words) + ")"
    return cases([
        (has("enterprise", "b2b", "business"), "'Enterprise / B2B'"), (has("developer", "api"), "'Developers'"), (has("startup", "small business"), "'SMBs / Startups'"), (has("consumer", "personal"), "'Consumers'"),
    ], "'General'")


def score_sql(d: Dialect, financial: str = "false", platforms: str = "false") -> list[tuple[str, str]]:
    """(context, score) over the evidence columns, in the order that decides ties. `platforms`
    says whether a shop platform was seen: detectors that don't report it leave it false."""
    z = d.double
    on = lambda test, points: f"CASE WHEN {test} THEN {z(points)} ELSE {z(0)} END"
    chain = f"({on('n_blockchain_specific > 0', 5)} + {on('n_blockchain_generic > 0', 1)} + {on('has_whitepaper', 2)})"
    saas = f"({on('n_saas > 0', 2)} + {on("pricing_model = 'Subscription'", 3)} + {on('login_detected', 1)})"
    dev = f"({on('n_developer_docs > 0', 3)} + {on('has_github', 1)})"
    trump = lambda x: f"({x} - CASE WHEN {chain} >= 5 AND {x} > 0 THEN {z(2)} ELSE {z(0)} END)"
    shop = f"({on(platforms, 7)} + {on('has_cart', 3)} + {on('n_ecommerce > 0', 1)})"
    fin = f"(n_fintech * {z(0.5)} + {on(financial, 4)})"
    by = {"ECOMMERCE_MERCHANT": shop, "MARKETPLACE": z(0), "SAAS_PRODUCT": trump(saas), "FINTECH_INFRASTRUCTURE": fin, "BLOCKCHAIN_INFRASTRUCTURE": chain, "CONTENT_MEDIA": on("n_content > 0", 2), "DEVELOPER_PLATFORM": trump(dev)}
    return [(k, by[k]) for k in R.CONTEXTS]


def classify(pages: DataFrame, key: str = "doc_id", text: str = "page_text", financial: str = "false") -> DataFrame:
    """(key, primary_context, status, confidence, surface, score, second_score) of each row.

    The best score decides, the first of equal ones; below 3 it is of low confidence, up to
    1 unknown and undetermined; less than 1 ahead of the second, of low confidence in
    any case. All of it is columns of one row: nothing is shuffled."""
    ev = pages.select(key, *[F.expr(e).alias(n) for n, e in evidence_sql(SPARK, text).items()])
    scored = ev.withColumns({f"s_{k}": F.expr(s) for k, s in score_sql(SPARK, financial)})
    ranked = F.sort_array(F.array(*[F.struct(F.col(f"s_{k}").alias("score"), F.lit(-i).alias("o"), F.lit(k).alias("name")) for i, k in enumerate(R.CONTEXTS)]), asc=False)
    top = scored.withColumn("r", ranked).withColumns({"score": F.col("r")[0]["score"], "second_score": F.col("r")[1]["score"], "best": F.col("r")[0]["name"]})
    score, best = F.col("score"), F.col("best")
    close = (score > 0) & (score - F.col("second_score") < 1)
    surface = (
        F.when(F.col("login_detected"), F.when(F.col("has_cart"), "FULL_COMMERCE").otherwise("AUTH_GATED")).when(F.col("has_cart"), "FULL_COMMERCE")
        .when((F.col("n_developer_docs") > 0) & (best == "DEVELOPER_PLATFORM"), "API_DOCS").when((F.col("n_content") > 0) & (best == "CONTENT_MEDIA"), "CONTENT_ONLY").otherwise("MARKETING_SITE")
    )
    return top.select(
        key, F.when((score < 3) & (score <= 1), "UNKNOWN").otherwise(best).alias("primary_context"),
        F.when(close, "LOW_CONFIDENCE").when(score <= 1, "UNDETERMINED").when(score < 3, "LOW_CONFIDENCE").otherwise("DETERMINED").alias("status"),
        F.least(score / 10, F.lit(1.0)).alias("confidence"), surface.alias("surface"), "score", "second_score", "pricing_model", "audience",
    )
