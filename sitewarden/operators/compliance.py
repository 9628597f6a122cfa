"""Compliance scores, expectations, issues and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.sqltext import SPARK, Dialect, cases
from ..rules import policies as P, risk as R


def expectation_sql(d: Dialect, policy: str, context: str = "primary_context", status: str = "context_status") -> str:
    """required, optional or n/a for a policy (a literal) in the row's context."""
    special = [(f"{context} = '{c}'", f"'{e[policy]}'") for c, e in P.EXPECTATIONS.items() if policy in e]
    base = cases(special, "'required'")
    if policy == "returns_refund":
        base = f"CASE WHEN {status} = 'LOW_CONFIDENCE' AND {base} = 'required' THEN 'optional' ELSE {base} END"
    return f"CASE WHEN {status} = 'UNDETERMINED' THEN 'optional' ELSE {base} END"


def age_points_sql(days: str) -> str:
    return f"CASE WHEN {days} IS NULL OR {days} < 180 THEN 0 WHEN {days} < 365 THEN 5 WHEN {days} < 1095 THEN 10 ELSE 15 END"


def penalty_sql(category: str, context: str = "primary_context") -> str:
    expected = ", ".join(f"'{c}'" for c in R.CRYPTO_EXPECTED)
    return cases([(f"{category} = 'crypto' AND {context} IN ({expected})", "0"), *[(f"{category} = '{c}'", str(p)) for c, p in R.PENALTY.items()]], "0")


def score_columns_sql(d: Dialect) -> dict[str, str]:
    """Score expressions over a site's facts: ssl_ok, age_days, found_<policy>, primary_context,
    context_status, n_<category> findings, has_dummy."""
    expected = ", ".join(f"'{c}'" for c in R.CRYPTO_EXPECTED)
    policy = " + ".join(f"CASE WHEN found_{p} OR {expectation_sql(d, p)} <> 'required' THEN 10 ELSE 0 END" for p, _ in P.SCORED_POLICIES)
    cost = " + ".join(f"n_{c} * {f'(CASE WHEN primary_context IN ({expected}) THEN 0 ELSE {p} END)' if c == 'crypto' else p}" for c, p in R.PENALTY.items())
    out = {
        "technical_score": f"(CASE WHEN ssl_ok THEN 15 ELSE 0 END + {age_points_sql('age_days')})",
        "policy_score": f"({policy})",
        "trust_score": f"greatest(0, least(30, 30 - ({cost}) - CASE WHEN has_dummy THEN 10 ELSE 0 END))",
    }
    total = " + ".join(out.values())
    return out | {"total_score": f"({total})", "rating": f"CASE WHEN {total} >= 80 THEN 'Good' WHEN {total} >= 50 THEN 'Fair' ELSE 'Poor' END"}


def score(facts: DataFrame, key: str = "site_id") -> DataFrame:
    """(key, technical_score, policy_score, trust_score, total_score, rating), at most
    30 + 40 + 30. One penalty for each finding, so a keyword on three pages costs thrice."""
    return facts.select(key, *[F.expr(e).alias(n) for n, e in score_columns_sql(SPARK).items()])


def facts_of(sites: DataFrame, found: DataFrame, findings: DataFrame, contexts: DataFrame, key: str = "site_id") -> DataFrame:
    """One row of facts for each site: sites (key, ssl_ok, age_days, has_dummy), found (key,
    policy), findings (key, category), contexts (key, primary_context, status). The three
    are summed by site before they are joined."""
    p = found.groupBy(key).agg(*[F.bool_or(F.col("policy") == k).alias(f"p_{k}") for k, _ in P.SCORED_POLICIES])
    c = findings.groupBy(key).agg(*[F.count_if(F.col("category") == k).alias(f"c_{k}") for k in R.PENALTY])
    both = sites.join(p, key, "left").join(c, key, "left").join(contexts.select(key, "primary_context", F.col("status").alias("context_status")), key, "left")
    return both.select(
        key, "ssl_ok", "age_days", "has_dummy", F.coalesce("primary_context", F.lit("UNKNOWN")).alias("primary_context"), F.coalesce("context_status", F.lit("DETERMINED")).alias("context_status"),
        *[F.coalesce(f"p_{k}", F.lit(False)).alias(f"found_{k}") for k, _ in P.SCORED_POLICIES], *[F.coalesce(f"c_{k}", F.lit(0)).alias(f"n_{k}") for k in R.PENALTY],
    )


_TITLES = {"NO_HTTPS": "Enable HTTPS with valid SSL certificate", "SSL_ERROR": "Fix SSL certificate configuration"}


def severity(kind: Column, category: Column, expectation: Column, context: Column, age_days: Column | None = None) -> Column:
    """HIGH, MEDIUM or LOW of an issue: of a young domain by age_days (null counts as 0), of a failed
    check by its name in category."""
    age = F.coalesce(age_days if age_days is not None else F.lit(0), F.lit(0))
    by_age = F.when(age < 180, "HIGH").when(age < 365, "MEDIUM").otherwise("LOW")
    policy = F.when(expectation == "required", "HIGH").when(expectation == "optional", "MEDIUM").otherwise("LOW")
    content = F.when((category == "crypto") & context.isin(*R.CRYPTO_EXPECTED), "LOW").when(category.isin("gambling", "adult"), "HIGH").otherwise("MEDIUM")
    return F.when(kind.isin("ssl_missing", "ssl_error"), "HIGH").when(kind == "domain_age_low", by_age).when((kind == "compliance_failure") & category.isin(*R.STOPPING_CHECKS), "HIGH").when(kind == "policy_missing", policy).when(kind == "restricted_content", content).otherwise("MEDIUM")


def reason(kind: Column, category: Column, expectation: Column, context: Column, age_days: Column, keyword: Column, policy: Column) -> Column:
    """Why an issue has its severity, in words."""
    say = lambda *parts: F.concat(*[F.coalesce(p, F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts])
    age, expected = F.coalesce(age_days, F.lit(0)), context.isin(*R.CRYPTO_EXPECTED)
    texts = R.REASONS
    content = (
        F.when((category == "crypto") & expected, say("Crypto content is expected for ", context, " businesses")).when(category == "crypto", say("Crypto content detected in ", context, " context may require review"))
        .when(category == "gambling", texts["gambling"]).when(category == "adult", texts["adult"]).when(category == "pharmacy", texts["pharmacy"])
        .otherwise(say("Restricted keyword '", keyword, "' detected in ", category, " category"))
    )
    wanted = F.when(expectation == "required", say(policy, " is required for ", context, " businesses")).when(expectation == "optional", say(policy, " is optional for ", context, " but recommended")).otherwise(say(policy, " is not applicable for ", context))
    return (
        F.when(kind.isin("ssl_missing", "ssl_error"), texts["ssl"]).when(kind == "domain_age_low", F.when(age < 180, texts["age_180"]).when(age < 365, texts["age_365"]).otherwise(texts["age"]))
        .when(kind == "policy_missing", wanted).when(kind == "restricted_content", content).when(kind == "dummy_text", texts["dummy_text"])
        .when((kind == "compliance_failure") & category.isin(*R.STOPPING_CHECKS), say(category, " failure prevents payment processing")).when(kind == "compliance_failure", say(category, " failure may impact compliance"))
    )


def by_severity(found: DataFrame, key: str = "site_id") -> DataFrame:
    """Issues as a report lists them: by site, then HIGH, MEDIUM and LOW, then title and fix."""
    rank = F.when(F.col("severity") == "HIGH", 0).when(F.col("severity") == "MEDIUM", 1).otherwise(2)
    return found.orderBy(key, rank, "title", "fix")


def issues(facts: DataFrame, findings: DataFrame, key: str = "site_id") -> DataFrame:
    """(key, ord, category, title, severity, required, fix): certificates, missing policies, restricted
    content and placeholder text of every site, in this order; content by its keyword's place
    in the table."""
    null = F.lit(None).cast("string")
    ctx = F.col("primary_context")
    made = [F.when(~F.col("ssl_ok"), F.struct(F.lit(0).alias("ord"), F.lit("ssl_missing").alias("kind"), F.lit("COMPLIANCE").alias("category"), F.lit("Compliance issue: NO_HTTPS").alias("title"), null.alias("expectation"), F.lit(_TITLES["NO_HTTPS"]).alias("fix")))]
    for n, (k, name) in enumerate(P.SCORED_POLICIES, 1):
        made.append(F.when(~F.col(f"found_{k}"), F.struct(F.lit(n).alias("ord"), F.lit("policy_missing").alias("kind"), F.lit("POLICY").alias("category"), F.lit(f"{name} missing").alias("title"), F.expr(expectation_sql(SPARK, k)).alias("expectation"), F.lit(f"Add {name} page accessible from site navigation").alias("fix"))))
    made.append(F.when(F.col("has_dummy"), F.struct(F.lit(1_000_000).alias("ord"), F.lit("dummy_text").alias("kind"), F.lit("QUALITY").alias("category"), F.lit("Dummy/placeholder text detected").alias("title"), null.alias("expectation"), F.lit("Replace placeholder text with actual content before going live").alias("fix"))))
    own = facts.select(key, "primary_context", F.explode(F.array_compact(F.array(*made))).alias("i")).select(key, "i.ord", "i.category", "i.title", severity(F.col("i.kind"), null, F.col("i.expectation"), ctx).alias("severity"), "i.fix")
    content = findings.join(facts.select(key, "primary_context"), key).select(
        key, (F.col("kw_ord") + 100).cast("int").alias("ord"), F.lit("CONTENT_RISK").alias("category"), F.concat(F.lit("Restricted content detected: "), F.col("category")).alias("title"),
        severity(F.lit("restricted_content"), F.col("category"), null, ctx).alias("severity"), F.concat(F.lit("Review content for '"), F.col("keyword"), F.lit("' - may require special compliance")).alias("fix"),
    )
    return own.unionByName(content).withColumn("required", F.col("severity") == "HIGH")


def recommendations(found: DataFrame, key: str = "site_id") -> DataFrame:
    """(key, fixes): the distinct fixes of a site's first three HIGH issues, then of its first two
    MEDIUM ones. A bounded rank, so that a site with many findings is cut before the shuffle."""
    order = W.partitionBy(key, "severity").orderBy("ord", "fix")
    ranked = found.where("severity in ('HIGH', 'MEDIUM')").select(key, "severity", "fix", "ord").withColumn("k", F.row_number().over(order)).where("k <= 3")
    kept = ranked.where("severity = 'HIGH' or k <= 2").select(key, F.struct(F.when(F.col("severity") == "HIGH", 0).otherwise(1).alias("s"), "k", "fix").alias("r"))
    fixes = F.transform(F.array_sort(F.collect_list("r")), lambda r: r["fix"])
    return kept.groupBy(key).agg(F.array_join(F.array_distinct(fixes), "; ").alias("fixes"))


def report(scores: DataFrame, found: DataFrame, key: str = "site_id") -> DataFrame:
    """(key, report): one JSON document for each site, with scores, issue counts and fixes."""
    counts = found.groupBy(key).agg(F.count("*").alias("issues"), F.count_if(F.col("severity") == "HIGH").alias("critical"))
    both = scores.join(counts, key, "left").join(recommendations(found, key), key, "left")
    passes = (F.col("rating") != "Poor") & (F.coalesce("critical", F.lit(0)) == 0)
    doc = F.struct(
        F.col(key), F.struct("technical_score", "policy_score", "trust_score", "total_score", "rating").alias("scores"), passes.alias("pass"),
        F.struct(F.coalesce("issues", F.lit(0)).alias("issues"), F.coalesce("critical", F.lit(0)).alias("critical")).alias("summary"), F.coalesce("fixes", F.lit("")).alias("recommendations"),
    )
    return both.select(key, F.to_json(doc).alias("report"))


def markdown(scores: DataFrame, key: str = "site_id") -> DataFrame:
    """(key, report) as Markdown."""
    rows = [F.concat(F.lit(f"| {n} | "), F.col(c).cast("string"), F.lit(f" / {m} |")) for n, c, m in (("Technical", "technical_score", 30), ("Policy", "policy_score", 40), ("Trust", "trust_score", 30))]
    head = F.concat(F.lit("# Site "), F.col(key).cast("string"))
    total = F.concat(F.lit("**"), F.col("total_score").cast("string"), F.lit("/100 – "), F.col("rating"), F.lit("**"))
    return scores.select(key, F.concat_ws("\n", head, F.lit(""), total, F.lit(""), F.lit("| Part | Score |"), F.lit("|-|-|"), *rows).alias("report"))


def report_filename(name: Column, kind: str = "json") -> Column:
    """A file name of a site's name: letters, digits, dots and hyphens, at most 50 characters."""
    return F.concat(F.lit("site_scan_"), F.left(F.regexp_replace(name, "[^A-Za-z0-9.-]", "_"), F.lit(50)), F.lit(f".{kind}"))
