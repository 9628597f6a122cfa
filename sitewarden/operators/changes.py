"""Changes between snapshots of a site, and what they mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..rules import changes as R

_FIELDS = ("id", "scan_timestamp", "page_hashes", "pricing_model", "product_count")


def with_previous(snapshots: DataFrame) -> DataFrame:
    """Each snapshot with the one before it of the same url (null for the first)."""
    order = W.partitionBy("target_url").orderBy("scan_timestamp", "id")
    return snapshots.withColumn("prev", F.lag(F.struct(*_FIELDS)).over(order))


def latest(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot of each url."""
    return snapshots.groupBy("target_url").agg(F.max_by(F.struct(*_FIELDS), F.struct("scan_timestamp", "id")).alias("s")).select("target_url", "s.*")


def append(snapshots: DataFrame, new: DataFrame, as_of: Column) -> DataFrame:
    """snapshots with new ones (id, target_url, page_hashes, pricing_model, product_count) at the
    end, taken at as_of. Hashes of pages that weren't found are left out."""
    found = F.map_filter("page_hashes", lambda k, v: F.coalesce(v != "", F.lit(False)))
    return snapshots.unionByName(new.withColumns({"scan_timestamp": as_of, "page_hashes": found}), allowMissingColumns=True)


def _change(ord_: Column, kind: str, where: Column, severity: Column, description: Column) -> Column:
    return F.struct(ord_.cast("int").alias("ord"), F.lit(kind).alias("type"), where.alias("where_"), severity.alias("severity"), description.alias("description"))


def changes_of(prev: Column) -> Column:
    """The changes of a snapshot's columns since prev, in order: pages in the order of the
    snapshot's page_hashes (a map of page type to hash), pricing model, number of products.

    A page changes if it had a hash and has another or a null one now; pages that aren't in
    the map aren't compared, new ones are no change."""
    hashes = F.map_entries("page_hashes")
    title = lambda k: F.initcap(F.replace(k, F.lit("_"), F.lit(" ")))
    content = lambda e, i: F.when(
        (F.coalesce(F.try_element_at(prev["page_hashes"], e["key"]), F.lit("")) != "") & ~e["value"].eqNullSafe(F.try_element_at(prev["page_hashes"], e["key"])),
        _change(i, "content_change", e["key"], F.when(e["key"].isin("product", "pricing"), "moderate").otherwise("minor"), F.concat(title(e["key"]), F.lit(" page content has changed."))),
    )
    n = F.size("page_hashes")
    model = lambda c: F.coalesce(c, F.lit("Unknown"))
    text = F.concat(F.lit("Pricing model changed from "), model(prev["pricing_model"]), F.lit(" to "), model(F.col("pricing_model")), F.lit("."))
    pricing = F.when(~F.col("pricing_model").eqNullSafe(prev["pricing_model"]), _change(n, "pricing_change", F.lit("pricing"), F.lit("critical"), text))
    count = F.concat(F.lit("Number of detected products changed from "), prev["product_count"].cast("string"), F.lit(" to "), F.col("product_count").cast("string"), F.lit("."))
    product = F.when(F.col("product_count") != prev["product_count"], _change(n + 1, "product_change", F.lit("product"), F.lit("moderate"), count))
    pages = F.coalesce(F.transform(hashes, content), F.array())
    return F.when(prev.isNotNull(), F.array_compact(F.concat(pages, F.array(pricing, product))))


def detect(snapshots: DataFrame) -> DataFrame:
    """(target_url, id, ord, type, where_, severity, description): one row for each change
    since the previous snapshot."""
    rows = with_previous(snapshots).select("target_url", "id", F.explode(changes_of(F.col("prev"))).alias("c"))
    return rows.select("target_url", "id", "c.*")


def _rule(kind: Column, where: Column) -> Column:
    by_type = {r[0]: r[1:] for r in R.CHANGE_RULES}
    made = lambda v: F.struct(*[F.lit(x).alias(n) for x, n in zip(v, ("severity", "business_impact", "recommended_action", "confidence"))])
    out = F.when(F.lit(False), made(R.UNKNOWN_CHANGE))
    for page, rule in R.PAGE_RULES:
        out = out.when((kind == "content_change") & (where == page), made(by_type[rule]))
    for name, values in by_type.items():
        out = out.when(kind == name, made(values))
    return out.otherwise(made(R.UNKNOWN_CHANGE))


def enrich(changes: DataFrame) -> DataFrame:
    """Changes with severity, impact, action and confidence of their rule (which replace the
    detector's severity)."""
    return changes.withColumn("rule", _rule(F.col("type"), F.col("where_"))).select(*[c for c in changes.columns if c != "severity"], "rule.*")


def intelligence(snapshots: DataFrame) -> DataFrame:
    """One row for each snapshot: overall severity, summary, recommended action, confidence.
    First snapshots are `none`; one without changes is `minor` with confidence 1. One pass:
    a snapshot's changes stay in its row."""
    rated = F.transform(changes_of(F.col("prev")), lambda c: F.struct(_rule(c["type"], c["where_"]).alias("r"), c["ord"].alias("ord"), c["description"].alias("description")))
    rank = lambda c: F.when(c["r"]["severity"] == "critical", 3).when(c["r"]["severity"] == "moderate", 2).otherwise(1)
    rows = with_previous(snapshots).select("target_url", "id", F.col("prev").isNotNull().alias("since_last_scan"), rated.alias("c"))
    worst = F.array_max(F.transform("c", lambda c: F.struct(rank(c).alias("rank"), (-c["ord"]).alias("o"), c["description"].alias("description"), c["r"]["recommended_action"].alias("action"))))

    def count(severity: str) -> Column:
        return F.size(F.filter("c", lambda c: c["r"]["severity"] == severity))

    number = {s: count(s) for s in ("critical", "moderate", "minor")}
    # In whole hundredths, so that halves round up whatever the order of adding.
    hundredths = F.aggregate("c", F.lit(0), lambda acc, c: acc + F.round(c["r"]["confidence"] * 100).cast("int"))
    mean = F.floor((2 * hundredths + F.size("c")) / (2 * F.size("c"))) / 100
    rows = rows.withColumns({"first_": worst, **number})
    seen, any_, serious = F.col("since_last_scan"), F.size("c") > 0, (F.col("critical") > 0) | (F.col("moderate") > 0)
    counts = F.concat_ws(", ", *[F.when(F.col(s) > 0, F.concat(F.col(s).cast("string"), F.lit(f" {s}"))) for s in number])
    suffix = F.when(F.col("critical") > 0, F.concat(F.lit(" — dominated by "), F.col("first_.description"))).when(F.col("moderate") > 0, F.concat(F.lit(" — notably "), F.col("first_.description"))).otherwise("")
    return rows.select(
        "target_url", "id", "since_last_scan",
        F.when(~seen, "none").when(F.col("critical") > 0, "critical").when(F.col("moderate") > 0, "moderate").otherwise("minor").alias("overall_severity"),
        F.when(~seen, "No significant changes detected").when(~any_, "No changes detected.").otherwise(F.concat(F.lit("Detected "), counts, F.lit(" changes"), suffix)).alias("summary"),
        F.when(seen, F.when(serious, F.col("first_.action")).otherwise("No immediate action required")).alias("recommended_action"),
        F.when(seen, F.when(any_, mean).otherwise(1.0)).alias("confidence"),
    )
