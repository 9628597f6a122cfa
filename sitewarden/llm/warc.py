"""Resolution of not-modified revisit records in WARC captures. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ._shared import lasting, saved, scratch

#: Headers of a 304 response that replace those of the stored one.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that don't tell resources apart.
TRACKING = r"^(utm_[a-z]+|gclid|fbclid|ref)(=|$)"


def canonical_url(url: Column) -> Column:
    """The url without scheme, `www.`, default port, fragment, tracking parameters and slashes
    at the path's end; host in lower case, parameters sorted. Null stays null."""
    rest = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    params = F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.array_join(F.array_sort(params), "&")
    return F.concat(host, path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))


def _header(col: str, name: str) -> Column:
    return F.try_element_at(F.col(col), F.lit(name))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve_revisits(records: DataFrame, slices: int = 256, rows_per_slice: int = 1_000_000) -> DataFrame:
    """Every revisit of `records` with the response that it stands for.

    records: record_id long, url string, date timestamp, type ("response" or "revisit"),
    status int, headers map<string,string> (names in lower case), digest string. Further
    columns, such as payloads, are not read: join them by ref_id.

    Returns (record_id, url_key, ref_id, outcome, status, headers, digest), one row for each
    revisit. ref_id is the latest full response (type response, status 200) with the same
    canonical url and an earlier date; of responses with the same date, the largest
    record_id. outcome: `no_response` if there is none (ref_id, status, headers and digest
    null); else the first validator that both have decides between `resolved` and
    `mismatch`: ETag (compared weakly), Last-Modified, payload digest; `unverified` if they
    share none. Only a resolved revisit gets the response's status and digest, and its
    headers with those PERMITTED taken from the revisit.

    The as-of join is two-level, so that a url with a third of all captures isn't one
    task's work: dates are cut into `slices` equal spans, or as many as hold
    `rows_per_slice` rows; within (url, span) a window finds the latest response, and the
    spans' last responses are carried forward over at most as many rows for each url.
    Only record ids move in these steps; headers are joined once, to the revisits.

    Null urls and null dates match nothing; nulls in headers are absent headers. Repeated
    rows are rows of their own: a revisit that appears twice comes out twice. Of responses
    that share a record id, one that has its url and the greatest date, status, digest and
    headers counts. A revisit with a null record id is resolved like any other. Empty
    tables give no rows.
    """
    with scratch(records.sparkSession):
        return _resolve(records, slices, rows_per_slice)


def _resolve(records: DataFrame, slices: int, rows_per_slice: int) -> DataFrame:
    micros = F.unix_micros(F.col("date").cast("timestamp"))
    full = F.coalesce((F.col("type") == "response") & (F.col("status") == 200), F.lit(False))
    keyed = records.select(
        "record_id", canonical_url(F.col("url")).alias("url_key"), micros.alias("at"), full.alias("full"), F.coalesce(F.col("type") == "revisit", F.lit(False)).alias("revisit"), "status", "headers", "digest"
    ).where("revisit or (full and record_id is not null and url_key is not null and at is not null)")
    # A number for each row tells repeated revisits apart.
    rows = lasting(saved(keyed.withColumn("n", F.monotonically_increasing_id()), "captures"))
    thin = rows.where("url_key is not null and at is not null").select("n", "record_id", "url_key", "at", "full", "revisit")
    low, high, count = thin.agg(F.min("at"), F.max("at"), F.count("*")).first()
    spans = max(slices, count // rows_per_slice)
    width = max(1, -(-((high or 0) - (low or 0) + 1) // spans))
    thin = thin.withColumn("span", F.floor((F.col("at") - (low or 0)) / width))
    candidate = F.when(F.col("full"), F.struct("at", "record_id"))
    near = W.partitionBy("url_key", "span").orderBy("at").rangeBetween(W.unboundedPreceding, -1)
    in_span = thin.withColumn("here", F.max(candidate).over(near)).where("revisit")
    ends = thin.groupBy("url_key", "span").agg(F.max(candidate).alias("end"))
    carried = ends.withColumn("carried", F.max("end").over(W.partitionBy("url_key").orderBy("span").rowsBetween(W.unboundedPreceding, -1)))
    found = in_span.join(carried.select("url_key", "span", "carried"), ["url_key", "span"], "left").select("n", F.coalesce("here", "carried").alias("ref"))
    found = found.where("ref is not null").select("n", F.col("ref.record_id").alias("ref_id"), F.col("ref.at").alias("ref_at"), "ref")
    # Few responses are asked for: their headers move, and only theirs.
    wanted = rows.where("full").join(found.select(F.col("ref_id").alias("record_id"), F.col("ref_at").alias("at")).distinct(), ["record_id", "at"])
    stored = F.struct("status", "digest", F.array_sort(F.map_entries("headers")).alias("entries"))
    old = wanted.groupBy(F.col("record_id").alias("ref_id"), F.col("at").alias("ref_at")).agg(F.max(stored).alias("stored")).select(
        "ref_id", "ref_at", F.col("stored.status").alias("old_status"), F.col("stored.digest").alias("old_digest"), F.map_from_entries("stored.entries").alias("old")
    )
    answered = lasting(saved(found.select("n", "ref_id", "ref_at").join(old, ["ref_id", "ref_at"]).drop("ref_at"), "answers"))
    both = rows.where("revisit").select("n", "record_id", "url_key", F.col("headers").alias("new"), F.col("digest").alias("new_digest")).join(answered, "n", "left")
    agrees = F.coalesce(
        _weak(_header("new", "etag")) == _weak(_header("old", "etag")), _header("new", "last-modified") == _header("old", "last-modified"), F.col("new_digest") == F.col("old_digest")
    )
    outcome = F.when(F.col("ref_id").isNull(), "no_response").when(agrees, "resolved").when(~agrees, "mismatch").otherwise("unverified")
    kept = F.map_filter("old", lambda k, v: ~F.coalesce(F.array_contains(F.map_keys(F.col("taken")), k), F.lit(False)))
    taken = F.map_filter(F.coalesce("new", F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    good = F.col("outcome") == "resolved"
    return both.withColumn("outcome", outcome).withColumn("taken", taken).select(
        "record_id", "url_key", "ref_id", "outcome",
        F.when(good, F.col("old_status")).alias("status"), F.when(good, F.map_concat(kept, "taken")).alias("headers"), F.when(good, F.col("old_digest")).alias("digest"),
    )


def captures_of(pages: DataFrame) -> DataFrame:
    """WARC records of a crawl of `pages`: the fixture that stands for an archive here.

    Page p is captured in full at second 10 p, and asked for again later under a variant
    of its url (another scheme, `www.`, fragment or tracking parameter). Of the second
    captures those of p % 7 = 3 carry another ETag, those of p % 11 = 5 are dated before
    the full one, those of p % 5 = 1 have no ETag but a Last-Modified, and those of
    p % 13 = 6 share no validator."""
    p, html = F.col("page_id"), F.coalesce(F.col("html"), F.lit(""))
    tag = F.concat(F.lit('"'), F.md5(html), F.lit('"'))
    start = F.timestamp_seconds(F.lit(1_700_000_000) + p * 10)
    digest = F.concat(F.lit("sha256:"), F.sha2(html, 256))
    modified = F.concat(F.lit("day "), (p % 365).cast("string"))
    none = F.lit(None).cast("string")
    response = pages.select(
        (p * 2).alias("record_id"), "url", start.alias("date"), F.lit("response").alias("type"), F.lit(200).alias("status"),
        F.map_filter(
            F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.octet_length(html).cast("string"), F.lit("etag"), F.when(p % 13 == 6, none).otherwise(tag), F.lit("last-modified"), F.when(p % 13 == 6, none).otherwise(modified), F.lit("date"), F.concat(F.lit("t"), (p * 10).cast("string"))),
            lambda k, v: v.isNotNull(),
        ).alias("headers"),
        F.when(p % 13 == 6, none).otherwise(digest).alias("digest"),
    )
    bare = F.regexp_replace(F.col("url"), "#.*$", "")
    joint = F.when(F.contains(bare, F.lit("?")), F.lit("&")).otherwise(F.lit("?"))
    variant = F.when(p % 3 == 0, F.concat(bare, F.lit("#again"))).when(p % 3 == 1, F.concat(bare, joint, F.lit("utm_source=feed"))).otherwise(F.regexp_replace(bare, "^https?://", "https://"))
    later = F.when(p % 11 == 5, F.timestamp_seconds(F.lit(1_700_000_000) + p * 10 - 7)).otherwise(F.timestamp_seconds(F.lit(1_700_000_000) + p * 10 + 86_400))
    sent = F.when(p % 5 == 1, none).when(p % 7 == 3, F.lit('"changed"')).otherwise(F.concat(F.lit("W/"), tag))
    revisit = pages.select(
        (p * 2 + 1).alias("record_id"), variant.alias("url"), later.alias("date"), F.lit("revisit").alias("type"), F.lit(304).alias("status"),
        F.map_filter(
            F.create_map(F.lit("etag"), sent, F.lit("last-modified"), F.when(p % 5 == 1, modified), F.lit("date"), F.concat(F.lit("t"), (p * 10 + 86_400).cast("string")), F.lit("content-length"), F.lit("0")),
            lambda k, v: v.isNotNull(),
        ).alias("headers"),
        none.alias("digest"),
    )
    return response.unionByName(revisit)
