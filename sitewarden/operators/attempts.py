"""Fetch attempts: from a log of every try to one final row for each url, and counters by site."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import crawl

MAX_RETRIES = 1
BACKOFF_MS = 2000
PAGE_TIMEOUT_S = 12


def outcomes(log: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """(site_id, url, status, final_url, content_type, body, error_type, message, retries, waited_ms,
    pending) of a log (site_id, url, attempt, status, failure, final_url, content_type, body), one row
    for each url. Attempts are numbered from 0; failure is null, `timeout` or what went wrong.

    An attempt ends the fetch if it has an answer below 500 (no client error is tried again), or
    if it is number max_retries; the first that does is the outcome, whatever was logged
    after it. Before each retry the wait doubles. A url whose log stops before that is
    pending, with its last attempt. Of rows that share a number the least counts. The body counts for html only, and not for server errors.

    One aggregation: the outcome is the least ending attempt, so a url's log is never gathered."""
    row = F.struct(F.col("attempt"), F.col("status"), F.col("failure"), F.col("final_url"), F.col("content_type"), F.col("body"))
    ends = (F.col("failure").isNull() & (F.col("status") < 500)) | (F.col("attempt") >= max_retries)
    found = log.groupBy("site_id", "url").agg(F.min(F.when(ends, row)).alias("end"), F.max(row).alias("last"))
    x = found.select("site_id", "url", F.col("end").isNull().alias("pending"), F.coalesce("end", "last").alias("x")).select("site_id", "url", "pending", "x.*")
    failed = F.col("failure").isNotNull()
    status = F.when(failed, 0).otherwise(F.col("status"))
    number = F.col("status").cast("string")
    after = F.concat(F.lit(" after "), F.col("attempt").cast("string"), F.lit(" retries"))
    message = (
        F.when(F.col("failure") == "timeout", F.concat(F.lit(f"Page timeout ({PAGE_TIMEOUT_S}s)"), after)).when(failed, F.col("failure"))
        .when(F.col("status") == 410, "HTTP 410 Gone").when(F.col("status").between(400, 499), F.concat(F.lit("HTTP "), number))
        .when(F.col("status") >= 500, F.concat(F.lit("HTTP "), number, after))
    )
    kind = F.when(failed, crawl.error_type(F.col("failure"), F.lit(None).cast("int"))).when(F.col("status") >= 400, "http_error")
    html = F.contains(F.lower(F.coalesce("content_type", F.lit(""))), F.lit("text/html"))
    body = F.when(html & ~failed & (F.col("status") < 500) & (F.col("status") != 410), F.col("body"))
    return x.select(
        "site_id", "url", status.cast("int").alias("status"), F.coalesce("final_url", "url").alias("final_url"), F.coalesce("content_type", F.lit("")).alias("content_type"),
        F.coalesce(body, F.lit("")).alias("body"), kind.alias("error_type"), message.alias("message"), F.col("attempt").alias("retries"),
        (F.lit(BACKOFF_MS) * (F.pow(F.lit(2), F.col("attempt")) - 1)).cast("long").alias("waited_ms"), "pending",
    )


def raw_bodies(log: DataFrame) -> DataFrame:
    """(site_id, url, content): the files of a log (robots files, sitemaps) whose first attempt was
    answered with 200. These are never tried again, whatever their type."""
    return log.where("attempt = 0 and failure is null and status = 200").groupBy("site_id", "url").agg(F.min("body").alias("content"))


def counters(fetched: DataFrame) -> DataFrame:
    """For each site of outcomes(): urls, successes, failures, and how many were tried again, timed
    out, or are pending."""
    return fetched.groupBy("site_id").agg(
        F.count("*").alias("urls"), F.count_if(F.col("status") == 200).alias("success"), F.count_if((F.col("status") != 200) & ~F.col("pending")).alias("failed"),
        F.count_if(F.col("retries") > 0).alias("retried"), F.count_if(F.coalesce(F.contains(F.lower("message"), F.lit("timeout")), F.lit(False))).alias("timeouts"),
        F.sum("waited_ms").alias("waited_ms"), F.count_if("pending").alias("pending"),
    )
