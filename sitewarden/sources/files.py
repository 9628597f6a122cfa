"""Readers of the formats that sites and agents leave, and sinks of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def robots_files(spark: SparkSession, path: str) -> DataFrame:
    """(site_id, content): one robots.txt in each file, its name (without ending) being the site."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("site_id"), F.col("value").alias("content"))


def code_table(spark: SparkSession, path: str) -> DataFrame:
    """(mcc, description, ...) of a file that holds one JSON array of objects."""
    schema = "mcc string, description string, category string, subcategory string, `range` string, networks array<string>, risk_level string, active boolean"
    return spark.read.schema(schema).json(path, multiLine=True)


def networks(text: Column) -> Column:
    """An array of a `{a,b}` text; null for an empty one."""
    inner = F.regexp_replace(text, r"^\{|\}$", "")
    return F.when(inner != "", F.split(inner, ","))


def registry_urls(domain: Column, bases: Column) -> Column:
    """Where to ask a registry for a domain: one url for each base, without the slashes at its
    end, the first of equal ones only."""
    return F.array_distinct(F.transform(bases, lambda b: F.concat(F.regexp_replace(b, "/+$", ""), F.lit("/domain/"), domain)))


def registry_facts(answers: DataFrame, as_of: Column) -> DataFrame:
    """Facts of domain registry answers (site_id, body as JSON): registered and expiry dates (the
    first event of that kind), age in days at as_of, up to ten name servers, whether signed."""
    schema = "events array<struct<eventAction: string, eventDate: string>>, nameservers array<struct<ldhName: string>>, secureDNS struct<delegationSigned: boolean>"
    parsed = answers.select("site_id", F.from_json("body", schema).alias("r"))
    when = lambda word: F.to_date(F.get(F.filter("r.events", lambda e: F.contains(F.lower(e["eventAction"]), F.lit(word))), F.lit(0))["eventDate"].substr(1, 10))
    return parsed.select("site_id", when("registration").alias("registered"), when("expiration").alias("expires"), F.slice(F.transform("r.nameservers", lambda n: F.lower(n["ldhName"])), 1, 10).alias("name_servers"), F.coalesce("r.secureDNS.delegationSigned", F.lit(False)).alias("signed")).withColumn("age_days", F.datediff(as_of, "registered"))


def tolerant_json(text: Column) -> Column:
    """The first JSON object in a text that may stand in code fences; null if there is none."""
    body = F.regexp_extract(F.regexp_replace(text, r"```[a-z]*", ""), r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(body).isNotNull(), body)


def unwrap_output(output: Column) -> Column:
    """A task's report, which may be JSON within a JSON string."""
    return F.coalesce(F.get_json_object(output, "$.response"), output)


def with_base(html: Column, url: Column) -> Column:
    """html with a <base> of its url after the first <head> (or <html>)."""
    tag = F.concat(F.lit('<base href="'), url, F.lit('">'))
    place = F.when(html.rlike("(?i)<head[^>]*>"), F.regexp_extract(html, "(?i)<head[^>]*>", 0)).otherwise(F.regexp_extract(html, "(?i)<html[^>]*>", 0))
    at = F.when(place == "", 0).otherwise(F.call_function("instr", html, place) + F.length(place) - 1)
    return F.concat(F.substring(html, F.lit(1), at), tag, F.substring(html, at + 1, F.length(html)))


def write_json_reports(reports: DataFrame, path: str, text: str = "report") -> None:
    """One JSON document a line, in as many files as partitions."""
    reports.select(F.col(text).alias("value")).write.text(path)


def write_markdown_reports(reports: DataFrame, path: str, key: str = "site_id", text: str = "report") -> None:
    """Reports as Parquet by bucket of the key, so that one is found without scanning all."""
    reports.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(64))).write.partitionBy("bucket").parquet(path)
