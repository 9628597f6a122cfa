"""The page cache: lifetimes, validity, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.sqltext import SPARK
from ..functions.urls import ttl_seconds


def with_expiry(cache: DataFrame, since: str = "created_at") -> DataFrame:
    """cache with expires_at, by the lifetime of its page type."""
    return cache.withColumn("expires_at", F.col(since) + F.make_dt_interval(secs=F.expr(ttl_seconds(SPARK, "page_type")).cast("decimal(18,6)")))


def valid(cache: DataFrame, as_of: Column) -> DataFrame:
    """Entries that haven't expired at as_of."""
    return with_expiry(cache).where(F.col("expires_at") > as_of)


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """The cache after new fetches (same columns): by url the newest row wins, but the first
    created_at stays. Fetches without a page or with a status other than 200 are ignored.
    Where both have updated_at, that says which row is the newest. Both sides meet in one aggregation: the state of a url is one small struct."""
    good = new.where((F.col("status") == 200) & F.col("content_hash").isNotNull())
    both = old.select("*", F.lit(0).alias("turn")).unionByName(good.select("*", F.lit(1).alias("turn")))
    at = "updated_at" if "updated_at" in old.columns else "created_at"
    fields = [c for c in old.columns if c not in ("url", "created_at", "updated_at")]
    last = both.groupBy("url").agg(
        F.max(F.struct("turn", F.col(at).alias("updated_at"), *fields)).alias("r"), F.min("created_at").alias("created_at")
    )
    return last.select("url", "created_at", "r.updated_at", *[f"r.{c}" for c in fields])
