"""Merchant category codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.sqltext import SPARK, Dialect, cases
from ..rules import mcc as R


def band(d: Dialect, code: str) -> str:
    return cases([(f"CAST({code} AS INT) <= {last}", d.text(name)) for last, name in R.BANDS], "NULL")


def with_bands(codes: DataFrame) -> DataFrame:
    """Codes (mcc, description, ord), the last of equal codes only, with category and range."""
    last = codes.groupBy("mcc").agg(F.max_by("description", "ord").alias("description"))
    start = F.floor(F.col("mcc").cast("int") / 100) * 100
    return last.select("mcc", "description", F.expr(band(SPARK, "mcc")).alias("category"), F.concat(start.cast("string"), F.lit("-"), (start + 99).cast("string")).alias("mcc_range"))


def parse_code_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """(mcc, description) of text lines that begin with a four-digit code."""
    return lines.select(F.regexp_extract(col, r"^(\d{4})\s+(.+)$", 1).alias("mcc"), F.regexp_extract(col, r"^(\d{4})\s+(.+)$", 2).alias("description")).where("mcc <> ''")


def insert_missing(old: DataFrame, new: DataFrame) -> DataFrame:
    """Codes of new that old has not; the first of equal ones by ord."""
    fresh = new.join(old.select("mcc"), "mcc", "left_anti")
    return fresh.groupBy("mcc").agg(F.min_by("description", "ord").alias("description"))


def listed(codes: DataFrame, active_only: bool = True) -> DataFrame:
    """Codes by number; those that aren't active only if asked for."""
    return (codes.where("active") if active_only else codes).orderBy("mcc")


def decide(decisions: DataFrame, codes: DataFrame, tasks: DataFrame) -> DataFrame:
    """Validation of decisions (id, mcc, task_id): the first check that fails, or ok."""
    known = codes.groupBy("mcc").agg(F.max("active").alias("active"))
    return (
        decisions.join(known, "mcc", "left").join(tasks.select(F.col("id").alias("task_id"), F.lit(True).alias("has_task")), "task_id", "left")
        .select("id", "mcc", "task_id", F.when(F.col("active").isNull(), "unknown_code").when(~F.col("active"), "inactive_code").when(F.col("has_task").isNull(), "unknown_task").otherwise("ok").alias("result"))
    )


def hits_sql(d: Dialect, text: str) -> str:
    """An array with the number of keyword hits of every code, in order."""
    return d.array([d.size(d.found(text, words)) for *_, words in R.MCC])


def classify(sites: DataFrame, key: str = "site_id", text: str = "page_text", top: int = 10) -> DataFrame:
    """(site, mcc, category, subcategory, confidence, role, low_confidence): up to `top` codes of
    each row, best first; ties in table order. Confidence is 15 for each keyword that the
    text holds, at most 100; the secondary code needs 30.

    The keywords are literals of the expression, so nothing is joined; only codes with a
    hit become rows, and the ranking is over one site's codes."""
    codes = F.array(*[F.struct(F.lit(k).alias("mcc_ord"), F.lit(c).alias("mcc"), F.lit(a).alias("category"), F.lit(b).alias("subcategory")) for k, (a, b, c, _, _) in enumerate(R.MCC)])
    counted = F.zip_with(codes, F.expr(hits_sql(SPARK, text)), lambda c, n: F.struct(c["mcc_ord"].alias("mcc_ord"), c["mcc"].alias("mcc"), c["category"].alias("category"), c["subcategory"].alias("subcategory"), F.least(n * 15, F.lit(100)).alias("confidence")))
    rows = sites.select(key, F.explode(F.filter(counted, lambda x: x["confidence"] > 0)).alias("x")).select(key, "x.*")
    order = W.partitionBy(key).orderBy(F.col("confidence").desc(), "mcc_ord")
    ranked = rows.withColumn("rank_", F.row_number().over(order)).where(F.col("rank_") <= top)
    role = F.when(F.col("rank_") == 1, "primary").when((F.col("rank_") == 2) & (F.col("confidence") >= 30), "secondary").otherwise("match")
    return ranked.select(key, "mcc", "category", "subcategory", "confidence", "rank_", role.alias("role"), ((F.col("rank_") == 1) & (F.col("confidence") < 30)).alias("low_confidence"))
