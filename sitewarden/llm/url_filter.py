"""URL filters: rules first, then logistic regression on hashed character n-grams."""

from __future__ import annotations

import functools
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .url_labels import labelled_urls

GRAMS = (3, 4, 5)
BUCKETS = 1 << 16
#: What all urls to block weigh in the fit.
BLOCK_SHARE = 0.4
#: Urls are scored in slices of about so many characters, each of which has six numbers at a time.
SLICE_CHARS = 1 << 18
_BASE = np.uint64(0x100000001B3)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)

#: (host/path prefix, verdict). A rule fits its host and all subdomains.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty if the url is null or has no `://`."""
    pattern = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, k), F.lit("")) for k in (1, 2))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def decide(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict, or nulls. Of rules of equal
    length the first in code point order is taken. Rules are a table of decisions, not
    data: literals of the plan, one test each."""
    rule, verdict = F, F
    for text, says in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        of, slash, start = text.partition("/")
        fits = ((host == of) | F.endswith(host, F.lit("." + of))) & F.startswith(path, F.lit(slash + start))
        rule, verdict = rule.when(fits, F.lit(text)), verdict.when(fits, F.lit(says))
    none = F.lit(None).cast("string")
    return (none, none) if rule is F else (rule, verdict)


def features(urls: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of hosts and paths: (row, bucket) pairs, in order of rows. Each part
    stands between marks, and host and path have hashes of their own."""
    rows, buckets = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for part in (0, 1):
        raw = [b"\x02" + u[part].encode() + b"\x03" for u in urls]
        flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64) + np.uint64(1)
        owner = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
        for n in GRAMS:
            if len(flat) < n:
                continue
            h = np.full(len(flat) - n + 1, 1 + part * 8 + n, np.uint64)
            for k in range(n):
                h = h * _BASE + flat[k : len(flat) - n + 1 + k]
            h = (h ^ (h >> np.uint64(29))) * _GOLDEN
            own = owner[: len(h)] == owner[n - 1 :]
            rows.append(owner[: len(h)][own])
            buckets.append((h[own] >> np.uint64(48)).astype(np.int64))
    row, bucket = np.concatenate(rows), np.concatenate(buckets)
    order = np.argsort(row, kind="stable")
    return row[order], bucket[order]


class Classifier:
    """Logistic regression; a url's features are scaled to length one."""

    def __init__(self, urls: list[tuple[str, str]], blocked: list[bool], rounds: int = 500, rate: float = 8.0, decay: float = 1e-5):
        """Fit by full gradient steps from zero, so that the same table gives the same weights.
        urls: (host, path) of a table small enough for the driver."""
        y = np.array(blocked, float)
        self.weights, self.bias = np.zeros(BUCKETS), 0.0
        row, bucket = features(urls)
        scale = 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=len(urls))))
        # What a kind weighs doesn't depend on how many urls there are of it. The scales tip to keeping.
        share = np.where(y > 0, BLOCK_SHARE / max(1.0, y.sum()), (1 - BLOCK_SHARE) / max(1.0, (1 - y).sum()))
        for _ in range(rounds):
            error = (1 / (1 + np.exp(-self._linear(row, bucket, scale))) - y) * share
            self.weights -= rate * (np.bincount(bucket, (error * scale)[row], BUCKETS) + decay * self.weights)
            self.bias -= rate / 8 * error.sum()

    def _linear(self, row: np.ndarray, bucket: np.ndarray, scale: np.ndarray) -> np.ndarray:
        return np.bincount(row, self.weights[bucket], len(scale)) * scale + self.bias

    def scores(self, urls: list[tuple[str, str]]) -> np.ndarray:
        """The probability of "block" for each (host, path)."""
        if not urls:
            return np.zeros(0)
        row, bucket = features(urls)
        scale = 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=len(urls))))
        return 1 / (1 + np.exp(-self._linear(row, bucket, scale)))


def fit(labelled: DataFrame, most: int = 100_000) -> Classifier:
    """A classifier of (url, verdict) rows. The table is collected, `most` rows of it at most:
    more is an error, and null urls are left out."""
    host, path = split_url(F.col("url"))
    rows = labelled.where("url is not null and verdict is not null").select(host.alias("host"), path.alias("path"), "verdict").orderBy("host", "path", "verdict").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} labelled urls")
    return Classifier([(r["host"], r["path"]) for r in rows], [r["verdict"] == "block" for r in rows])


@functools.cache
def own_classifier() -> Classifier:
    """The classifier of labelled_urls(), fitted once for a process."""
    rows = []
    for url, verdict in labelled_urls():
        host, slash, path = url.partition("://")[2].partition("/")
        rows.append(((host, slash + path), verdict == "block"))
    return Classifier(*map(list, zip(*sorted(rows))))


def judge(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, score) of every row: the verdict of the longest rule
    that fits the url, else of the classifier (block at 0.5 or more). rule is null where no
    rule fits; score is the classifier's probability of "block" in any case. labelled: (url,
    verdict), labelled_urls() if not given.

    Only the url is read, nothing is shuffled; host, path and rule are Spark expressions,
    the score is made in Arrow batches. A null url, or one without `://`, has an empty host
    and path and fits no rule. Null ids and repeated rows stay as they are, whatever other
    columns pages has (host, rule, score ...) isn't read, an empty table gives no rows. Urls of
    any length are judged whole, in slices of a batch bounded by their bytes."""
    spark = pages.sparkSession
    model = own_classifier() if labelled is None else fit(labelled)
    shared = spark.sparkContext.broadcast(model)
    host, path = split_url(F.col("url"))
    rule, says = decide(F.col("host"), F.col("path"), rules)
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", host.alias("host"), path.alias("path"))
    ruled = urls.select("id", "host", "path", rule.alias("rule"), says.alias("says"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, scores, start, size = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())), [np.zeros(0)], 0, 0
            for k, u in enumerate(urls):
                size += len(u[0]) + len(u[1])
                if size > SLICE_CHARS or k + 1 == len(urls):
                    scores.append(shared.value.scores(urls[start : k + 1]))
                    start, size = k + 1, 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores))], names=["id", "host", "path", "rule", "says", "score"])

    kind = ruled.schema["id"].dataType.simpleString()
    scored = ruled.mapInArrow(run, f"id {kind}, host string, path string, rule string, says string, score double")
    verdict = F.coalesce("says", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "score")
