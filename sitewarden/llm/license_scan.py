"""License scans: texts that run along a known license text for long enough, found by diagonals."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .license_texts import TEMPLATES

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Phrases that name a license, and the label of each.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Words of a gram, how far apart neighbouring diagonals may be, and the share of a template's words that a span must cover.
GRAM, DRIFT, PERCENT = 4, 3, 75
#: The score of a document that only names a license.
NAMED = 0.5
#: Templates of so many words in all are sent to every executor; more than that are joined by shuffling.
BROADCAST_WORDS = 500_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _grams() -> Column:
    """Of a row with `words`: one struct (hash, word) for each place where GRAM words stand."""
    hashed = ", ".join(f"get(words, i + {j})" for j in range(GRAM))
    return F.expr(f"CASE WHEN size(words) >= {GRAM} THEN transform(sequence(0, size(words) - {GRAM}), i -> struct(xxhash64({hashed}) AS hash, get(words, i) AS word)) ELSE array() END")


def template_grams(spark: SparkSession, templates: tuple[tuple[str, str], ...]) -> DataFrame:
    """(template, label, m, tpl_pos, hash, tpl_word): the grams of every template, m being its
    number of words. Shorter templates than DRIFT + 2 words are refused: side by side, copies
    of one would lie on neighbouring diagonals."""
    total = 0
    for label, text in templates:
        n = len(re.findall(WORD, text.lower()))
        if n < max(GRAM, DRIFT + 2):
            raise ValueError(f"the template of {label} has {n} words, and {max(GRAM, DRIFT + 2)} are needed: {text[:60]}")
        total += n
    listed = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(text).alias("text")) for i, (label, text) in enumerate(templates)])
    rows = spark.range(1).select(F.inline(listed)).select("template", "label", words_of(F.col("text")).alias("words"))
    grams = rows.select("template", "label", F.size("words").alias("m"), F.posexplode(_grams())).select("template", "label", "m", F.col("pos").alias("tpl_pos"), "col.hash", F.col("col.word").alias("tpl_word"))
    return F.broadcast(grams) if total <= BROADCAST_WORDS else grams


def _spans(rows: DataFrame, templates: tuple[tuple[str, str], ...]) -> DataFrame:
    """(id, text_hash, template, label, m, start, end, covered) of rows (id, text_hash, words)."""
    places = rows.select("id", "text_hash", F.posexplode(_grams())).select("id", "text_hash", F.col("pos").alias("doc_pos"), "col.hash", "col.word")
    hits = places.join(template_grams(rows.sparkSession, templates), "hash").where("word = tpl_word").withColumn("diagonal", F.col("doc_pos") - F.col("tpl_pos"))
    document = ["id", "text_hash"]
    # On a diagonal a template's place has one place in the text, so these sets are votes, and no larger than the template.
    diagonals = hits.groupBy(*document, "template", "label", "m", "diagonal").agg(F.collect_set("tpl_pos").alias("votes"), F.min("doc_pos").alias("low"), F.max("doc_pos").alias("high"))
    along = W.partitionBy(*document, "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > DRIFT, F.lit(True))
    clusters = diagonals.withColumn("new", apart.cast("int")).withColumn("cluster", F.sum("new").over(along))
    merged = clusters.groupBy(*document, "template", "label", "m", "cluster").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("votes")))).alias("votes"), F.min("low").alias("start"), (F.max("high") + GRAM).alias("end")
    )
    covered = F.expr(f"aggregate(votes, struct(-{GRAM} AS last, 0 AS n), (a, x) -> struct(x AS last, a.n + least({GRAM}, x - a.last) AS n), a -> a.n)")
    verified = merged.withColumn("covered", covered).where((100 * F.col("covered") >= PERCENT * F.col("m")) & (2 * (F.col("end") - F.col("start")) <= 3 * F.col("m")))
    # Of spans that overlap, those of the most covered words stay, and of equal ones those of the shortest template.
    longest = max(3 * len(re.findall(WORD, text.lower())) // 2 for _, text in templates)
    near = F.collect_list(F.struct("start", "end", "covered", "m")).over(W.partitionBy(*document).orderBy("start").rangeBetween(-longest, longest))
    beaten = F.expr("exists(near, o -> o.start < end AND start < o.end AND (o.covered > covered OR (o.covered = covered AND o.m < m)))")
    return verified.withColumn("near", near).where(~beaten).select(*document, "template", "label", "m", "start", "end", "covered")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), words_of(F.col(text_col)).alias("words"))


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """(id, label, template, start, end, score): every span of a text, in words, that is a
    license text; score is the share of the template's words that it covers.

    1. Every gram of GRAM words of every text is hashed and joined with the grams of all
       templates, and its first word compared as text.
    2. Hits vote by diagonal (place in the text less place in the template).
    3. Diagonals of one text and template that are at most DRIFT apart are one candidate, so
       that a word put in or left out doesn't end it.
    4. A candidate is a span if its grams cover PERCENT of the template's words, and it is
       no longer than one and a half times the template. Of overlapping spans the one that
       covers most stays, all of equal ones.

    Only DataFrame functions. Hits are what moves, never texts. Rows that share id and text
    are one document here; null and empty texts have no span; a null id is an id like others;
    other columns aren't read; an empty table gives no rows."""
    found = _spans(_rows(docs, id_col, text_col), templates)
    return found.select(F.col("id").alias(id_col), "label", "template", "start", "end", (F.col("covered") / F.col("m")).alias("score"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row for each
    row of docs.

    Base places are where a phrase's words stand one after the other: their number, the first
    and the last, and their labels. labels has these and the labels of license_spans(); both are
    sorted and joined by commas, empty where there are none. score is the best span's, or
    NAMED at least where there is a base place, else 0.

    Null text is empty text; repeated rows, also of a null id, give equal rows; other columns
    aren't read; an empty table gives no rows; a very long text is one row's array of words."""
    rows = _rows(docs, id_col, text_col)
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    tests = []
    for phrase, _ in phrases:
        parts = phrase.split(" ")
        stands = " AND ".join(f"get(words, i + {j}) = '{w}'" for j, w in enumerate(parts))
        named = " AND ".join(f"contains(lowered, '{w}')" for w in parts)
        tests.append(F.expr(f"CASE WHEN {named} AND size(words) > 0 THEN filter(sequence(0, size(words) - 1), i -> coalesce({stands}, false)) ELSE array() END"))
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), text.alias("lowered"), words_of(F.col(text_col)).alias("words"))
    base = base.select("id", "text_hash", F.size("words").cast("long").alias("n_words"), F.array(*tests).alias("places"))
    every = F.flatten("places")
    labels = F.array(*[F.when(F.size(F.col("places")[k]) > 0, label) for k, (_, label) in enumerate(phrases)])
    facts = base.select(
        "id", "text_hash", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"), F.array_sort(F.array_distinct(F.array_compact(labels))).alias("base"),
    )
    spans = _spans(rows, templates).groupBy("id", "text_hash").agg(F.collect_set("label").alias("more"), F.max(F.col("covered") / F.col("m")).alias("best"))
    spans = spans.select(F.col("id").alias("span_id"), F.col("text_hash").alias("span_hash"), "more", "best")
    both = facts.join(spans, F.col("id").eqNullSafe(F.col("span_id")) & (F.col("text_hash") == F.col("span_hash")), "left")
    joined = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return both.select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(joined, ",").alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, NAMED).otherwise(0.0)).alias("score"),
    )
