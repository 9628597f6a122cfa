"""A corpus pipeline of five stages over `documents`, each of them one of the operators in
sitewarden.llm. Every stage gets what its predecessor kept, written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sitewarden.llm import bpe, language_id, line_dedup, minhash, mixing
from sitewarden.llm._shared import drop_saved, lasting, saved, scratch, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified (operator 2). Null texts and texts without a letter
    go; rows with null or repeated ids are judged like any other; no rows, no rows."""
    return language_id.keep_identified(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the lines that they keep (operator 8), n_chars counted anew. A document
    that loses its last line goes: others hold all that it said. Rows with a null id keep
    all their lines; rows that share an id count as one document; null texts stay null."""
    return line_dedup.without_repeated_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (operator 5), and one of rows that share id
    and text. Rows with a null id and texts without words are in no group and stay. A text of any
    length is compared whole; no rows, no rows."""
    return minhash.keep_representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them (operator 10), each row by its own
    count. A null source is a source; a text without words has no size and counts nothing; a very
    long one counts all its words; no rows, no rows."""
    return mixing.apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with hashes of the ids and of the decoded text (operator 7).
    Null text is empty text; null and repeated ids stay as they are; a very long text is encoded
    whole; no rows, no rows."""
    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("word_bpe", encode),
]

#: Neither language profiles nor merges can be said in SQL; a test runs every stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' result over documents. Each stage's output is deleted once the next one is
    written, and all that a stage saves with it; the last one's stays until release()."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark):
            docs = lasting(saved(stage(spark, docs, sf_dir), f"stage-{name}"))
        if before is not None:
            drop_saved(before)
        before = docs
    return docs
