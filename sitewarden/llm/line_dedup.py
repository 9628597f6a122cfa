"""Line dedup over all documents. DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ._shared import lasting, saved, scratch, shuffle_partitions

_GAP_CHARS = " \t\n\x0b\x0c\r"
MIN_CHARS = 10


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    trimmed = F.btrim(line, F.lit(_GAP_CHARS))
    ascii_only = F.octet_length(trimmed) == F.char_length(trimmed)
    return F.when(ascii_only, F.lower(trimmed)).otherwise(F.translate(trimmed, string.ascii_uppercase, string.ascii_lowercase))


def _lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(h1, h2, id, th, pos): 128-bit hash, document and position of every line that counts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (
        docs.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
        .select("id", "th", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2"), "id", "th", "pos")
    )


def _hot(lines: DataFrame, ranges: int) -> DataFrame:
    """(h1, h2, salts): hashes with more rows than a range holds on average, and over how many
    parts they are to spread. `ranges` rows at most. A sample finds them: they decide
    where rows go, not what comes out."""
    found = lines.sample(0.01, seed=5).groupBy("h1", "h2").agg(F.count("*").alias("n"))
    total = found.agg(F.sum("n")).first()[0] or 0
    fair = max(20, total / ranges)
    return found.where(F.col("n") > fair).select("h1", "h2", F.ceil(F.col("n") / fair).cast("int").alias("salts"))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, text_hash, keep array<struct<word int, mask long>>, n_dropped long), one row for
    each document that loses lines.

    Bit p % 64 of the mask of word p div 64 is set if line p stays. Words in which every
    bit is set are left out, so documents that keep everything have no row at all.

    Rows of 128-bit line hashes are dealt into ranges of the hash and sorted by hash,
    document and position. In that stream a row is a hash's first occurrence if the row
    before it has another hash, and its document is carried along to the rows that
    follow. Hashes are uniform, so equal ranges hold equal shares, but for single hashes
    with more rows than a range: these are spread over several parts of their range by
    document, and the first documents of their parts meet in a second table of a row for
    each part. All lines are shuffled once.

    text_hash tells rows apart that repeat an id with another text; such rows count as
    one document where "two documents" are asked for. A row with a null id keeps all
    its lines and drops none elsewhere. Null text is one empty line. An empty table
    gives no rows; further columns are not read.
    """
    with scratch(docs.sparkSession):
        ranges = 4 * shuffle_partitions(docs.sparkSession)
        lines = saved(_lines(docs, id_col, text_col, min_chars), "lines")
        hot = saved(_hot(lines, ranges), "hot-lines")
        # The sign-shifted high bits of the hash, cut into equal ranges.
        at = F.floor((F.shiftrightunsigned("h1", 33).cast("double") / float(1 << 31)) * ranges).cast("int")
        dealt = lines.join(F.broadcast(hot), ["h1", "h2"], "left").withColumns(
            {"range": at, "salt": F.when(F.col("salts").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("id"), F.col("salts").cast("long")))}
        )
        stream = W.partitionBy("range", "salt").orderBy("h1", "h2", "id", "pos")
        opens = ~F.coalesce((F.lag("h1").over(stream) == F.col("h1")) & (F.lag("h2").over(stream) == F.col("h2")), F.lit(False))
        first = F.last(F.when(F.col("opens"), F.col("id")), ignorenulls=True).over(stream.rowsBetween(W.unboundedPreceding, W.currentRow))
        found = dealt.withColumn("opens", opens).withColumn("first_id", first)
        edge = (F.col("salt") > 0) & (F.col("id") == F.col("first_id"))
        repeats = saved(found.where((F.col("id") > F.col("first_id")) | edge).select("h1", "h2", "id", "th", "pos", "first_id", edge.alias("edge")), "line-repeats")
        edges = F.broadcast(repeats.where("edge").groupBy("h1", "h2").agg(F.min("first_id").alias("least_id")))
        dropped = repeats.join(edges, ["h1", "h2"], "left").where("not edge or id > least_id")
        words = dropped.groupBy("id", "th", F.expr("pos div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("mask"))
        out = words.groupBy("id", "th").agg(
            F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("mask").alias("mask")))).alias("keep"), F.sum(F.bit_count("mask")).cast("long").alias("n_dropped")
        )
        return lasting(saved(out.select(F.col("id").alias(id_col), F.col("th").alias("text_hash"), "keep", "n_dropped"), "line-bitmaps"))


def _applied(docs: DataFrame, bitmaps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, kept, n_lines, n_dropped) for each row of docs, whose columns are in `row`."""
    marks = bitmaps.select(F.col(id_col).alias("mark_id"), F.col("text_hash").alias("mark_hash"), F.map_from_entries("keep").alias("masks"), F.col("n_dropped").alias("n"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("whole"))
    both = packed.join(marks, (F.col("id") == F.col("mark_id")) & (F.xxhash64("whole") == F.col("mark_hash")), "left")
    lines = F.split("whole", "\n", -1)

    def stays(i: Column) -> Column:
        mask = F.coalesce(F.try_element_at(F.col("masks"), F.floor(i / 64).cast("int")), F.lit(-1).cast("long"))
        return mask.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (i % 64).cast("int"))) != 0

    kept = F.when(F.col("mark_id").isNull(), F.col("whole")).otherwise(F.array_join(F.filter(lines, lambda x, i: stays(i)), "\n"))
    return both.select("row", kept.alias("kept"), F.size(lines).cast("long").alias("n_lines"), F.coalesce("n", F.lit(0)).cast("long").alias("n_dropped"))


def kept_lines(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with its bitmaps applied: columns of docs, then kept_text, n_lines, n_dropped. A column
    of docs with one of these three names gives way to it."""
    made = ["kept_text", "n_lines", "n_dropped"]
    return _applied(docs, bitmaps, id_col, text_col).select(
        *[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in made], F.col("kept").alias("kept_text"), "n_lines", "n_dropped"
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """kept_lines() of docs under its own keep_bitmaps()."""
    return kept_lines(docs, keep_bitmaps(docs, id_col, text_col, min_chars), id_col, text_col)


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", min_chars: int = MIN_CHARS) -> DataFrame:
    """docs, in its own columns, with the lines that stay. A row that loses its last line goes:
    others hold all that it said. Rows that lose nothing are passed as they are (null text
    stays null); length_col, if docs has it, counts the characters of changed texts anew."""
    changed = F.col("n_dropped") > 0
    fresh = {text_col: F.col("kept"), length_col: F.char_length("kept")}
    kinds = dict(docs.dtypes)
    rows = _applied(docs, keep_bitmaps(docs, id_col, text_col, min_chars), id_col, text_col).where("n_dropped < n_lines")
    return rows.select(*[
        (F.when(changed, fresh[c].cast(kinds[c])).otherwise(F.col(f"row.`{c}`")) if c in fresh else F.col(f"row.`{c}`")).alias(c) for c in docs.columns
    ])
