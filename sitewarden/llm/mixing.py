"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ._shared import in_order, lasting, parts_of, saved, scratch

WORD_GAP = r"[\x20\x09-\x0D]+"
_GAP_CHARS = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Number of runs of characters that are not ASCII white space (null: 0)."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_GAP_CHARS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, WORD_GAP))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], budget: float, repeats: int) -> DataFrame:
    """From (source, source_size): (source, source_size, weight, target, rank_).

    Sources in code point order, null last, get `weights` in turn. The budget is
    `budget` times all sizes; a target stops at `repeats` times its source's size and
    what it leaves is shared again by weight. That is the level v at which
    sum(min(weight * v, cap)) reaches the budget: sources in order of cap / weight
    fill up until the level fits the rest. The table has one row per source.
    """
    named = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank_", F.row_number().over(named) - 1)
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank_") % len(weights) + 1).cast("int"))
    caps = ranked.withColumn("weight", pick).withColumn("cap", (F.col("source_size") * repeats).cast("double"))
    order = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("rank_"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    levels = (
        caps.withColumn("full_cap", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("total", F.lit(float(budget)) * F.sum("source_size").over(whole))
        # The level if all sources before this one are full; it holds for the first source whose cap it doesn't reach.
        .withColumn("level", (F.col("total") - F.col("full_cap")) / F.col("open_weight"))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    )
    level = F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), F.col("rank_"), F.col("level"))).otherwise(None)).over(whole)
    return levels.withColumn("at", level["level"]).select(
        "source", "source_size", "weight", "rank_",
        F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("at") * F.col("weight"))).alias("target"),
    )


def _queues(docs: DataFrame, slices: int, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(row, id, source, size, h, slice) of docs: row holds all its columns, h its place in the
    shuffled order, and slice which part of that order it is in."""
    h = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    # The sign-shifted high bits of the hash: slice k holds the k-th part of the shuffled order.
    part = F.floor((F.shiftrightunsigned("h", 33).cast("double") / float(1 << 31)) * slices).cast("int")
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"), h.alias("h"),
    ).withColumn("slice", part)


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit(""))


def _finish(queues: DataFrame, starts: DataFrame) -> DataFrame:
    """queues with their source's figures and `words`, the source's words up to and with the row."""
    order = W.partitionBy("key", "slice").orderBy(F.shiftrightunsigned("h", 33), "h", F.col("id").asc_nulls_last(), "size")
    within = F.sum("size").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    queued = queues.withColumn("key", _key(F.col("source"))).withColumn("within", within)
    return queued.join(starts, ["key", "slice"]).withColumn("words", F.col("before") + F.col("within"))


def _time(k: int) -> Column:
    """The virtual finish time of a row's k-th copy."""
    return (F.col("words") + F.col("source_size") * k) / F.col("weight")


def _planned(docs: DataFrame, weights, budget, repeats, seed, id_col, text_col, source_col, rows_per_slice, whole: bool) -> DataFrame:
    """_finish() of docs, with copies: how often the mix takes the row. With `whole` the rows of
    docs are carried along (read and ordered a second time), else just id, source and size."""
    thin = saved(_queues(docs, 1, seed, id_col, text_col, source_col).drop("row", "slice"), "mix-sizes")
    slices = max(256, thin.count() // rows_per_slice)
    if not whole:
        lasting(thin)
    thin = thin.withColumn("slice", F.floor((F.shiftrightunsigned("h", 33).cast("double") / float(1 << 31)) * slices).cast("int"))
    per_slice = saved(thin.groupBy("source", "slice").agg(F.sum("size").alias("slice_size")), "mix-slices")
    targets = source_targets(per_slice.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, budget, repeats)
    run = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    starts = per_slice.withColumn("before", F.coalesce(F.sum("slice_size").over(run), F.lit(0))).withColumn("key", _key(F.col("source")))
    starts = starts.join(targets.withColumn("key", _key(F.col("source"))).drop("source"), "key")
    starts = lasting(saved(starts.select("key", "slice", "before", "source_size", "target", "weight", "rank_"), "mix-starts"))
    # All queued copies in the order of their finish times. Only documents of no size can share time and source.
    copies = _finish(thin, starts).select("rank_", "size", F.explode(F.array(*[_time(k) for k in range(repeats)])).alias("finish"))
    ordered = in_order(copies, ["finish", "rank_"], "mix-order")
    parts = saved(parts_of(ordered, words=F.sum("size")), "mix-ranges")
    most = float(budget) * (parts.agg(F.sum("words")).first()[0] or 0) / repeats
    # The budget ends in one range, and only there words are added up row by row.
    last = parts.where(F.col("before_words") <= most).agg(F.max(F.struct("part", "before_words")).alias("x")).first()["x"]
    if last is None:
        cut = (0.0, -1)
    else:
        within = F.sum("size").over(W.orderBy("row").rowsBetween(W.unboundedPreceding, W.currentRow))
        ends = ordered.where(F.col("part") == last["part"]).withColumn("used", within + last["before_words"] - F.col("size") / 2.0)
        inside = ends.where(F.col("used") <= most).agg(F.max(F.struct("finish", "rank_")).alias("x")).first()["x"]
        before = ordered.where(F.col("part") < last["part"]).agg(F.max(F.struct("finish", "rank_")).alias("x")).first()["x"] if inside is None else inside
        cut = tuple(before) if before else (0.0, -1)
    rows = _finish(_queues(docs, slices, seed, id_col, text_col, source_col) if whole else thin, starts)
    taken = [F.when((_time(k) < cut[0]) | ((_time(k) == cut[0]) & (F.col("rank_") <= cut[1])), 1).otherwise(0) for k in range(repeats)]
    return rows.withColumn("copies", sum(taken, F.lit(0)))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    budget: float = 1.5,
    repeats: int = 2,
    seed: int = 11,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    rows_per_slice: int = 50_000,
) -> DataFrame:
    """(id, size, source, source_size, target, taken, copies): what the mix takes of each row.

    Each source queues its documents in a shuffled order (a seeded hash of id and
    text), `repeats` times over; a queued copy's virtual finish time is the source's
    words up to and with it, divided by the source's weight. All copies of all sources
    are range-sorted by finish time, their words are added up in that order (by range,
    and by row in the one range where the budget ends), and the order is truncated at
    the budget: the last copy is taken if more than half of it fits. A source whose
    copies are all taken leaves the rest to the others by weight, which is what
    source_targets() computes; a source ends within about a document of its target.

    The running sums need no task that holds a whole source: a source's shuffled order
    is cut into slices, 256 or as many as hold about `rows_per_slice` rows of all
    sources; slices are summed first, then each is ordered by itself and starts from
    the sum of those before it.

    Null text has size 0; a null source is a source of its own; a null id is allowed;
    repeated rows share the hash and are queued one after the other, each counted.
    Documents of no size are taken when the queue reaches them and count nothing.
    An empty table gives no rows. Extra columns are ignored.
    """
    with scratch(docs.sparkSession):
        rows = _planned(docs, weights, budget, repeats, seed, id_col, text_col, source_col, rows_per_slice, False)
    return rows.select(
        F.col("id").alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"), F.col("copies").cast("int").alias("copies"),
    )


def apply_mix(
    docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), budget: float = 1.5, repeats: int = 2, seed: int = 11,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", rows_per_slice: int = 50_000,
) -> DataFrame:
    """The rows of docs as often as mix() takes them, with their own columns, whatever these
    are called. Rows that share an id, or have none, are each taken by their own count."""
    with scratch(docs.sparkSession):
        rows = _planned(docs, weights, budget, repeats, seed, id_col, text_col, source_col, rows_per_slice, True)
    return rows.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
