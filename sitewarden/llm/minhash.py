"""MinHash near-dedup: fast similarity sketching, banding, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ._shared import lasting, saved, scratch, shuffle_partitions
from .components import connected_components

WORDS = 5
BANDS, ROWS = 40, 5
PIVOTS = 3
#: A bucket that has to be compared in full is cut into cells of so many members and shingles.
CELL, MOST_CELL = 256, 512
CELL_SHINGLES = 1 << 20

# Odd 64-bit constants of the mixing steps below (splitmix64 and the golden ratio). Fixed values.
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)
_BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base modulo 2^64, and of its inverse."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(n, base, np.uint64)
        steps[:1] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def word_hashes(texts: list[bytes | None], powers: dict) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of all texts, and each text's number of words.

    Words are runs of bytes that are not ASCII white space; bytes.lower lower-cases
    just A-Z. A word's hash is a polynomial of its (randomly mapped) bytes, got for all
    words at once from one running sum, then scrambled together with its length."""
    joined = b"\n".join(t or b"" for t in texts).lower() + b"\n"
    raw = np.frombuffer(joined, np.uint8)
    if len(raw) > powers.get("n", 0):
        powers["n"] = max(len(raw), 1 << 20)
        powers["up"], powers["down"] = _powers(powers["n"])
    gap = np.empty(len(raw) + 1, bool)
    gap[0] = True
    gap[1:] = _SPACE[raw]
    starts = np.flatnonzero(gap[:-1] & ~gap[1:])
    ends = np.flatnonzero(~gap[:-1] & gap[1:])
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * powers["up"][: len(raw)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers["down"][starts]
    bounds = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])
    return mix64(h + (ends - starts).astype(np.uint64) * _GOLDEN), np.diff(np.searchsorted(starts, bounds))


def shingle_sets(texts: list[bytes | None], words: int, powers: dict) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its word shingles. With fewer
    words than a shingle has, the whole sequence is one; without words, empty."""
    h, counts = word_hashes(texts, powers)
    rolled = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for k in range(words if len(rolled) else 0):
        rolled = rolled * _GOLDEN + h[k : len(h) - words + 1 + k]
    rolled = mix64(rolled + np.uint64(words))
    out, at = [], 0
    for n in counts.tolist():
        if n >= words:
            s = np.sort(rolled[at : at + n - words + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif n:
            few = 0
            for x in h[at : at + n].tolist():
                few = (few * _BASE + x) & 0xFFFFFFFFFFFFFFFF
            out.append(mix64(np.array([few], np.uint64) + np.uint64(n)))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def in_parts(texts: list[bytes | None], most_bytes: int = 1 << 19) -> Iterator[list[bytes | None]]:
    """texts in lists of about so many bytes; a longer text is a list of its own."""
    part, size = [], 0
    for t in texts:
        n = len(t or b"")
        if part and size + n > most_bytes:
            yield part
            part, size = [], 0
        part.append(t)
        size += n
    if part:
        yield part


def sketch(hashes: np.ndarray, size: int) -> np.ndarray:
    """The similarity sketch of a non-empty set: `size` coordinates, all filled.

    In round i < size every element is thrown into a random bin with the value
    (i, random part); in round size + j into bin j. A coordinate keeps its smallest
    value, and rounds end once every bin is filled, at the latest after 2 * size.
    An element thrown in an earlier round is always smaller, so several rounds can be
    made at once without changing what is kept. Two sets agree in a coordinate with
    the probability of their Jaccard similarity."""
    out = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    step, done = max(1, min(2 * size, 1536 // len(hashes))), 0
    while done < 2 * size:
        rounds = np.arange(done, min(done + step, 2 * size), dtype=np.uint64)
        done += len(rounds)
        h = mix64(hashes[None, :] ^ mix64((rounds + np.uint64(1)) * _GOLDEN)[:, None])
        bins = ((h >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
        late = rounds >= size
        if late.any():
            bins[late] = (rounds[late] - np.uint64(size))[:, None]
        values = (rounds << np.uint64(44))[:, None] | ((h * _GOLDEN) >> np.uint64(20))
        np.minimum.at(out, bins.ravel().astype(np.int64), values.ravel())
        if out.max() < np.iinfo(np.uint64).max:
            break
    return out


def band_keys(coords: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """From sketches (documents x bands * rows) one 64-bit key for each document and band of
    `rows` coordinates; the band's number is part of it."""
    parts = coords.reshape(len(coords), bands, rows)
    keys = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=np.uint64) * _GOLDEN), parts.shape[:2])
    for k in range(rows):
        keys = mix64(keys * _GOLDEN ^ parts[:, :, k])
    return keys


def _bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int, bands: int, rows: int) -> DataFrame:
    """(id, text_hash, n_shingles, sig, bands): the size of each row's shingle set, a 128-bit
    digest of it and its band keys (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers: dict = {}
        for batch in batches:
            n, sig, coords = [], [], np.full((len(batch), bands * rows), 0, np.uint64)
            for i, s in enumerate(s for part in in_parts(_bytes(batch, "text")) for s in shingle_sets(part, words, powers)):
                n.append(len(s))
                sig.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                if len(s):
                    coords[i] = sketch(s, bands * rows)
            keys = band_keys(coords, bands, rows).view(np.int64)
            ends = pa.array(np.arange(0, (len(batch) + 1) * bands, bands, dtype=np.int32))
            listed = pa.ListArray.from_arrays(ends, pa.array(keys.ravel()), mask=pa.array([x is None for x in sig], pa.bool_()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), listed], names=["id", "text_hash", "n_shingles", "sig", "bands"]
            )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).mapInArrow(
        run, "id long, text_hash long, n_shingles long, sig binary, bands array<long>"
    )


def _shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(rep, bands, shingles) of (rep, bands, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers: dict = {}
        for batch in batches:
            sets = [s.view(np.int64) for part in in_parts(_bytes(batch, "text")) for s in shingle_sets(part, words, powers)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.list_(pa.int64()))], names=["rep", "bands", "shingles"])

    return texts.select("rep", "bands", "text").mapInArrow(run, "rep long, bands array<long>, shingles array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(left, "a").join(right, "b")
        .where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")
    )


def _split_buckets(members: DataFrame, groups: DataFrame) -> DataFrame:
    """(key, rep, n, c) of the buckets whose members lie in several components c."""
    placed = saved(
        members.join(groups.withColumnRenamed("id", "rep"), "rep", "left").select("key", "rep", "n", F.coalesce("component_id", "rep").alias("c")), "placed"
    )
    split = saved(placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key"), "split")
    return saved(placed.join(split, "key"), "split-buckets")


def _common(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """The sizes of all intersections of sets, from products of slices of their incidence
    matrix; elements of one set only are left out."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(n > 1) - 1
    several = n[at] > 1
    owner, at = owner[several], number[at[several]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(at[-1]) + 1 if len(at) else 0, columns):
        part = slice(*np.searchsorted(at, [start, start + columns]))
        x = np.zeros((len(sets), columns), np.float32)
        x[owner[part], at[part] - start] = 1
        out += x @ x.T
    return out


def _block_links(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) between members of a bucket in different components. A bucket is cut
    into cells, bounded by members and by shingles, and each pair of cells is one block
    that is compared at once on full sets; only links come out. A pair is compared in the
    first of its common buckets."""
    sizes = saved(buckets.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("total")), "bucket-sizes")
    most = F.least(F.lit(MOST_CELL), F.greatest(F.lit(CELL), F.floor(F.col("m") / 8)))
    cells = F.ceil(F.greatest(F.col("m") / most, F.col("total") / CELL_SHINGLES)).cast("int")
    rows = (
        buckets.join(sizes, "key").join(sets, "rep").withColumn("cells", cells).withColumn("cell", F.pmod(F.xxhash64("rep", "key"), F.col("cells")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
        .select("key", "rep", "c", "n", F.least("cell", "other").alias("low"), F.greatest("cell", "other").alias("high"), "cell", "bands", "shingles")
    )

    def run(t: pa.Table) -> pa.Table:
        rep, c, n, cell = (np.asarray(t[k]) for k in ("rep", "c", "n", "cell"))
        bands = np.asarray(t["bands"].combine_chunks().flatten()).reshape(len(t), -1)
        fits = 100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :])
        wanted = fits & (c[:, None] != c[None, :]) & (rep[:, None] < rep[None, :])
        if t["low"][0] != t["high"][0]:
            wanted &= cell[:, None] != cell[None, :]
        own = np.flatnonzero(bands[0] == t["key"][0].as_py())[0]
        for k in range(own):
            wanted &= bands[:, k][:, None] != bands[:, k][None, :]
        used = np.flatnonzero(wanted.any(axis=0) | wanted.any(axis=1))
        if not len(used):
            return pa.table({"a": rep[:0], "b": rep[:0]})
        listed = t["shingles"].combine_chunks().take(pa.array(used))
        both = _common([np.asarray(x.values) for x in listed])
        n = n[used]
        a, b = np.nonzero((100 * both >= percent * (n[:, None] + n[None, :] - both)) & wanted[np.ix_(used, used)])
        return pa.table({"a": rep[used][a], "b": rep[used][b]})

    return rows.groupBy("key", "low", "high").applyInArrow(run, "a long, b long")


def _components(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, bands: int, rows: int) -> DataFrame:
    """(id, text_hash, n_shingles, first struct<id, text_hash>) of every row of docs, first being
    the smallest row of its component; null for rows that link with nothing."""
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    made = lasting(saved(sketches(docs, id_col, text_col, words, bands, rows), "sketches"))
    # Ids may repeat with other texts, so each class gets a number of its own.
    classes = made.where("sig is not null and id is not null").groupBy("sig").agg(
        F.min(F.struct("id", "text_hash")).alias("first"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n")
    )
    # The numbers follow the ids, so that a bucket's first class is the oldest: copies of one text are more like it than like each other.
    ranged = classes.repartitionByRange(shuffle_partitions(docs.sparkSession), "first").sortWithinPartitions("first")
    classes = saved(ranged.withColumn("rep", F.monotonically_increasing_id()), "classes")
    keyed = classes.select("rep", "n", F.explode("bands").alias("key"))
    # Tables of their own, here and below: then both sides of a join on buckets are shuffles, and a hot bucket can be split.
    heads = saved(keyed.groupBy("key").agg(F.min("rep").alias("head"), F.max("rep").alias("last")).where("head < last").drop("last"), "heads")
    members = saved(keyed.join(heads, "key").select("key", "rep", "n", "head"), "members")
    stars = saved(members.where("head < rep").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct(), "stars")
    # One row of each class has the text that its set comes from.
    wanted = classes.join(members.select("rep").distinct(), "rep").select("rep", "bands", "first.id", "first.text_hash")
    sets = saved(_shingle_sets(text.join(wanted, ["id", "text_hash"]).dropDuplicates(["rep"]), words), "shingles")
    links = saved(_verified(stars, sets, percent), "links")
    placed = _split_buckets(members.select("key", "rep", "n"), connected_components(links))
    pivots = [F.min(F.struct(F.xxhash64(F.lit(k), "key", "rep"), F.col("rep").alias("b"), F.col("c").alias("cb"), F.col("n").alias("nb"))).alias(f"p{k}") for k in range(PIVOTS)]
    chosen = placed.groupBy("key").agg(*pivots).select("key", F.explode(F.array(*[f"p{k}" for k in range(PIVOTS)])).alias("p")).select("key", "p.b", "p.cb", "p.nb")
    chosen = saved(chosen, "pivots")
    fits = 100 * F.least("n", "nb") >= percent * F.greatest("n", "nb")
    second = placed.join(chosen, "key").where((F.col("c") != F.col("cb")) & fits).select(F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b")).distinct()
    links = links.unionAll(saved(_verified(saved(second, "pairs"), sets, percent), "links"))
    placed = _split_buckets(placed.select("key", "rep", "n"), connected_components(links))
    final = connected_components(links.unionAll(saved(_block_links(placed, sets, percent), "links")))
    grouped = final.select(F.col("id").alias("rep"), F.col("component_id").alias("g")).join(classes.select("rep", "first"), "rep")
    firsts = grouped.groupBy("g").agg(F.min("first").alias("least"))
    grouped = grouped.select("rep", "g").join(firsts, "g").select("rep", "least")
    by_sig = lasting(saved(classes.join(grouped, "rep", "left").select("sig", F.coalesce("least", "first").alias("first")), "by-class"))
    return made.select("id", "text_hash", "n_shingles", "sig").join(by_sig, "sig", "left").select(
        "id", "text_hash", "n_shingles", F.when(F.col("id").isNotNull(), F.col("first")).alias("first")
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    percent: int = 75,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """(id, n_shingles, component_id, kept), one row for each row of docs.

    1. One pass over the texts makes shingle sets, their sketches and band keys.
    2. Rows with equal sets are one class; only classes go on.
    3. Every class of a band bucket is paired with the bucket's first class. These
       stars are verified on full sets and joined to components.
    4. In buckets that still hold several components, three more members, drawn by a hash
       of member and bucket, are paired with all others in the same way.
    5. In buckets that are still split, all members of different components are compared on
       full sets, in blocks of bounded size. So every pair that shares a bucket is verified
       or lies within one component already, and a group of near copies costs its stars.

    With 40 bands of 5 coordinates a pair of similarity 0.75 shares no bucket with
    probability 2e-5, one of 0.8 with 1e-7.

    Null or empty text, or text without words: n_shingles 0, linked with nothing.
    A null id: component_id null, kept, linked with nothing. Rows that repeat an id
    each follow their own text. Ids are integers; further columns are not read. An empty
    table gives no rows.
    """
    with scratch(docs.sparkSession):
        found = _components(docs, id_col, text_col, words, percent, bands, rows)
    component = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("first.id", "id"))
    return found.select(
        F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")
    )


def keep_representatives(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = 75, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row of each group of near duplicates, in the columns of docs, whatever these are
    called: the one with the smallest id. Of rows that share id and text one stays, and of
    a group's rows that share the smallest id but not the text as well. Rows with a null id
    stay; texts without words are no group, so each id with one stays."""
    with scratch(docs.sparkSession):
        found = _components(docs, id_col, text_col, words, percent, bands, rows)
        stay = found.where("id is not null and (first is null or (id = first.id and text_hash = first.text_hash))")
        stay = lasting(saved(stay.select(F.col("id").alias("stay_id"), F.col("text_hash").alias("stay_hash")).distinct(), "representatives"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"))
    chosen = packed.join(stay, (F.col("id") == F.col("stay_id")) & (F.col("text_hash") == F.col("stay_hash"))).groupBy("id", "text_hash").agg(F.first("row").alias("row"))
    return chosen.select("row").unionAll(packed.where("id is null").select("row")).select("row.*")
