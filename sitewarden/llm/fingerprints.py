"""SimHash fingerprints of documents, and the search for near fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._shared import lasting, saved, scratch, shuffle_partitions
from .minhash import in_parts, mix64, word_hashes

FBITS = 128
TERM_WORDS = 2
#: Bits by which near fingerprints may differ, and the members of a bucket that are compared at once.
RADIUS = 4
CELL = 1024
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_SIGNS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64) * 2 - 1
_PLACES = np.arange(FBITS // 8) * 256


def simhash(texts: list[bytes | None], powers: dict) -> np.ndarray:
    """The fingerprints of texts, as rows of 16 bytes.

    A text's terms are its pairs of neighbouring words (the word, if it has one), with A-Z
    lower-cased. Each distinct term votes on every bit with its hash's bits as signs and
    the weight 1 + ln(occurrences); a bit is set if its votes are above 0. A text
    without words has no votes and no bit."""
    h, counts = word_hashes(texts, powers)
    pairs = mix64(h[:-1] * _GOLDEN + h[1:]) if len(h) > 1 else np.empty(0, np.uint64)
    out, at = np.zeros((len(texts), FBITS // 8), np.uint8), 0
    for row, n in enumerate(counts.tolist()):
        if n:
            terms = np.sort(pairs[at : at + n - 1] if n >= TERM_WORDS else h[at : at + n])
            first = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]])
            weights = 1 + np.log(np.diff(np.r_[first, len(terms)]))
            both = np.empty((len(first), 2), np.uint64)
            both[:, 0] = terms[first]
            both[:, 1] = mix64(terms[first] * _GOLDEN)
            at_byte = (both.view(np.uint8).astype(np.int64) + _PLACES).ravel()
            votes = np.bincount(at_byte, np.repeat(weights, FBITS // 8), _PLACES[-1] + 256).reshape(-1, 256) @ _SIGNS
            out[row] = np.packbits(votes.ravel() > 0)
        at += n
    return out


def simhash_all(texts: list[bytes | None], powers: dict) -> np.ndarray:
    parts = [simhash(p, powers) for p in in_parts(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, FBITS // 8), np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine that the share of differing bits stands for, not below 0."""
    differ = np.unpackbits(a ^ b, axis=1).sum(axis=1)
    return np.maximum(0.0, np.cos(np.pi * differ / FBITS))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint): 32 hex digits for the whole text of each row (null: empty)."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers: dict = {}
        for batch in batches:
            found = simhash_all(batch.column(1).cast(pa.binary()).to_pylist(), powers)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes().hex() for x in found], pa.string())], names=[id_col, "fingerprint"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, fingerprint string")


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Partitions of (bucket, extra, id, text), each bucket together and in ascending id, in
    which the row after a bucket's last one is the first of the next bucket (extra = true;
    after the last bucket: the first), so that a stream sees every row's successor.

    Buckets are ranges of ids between approximate quantiles; they decide where rows go,
    not what comes out. One shuffle of the texts; the only rows that move twice are the
    buckets' first ones. Rows with a null id are a bucket of their own for each partition
    (-1 and below) with no successors. The driver and the tasks hold two numbers for each
    bucket, four buckets for each shuffle partition."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    wanted = 4 * parts
    bounds = np.array(sorted(set(docs.stat.approxQuantile(id_col, [k / wanted for k in range(1, wanted)], 0.25 / wanted))))

    @F.pandas_udf("int")
    def bucket_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(np.int64), side="right").astype(np.int32))

    known = F.coalesce("id", F.lit(0).cast("long"))
    lost = -1 - F.pmod(F.xxhash64("text"), F.lit(parts)).cast("int")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = rows.where("id is not null").groupBy(bucket_of("id").alias("bucket")).agg(F.min("id").alias("first")).orderBy("bucket").collect()
    firsts, before = np.array([r["first"] for r in found], np.int64), np.array([r["bucket"] for r in [*found[-1:], *found[:-1]]], np.int32)

    @F.pandas_udf("int")
    def also_in(ids: pd.Series) -> pd.Series:
        """The bucket before that of which the id is the first one; -1 for any other id."""
        ids = ids.to_numpy(np.int64)
        at = np.minimum(np.searchsorted(firsts, ids), max(0, len(firsts) - 1))
        return pd.Series(np.where(firsts[at] == ids, before[at], -1) if len(firsts) else np.full(len(ids), -1), dtype=np.int32)

    placed = rows.withColumn("bucket", F.when(F.col("id").isNull(), lost).otherwise(bucket_of(known))).withColumn("also", F.when(F.col("id").isNull(), -1).otherwise(also_in(known)))
    own, again = F.struct("bucket", F.lit(False).alias("extra")), F.struct(F.col("also").alias("bucket"), F.lit(True).alias("extra"))
    places = F.when(F.col("also") >= 0, F.array(own, again)).otherwise(F.array(own))
    return (
        placed.select("id", "text", F.explode(places).alias("at")).select("at.bucket", "at.extra", "id", "text")
        .repartition(parts, "bucket").sortWithinPartitions("bucket", "extra", "id", "text")
    )


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    A row's edited text has its last floor(n_chars / 4) code points replaced by as many
    (or all) from the start of the row with the next id; the last row is followed by the
    first. near_edited and near_next are the likeness of the fingerprint to the edited
    text's and to the next row's. Equal ids are ordered by text, null text first. A row
    with a null id has no next one: its edited text is just shortened, and near_next is
    null. Further columns aren't read; a very long text goes through whole, on its own. An
    empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers: dict = {}
        names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

        def made(rows: list[tuple], after: str | None) -> pa.RecordBatch:
            """rows: (bucket, id, text) in order; after: the text that follows, if any."""
            texts = [r[2] for r in rows] + [after or ""]
            edited = []
            for k, (bucket, _, text) in enumerate(rows):
                cut = len(text) // 4
                edited.append(text[: len(text) - cut] + (texts[k + 1][:cut] if bucket >= 0 else ""))
            raw = [t.encode() for t in texts + edited]
            found = simhash_all(raw, powers)
            n = len(rows)
            own, following, changed = found[:n], found[1 : n + 1], found[n + 1 :]
            near_next = [x if r[0] >= 0 else None for x, r in zip(likeness(own, following).tolist(), rows)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[1] for r in rows], pa.int64()), pa.array([len(r[2]) for r in rows], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in raw[n + 1 :]]), pa.array([x.tobytes().hex() for x in own]),
                    pa.array([x.tobytes().hex() for x in changed]), pa.array(likeness(own, changed)), pa.array(near_next, pa.float64()),
                ],
                names=names,
            )

        held: list[tuple] = []
        size = 0
        for batch in batches:
            for bucket, extra, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                text = text or ""
                if held and bucket != held[-1][0]:
                    # Only a bucket below 0, or a bucket whose extra row came already, ends without one.
                    yield made(held, None)
                    held, size = [], 0
                if extra:
                    if held:
                        yield made(held, text)
                        held, size = [], 0
                    continue
                if size > 1 << 19:
                    yield made(held, text)
                    held, size = [], 0
                held.append((bucket, key, text))
                size += len(text)
        if held:
            yield made(held, None)

    schema = f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, id_col, text_col).mapInArrow(run, schema)


def block_tables(radius: int) -> tuple[np.ndarray, list[tuple[int, ...]]]:
    """(block of each bit, choices): the permuted tables that find all fingerprints within
    `radius` bits. Two such fingerprints differ in `radius` blocks at most, so of more
    blocks they agree in the others: each table is keyed by one choice of blocks, and one
    of the tables has the pair in a bucket. The blocks are the fewest with keys of 24 bits."""
    if not 0 <= radius <= 16:
        raise ValueError("radius must be 0 to 16")
    blocks = next(b for b in range(radius + 1, FBITS) if (b - radius) * FBITS // b >= 24)
    return np.arange(FBITS) * blocks // FBITS, list(combinations(range(blocks), blocks - radius))


def _words(prints: np.ndarray) -> np.ndarray:
    """Rows of 16 bytes as two 64-bit words each."""
    return np.ascontiguousarray(prints).view(">u8").astype(np.uint64)


def _keyed(classes: DataFrame, radius: int) -> DataFrame:
    """(t, k, fp_id, hi, lo) of (fp_id, fp): each fingerprint's key in every table."""
    block_of, choices = block_tables(radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.frombuffer(bytes.fromhex("".join(batch.column(1).to_pylist())), np.uint8).reshape(-1, FBITS // 8)
            bits, words = np.unpackbits(raw, axis=1), _words(raw).view(np.int64)
            for t, choice in enumerate(choices):
                own = bits[:, np.isin(block_of, choice)]
                key = np.zeros((len(raw), 64), np.uint8)
                key[:, 64 - min(64, own.shape[1]) :] = own[:, :64]
                k = np.packbits(key, axis=1).view(">u8")[:, 0].astype(np.uint64).view(np.int64)
                columns = [pa.array(np.full(len(raw), t, np.int32)), pa.array(k), batch.column(0), pa.array(words[:, 0]), pa.array(words[:, 1])]
                yield pa.RecordBatch.from_arrays(columns, names=["t", "k", "fp_id", "hi", "lo"])

    return classes.select("fp_id", "fp").mapInArrow(run, "t int, k long, fp_id long, hi long, lo long")


def _near_pairs(members: DataFrame, radius: int, counts: bool, cell: int = CELL) -> DataFrame:
    """All pairs within the radius among members (t, k, fp_id, hi, lo, m) of buckets with m rows:
    as (a, b, distance), or with `counts` as (fp_id, n), the number of pairs that each is in.

    Buckets of up to `cell` members go together into groups of about so many rows; a larger
    one is cut into cells, and each pair of cells is a group of its own. A pair counts in
    the first table that has it in a bucket."""
    block_of, choices = block_tables(radius)
    masks = np.array([_words(np.packbits(block_of == b)[None])[0] for b in range(block_of[-1] + 1)])
    # The first table of each set of agreeing blocks.
    first = np.array([next((t for t, c in enumerate(choices) if all(have >> b & 1 for b in c)), -1) for have in range(1 << len(masks))])
    names = ["fp_id", "n"] if counts else ["a", "b", "distance"]

    def compare(t: int, ids_a, xa, ids_b, xb, same: bool) -> Iterator[list[np.ndarray]]:
        for i in range(0, len(ids_a), 512):
            differ = np.bitwise_count(xa[i : i + 512, None, 0] ^ xb[None, :, 0]) + np.bitwise_count(xa[i : i + 512, None, 1] ^ xb[None, :, 1])
            near = differ <= radius
            if same:
                near &= np.arange(i, i + len(near))[:, None] < np.arange(len(ids_b))[None, :]
            a, b = np.nonzero(near)
            apart = xa[i + a] ^ xb[b]
            agree = sum(((apart & m) == 0).all(axis=1).astype(np.int64) << j for j, m in enumerate(masks))
            own = first[agree] == t
            a, b = a[own], b[own]
            x, y = ids_a[i + a], ids_b[b]
            if counts:
                ids, n = np.unique(np.r_[x, y], return_counts=True)
                yield [ids, n]
            else:
                yield [np.minimum(x, y), np.maximum(x, y), differ[a, b].astype(np.int64)]

    def table(found: list[list[np.ndarray]]) -> pa.Table:
        return pa.table({n: np.concatenate([x[j] for x in found] or [np.empty(0, np.int64)]).astype(np.int64) for j, n in enumerate(names)})

    def parts(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return np.asarray(t["fp_id"]), np.stack([np.asarray(t["hi"]), np.asarray(t["lo"])], axis=1).view(np.uint64)

    def in_group(t: pa.Table) -> pa.Table:
        t = t.sort_by([("t", "ascending"), ("k", "ascending")])
        (ids, x), at, k = parts(t), np.asarray(t["t"]), np.asarray(t["k"])
        edges = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (k[1:] != k[:-1]), True])
        return table([out for i, j in zip(edges[:-1], edges[1:]) for out in compare(at[i], ids[i:j], x[i:j], ids[i:j], x[i:j], True)])

    def in_cells(t: pa.Table) -> pa.Table:
        low, high = t["low"][0].as_py(), t["high"][0].as_py()
        (ids, x), own = parts(t), np.asarray(t["cell"])
        a, b = np.flatnonzero(own == low), np.flatnonzero(own == high)
        return table(list(compare(t["t"][0].as_py(), ids[a], x[a], ids[b], x[b], low == high)))

    kinds = ", ".join(f"{n} long" for n in names)
    few = members.where(F.col("m") <= cell)
    groups = max(1, -(-few.count() // (2 * cell)))
    by_group = few.withColumn("group", F.pmod(F.xxhash64("t", "k"), F.lit(groups))).groupBy("group").applyInArrow(in_group, kinds)
    many = members.where(F.col("m") > cell).withColumn("cells", F.ceil(F.col("m") / cell).cast("int"))
    many = many.withColumn("cell", F.pmod(F.xxhash64("fp_id", "t"), F.col("cells")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    many = many.select("t", "k", "fp_id", "hi", "lo", "cell", F.least("cell", "other").alias("low"), F.greatest("cell", "other").alias("high"))
    out = by_group.unionAll(many.groupBy("t", "k", "low", "high").applyInArrow(in_cells, kinds))
    return out.groupBy("fp_id").agg(F.sum("n").alias("n")) if counts else out


def _classes(prints: DataFrame, id_col: str, fp_col: str) -> DataFrame:
    """(fp, fp_id): each fingerprint and the smallest id that has it."""
    rows = prints.where(F.col(id_col).isNotNull() & F.col(fp_col).isNotNull())
    return rows.groupBy(F.col(fp_col).alias("fp")).agg(F.min(F.col(id_col).cast("long")).alias("fp_id"))


def _buckets(classes: DataFrame, radius: int) -> DataFrame:
    """_keyed() rows of buckets with several fingerprints, with their number m."""
    keyed = _keyed(classes, radius)
    sizes = saved(keyed.groupBy("t", "k").agg(F.count("*").alias("m")).where("m > 1"), "fingerprint-buckets")
    return saved(keyed.join(sizes, ["t", "k"]), "fingerprint-tables")


def near_fingerprints(prints: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", fp_col: str = "fingerprint") -> tuple[DataFrame, DataFrame]:
    """All fingerprints within `radius` bits: (pairs, members).

    members: (id, fp_id), fp_id being the smallest id with the same fingerprint; pairs:
    (a, b, distance) of such ids with different fingerprints, found by block_tables().
    Null ids and fingerprints are left out. Pairs of a group of m near copies are m * m:
    with_near_counts() tells their number without making them."""
    with scratch(prints.sparkSession):
        classes = lasting(saved(_classes(prints, id_col, fp_col), "fingerprints"))
        pairs = lasting(saved(_near_pairs(_buckets(classes, radius), radius, False), "fingerprint-pairs"))
    members = prints.select(F.col(id_col), F.col(fp_col).alias("fp")).where(F.col(id_col).isNotNull()).join(classes, "fp").select(id_col, "fp_id")
    return pairs, members


def with_near_counts(prints: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", fp_col: str = "fingerprint") -> DataFrame:
    """prints with fp_id, the smallest id with the same fingerprint, and n_near, the number of
    other fingerprints within `radius` bits. Null ids count for none and get null."""
    with scratch(prints.sparkSession):
        classes = saved(_classes(prints, id_col, fp_col), "fingerprints")
        n = _near_pairs(_buckets(classes, radius), radius, True)
        found = lasting(saved(classes.join(n, "fp_id", "left").select("fp", "fp_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_near")), "fingerprint-counts"))
    both = prints.join(found, (prints[fp_col] == found["fp"]) & prints[id_col].isNotNull(), "left")
    return both.select(*[prints[c] for c in prints.columns], "fp_id", "n_near")
