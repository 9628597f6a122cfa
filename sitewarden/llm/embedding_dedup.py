"""Embedding near-dedup by sorted projection passes."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._shared import in_order, lasting, parts_of, saved, scratch
from .components import connected_components

HASHES = 64
BLOCK = 2048
WINDOW = 256
FIRST_PASSES, MOST_PASSES = 4, 128
PROBES = 4000
MISSED = 0.001
SEED = 977


def _rows(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a list column as rows of one matrix in double precision, short ones filled
    with zeros, and their lengths."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(column.value_lengths()).astype(np.int64)
    flat = np.asarray(column.flatten().cast(pa.float64()), np.float64)
    if len(lengths) == 0 or (lengths == lengths[0]).all():
        return flat.reshape(len(lengths), -1), lengths
    wide = np.zeros((len(lengths), lengths.max()))
    wide[np.arange(wide.shape[1]) < lengths[:, None]] = flat
    return wide, lengths


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=1e-300)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _usable(vector: str) -> str:
    return f"{vector} is not null and size({vector}) > 0 and not exists({vector}, x -> x is null or isnan(x) or abs(x) = double('Infinity')) and exists({vector}, x -> x <> 0)"


def hash_keys(vectors: np.ndarray, passes: range) -> np.ndarray:
    """For each vector and pass the signs of HASHES random projections, as one integer whose
    order is the lexicographic order of the signs. A pass has one seeded matrix for each
    dimension, so keys don't depend on where they are made."""
    out = np.empty((len(vectors), len(passes)), np.int64)
    for k, p in enumerate(passes):
        planes = np.random.default_rng([SEED, vectors.shape[1], p]).standard_normal((vectors.shape[1], HASHES))
        key = np.packbits(vectors @ planes > 0, axis=1).view(">u8")[:, 0].astype(np.uint64)
        out[:, k] = (key ^ np.uint64(1 << 63)).view(np.int64)
    return out


def _with_keys(classes: DataFrame, passes: range, partner: float | None = None) -> DataFrame:
    """(rep, label, n, probe, p, key) of (rep, label, v, h1). With `partner` the keys are those of
    another vector, one with this cosine to the row's in a random direction (a probe)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, lengths = _rows(batch.column(2))
            keys = np.zeros((len(batch), len(passes)), np.int64)
            for n in np.unique(lengths):
                own = np.flatnonzero(lengths == n)
                v = _unit(x[own, :n])
                if partner is not None:
                    seeds = np.asarray(batch.column(3))[own].view(np.uint64).tolist()
                    side = np.stack([np.random.default_rng([SEED, s]).standard_normal(n) for s in seeds])
                    side -= (side * v).sum(axis=1, keepdims=True) * v
                    v = partner * v + np.sqrt(1 - partner**2) * _unit(side) if n > 1 else v
                keys[own] = hash_keys(v, passes)
            ends = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * len(passes))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lengths.astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))],
                names=["rep", "label", "n", "keys"],
            )

    kind = classes.schema["label"].dataType.simpleString()
    keyed = classes.select("rep", "label", "v", "h1").mapInArrow(run, f"rep long, label {kind}, n int, keys array<long>")
    return keyed.select("rep", "label", "n", F.lit(partner is not None).alias("probe"), F.posexplode("keys").alias("p", "key"))


def _places(classes: DataFrame, probes: DataFrame, threshold: float, miss: float, block: int, window: int, most: int) -> DataFrame:
    """(rep, p, r): every class's rank in every pass, over all labels.

    The passes double from FIRST_PASSES on until no more than the share `miss` of the
    probes was never brought together with its vector, so their number follows the size
    and the shape of the labels. Probes are vectors at just the threshold, the hardest
    case, so links are found more often than probes. A warning says so if `most` passes
    don't get there."""
    places, done, want = None, 0, FIRST_PASSES
    while True:
        order = ["p", "label", "n", "key", "rep", "probe"]
        made = _with_keys(classes, range(done, want)).unionAll(_with_keys(probes, range(done, want), threshold))
        made = saved(made.withColumn("p", (F.col("p") + done).cast("int")), "vector-keys")
        ordered = in_order(made, order, "vector-order")
        parts = F.broadcast(parts_of(ordered).select("part", "before_rows"))
        ranked = saved(ordered.join(parts, "part").select("rep", "probe", "p", (F.col("before_rows") + F.col("row")).alias("r")), "vector-ranks")
        places = ranked if places is None else places.unionAll(ranked)
        wanted = F.broadcast(places.where("probe").select("rep", "p", F.col("r").alias("q")))  # PROBES rows a pass at most
        low, high = F.least("r", "q"), F.greatest("r", "q")
        same, before = F.floor(high / block) == F.floor(low / block), F.floor(high / block) == F.floor(low / block) + 1
        met = same | (before & (low % block >= block - window))
        seen = places.where("not probe").join(wanted, ["rep", "p"]).groupBy("rep").agg(F.bool_or(met).alias("met"))
        all_, missed = seen.agg(F.count("*"), F.count_if(~F.col("met"))).first()
        done = want
        if missed <= miss * all_ or done >= most:
            if missed > miss * all_:
                warnings.warn(f"{done} passes missed {missed} of {all_} vectors at the threshold")
            return places.where("not probe").select("rep", "p", "r")
        want = min(most, 2 * done)


def _hits(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of unit vectors (rows of a x rows of b) have the cosine: single precision
    decides what is clear of the threshold, double precision the rest."""
    near = a.astype(np.float32) @ b.astype(np.float32).T
    slack = max(1e-5, 1.2e-7 * a.shape[1])
    hit = near >= threshold + slack
    i, j = np.nonzero((near >= threshold - slack) & ~hit)
    for k in range(0, len(i), 100_000):
        x, y = i[k : k + 100_000], j[k : k + 100_000]
        hit[x, y] = np.einsum("ij,ij->i", a[x], b[y]) >= threshold
    return hit


def _join(roots: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The roots of rows (each the smallest row of its group) after linking rows a with rows b."""
    while len(a):
        x, y = roots[a], roots[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(roots, np.maximum(x, y), np.minimum(x, y))
        while (roots[roots] != roots).any():
            roots = roots[roots]
    return roots


def _kinds(t: pa.Table, lengths: np.ndarray) -> np.ndarray:
    labels = t["label"].combine_chunks().dictionary_encode()
    return np.asarray(labels.indices).astype(np.int64) * (1 << 20) + lengths


def _stars(placed: DataFrame, threshold: float, block: int, window: int) -> DataFrame:
    """(a, b): in every block of every pass, each vector that has links with the smallest row
    that it reaches by them. As many rows as vectors at most, however many links."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("old", "ascending"), ("rep", "ascending")])
        x, lengths = _rows(t["v"])
        x, rep = _unit(x), np.asarray(t["rep"])
        kinds = _kinds(t, lengths) * 256 + np.asarray(t["p"])
        new, roots = int((~np.asarray(t["old"])).sum()), np.arange(len(t))
        for i in range(0, new, 512):
            hit = _hits(x[i : min(i + 512, new)], x, threshold) & (kinds[i : min(i + 512, new), None] == kinds[None, :])
            a, b = np.nonzero(hit)
            ahead = a + i < b
            roots = _join(roots, a[ahead] + i, b[ahead])
        linked = np.flatnonzero(roots != np.arange(len(roots)))
        return pa.table({"a": rep[roots[linked]], "b": rep[linked]})

    r = F.col("r")
    own = F.struct(F.floor(r / block).alias("block"), F.lit(False).alias("old"))
    again = F.struct((F.floor(r / block) + 1).alias("block"), F.lit(True).alias("old"))
    rows = placed.withColumn("to", F.explode(F.when(r % block >= block - window, F.array(own, again)).otherwise(F.array(own))))
    # Ranks of a later round of passes start at 0 again; `round` tells its blocks apart.
    rounds = F.when(F.col("p") < FIRST_PASSES, 0).otherwise(F.floor(F.log2(F.col("p") / FIRST_PASSES)) + 1)
    return rows.select("rep", "label", "v", "p", rounds.alias("round"), "to.block", "to.old").groupBy("round", "block").applyInArrow(run, "a long, b long")


def _counts(members: DataFrame, threshold: float, small: int, large: int) -> DataFrame:
    """(rep, k): links of every class, copies counted, from all pairs of each component.

    members: (rep, copies, v, g, m), g the component and m its size. Components of
    up to `small` members go together into groups of about so many rows. A larger one is
    cut into cells of m / 8 members, from `small` to `large`, each cell one row, and every
    pair of cells is a group of its own: m * m / cell row copies, for m * m comparisons."""

    def in_group(t: pa.Table) -> pa.Table:
        t = t.sort_by("g")
        x, _ = _rows(t["v"])
        x, group, copies = _unit(x), np.asarray(t["g"]), np.asarray(t["copies"]).astype(float)
        edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
        k = np.zeros(len(t))
        for i, j in zip(edges[:-1], edges[1:]):
            k[i:j] = _hits(x[i:j], x[i:j], threshold) @ copies[i:j]
        # A vector is no link of its own.
        return pa.table({"rep": t["rep"], "k": (k - copies).astype(np.int64)})

    def in_cells(t: pa.Table) -> pa.Table:
        cells, same = [], t["low"][0] == t["high"][0]
        if len(t) < 2 and not same:  # The other cell has no members.
            return pa.table({"rep": pa.array([], pa.int64()), "k": pa.array([], pa.int64())})
        for row in t["rows"].combine_chunks():
            inner = row.values
            x, _ = _rows(inner.field("v"))
            cells.append((np.asarray(inner.field("rep")), np.asarray(inner.field("copies")).astype(float), _unit(x)))
        (ra, ca, xa), (rb, cb, xb) = cells[0], cells[-1]
        ka, kb = np.zeros(len(ra)), np.zeros(len(rb))
        for i in range(0, len(ra), 256):
            hit = _hits(xa[i : i + 256], xb, threshold)
            ka[i : i + 256] = hit @ cb
            kb += ca[i : i + 256] @ hit
        if same:
            return pa.table({"rep": ra, "k": (ka - ca).astype(np.int64)})
        return pa.table({"rep": np.r_[ra, rb], "k": np.r_[ka, kb].astype(np.int64)})

    few = members.where(F.col("m") <= small)
    buckets = max(1, -(-few.count() // small))
    by_group = few.withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(buckets))).groupBy("bucket").applyInArrow(in_group, "rep long, k long")
    size = F.least(F.lit(large), F.greatest(F.lit(small), F.floor(F.col("m") / 8)))
    cells = F.ceil(F.col("m") / size).cast("int")
    cut = members.where(F.col("m") > small).withColumn("cells", cells).withColumn("cell", F.pmod(F.xxhash64("rep"), F.col("cells")).cast("int"))
    packed = cut.groupBy("g", "cells", "cell").agg(F.collect_list(F.struct("rep", "copies", "v")).alias("rows"))
    pairs = saved(packed, "vector-cells").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    pairs = pairs.select("g", F.least("cell", "other").alias("low"), F.greatest("cell", "other").alias("high"), "rows")
    by_cell = pairs.groupBy("g", "low", "high").applyInArrow(in_cells, "rep long, k long")
    return by_group.unionAll(by_cell).groupBy("rep").agg(F.sum("k").alias("k"))


def near_vectors(
    table: DataFrame,
    threshold: float = 0.98,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    block: int = BLOCK,
    window: int = WINDOW,
    miss: float = MISSED,
    probes: int = PROBES,
    most_passes: int = MOST_PASSES,
    cells: tuple[int, int] = (256, 4096),
) -> DataFrame:
    """(id, n_links, component_id, kept), one row for each row of the table.

    Rows are compared only if their labels are equal and not null and their vectors have
    the same length; vectors that are null, empty, zero or hold null or non-finite
    components link with nothing (n_links 0, component: itself). Linked are rows with a
    cosine of `threshold` at least, in double precision.

    1. Rows with the same label and the same vector are one class, named by its smallest
       id; a class of n rows gives each of them n - 1 links and is compared once.
    2. In every pass the classes of a label are ordered by 64 concatenated random hashes
       (signs of projections) and cut into blocks; each is compared with the others of its
       block and the last `window` of the block before. As many passes are made as it
       takes until a planted vector at the threshold is missed by all of them with a
       probability of `miss`, measured with up to `probes` of them (2 % of the classes at
       most).
    3. A block passes on a spanning star of each group of linked vectors; all blocks' stars
       make components.
    4. Links are counted over all pairs of a component, in groups of bounded size, so no
       link within a component is lost, and no table holds links.

    A task holds one block with its window, or two cells of `cells[1]` vectors. Rows with a
    null id are passed with null component and no link. Rows that repeat an id are vectors of
    their own, each with its links. Ids are integers. Further columns aren't read, whatever
    they are called. An empty table gives no rows.
    """
    with scratch(table.sparkSession):
        return _near(table, threshold, id_col, vector_col, label_col, block, window, miss, probes, most_passes, cells)


def _near(table, threshold, id_col, vector_col, label_col, block, window, miss, probes, most_passes, cells) -> DataFrame:
    data = table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    base = data.withColumn("ok", F.expr("id is not null and label is not null and " + _usable("v"))).select(
        "id", "ok", "label", "v",
        F.when(F.col("ok"), F.xxhash64("label", "v")).alias("h1"), F.when(F.col("ok"), F.xxhash64(F.lit(7), "label", "v")).alias("h2"),
    )
    firsts = base.where("ok").groupBy("h1", "h2").agg(F.min("id").alias("least_id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    # Ids may repeat with other vectors, so each class gets a number of its own.
    classes = saved(firsts.withColumn("rep", F.monotonically_increasing_id()), "vector-classes")
    named = classes.select("rep", "label", "v", "h1")
    some = named.orderBy(F.xxhash64("h1", F.lit(SEED)), "h1").limit(min(probes, classes.count() // 50))
    placed = _places(named, saved(some, "vector-probes"), threshold, miss, block, window, most_passes)
    stars = saved(_stars(placed.join(named.drop("h1"), "rep"), threshold, block, window), "vector-stars")
    groups = connected_components(stars).select(F.col("id").alias("rep"), F.col("component_id").alias("g")).join(classes.select("rep", "least_id"), "rep")
    sizes = groups.groupBy("g").agg(F.count("*").alias("m"), F.min("least_id").alias("component_id"))
    grouped = saved(groups.drop("least_id").join(sizes, "g"), "vector-groups")
    counts = _counts(classes.select("rep", "copies", "v").join(grouped, "rep"), threshold, *cells)
    result = saved(
        classes.select("h1", "h2", "rep", "copies", "least_id").join(counts, "rep", "left").join(grouped.select("rep", "component_id"), "rep", "left")
        .select("h1", "h2", (F.coalesce("k", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("component_id", "least_id").alias("component_id")),
        "vector-result",
    )
    out = base.select("id", "h1", "h2").join(lasting(result), ["h1", "h2"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
