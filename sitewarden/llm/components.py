"""Connected components of an edge table, by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._shared import drop_saved, lasting, saved, scratch


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id): for each end of an edge the smallest id reachable from it.

    Each round points every vertex at its smallest neighbour, doubles the pointers
    once, and rewrites the edges between the vertices pointed at; edges within a
    vertex vanish. Rounds end when no edge is left, so their number follows the
    logarithm of the longest path, not the data. A hub costs nothing special: the
    minimum over neighbours is pre-aggregated, and joins on a hub are inner or left
    equi-joins that adaptive execution splits. Every round's tables are written to
    the shared folder. Null ends and self-loops are ignored; no edges, no rows.
    """
    with scratch(edges.sparkSession):
        return lasting(_contract(edges, a, b))


def _contract(edges: DataFrame, a: str, b: str) -> DataFrame:
    live = saved(
        edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u is not null and v is not null and u < v").distinct(),
        "edges",
    )
    labels = None
    while not live.isEmpty():
        both = live.select("u", "v").unionAll(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        down = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p")), "down")
        up = down.select(F.col("u").alias("p"), F.col("p").alias("g"))
        jumped = saved(down.join(up, "p", "left").select("u", F.coalesce("g", "p").alias("p")), "jumped")
        drop_saved(down)
        if labels is None:
            after = jumped.select(F.col("u").alias("id"), F.col("p").alias("component_id"))
            after = saved(after, "labels")
        else:
            to = jumped.select(F.col("u").alias("component_id"), F.col("p").alias("q"))
            after = saved(labels.join(to, "component_id", "left").select("id", F.coalesce("q", "component_id").alias("component_id")), "labels")
            drop_saved(labels)
        left = jumped.select("u", F.col("p").alias("pu"))
        right = jumped.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        rest = (
            live.join(left, "u").join(right, "v")
            .select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v"))
            .where("u < v").distinct()
        )
        rest = saved(rest, "edges")
        drop_saved(live)
        drop_saved(jumped)
        live, labels = rest, after
    return labels if labels is not None else saved(live.select(F.col("u").alias("id"), F.col("v").alias("component_id")), "labels")
