"""Connected components by alternating large and small stars; every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut, drop_cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger (or, of the small star, smaller) neighbours to the least node in reach."""
    if large:
        edges = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    linked = edges.join(least, "a")
    if large:
        return linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    return linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b) in, in any direction, of one orderable type; (node, component) out: the least node of each component.

    Loops and edges with a null end count for nothing; nodes without an edge do not appear.  A node's
    minimum is aggregated before the shuffle, and the joins by node may be split where a node is hot.
    """
    state = cut(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = mark(state)
    for _ in range(most_rounds):
        last, state = state, cut(_star(_star(state, True), False))
        drop_cut(last)
        after = mark(state)
        if after == before:
            return state.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = after
    raise RuntimeError("connected components did not settle")
