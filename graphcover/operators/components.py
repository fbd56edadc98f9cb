"""Connected components by alternating large-star and small-star contraction.

Both steps are a grouped minimum and an equi-join, so the state is one row per
edge however long a component's diameter is, and a hub is never gathered in one
task: minima combine on the map side and AQE splits the join's skewed side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphcover.functions.scratch import materialize, release

MAX_ROUNDS = 100


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def linked_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Component of every node that has an edge: ``node, component``.

    ``component`` is the smallest node that can be reached, the node itself
    included. Edges are undirected; rows with a null end and self-loops link
    nothing, repeated edges count once. No edges give an empty table.
    """
    edges = materialize(
        edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b"))
        .filter(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("a") != F.col("b")))
        .distinct(),
        "edges",
    )
    seen = _mark(edges)
    for _ in range(MAX_ROUNDS):
        if not seen[0]:
            break
        large = materialize(_large_star(edges), "large")
        small = materialize(_small_star(large), "small")
        release(edges, large)
        edges, before = small, seen
        if (seen := _mark(edges)) == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    kind = edges.schema["a"].dataType
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").cast(kind).alias("node"), F.col("b").alias("component")).unionByName(roots)


def components(nodes: DataFrame, edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node, component`` for all of ``nodes``; nodes without an edge stand alone."""
    linked = linked_components(edges, src, dst)
    return (
        nodes.select("node")
        .distinct()
        .join(linked, "node", "left")
        .select("node", F.coalesce("component", "node").alias("component"))
    )
