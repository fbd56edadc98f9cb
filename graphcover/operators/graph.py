"""Edges, adjacency, degrees and induced subgraphs.

Edges are ``src, dst`` with each undirected edge once. ``adjacency`` has both
directions. The simple view drops loops and repeats; the multigraph view keeps both,
and a loop counts twice in its own row. Null ends are dropped at the source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def canonical_edges(edges: DataFrame) -> DataFrame:
    """Each undirected edge once with ``src < dst``; no loops, no null ends."""
    return edges.filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of every row, repeats kept."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def adjacency_list(edges: DataFrame, kind: str = "string") -> DataFrame:
    """``node, neighbours``: sorted ids of type ``kind``, repeats kept; one row holds one node's neighbours."""
    rows = adjacency(edges).select(F.col("src").cast(kind).alias("node"), F.col("dst").cast(kind).alias("dst"))
    return rows.groupBy("node").agg(F.sort_array(F.collect_list("dst")).alias("neighbours"))


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``node, deg`` with repeats counted; with ``nodes``, those without an edge have degree 0."""
    found = adjacency(edges).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("deg"))
    if nodes is None:
        return found
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("deg", F.lit(0)).alias("deg"))


def max_degree(deg: DataFrame) -> DataFrame:
    return deg.agg(F.coalesce(F.max("deg"), F.lit(0)).cast("long").alias("max_degree"))


def pure_nodes(deg: DataFrame, threshold: int) -> DataFrame:
    return deg.filter(F.col("deg") <= threshold)


def threshold_schedule(deg: DataFrame, initial: int = 1) -> DataFrame:
    """``threshold, pure``: the thresholds at which the set of pure nodes grows, and its size.

    The first is ``initial + 1``, later ones are the larger distinct degrees; between
    them nothing changes. Degrees are counted first, so the window holds distinct
    degrees only.
    """
    from pyspark.sql import Window

    counts = deg.groupBy(F.greatest(F.col("deg"), F.lit(initial + 1)).alias("threshold")).agg(F.count(F.lit(1)).alias("n"))
    top = deg.agg(F.max("deg").alias("_max"), F.count(F.lit(1)).alias("_rows"))
    upto = Window.orderBy("threshold").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = counts.select("threshold", F.sum("n").over(upto).alias("pure"))
    return run.join(F.broadcast(top)).filter("threshold <= _max AND threshold - 1 < _rows").select(F.col("threshold").cast("long").alias("threshold"), "pure")


def induced_subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in ``nodes``; ids stay global."""
    own = nodes.select("node").distinct()
    return edges.join(own.withColumnRenamed("node", "src"), "src", "left_semi").join(own.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")


def degree_stats(deg: DataFrame) -> DataFrame:
    """One row: nodes, mean, exact median, population deviation, largest degree."""
    return deg.agg(
        F.count(F.lit(1)).alias("n_nodes"),
        F.round(F.avg("deg"), 6).alias("mean_degree"),
        F.median("deg").cast("double").alias("median_degree"),
        F.round(F.stddev_pop("deg"), 6).alias("sd_degree"),
        F.max("deg").cast("long").alias("max_degree"),
    )


def degree_histogram(deg: DataFrame, bins: int = 40) -> DataFrame:
    """``bin, low, high, n``: equal widths from the smallest to the largest degree, the last bin closed."""
    ends = deg.agg(F.min("deg").alias("_low"), F.max("deg").alias("_high"))
    width = (F.col("_high") - F.col("_low")) / F.lit(float(bins))
    at = F.when(width > 0, F.least(F.floor((F.col("deg") - F.col("_low")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))).otherwise(0)
    rows = deg.join(F.broadcast(ends)).withColumn("bin", at.cast("long"))
    return rows.groupBy("bin", "_low", width.alias("_w")).agg(F.count(F.lit(1)).alias("n")).select(
        "bin", F.round(F.col("_low") + F.col("bin") * F.col("_w"), 6).alias("low"), F.round(F.col("_low") + (F.col("bin") + 1) * F.col("_w"), 6).alias("high"), "n"
    )


def unordered_pairs(values: DataFrame) -> DataFrame:
    """``x, y`` with ``x < y`` for the distinct values of each ``group``."""
    own = values.select("group", "value").distinct()
    other = own.withColumnRenamed("value", "y")
    return own.withColumnRenamed("value", "x").join(other, "group").filter("x < y").select("group", "x", "y")
