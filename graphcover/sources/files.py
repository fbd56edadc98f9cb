"""Text files in and out: edge lists, METIS and SNAP graphs, community files, reports.

All files are read split. Where a line's number is its id, it is the line's place in its
split and the number of lines in the splits before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphcover.functions.scratch import materialize
from graphcover.operators.graph import adjacency


def parse_edges(lines: DataFrame, base: int = 0) -> DataFrame:
    """``src, dst`` from ``value`` lines of two ids; ``base`` is taken off both. Blank and ``#`` lines are none."""
    parts = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    rows = lines.filter("trim(value) <> '' AND NOT startswith(trim(value), '#')").select(parts.alias("x"))
    return rows.select((F.col("x")[0].cast("long") - base).alias("src"), (F.col("x")[1].cast("long") - base).alias("dst"))


def read_edges(spark: SparkSession, path: str, base: int = 0) -> DataFrame:
    return parse_edges(spark.read.text(path), base)


def check_counts(edges: DataFrame, num_nodes: int, num_edges: int) -> None:
    """Raise unless there are ``num_edges`` rows with ids from 1 to ``num_nodes``."""
    n, low, high = edges.agg(F.count(F.lit(1)), F.min(F.least("src", "dst")), F.max(F.greatest("src", "dst"))).first()
    if n != num_edges or (n and (low < 1 or high > num_nodes)):
        raise ValueError(f"{n} edges with ids {low}..{high}; expected {num_edges} within 1..{num_nodes}")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line`` from 1, ``value``; the files of a folder follow each other by name.

    The split of each line is written with it, as another scan might cut the file
    otherwise; the window is over splits, of which a file has one per 128 MB or so.
    """
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    own = materialize(spark.read.text(path).select("value", *where).withColumn("at", F.monotonically_increasing_id()), "lines")
    splits = own.groupBy("file", "start").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1))
    offsets = splits.select("file", "start", (F.coalesce(before, F.lit(0)) + 1 - F.col("first")).alias("offset"))
    return own.join(offsets, ["file", "start"]).select((F.col("at") + F.col("offset")).alias("line"), "value")


def parse_communities(lines: DataFrame, base: int = 0) -> DataFrame:
    """``comm_id, node`` from lines of ids; blank lines are no community but keep their number."""
    ids = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    rows = lines.filter("trim(value) <> ''").select(F.col("line").alias("comm_id"), F.explode(ids).alias("id"))
    return rows.select("comm_id", (F.col("id").cast("long") - base).alias("node")).distinct()


def read_communities(spark: SparkSession, path: str, base: int = 0) -> DataFrame:
    return parse_communities(numbered_lines(spark, path), base)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``comm_id`` from blank separated numbers, on any number of lines."""
    ids = F.explode(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " "))
    return spark.read.text(path).filter("trim(value) <> ''").select(ids.alias("id")).select(F.col("id").cast("long").alias("comm_id"))


def count_communities(lines: DataFrame) -> int:
    return lines.filter("length(trim(value)) > 0").count()


def parse_metis(lines: DataFrame, base: int = 1) -> DataFrame:
    """``src, dst`` with ``src < dst``, each edge once, from METIS lines (``line`` 1 is the header).

    Line ``i + 1`` holds the neighbours of node ``i``, a blank line those of a node without
    any; ``base`` is the id of the first node in the file, and ids come out from 1.
    """
    ids = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    rows = lines.filter("line > 1 AND trim(value) <> ''").select((F.col("line") - 1).alias("src"), F.explode(ids).alias("id"))
    return rows.select("src", (F.col("id").cast("long") + 1 - base).alias("dst")).filter("dst > src").distinct()


def metis_header(lines: DataFrame) -> DataFrame:
    """One row: ``n_nodes, n_edges``."""
    parts = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    return lines.filter("line = 1").select(parts[0].cast("long").alias("n_nodes"), parts[1].cast("long").alias("n_edges"))


def snap_rows(edges: DataFrame) -> DataFrame:
    """``src, dst, value``: both directions of every edge as tab-separated lines."""
    return adjacency(edges).select("src", "dst", F.concat_ws("\t", F.col("src").cast("string"), F.col("dst").cast("string")).alias("value"))


def write_snap(edges: DataFrame, path: str, num_nodes: int, num_edges: int) -> None:
    """SNAP text in sorted order: the header in the first part, the lines in the others, range by range."""
    spark = edges.sparkSession
    head = ["# Undirected graph", f"# Nodes: {num_nodes} Edges: {num_edges}", "# Each edge is listed in both directions", "# FromNodeId\tToNodeId"]
    first = spark.createDataFrame([(i, x) for i, x in enumerate(head)], "k long, value string").coalesce(1).orderBy("k").select("value").coalesce(1)
    first.write.mode("overwrite").text(path)
    snap_rows(edges).orderBy("src", "dst").select("value").write.mode("append").text(path)


def write_edges(edges: DataFrame, path: str) -> None:
    edges.select(F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string")).alias("value")).write.mode("overwrite").text(path)


def write_matrix(edges: DataFrame, path: str) -> None:
    """The 0/1 adjacency matrix as coordinate rows ``row, col, value`` in Parquet."""
    adjacency(edges).distinct().select(F.col("src").alias("row"), F.col("dst").alias("col"), F.lit(1.0).alias("value")).write.mode("overwrite").parquet(path)


def community_lines(cover: DataFrame) -> DataFrame:
    """``comm_id, value``: members ascending, blank separated, as in a community file."""
    members = F.sort_array(F.collect_list("node"))
    return cover.select("comm_id", "node").distinct().groupBy("comm_id").agg(F.concat_ws(" ", members.cast("array<string>")).alias("value"))


def write_communities(cover: DataFrame, path: str) -> None:
    """One community per line in the order of their ids; a range-partitioned sort, so parts read in order."""
    community_lines(cover).orderBy("comm_id").select("value").write.mode("overwrite").text(path)


def f1_report(f1: float, seconds: float, found: str, truth: str) -> list[str]:
    return [f"Found communities: {found}", f"Ground truth: {truth}", f"Average F1: {f1}", f"Seconds: {seconds}"]


def write_lines(spark: SparkSession, lines: list[str], path: str) -> None:
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(path)
