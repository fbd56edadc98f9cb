r"""Reply trees to formatted conversations, in DataFrame code only.

Paths from root to leaf come from iterative self-joins with doubling: after round
k a node knows its ancestor 2^k replies up, so a thread of a thousand replies takes
ten rounds. Only node ids take part; texts are joined to chosen paths at the end.

The template writes a turn as ``<|turn|>role<|text|>text<|end|>``. A control string
inside a role or text gets one backslash after its first character, and one more if
it has some already, so that no control string is left there and reading takes
exactly that backslash away again.

Defined results: a null role or text is empty; a node whose parent is not in its
tree is a root; nodes on or below a cycle reach no root and are in no path; a null
tree id is a tree of its own; repeated rows are turns of their own in ``threads``.
No rows give an empty table. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphcover.functions.scratch import materialize

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: What follows the first character of a control string of a common chat template.
CONTROL = r"\|[A-Za-z0-9_]+\|>|/?s>|/?INST\]|</?SYS>>"
ESCAPE = rf"([<\[])(\\*)({CONTROL})"
UNESCAPE = rf"([<\[])\\(\\*)({CONTROL})"


def escape(text) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(ESCAPE), F.lit(r"$1\\$2$3"))


def unescape(text) -> F.Column:
    return F.regexp_replace(text, F.lit(UNESCAPE), F.lit("$1$2$3"))


def threads(turns: DataFrame, tree: str = "conv_id", order: str = "turn") -> DataFrame:
    """Flat conversations as reply trees: each turn answers the one before it."""
    row = F.row_number().over(Window.partitionBy(tree).orderBy(order, "role", "text"))
    return turns.select(tree, row.cast("long").alias("node_id"), "role", "text").withColumn("parent_id", F.nullif(F.col("node_id") - 1, F.lit(0).cast("long")))


def root_to_leaf(nodes: DataFrame) -> DataFrame:
    """``tree, leaf, node, up`` for every node on every path; ``up`` is its distance from the leaf.

    ``nodes`` has ``tree, node, parent``, where tree and node are not null.
    """
    nodes = materialize(nodes.dropDuplicates(["tree", "node"]), "nodes")
    most = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    parent = nodes.select("tree", F.col("node").alias("up_node"))
    jumps = [
        materialize(
            nodes.filter("parent IS NOT NULL").select("tree", "node", F.col("parent").alias("up_node")).join(parent, ["tree", "up_node"]), "jump"
        )
    ]
    while 2 ** len(jumps) < most:
        last = jumps[-1]
        on = last.select("tree", F.col("node").alias("up_node"), F.col("up_node").alias("far"))
        jumps.append(materialize(last.join(on, ["tree", "up_node"]).select("tree", "node", F.col("far").alias("up_node")), "jump"))
    inner = nodes.select("tree", F.col("parent").alias("node"))
    leaves = nodes.select("tree", "node").join(inner, ["tree", "node"], "left_anti")
    # a walk of as many steps as the tree has nodes never ends: it is on a cycle
    endless = materialize(_walk(leaves.select("tree", F.col("node").alias("leaf"), "node"), jumps, most), "endless") if most else None
    if endless is not None:
        leaves = leaves.join(endless.select("tree", F.col("leaf").alias("node")), ["tree", "node"], "left_anti")
    paths = materialize(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "paths")
    for k in range(len(jumps) - 1, -1, -1):
        further = paths.join(jumps[k], ["tree", "node"]).select("tree", "leaf", F.col("up_node").alias("node"), (F.col("up") + 2**k).alias("up"))
        paths = materialize(paths.unionByName(further), "paths")
    return paths


def _walk(at: DataFrame, jumps: list[DataFrame], steps: int) -> DataFrame:
    """Where ``steps`` replies up lead from ``node``; rows for which that is nowhere go."""
    for k, jump in enumerate(jumps):
        if steps >> k & 1:
            at = at.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("up_node").alias("node"))
    if steps >> len(jumps):
        last = jumps[-1]
        for _ in range((steps >> len(jumps)) * 2):
            at = at.join(last, ["tree", "node"]).select("tree", "leaf", F.col("up_node").alias("node"))
    return at


def chosen_paths(paths: DataFrame, scores: DataFrame, top: int = 1) -> DataFrame:
    """``tree, leaf`` of the ``top`` paths of each tree by summed score, the smaller leaf first among equals."""
    total = paths.join(scores, ["tree", "node"]).groupBy("tree", "leaf").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("path_score"))
    place = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("path_score"), "leaf"))
    return total.withColumn("branch_rank", place).filter(F.col("branch_rank") <= top)


def format_trees(
    nodes: DataFrame, tree: str = "conv_id", node: str = "node_id", parent: str = "parent_id", score: str | None = None,
    top: int = 1, loss_role: str = "assistant",
) -> DataFrame:
    """``tree, leaf, branch_rank, n_turns, formatted, loss_spans`` for each chosen path.

    ``loss_spans`` holds ``start, end`` (code points, from 0) of each ``loss_role`` text in ``formatted``.
    """
    key = F.coalesce(F.concat(F.lit("t"), F.col(tree).cast("string")), F.lit("n"))
    rows = materialize(
        nodes.filter(F.col(node).isNotNull()).select(
            key.alias("tree"), F.col(tree).alias("_tree"), F.col(node).alias("node"), F.col(parent).alias("parent"),
            (F.col(score).cast("double") if score else F.lit(0.0)).alias("score"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        ),
        "turns",
    )
    paths = root_to_leaf(rows.select("tree", "node", "parent"))
    best = chosen_paths(paths, rows.select("tree", "node", "score"), top).select("tree", "leaf", "branch_rank")
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    turns = (
        paths.join(best, ["tree", "leaf"])
        .join(rows, ["tree", "node"])
        .select("tree", "_tree", "leaf", "branch_rank", "up", F.col("role") == loss_role, head, escape(F.col("text")))
        .toDF("tree", "_tree", "leaf", "branch_rank", "up", "scored", "head", "body")
        .withColumn("piece", F.concat("head", "body", F.lit(END)))
    )
    before = Window.partitionBy("tree", "leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head"))
    span = F.struct("start", (F.col("start") + F.length("body")).alias("end"))
    listed = turns.groupBy("tree", "leaf").agg(
        F.first("_tree").alias(tree),
        F.first("branch_rank").alias("branch_rank"),
        F.sort_array(F.collect_list(F.struct("up", "piece")), asc=False).alias("pieces"),
        F.sort_array(F.collect_list(F.when(F.col("scored"), span))).alias("loss_spans"),
    )
    return listed.select(
        tree, "leaf", "branch_rank", F.size("pieces").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda x: x["piece"]), "").alias("formatted"), "loss_spans",
    )


def read_turns(formatted) -> F.Column:
    """The ``role, text`` structs of a formatted conversation, unescaped."""
    marked = F.split(formatted, r"<\|turn\|>")
    pieces = F.slice(marked, 2, F.greatest(F.size(marked) - 1, F.lit(0)))
    cut = F.transform(pieces, lambda x: F.split(F.substring(x, F.lit(1), F.length(x) - len(END)), r"<\|text\|>"))
    return F.transform(cut, lambda x: F.struct(unescape(x[0]).alias("role"), unescape(x[1]).alias("text")))


def read_loss(formatted, spans) -> F.Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


PROBE = "</s>[INST] ok [/INST]"


def op10_chat(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.sql(f"SELECT -1L AS conv_id, t AS turn, r AS role, '{PROBE}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)")
    out = materialize(format_trees(threads(turns.unionByName(probe))), "chats")
    read = out.withColumn("_turns", read_turns(F.col("formatted"))).withColumn("_loss", read_loss(F.col("formatted"), F.col("loss_spans")))
    told = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2(F.col("_loss"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


_LEN = rf"length(regexp_replace({{0}}, '{ESCAPE}', '\1\\\2\3', 'g'))"
OP10_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}'))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({_LEN.format('role')} + {_LEN.format('text')} + {len(TURN) + len(TEXT) + len(END)}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
