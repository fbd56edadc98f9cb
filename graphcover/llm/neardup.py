"""Near copies by the Jaccard similarity of word shingles: MinHash bands, then the sets themselves.

A text is the set of its folded shingles; equal sets are one node from the start, so
exact copies are never paired. ``BANDS`` bands of ``ROWS`` minima make the buckets: a
pair of similarity 0.8 shares none of them with probability 0.0004, 0.9 with 2e-8.

Every pair that shares a bucket counts, unless links already join it. In each of
``ROUNDS`` rounds a bucket's nodes are compared with its leader, the first time the node
that meets most others (an original lies closer to its copies than they to each other).
What is then still apart in a bucket is dealt out as pairs of blocks of ``BLOCK`` nodes;
a task holds one such pair, counts common shingles by a matrix product, some shingles at
a time, and emits the links that join what it had not yet joined, so no table ever holds
a row for each pair. A pair is linked only if the sets, made anew for candidates alone,
are at least ``LEAST`` similar.

With a ``radius`` texts are linked by SimHash as well, by the fingerprints and links of
``simhash``: a group is what both kinds of links join, so neither loses any of its own.

Null and empty texts are one node; a text with fewer words than a shingle is one
shingle. Rows are told apart by a hash of id and text, so rows that share an id, or
have none, are decided each by its own text; of equal rows one stays. Only id and text
are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphcover.functions.scratch import materialize
from graphcover.llm import simhash
from graphcover.llm.bitset import bitset, passes
from graphcover.llm.words import batched, chunks, FOLD, mapped, split_words, text_column
from graphcover.operators.components import linked_components

LEAST = 0.8
SHINGLE = 5
BANDS = 20
ROWS = 5
ROUNDS = 1
BLOCK = 256
COLUMNS = 1 << 14
SEED = 42
_RANDOM = np.random.default_rng(SEED)
_XOR = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_ODD = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingles_of(texts: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted different shingle hashes of each text."""
    words, offsets = split_words(mapped(texts, FOLD))
    n = len(words) - shingle + 1
    joined = pc.binary_join_element_wise(*(words.slice(k, n) for k in range(shingle)), pa.scalar(" ", pa.large_string())) if n > 0 else pa.array([], pa.large_string())
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(x, SEED) for x in joined.cast(pa.large_binary()).to_pylist()), np.uint64, max(n, 0))
    out = []
    for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if high - low >= shingle:
            out.append(np.unique(hashes[low : high - shingle + 1]))
        else:
            short = " ".join(words.slice(low, high - low).to_pylist()).encode()
            out.append(np.array([digest(short, SEED)] if high > low else [], np.uint64))
    return out


def node_of(shingles: np.ndarray) -> int:
    """A signed digest of the set; zero for the empty one."""
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), SEED)))) if len(shingles) else 0


def bands_of(sets: list[np.ndarray]) -> np.ndarray:
    """``BANDS`` signed bucket keys of each of the sets, none of them empty."""
    every = np.concatenate(sets)
    start = np.cumsum([0, *map(len, sets[:-1])])
    keys = np.empty((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(sets), band + 1, np.uint64)
        for k in range(band * ROWS, band * ROWS + ROWS):
            key = (key ^ np.minimum.reduceat((every ^ _XOR[k]) * _ODD[k], start)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        keys[:, band] = key
    return keys.view(np.int64)


def _row(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col), F.col(text_col), F.col(id_col).isNull(), F.col(text_col).isNull())


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int | None = None) -> DataFrame:
    """``id, row, node, size, bands, fp`` of every row; empty texts have no bands, ``fp`` is null without a radius."""
    slim = docs.select(F.col(id_col).alias("id"), _row(id_col, text_col).alias("row"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            texts = text_column(batch.column(2))
            for a, b in chunks(texts, 4 << 20):
                sets = shingles_of(texts.slice(a, b - a), shingle)
                full = [k for k, x in enumerate(sets) if len(x)]
                bands = [[]] * len(sets)
                for k, x in zip(full, bands_of([sets[k] for k in full]).tolist() if full else []):
                    bands[k] = x
                nodes, sizes = pa.array([node_of(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64())
                fps = pa.nulls(b - a, pa.int64()) if radius is None else pa.array(simhash.fingerprints_of(texts.slice(a, b - a)).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), nodes, sizes, pa.array(bands, pa.list_(pa.int64())), fps], ["id", "row", "node", "size", "bands", "fp"]
                )

    kind = slim.schema["id"].dataType.simpleString()
    return materialize(batched(slim).mapInArrow(run, f"id {kind}, row long, node long, size long, bands array<long>, fp long"), "signatures")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``node, shingles`` for the nodes of ``wanted`` (``row, node``); other rows are passed over by a bitset."""
    bits = docs.sparkSession.sparkContext.broadcast(bitset(wanted.select(F.col("row").alias("id"))))

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(passes(bits.value, batch.column(0).to_numpy(zero_copy_only=False))))
            texts = text_column(batch.column(1))
            for a, b in chunks(texts, 4 << 20):
                sets = shingles_of(texts.slice(a, b - a), shingle)
                yield pa.RecordBatch.from_arrays([pa.array([node_of(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "shingles"])

    found = batched(docs.select(_row(id_col, text_col).alias("row"), text_col)).mapInArrow(run, "node long, shingles binary")
    return found.join(wanted.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs ``src, dst`` whose sets are at least ``least`` similar, with ``similarity``."""
    both = pairs.join(sets.select(F.col("node").alias("src"), F.col("shingles").alias("_a")), "src").join(sets.select(F.col("node").alias("dst"), F.col("shingles").alias("_b")), "dst")

    def run(batches):
        for batch in batches:
            found = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                found.append(common / (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], ["src", "dst", "similarity"])

    return batched(both.select("src", "dst", "_a", "_b")).mapInArrow(run, "src long, dst long, similarity double").filter(F.col("similarity") >= least)


def _leaders(apart: DataFrame, first) -> DataFrame:
    """``key`` and its leader's ``x, xp, xs``: the node that comes first in the bucket."""
    lead = apart.groupBy("key").agg(F.max(F.struct(first.alias("first"), "node", "part", "size")).alias("lead"))
    # written, so that the join with the buckets is of two plain shuffles, whose hot buckets Spark can split
    return materialize(lead.select("key", F.col("lead.node").alias("x"), F.col("lead.part").alias("xp"), F.col("lead.size").alias("xs")), "near-leaders")


def _close_in_blocks(sets: list[np.ndarray], ours: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs of one row of ``ours`` and one other, at least ``least`` similar; within the rows if ``ours`` is all true."""
    size = np.array([len(x) for x in sets], float)
    every, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), size.astype(int))
    order = np.argsort(every, kind="stable")
    every, row = every[order], row[order]
    new = np.concatenate(([True], every[1:] != every[:-1]))
    column, times = np.cumsum(new) - 1, np.diff(np.append(np.flatnonzero(new), len(every)))
    shared = times[column] > 1
    column, row = np.unique(column[shared], return_inverse=True)[1].ravel(), row[shared]
    left = np.flatnonzero(ours)
    right = left if ours.all() else np.flatnonzero(~ours)
    common = np.zeros((len(left), len(right)))
    cuts = np.searchsorted(column, np.arange(0, column[-1] + 1 + COLUMNS, COLUMNS)) if len(column) else [0]
    for low, high in zip(cuts[:-1], cuts[1:]):
        some = np.zeros((len(sets), COLUMNS), np.float32)
        some[row[low:high], column[low:high] % COLUMNS] = 1
        common += some[left] @ some[right].T
    near = common >= least * (size[left][:, None] + size[right][None, :] - common)
    return [(int(left[i]), int(right[j])) for i, j in zip(*np.nonzero(near)) if left[i] != right[j]]


def _rest(apart: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links between the parts of each bucket, from all pairs of its nodes, block by block."""
    blocks = materialize(apart.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "near-blocks")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    dealt = (
        apart.join(blocks, "key")
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("pair", F.explode(F.array_distinct(pairs)))
        .select("key", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "block", "node", "part")
        .join(sets, "node")
        .select("key", "i", "j", "block", "node", "part", "shingles")
    )
    # packing goes by groups; sorted, a group's rows are neighbours and one group is held at a time
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def verify(batches):
        at, rows = None, []

        def close():
            if len({r[2] for r in rows}) < 2:
                return
            ours = np.array([r[0] == at[1] for r in rows])
            if ours.all() and at[1] != at[2]:
                return
            root = {r[2]: r[2] for r in rows}

            def top(x):
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            for a, b in _close_in_blocks([np.frombuffer(r[3], np.uint64) for r in rows], ours, least):
                x, y = top(rows[a][2]), top(rows[b][2])
                if x != y:
                    root[y] = x
                    yield rows[a][1], rows[b][1]

        def flush(found):
            found = list(zip(*found)) or [(), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["src", "dst"])

        for batch in batches:
            for key, i, j, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, i, j) != at:
                    yield flush(close())
                    at, rows = (key, i, j), []
                rows.append(row)
        yield flush(close())

    return batched(dealt).mapInArrow(verify, "src long, dst long")


def similar_pairs(docs: DataFrame, marked: DataFrame, id_col: str, text_col: str, least: float = LEAST, shingle: int = SHINGLE) -> DataFrame:
    """``src, dst``: links that join the nodes which pairs sharing a bucket join."""
    spark = docs.sparkSession
    nodes = marked.filter("size > 0").groupBy("node").agg(F.min("row").alias("row"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    members = nodes.select("node", "row", "size", F.explode("bands").alias("key"))
    full = members.groupBy("key").agg(F.min("node").alias("_low"), F.max("node").alias("_high"), F.count(F.lit(1)).alias("n")).filter("_low <> _high").select("key", "n")
    members = materialize(members.join(materialize(full, "near-full"), "key"), "near-buckets")
    wanted = materialize(members.groupBy("node").agg(F.min("row").alias("row"), F.sum("n").alias("meets")), "near-wanted")
    sets = materialize(_sets(docs, wanted.select("row", "node"), id_col, text_col, shingle), "near-sets")
    members = materialize(members.join(wanted.select("node", "meets"), "node").select("key", "node", "size", "meets"), "near-buckets")
    links = spark.createDataFrame([], "src long, dst long")
    for turn in range(ROUNDS + 1):
        if not turn:
            apart = members.withColumn("part", F.col("node"))
        else:  # buckets that links do not yet join
            parts = materialize(linked_components(links).withColumnRenamed("node", "_node"), "near-parts")
            apart = members.join(parts, members["node"] == parts["_node"], "left").select("key", members["node"], "size", "meets", F.coalesce("component", members["node"]).alias("part"))
            split = apart.groupBy("key").agg(F.min("part").alias("_low"), F.max("part").alias("_high"), F.count(F.lit(1)).alias("_n")).filter("_low <> _high AND _n > 2").select("key")
            apart = materialize(apart.join(materialize(split, "near-split"), "key"), "near-apart")
            if apart.isEmpty():
                break
        if turn < ROUNDS:
            lead = _leaders(apart, F.col("meets") if not turn else F.xxhash64("node", F.lit(turn)))
            met = apart.join(lead, "key").filter((F.col("part") != F.col("xp")) & (F.least("xs", "size") >= least * F.greatest("xs", "size")))
            pairs = met.select(F.least("x", "node").alias("src"), F.greatest("x", "node").alias("dst")).distinct()
            found = _similar(pairs, sets, least).select("src", "dst")
        else:
            found = _rest(apart.select("key", "node", "part"), sets, least)
        links = links.unionByName(materialize(found, "near-links"))
    return links


def fingerprint_links(marked: DataFrame, radius: int) -> DataFrame:
    """``src, dst``: links that join the nodes whose fingerprints are at most ``radius`` bits apart."""
    owned = materialize(marked.select("fp", "node").distinct(), "near-owned")
    # written, so that the join with the nodes is of two plain shuffles, whose hot fingerprints Spark can split
    reps = materialize(owned.groupBy("fp").agg(F.min("node").alias("rep")), "near-reps")
    same = owned.join(reps, "fp").filter("node <> rep").select(F.col("rep").alias("src"), F.col("node").alias("dst"))
    return materialize(same.unionByName(simhash.links(reps, radius)), "near-fingerprints")


def components_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, shingle: int = SHINGLE, radius: int | None = None) -> DataFrame:
    """``id, row, node, part`` of every row: rows of a component have one ``part``."""
    marked = signatures(docs, id_col, text_col, shingle, radius)
    links = similar_pairs(docs, marked, id_col, text_col, least, shingle)
    if radius is not None:
        links = links.unionByName(fingerprint_links(marked, radius))
    joined = linked_components(links).withColumnRenamed("node", "_node")
    return materialize(
        marked.join(joined, marked["node"] == joined["_node"], "left").select("id", "row", "node", F.coalesce("component", marked["node"]).alias("part")), "near-components"
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, shingle: int = SHINGLE, radius: int | None = None) -> DataFrame:
    """One row of each component, the one with the smallest id; a null id comes last."""
    found = components_of(docs, id_col, text_col, least, shingle, radius)
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best")
    first = found.groupBy("part").agg(best, F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    first = materialize(first.select("part", F.col("best.row").alias("stays")), "near-first")
    several = found.join(first, "part")
    gone = materialize(several.filter("row <> stays").select(F.col("row").alias("_gone")).distinct(), "near-gone")
    again = materialize(several.filter("row = stays").groupBy(F.col("row").alias("_again")).count().filter("count > 1").select("_again"), "near-again")
    keyed = docs.withColumn("_near_row", _row(id_col, text_col))
    kept = keyed.join(gone, keyed["_near_row"] == gone["_gone"], "left_anti")
    if again.isEmpty():
        return kept.drop("_near_row")
    once = kept.join(again, kept["_near_row"] == again["_again"], "left_anti")
    twice = kept.join(again, kept["_near_row"] == again["_again"], "left_semi").dropDuplicates(["_near_row"])
    return once.unionByName(twice).drop("_near_row")
