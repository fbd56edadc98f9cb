"""Line dedup by a segment-partition edit join.

Two lines at most ``TAU`` edits apart share one of the ``TAU + 1`` even segments of
the shorter line, at a place that the lengths confine to a few offsets. So a line is
indexed under (its length, segment number, segment) and probes, for its own and up to
``TAU`` shorter lengths, the substrings at those offsets. Only keys travel at first, and
tasks combine equal ones: a bucket counts if an indexed and another line meet there. In
a second pass the lines of such buckets come, in a third their texts; bitsets of the
keys and of the lines' ids, of one size whatever the corpus, keep most others from being
shuffled. A banded bit-parallel automaton verifies each pair.

Equal lines are one line from the start (a 128-bit digest), so repeats are never
paired. A bucket of more than ``GROUP`` lines is dealt out as pairs of blocks, each a
task's small group of its own. A group emits only links that join what it had not yet
joined, and how many partners each line has; a pair is counted in the first segment
it shares.

A class keeps its first line, by document id and line number; its other occurrences
are repeated lines. Lines are taken without the blanks at their ends; those under
``MIN_CHARS`` characters take no part in the edit join. With ``short`` their exact
repeats count all the same, blank lines aside; without it they stay.

Defined results: null and empty texts have no lines; rows with the same id and text are
one document, so a row's exact repeat removes nothing, while rows that share an id only
are documents of their own, told apart by ``text_hash``; a null id sorts first; empty
tables give empty results. Lines of any length are compared whole. Only id and text are
read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphcover.functions.scratch import materialize, sweep
from graphcover.llm.bitset import bitset, passes
from graphcover.llm.words import batched, chunks, free_prefix, text_column
from graphcover.operators.components import linked_components

TAU = 2
MIN_CHARS = 32
GROUP = 512
CHUNK_BYTES = 2 << 20
LONG = 1 << 20
_BASE, _LENGTH, _NUMBER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_INVERSE, _SHIFT = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64)), np.uint64(31)
BLANK = " \t\n\x0b\x0c\r"


def segments(length: int, tau: int = TAU) -> list[tuple[int, int]]:
    """``start, size`` of the even partition; the longer segments come last."""
    size, longer = divmod(length, tau + 1)
    out, at = [], 0
    for i in range(tau + 1):
        own = size + (i > tau - longer)
        out.append((at, own))
        at += own
    return out


def offsets(i: int, start: int, size: int, length: int, delta: int, tau: int = TAU) -> range:
    """Where a line of ``length`` may hold segment ``i`` of a line shorter by ``delta``."""
    low = max(0, start - i, start + delta - (tau - i))
    high = min(length - size, start + i, start + delta + (tau - i))
    return range(low, high + 1)


def _mixed(part, length, i):
    """A bucket's key from the hash of a segment, the indexed line's length and the segment's number."""
    x = part + length * _LENGTH + i * _NUMBER
    x = (x ^ (x >> _SHIFT)) * _BASE
    return x ^ (x >> _SHIFT)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _hash(points: np.ndarray) -> np.uint64:
    """The sum of (point + 1) BASE**place modulo 2**64, some of the points at a time."""
    total, factor = np.zeros(1, np.uint64), np.ones(1, np.uint64)
    powers = _powers(min(len(points), LONG) + 1, _BASE)
    for at in range(0, len(points), LONG):
        some = points[at : at + LONG].astype(np.uint64) + np.uint64(1)
        total += factor * np.sum(some * powers[: len(some)], dtype=np.uint64)
        factor *= powers[len(some)] if len(some) < len(powers) else np.uint64(0)
    return total


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _key(length: int, i: int, part: str) -> int:
    return int(_mixed(_hash(_points(part)), np.array([length], np.uint64), np.uint64(i)).view(np.int64)[0])


def keys_of(lines: list[str], tau: int = TAU, least: int = MIN_CHARS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lines' keys: number of the line, key, and whether it is indexed under it. A line may have a key twice."""
    found = []
    brief = [k for k, x in enumerate(lines) if len(x) <= LONG]
    if brief:
        points = _points("".join(lines[k] for k in brief))
        n = np.array([len(lines[k]) for k in brief], np.int64)
        begin = np.cumsum(n) - n
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * _powers(len(points), _BASE), dtype=np.uint64)])
        back = _powers(len(points) + 1, _INVERSE)
        number = np.array(brief)
        for delta, i, at, length, size, indexed, rows in _places(n, tau, least):
            low = begin[rows] + at
            part = (upto[low + size] - upto[low]) * back[low]
            found.append((number[rows], _mixed(part, length.astype(np.uint64), np.uint64(i)).view(np.int64), indexed))
    for k, line in enumerate(lines):
        if len(line) > LONG:
            for delta, i, at, length, size, indexed, rows in _places(np.array([len(line)]), tau, least):
                if len(rows):
                    key = _key(int(length[0]), i, line[int(at[0]) : int(at[0] + size[0])])
                    found.append((np.array([k]), np.array([key]), indexed))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*found))


def _places(n: np.ndarray, tau: int, least: int):
    """What ``segments`` and ``offsets`` say for lines of ``n`` characters, all lines at once."""
    for delta in range(tau + 1):
        length = n - delta
        size, longer = np.divmod(np.maximum(length, 0), tau + 1)
        for i in range(tau + 1):
            start = i * size + np.maximum(0, i - (tau + 1 - longer))
            own = size + (i > tau - longer)
            low = np.maximum(np.maximum(0, start - i), start + delta - (tau - i))
            high = np.minimum(np.minimum(n - own, start + i), start + delta + (tau - i))
            for step in range(2 * tau + 1):
                rows = np.flatnonzero((length >= least) & (low + step <= high))
                at = (low + step)[rows]
                yield delta, i, at, length[rows], own[rows], (at == start[rows]) & (delta == 0), rows


def within(a: str, b: str, tau: int = TAU) -> bool:
    """Whether ``a`` and ``b`` are at most ``tau`` edits apart.

    Bit ``o + tau`` of ``reach[d]`` says that, with the part of ``b`` read so far, ``d``
    edits lead to a place ``o`` further in ``a``: one word of ``2 tau + 1`` diagonals per
    number of edits. Common ends are cut off first.
    """
    if abs(len(a) - len(b)) > tau:
        return False
    short = min(len(a), len(b))
    low, high = 0, short
    while low < high:  # the longest common beginning
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    a, b, short = a[low:], b[low:], short - low
    low, high = 0, short
    while low < high:
        mid = (low + high + 1) // 2
        same = a[len(a) - mid : len(a) - low] == b[len(b) - mid : len(b) - low]
        low, high = (mid, high) if same else (low, mid - 1)
    a, b = a[: len(a) - low], b[: len(b) - low]
    band = (1 << (2 * tau + 1)) - 1
    reach = [(((1 << (d + 1)) - 1) << tau) & band for d in range(tau + 1)]
    for j, c in enumerate(b):
        match = 0
        for k in range(max(0, tau - j), min(2 * tau + 1, len(a) - j + tau)):
            if a[j + k - tau] == c:
                match |= 1 << k
        before, new = 0, 0
        for d in range(tau + 1):
            old = reach[d]
            step = old & match
            if d:
                step |= before | before >> 1 | new << 1
            before, new = old, step & band
            reach[d] = new
        if not new:
            return False
    at = len(a) - len(b) + tau
    return bool(reach[tau] >> at & 1)


def digest(line: str) -> tuple[int, int]:
    high, low = divmod(xxhash.xxh3_128_intdigest(line.encode()), 1 << 64)
    return tuple(x - (1 << 64) if x >> 63 else x for x in (high, low))


def name(high: int, low: int) -> str:
    return f"{high & (1 << 64) - 1:016x}{low & (1 << 64) - 1:016x}"


def _lines(column, least: int):
    """For each chunk of texts, a list of ``row, line number, line`` of every line that is compared."""
    texts = text_column(column)
    for a, b in chunks(texts, CHUNK_BYTES):
        found = []
        for row, text in enumerate(texts.slice(a, b - a).to_pylist(), a):
            if len(text) >= least:
                for number, line in enumerate(text.split("\n")):
                    if len(line) >= least and len(line := line.strip(BLANK)) >= least:
                        found.append((row, number, line))
        yield found


def text_hash(text_col: str) -> F.Column:
    return F.xxhash64(F.col(f"`{text_col}`"))


def occurrences(docs: DataFrame, id_col: str, text_col: str, least: int = MIN_CHARS) -> DataFrame:
    """``id, line_no, high, low`` of every compared line; ``id`` is the document's id with a hash of its text."""
    slim = docs.select(F.struct(F.col(id_col).alias("doc"), text_hash(text_col).alias("hash")).alias("id"), text_col)
    kind = slim.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for found in _lines(batch.column(1), least):
                ids = batch.column(0).take(pa.array([row for row, _, _ in found], pa.int64()))
                numbers = pa.array([number for _, number, _ in found], pa.int32())
                high, low = zip(*(digest(line) for _, _, line in found)) if found else ((), ())
                yield pa.RecordBatch.from_arrays([ids, numbers, pa.array(high, pa.int64()), pa.array(low, pa.int64())], ["id", "line_no", "high", "low"])

    return materialize(batched(slim).mapInArrow(run, f"id {kind}, line_no int, high long, low long"), "occurrences")


def _distinct(docs: DataFrame, text_col: str, least: int, batch_of, schema: str) -> DataFrame:
    """What ``batch_of`` makes of the lines of a chunk, each line once for a batch of documents."""

    def run(batches):
        for batch in batches:
            seen = set()
            for found in _lines(batch.column(0), least):
                lines = []
                for _, _, line in found:
                    own = xxhash.xxh3_128_digest(line.encode())
                    if own not in seen:
                        seen.add(own)
                        lines.append(line)
                yield batch_of(lines)

    return batched(docs.select(text_col)).mapInArrow(run, schema)


class Group:
    """Lines of one bucket, or of two blocks of a large one."""

    def __init__(self, tau: int):
        self.tau, self.rows = tau, {}

    def add(self, line: str, indexed: bool, block: int) -> None:
        was = self.rows.get(line, (False, block))
        self.rows[line] = (was[0] or indexed, block)

    def links(self, first: int, second: int):
        """Links that join lines, and each line's partners counted here."""
        order = sorted(self.rows, key=lambda x: (len(x), x))
        parent = {x: x for x in order}

        def root(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        partners: dict[str, int] = {}
        edges = []
        for k, a in enumerate(order):
            indexed, block = self.rows[a]
            if not indexed:
                continue
            for b in order[k + 1 :]:
                if {block, self.rows[b][1]} != {first, second} or not within(a, b, self.tau):
                    continue
                if self._first_segment(a, b) == self.segment:
                    partners[a] = partners.get(a, 0) + 1
                    partners[b] = partners.get(b, 0) + 1
                x, y = root(a), root(b)
                if x != y:
                    parent[y] = x
                    edges.append((a, b))
        return edges, partners

    def _first_segment(self, a: str, b: str) -> int:
        delta = len(b) - len(a)
        for i, (start, size) in enumerate(segments(len(a), self.tau)):
            if any(b[at : at + size] == a[start : start + size] for at in offsets(i, start, size, len(b), delta, self.tau)):
                return i
        return -1

    def find_segment(self, key: int) -> None:
        """The segment number behind the bucket's key, told by any indexed line."""
        for line, (indexed, _) in self.rows.items():
            if indexed:
                for i, (start, size) in enumerate(segments(len(line), self.tau)):
                    if _key(len(line), i, line[start : start + size]) == key:
                        self.segment = i
                        return
        self.segment = -1


def line_links(docs: DataFrame, text_col: str = "text", tau: int = TAU, least: int = MIN_CHARS) -> DataFrame:
    """``src, dst, partners``: links between different lines, and rows without ``dst`` that count a line's partners."""
    spark = docs.sparkSession

    def keyed(wanted):
        def batch_of(lines):
            row, key, indexed = keys_of(lines, tau, least)
            if wanted is not None:
                some = passes(wanted.value, key)
                row, key, indexed = row[some], key[some], indexed[some]
            own = np.array([digest(x)[0] for x in lines], np.int64)
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(own[row], pa.int64()), pa.array(indexed, pa.bool_())], ["key", "id", "indexed"])

        return _distinct(docs, text_col, least, batch_of, "key long, id long, indexed boolean")

    ends = keyed(None).groupBy("key").agg(F.min("id").alias("_low"), F.max("id").alias("_high"), F.max("indexed").alias("_any"))
    met = materialize(ends.filter("_any AND _low <> _high").select("key"), "met")
    sweep(spark)
    bits = spark.sparkContext.broadcast(bitset(met.withColumnRenamed("key", "id")))
    active = materialize(keyed(bits).join(met, "key", "left_semi"), "buckets")
    active = materialize(active.groupBy("key", "id").agg(F.max("indexed").alias("indexed")), "buckets")
    bits.unpersist()
    sizes = active.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("blocks"))
    sizes = materialize(sizes, "sizes")
    wanted = materialize(active.select("id").distinct(), "wanted")
    likely = spark.sparkContext.broadcast(bitset(wanted))

    def texted(lines):
        own = np.array([digest(x)[0] for x in lines], np.int64)
        some = np.flatnonzero(passes(likely.value, own))
        return pa.RecordBatch.from_arrays([pa.array(own[some], pa.int64()), pa.array([lines[k] for k in some], pa.string())], ["id", "line"])

    texts = _distinct(docs, text_col, least, texted, "id long, line string")
    texts = materialize(texts.join(wanted, "id", "left_semi").distinct(), "lines")
    sweep(spark)
    # a line of block r of n meets every block: groups (r, j) and (j, r), smaller block first
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    dealt = (
        active.join(sizes, "key")
        .withColumn("block", block)
        .withColumn("pair", F.explode(pairs))
        .select("key", "id", "indexed", "block", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"))
        .join(texts, "id")
        .select("key", "i", "j", "block", "indexed", "line")
    )
    # packing goes by groups; sorted, a group's rows are neighbours and one group is held at a time
    sorted_rows = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def verify(batches):
        at, group, out = None, None, []

        def close():
            if group is not None and len(group.rows) > 1:
                group.find_segment(at[0])
                edges, partners = group.links(at[1], at[2])
                out.extend((name(*digest(a)), name(*digest(b)), None) for a, b in edges)
                out.extend((name(*digest(x)), None, n) for x, n in partners.items())

        def flush():
            columns = list(zip(*out)) or [(), (), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))], ["src", "dst", "partners"])

        for batch in batches:
            for key, i, j, own, indexed, line in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, i, j) != at:
                    close()
                    at, group = (key, i, j), Group(tau)
                group.add(line, indexed, own)
            yield flush()
        close()
        yield flush()

    return materialize(batched(sorted_rows).mapInArrow(verify, "src string, dst string, partners long"), "links")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU, least: int = MIN_CHARS, short: bool = False) -> DataFrame:
    """One row per document with compared lines: ``id, text_hash, n_lines, n_links, removed_lines, first_docs``.

    With ``short`` lines under ``least`` characters are compared too, for equality only.

    ``removed_lines`` are the numbers (from 0) of lines whose class occurs earlier;
    ``first_docs`` has, in the same order, the document of the class's first line;
    ``n_links`` counts the different lines within the threshold of the document's lines.
    """
    found = line_links(docs, text_col, tau, least)
    classes = linked_components(found.filter("dst IS NOT NULL"))
    partners = found.filter("dst IS NULL").groupBy("src").agg(F.sum("partners").alias("partners"))
    known = materialize(partners.join(classes, partners["src"] == classes["node"]).select("node", "component", "partners"), "classes")
    word = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    lines = occurrences(docs, id_col, text_col, 1 if short else least).select("id", "line_no", F.concat(word("high"), word("low")).alias("node"))
    lines = lines.join(known, "node", "left").select("id", "line_no", F.coalesce("component", "node").alias("class"), F.coalesce("partners", F.lit(0)).alias("partners"))
    lines = materialize(lines, "line-classes")
    place = F.struct("id", "line_no")
    # written first, so that the join below is one of two plain shuffles, whose hot classes Spark can split
    twice = lines.groupBy("class").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last").select("class", "first")
    twice = materialize(twice, "repeated")
    repeats = lines.join(twice, "class").filter(place != F.col("first")).select("id", F.struct("line_no", F.col("first.id.doc").alias("doc")).alias("hit"))
    removed = repeats.groupBy("id").agg(F.sort_array(F.collect_set("hit")).alias("hits"))
    own = lines.groupBy("id").agg(F.collect_set(F.struct("line_no", "partners")).alias("own"))
    total = F.aggregate("own", F.lit(0).cast("long"), lambda n, x: n + x["partners"])
    totals = own.select("id", F.size("own").cast("long").alias("n_lines"), total.alias("n_links"))
    none = F.array().cast(removed.schema["hits"].dataType)
    hits = F.coalesce("hits", none)
    return totals.join(removed, totals["id"] == removed["id"], "left").select(
        totals["id.doc"].alias(id_col), totals["id.hash"].alias("text_hash"), "n_lines", "n_links", F.transform(hits, lambda x: x["line_no"]).alias("removed_lines"), F.transform(hits, lambda x: x["doc"]).alias("first_docs")
    )


def drop_lines(docs: DataFrame, removed: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The documents without their removed lines, with all their columns; ``length_col`` is measured anew."""
    x = free_prefix(docs)
    at = F.col(f"`{x}gone`")
    gone = removed.filter(F.size("removed_lines") > 0).select(F.col(id_col).alias(f"{x}id"), F.col("text_hash").alias(f"{x}hash"), F.col("removed_lines").alias(f"{x}gone"))
    left = F.array_join(F.filter(F.split(F.col(f"`{text_col}`"), "\n"), lambda line, i: ~F.array_contains(at, i)), "\n")
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(f"`{x}id`")) & (text_hash(text_col) == F.col(f"`{x}hash`"))
    cut = docs.join(gone, same, "left")
    new = {text_col: F.when(at.isNull(), F.col(f"`{text_col}`")).otherwise(left)}
    if length_col and length_col in docs.columns:
        new[length_col] = F.when(at.isNull(), F.col(f"`{length_col}`")).otherwise(F.length(left).cast(docs.schema[length_col].dataType))
    return cut.withColumns(new).select(*(F.col(f"`{c}`") for c in docs.columns))


def op6_linededup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = repeated_lines(docs, short=True).withColumnRenamed("doc_id", "_doc")
    each = docs.select("doc_id", text_hash("text").alias("_hash")).distinct()
    same = each["doc_id"].eqNullSafe(found["_doc"]) & (each["_hash"] == found["text_hash"])
    return each.join(found, same, "left").select(
        "doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("removed_lines", F.array().cast("array<int>")).alias("removed_lines"), F.coalesce("first_docs", F.array().cast("array<bigint>")).alias("first_docs"),
    )
