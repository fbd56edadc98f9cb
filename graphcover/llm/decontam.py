"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` stores the positions of every training token: an index segment holds
the postings of some megabytes of documents, sorted by term, as delta-coded blobs.
Segments are Parquet rows in the shared folder, so a lost task is built again alone
and a segment never grows with the corpus.

``search_windows`` sends the benchmark's windows to every segment, as numbers of their
different terms. The segment's vocabulary is intersected with these terms first, so a
window with a term that the segment lacks costs no look at a list. The others are
resolved from the segment's rarest term upwards: the rarest list, moved back by the
term's place in the window, gives the candidate starts, and each further list keeps
those that it has as well. ``search_near`` returns places where all terms of a query
stand within a span.

The windows go out in blocks of at most ``BLOCK_WINDOWS``, which bounds what is broadcast
however large the benchmark or an item of it is; a block's hits are written, only those
of hit documents, before the next one goes out. Documents are never shuffled.

Defined results: null and empty texts have no words, get zeros and no items; an item
without words has no window; an item with fewer words than the window is one window;
items with a null id hit words but are in no id list; repeated items count once per
id; repeated documents give repeated rows; overlapping and touching windows cover each
word once; texts of any length are indexed whole; only id and text are read, so other
columns may have any name; either table may be empty. ``drop_contaminated`` decides each
row by its own id and text, so rows that share an id, or have none, are not drawn in.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphcover.functions.scratch import materialize
from graphcover.llm.words import ALNUM, batched, chunks, free_prefix, mapped, split_words, text_column

WINDOW = 10
BLOCK_WINDOWS = 200_000
SEGMENT_BYTES = 8 << 20

_SEGMENT = "segment string, doc_ids array<{kind}>, doc_words array<int>, terms binary, term_counts binary, postings binary"


def _pack(values: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(values).tobytes(), 1)


def _unpack(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), kind)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Index segments of whole documents: ids, word counts, terms, postings."""
    slim = docs.select(id_col, text_col)
    kind = slim.schema[id_col].dataType.simpleString()

    def build(batches):
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = text_column(batch.column(1))
            for a, b in chunks(texts, SEGMENT_BYTES):
                number += 1
                words, offsets = split_words(mapped(texts.slice(a, b - a), ALNUM))
                coded = words.dictionary_encode()
                ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
                order = np.argsort(ids, kind="stable").astype(np.int32)
                count = np.bincount(ids, minlength=len(coded.dictionary)).astype(np.int32)
                delta = np.diff(order, prepend=np.int32(0))
                terms = "\n".join(coded.dictionary.to_pylist()).encode()
                yield pa.RecordBatch.from_pydict(
                    {
                        "segment": [f"{part}-{number}"],
                        "doc_ids": pa.array([batch.column(0).slice(a, b - a).to_pylist()], pa.list_(batch.column(0).type)),
                        "doc_words": pa.array([np.diff(offsets).astype(np.int32)], pa.list_(pa.int32())),
                        "terms": pa.array([zlib.compress(terms, 1)], pa.binary()),
                        "term_counts": pa.array([_pack(count)], pa.binary()),
                        "postings": pa.array([_pack(delta)], pa.binary()),
                    }
                )

    return materialize(batched(slim).mapInArrow(build, _SEGMENT.format(kind=kind)), "index")


class Windows:
    """Different windows as rows of term numbers, filled up at the end, and the ids of the items that have each."""

    def __init__(self, found: dict[tuple[str, ...], set]):
        self.terms = sorted({t for w in found for t in w})
        number = {t: k for k, t in enumerate(self.terms)}
        self.sizes = [len(w) for w in found]
        self.rows = np.full((len(found), max(self.sizes, default=1)), len(self.terms), np.int32)
        for k, w in enumerate(found):
            self.rows[k, : len(w)] = [number[t] for t in w]
        self.items = list(found.values())


class Segment:
    """Postings of one segment; positions count all words of its documents."""

    def __init__(self, segment, doc_ids, doc_words, terms, term_counts, postings):
        self.name = segment
        self.doc_ids = doc_ids
        self.words = np.asarray(doc_words, np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.words)))
        raw = zlib.decompress(terms).decode()
        self.place = {t: i for i, t in enumerate(raw.split("\n"))} if raw else {}
        counts = _unpack(term_counts, np.int32).astype(np.int64)
        self.bounds = np.concatenate(([0], np.cumsum(counts)))
        self.counts = counts
        self.order = np.cumsum(_unpack(postings, np.int32), dtype=np.int64)

    def positions(self, term: str) -> np.ndarray:
        at = self.place.get(term)
        return self.order[:0] if at is None else self.order[self.bounds[at] : self.bounds[at + 1]]

    def document(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, "right") - 1

    def phrase(self, at: np.ndarray) -> np.ndarray:
        """Starts of the phrase of these term numbers, intersected from its rarest term upwards."""
        found = None
        for i in np.argsort(self.counts[at], kind="stable").tolist():
            moved = self.order[self.bounds[at[i]] : self.bounds[at[i] + 1]]
            if found is None:
                found = moved - i
                found = found[found >= 0]
            else:  # the list is sorted: look the few candidates up in it
                spot = np.minimum(np.searchsorted(moved, found + i), len(moved) - 1)
                found = found[moved[spot] == found + i]
            if not len(found):
                return found
        found = found[found + len(at) <= len(self.order)]
        return found[self.document(found) == self.document(found + len(at) - 1)]

    def phrases(self, windows: Windows):
        """``window, starts`` of the windows that occur here."""
        here = np.array([self.place.get(t, -1) for t in windows.terms] + [0], np.int64)
        held = here >= 0
        held[-1] = True  # the filler of short windows
        for k in np.flatnonzero(held[windows.rows].all(axis=1)).tolist():
            found = self.phrase(here[windows.rows[k, : windows.sizes[k]]])
            if len(found):
                yield k, found

    def near(self, terms: tuple[str, ...], span: int) -> np.ndarray:
        """Positions of the rarest term that have all terms within ``span`` words, in one document."""
        lists = sorted((self.positions(t) for t in set(terms)), key=len)
        if not lists or not len(lists[0]):
            return self.order[:0]
        found = lists[0]
        low = np.maximum(found - span + 1, self.starts[self.document(found)])
        keep = np.zeros(len(found), bool)
        end = self.starts[self.document(found) + 1]
        for k in range(span):  # the span may begin up to span-1 words earlier
            begin = found - span + 1 + k
            stop = np.minimum(begin + span, end)
            ok = begin >= low
            for other in lists[1:]:
                ok &= np.searchsorted(other, stop) > np.searchsorted(other, begin)
            keep |= ok
        return found[keep]


def segments(batches):
    for batch in batches:
        for row in batch.to_pylist():
            yield Segment(**row), batch.schema.field("doc_ids").type.value_type


def window_blocks(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text", limit: int = BLOCK_WINDOWS):
    """At most ``limit`` different windows at a time, with the ids of the items that have them."""
    block: dict[tuple[str, ...], set] = {}
    for row in items.select(F.col(id_col).cast("string"), text_col).toLocalIterator():
        words = split_words(mapped(text_column(pa.array([row[1]], pa.string())), ALNUM))[0].to_pylist()
        for i in range(max(len(words) - window, 0) + 1 if words else 0):
            block.setdefault(tuple(words[i : i + window]), set()).add(row[0])
            if len(block) >= limit:
                yield Windows(block)
                block = {}
    if block:
        yield Windows(block)


def search_windows(index: DataFrame, windows: Windows) -> DataFrame:
    """``row, spans, items`` of each hit document: hit word ranges ``[from, to)`` and item ids."""
    sent = index.sparkSession.sparkContext.broadcast(windows)

    def search(batches):
        for seg, _ in segments(batches):
            spans: dict[int, list] = {}
            items: dict[int, set] = {}
            for k, found in seg.phrases(sent.value):
                for doc, at in zip(seg.document(found).tolist(), found.tolist()):
                    at -= int(seg.starts[doc])
                    spans.setdefault(doc, []).append([at, at + sent.value.sizes[k]])
                    items.setdefault(doc, set()).update(sent.value.items[k])
            docs = sorted(spans)
            yield pa.RecordBatch.from_pydict(
                {
                    "row": pa.array([f"{seg.name}-{i}" for i in docs], pa.string()),
                    "spans": pa.array([_joined(spans[i]) for i in docs], pa.list_(pa.list_(pa.int64()))),
                    "items": pa.array([sorted(items[i] - {None}) for i in docs], pa.list_(pa.string())),
                }
            )

    found = materialize(batched(index).mapInArrow(search, "row string, spans array<array<long>>, items array<string>"), "hits")
    sent.destroy()
    return found


def _joined(spans) -> list[list[int]]:
    """The ranges' union, as ranges that neither overlap nor touch."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def search_near(index: DataFrame, queries: list[tuple[str, ...]], span: int, id_col: str = "doc_id") -> DataFrame:
    """``id, query, position`` of places where all terms of a query stand within ``span`` words."""
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    sent = index.sparkSession.sparkContext.broadcast(list(queries))

    def search(batches):
        for seg, ids_type in segments(batches):
            rows = [
                (seg.doc_ids[doc], q, at - int(seg.starts[doc]))
                for q, terms in enumerate(sent.value)
                for found in [seg.near(terms, span)]
                for doc, at in zip(seg.document(found).tolist(), found.tolist())
            ]
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (ids_type, pa.int64(), pa.int64()))], [id_col, "query", "position"])

    return batched(index).mapInArrow(search, f"`{id_col}` {kind}, query long, position long")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``id, n_words, n_hit, n_items, items, items_sha256`` for every document."""
    index = build_index(docs, id_col, text_col)
    found = docs.sparkSession.createDataFrame([], "row string, spans array<array<long>>, items array<string>")
    for windows in window_blocks(items, window, item_col):
        found = found.unionByName(search_windows(index, windows))
    # a document's hits in several blocks
    found = found.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

    def digest(batches):
        for batch in batches:
            listed = [sorted(x) for x in batch.column(2).to_pylist()]
            hit = [sum(b - a for a, b in _joined(x)) for x in batch.column(1).to_pylist()]
            digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in listed]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hit, pa.int64()), pa.array(listed, pa.list_(pa.string())), pa.array(digests, pa.string())], ["_row", "n_hit", "items", "items_sha256"])

    told = materialize(batched(found).mapInArrow(digest, "_row string, n_hit long, items array<string>, items_sha256 string"), "hits")
    each = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "doc_words")).alias("pos", "doc"))
    each = each.select(F.col("doc.doc_ids").alias(id_col), F.col("doc.doc_words").cast("long").alias("n_words"), F.concat_ws("-", "segment", F.col("pos").cast("string")).alias("_at"))
    none = F.array().cast("array<string>")
    return each.join(told, each["_at"] == told["_row"], "left").select(
        id_col, "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"), F.coalesce("items_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("items_sha256"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without a hit, with all their columns."""
    x = free_prefix(docs)
    own, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    key = F.xxhash64(own, text, own.isNull(), text.isNull())
    found = contamination(docs.select(key.alias("key"), text.alias("text")), items, window, "key", "text")
    gone = materialize(found.filter("n_hit > 0").select(F.col("key").alias(f"{x}gone")).distinct(), "contaminated")
    return docs.join(gone, key == F.col(f"`{x}gone`"), "left_anti")


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.drop("items").withColumn("contaminated", F.col("n_hit") > 0)


_TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP9_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({_FOLD}, '{_TERM}') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_FOLD}, '{_TERM}') AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item, array_to_string(ws[i : i + {WINDOW - 1}], ' ') AS g, least(len(ws), {WINDOW}) AS n
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT k, n, i, array_to_string(ws[i : i + n - 1], ' ') AS g
  FROM (SELECT k, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, lens WHERE len(ws) >= n)),
hits AS (SELECT k, i, grams.n, item FROM grams JOIN win USING (n, g)),
words AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT k, i, n FROM hits)) GROUP BY k),
items AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT k, item FROM hits) GROUP BY k)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (k) LEFT JOIN items USING (k)
"""
