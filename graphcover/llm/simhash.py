"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most ``radius`` bits apart have a point between them that is at
most half the radius from either. So every distinct fingerprint emits all variants
within half the radius, variants are the shuffle key, and the fingerprints that meet
in one are candidates. At most one ball of fingerprints can meet in a variant (65 for
radius 2), whatever the data, so no bucket can grow.

Fingerprints that meet are all within the radius of each other, hence a chain through
a variant's fingerprints connects what all its pairs would: the window emits links
between neighbours only, which are then deduplicated and verified. Exact copies are
one fingerprint from the start and are never paired.

Null and empty texts have fingerprint zero and are linked like any other; a text with
fewer words than a shingle is one shingle; repeated rows share a component; rows with
a null id take part through their fingerprint's other rows and else stay alone with a
null component; empty tables give empty results; texts of any length count whole, some
shingles at a time. Only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphcover.functions.scratch import materialize
from graphcover.llm.words import batched, chunks, FOLD, mapped, split_words, text_column
from graphcover.operators.components import linked_components

RADIUS = 2
SHINGLE = 3
SEED = 42


def _majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints_of(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """One unsigned 64-bit fingerprint per text."""
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    for a, b in chunks(texts, 4 << 20):
        words, offsets = split_words(mapped(texts.slice(a, b - a), FOLD))
        n = len(words) - shingle + 1
        joined = pc.binary_join_element_wise(*(words.slice(k, n) for k in range(shingle)), pa.scalar(" ", pa.large_string())) if n > 0 else pa.array([], pa.large_string())
        hashes = np.fromiter((digest(x, SEED) for x in joined.cast(pa.large_binary()).to_pylist()), np.uint64, max(n, 0))
        for i in range(b - a):
            low, high = int(offsets[i]), int(offsets[i + 1])
            if high - low >= shingle:
                out[a + i] = _majority(hashes[low : high - shingle + 1])
            elif high > low:
                out[a + i] = digest(" ".join(words.slice(low, high - low).to_pylist()).encode(), SEED)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``id, fp``: the fingerprint as a signed long."""
    slim = docs.select(id_col, text_col)
    kind = slim.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = fingerprints_of(text_column(batch.column(1)), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], [id_col, "fp"])

    return batched(slim).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def ball(half: int) -> list[int]:
    """Signed masks of all words with at most ``half`` bits."""
    masks = [sum(1 << b for b in c) for k in range(half + 1) for c in combinations(range(64), k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(marked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``src, dst`` between representatives of fingerprints at most ``radius`` bits apart.

    ``marked`` has distinct ``fp`` with its representative ``rep``. Links connect what
    the pairs within the radius connect; pairs that a chain already joins are left out.
    """
    if radius % 2:
        raise ValueError("an even radius has a middle")
    masks = F.array(*map(F.lit, ball(radius // 2)))
    variants = marked.select("fp", "rep", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    at = Window.partitionBy("variant").orderBy("fp")
    chained = variants.select("fp", "rep", F.lag("fp").over(at).alias("near"), F.lag("rep").over(at).alias("src"))
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("near"))) <= radius
    return chained.filter(F.col("near").isNotNull() & close).select("src", F.col("rep").alias("dst")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``id, fp, component_id``: the smallest id that links lead to, one row per document."""
    marked = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    reps = materialize(marked.groupBy("fp").agg(F.min(id_col).alias("rep")), "representatives")
    joined = linked_components(links(reps.filter("rep IS NOT NULL"), radius))
    classes = reps.join(joined, reps["rep"] == joined["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    # written first, so that the join is one of two plain shuffles, whose hot fingerprints Spark can split
    return marked.join(materialize(classes, "classes"), "fp").select(id_col, "fp", "component_id")


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
