"""Words of Arrow text columns, split without a Python object per word.

A word is a run of characters other than blank and ``\\t\\n\\v\\f\\r``; the folded
form first lower-cases A-Z, the alphanumeric form also turns every other ASCII
character but digits and letters into a blank. The mappings replace one byte by
one byte, so the offsets of the column stay as they are.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: A word of white-space separated text, for Spark and DuckDB alike.
WORD = r"[^\x20\x09-\x0D]+"

_ASCII = bytes(range(256))
FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in _ASCII)
ALNUM = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in FOLD)

#: Texts handled together: at most so many bytes, one text at least.
CHUNK_BYTES = 4 << 20


#: Bytes of an Arrow batch on its way to Python, so that a worker's memory does not follow its partition's size.
BATCH_BYTES = 8 << 20


def batched(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches held to ``BATCH_BYTES``; a longer text is a batch of its own."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    size = re.fullmatch(r"(\d+)([bkmg]?)b?", (conf.get(name, None) or "").lower())
    if not size or not 0 < int(size[1]) * 1024 ** "bkmg".index(size[2] or "b") <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def free_prefix(df: DataFrame, wanted: str = "_") -> str:
    """A beginning that no column of ``df`` has, for columns added to the caller's own."""
    names = [c.lower() for c in df.columns]
    while any(c.startswith(wanted) for c in names):
        wanted += "_"
    return wanted


def text_column(column) -> pa.Array:
    """A column as one string array in which null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    return pc.fill_null(column, pa.scalar("", pa.large_string()))


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES):
    """``(from, to)`` of neighbouring texts of together about ``limit`` bytes."""
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    block = (np.cumsum(size) - size) // limit
    edges = np.flatnonzero(np.diff(block)) + 1
    bounds = [0, *edges.tolist(), len(texts)]
    yield from ((a, b) for a, b in zip(bounds, bounds[1:]) if b > a)
    pa.default_memory_pool().release_unused()


def mapped(texts: pa.Array, table: bytes) -> pa.Array:
    """The texts with each byte replaced by ``table``."""
    texts = pa.concat_arrays([texts])  # offset zero
    _, offsets, data = texts.buffers()
    data = (data.to_pybytes() if data else b"").translate(table)
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, pa.py_buffer(data)], 0, texts.offset)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and ``len(texts) + 1`` offsets into them."""
    lists = pc.ascii_split_whitespace(texts)
    words, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    if not full.all():
        before = np.concatenate(([0], np.cumsum(full)))
        words, offsets = words.filter(pa.array(full)), before[offsets]
    return words, offsets
