"""Quality rules as a bitmask ledger.

``ledger`` evaluates every rule once and stores, for each document, the measurements
and one failure bit per rule. A policy is a named mask over those bits, so policies
can change, and be compared, without a text being read again: ``apply_policy`` is one
bitwise AND, and ``ablations`` aggregates the distinct masks (2^rules rows at most)
to tell what each rule rejects and what would be kept without it.

Words are runs of characters other than blank and ``\\t\\n\\v\\f\\r``. Null and empty
texts have no words and fail ``min_words``; whole texts are measured whatever their
length; repeated rows give repeated results; empty tables give empty ledgers. Only
the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphcover.llm.words import batched, chunks, split_words, text_column, WORD

#: Bit numbers never change: stored ledgers stay readable when rules are added.
RULES = {
    "min_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "max_words": "n_words > 100000",
    "mean_word_short": "word_chars < 2 * n_words",
    "mean_word_long": "word_chars > 15 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "100 * n_dup_lines > 30 * n_lines",
    "capitals": "2 * n_capitals > n_letters",
}
BITS = {name: 1 << i for i, name in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BITS[r] for r in self.rules)


BASE = Policy("base", 1, ("min_words", "repeated_windows"))
#: Repeated lines alone reject nothing here: line dedup is what takes them out.
STANDARD = Policy("standard", 1, tuple(r for r in RULES if r != "duplicate_lines"))
STRICT = Policy("strict", 1, tuple(RULES))

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_letters"]
SYMBOLS = b"#*$%&|<>"
BLANK = b" \t\n\x0b\x0c\r"


def _repeat_words(ids: np.ndarray) -> int:
    """Words inside 3-word windows that the text has twice or more."""
    if len(ids) < 3:
        return 0
    base = int(ids.max()) + 1
    code = ids[:-2] * base + ids[1:-1]
    if base >= 1 << 21:  # three ids would not fit in 63 bits
        code = np.unique(code, return_inverse=True)[1]
    code = code * base + ids[2:]
    order = np.argsort(code, kind="stable")
    same = np.diff(code[order]) == 0
    twice = np.zeros(len(code), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : k + len(code)] |= twice
    return int(covered.sum())


def _measure(texts: pa.Array) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {m: [] for m in MEASURES}
    for a, b in chunks(texts):
        part = texts.slice(a, b - a)
        words, offsets = split_words(part)
        ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n = np.diff(offsets)
        for i, text in enumerate(part.to_pylist()):
            raw = text.encode()
            own = ids[offsets[i] : offsets[i + 1]]
            lines = [x for x in raw.split(b"\n") if x.strip()]
            at = np.frombuffer(raw, np.uint8)
            capitals = int(((at >= 65) & (at <= 90)).sum())
            small = int(((at >= 97) & (at <= 122)).sum())
            _, own = np.unique(own, return_inverse=True) if len(own) else (None, own)
            row = (
                int(n[i]), len(text) - (len(raw) - len(raw.translate(None, BLANK))), len(raw) - len(raw.translate(None, SYMBOLS)),
                len(lines) - len(set(lines)), _repeat_words(own), len(lines), capitals, capitals + small,
            )
            for m, v in zip(MEASURES, row):
                out[m].append(v)
    return out


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, measurements, fail_bits``: every rule evaluated once for every document."""
    slim = docs.select(id_col, text_col)
    kind = slim.schema[id_col].dataType.simpleString()

    def measure(batches):
        for batch in batches:
            found = _measure(text_column(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[m], pa.int64()) for m in MEASURES)], [id_col, *MEASURES])

    measured = batched(slim).mapInArrow(measure, f"`{id_col}` {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = " + ".join(f"IF({rule}, {BITS[name]}L, 0L)" for name, rule in RULES.items())
    return measured.withColumn("fail_bits", F.expr(bits))


def apply_policy(entries: DataFrame, policy: Policy, into: str = "kept") -> DataFrame:
    return entries.withColumn(into, F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0)


def ablations(entries: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of a policy: ``rule, failed, failed_alone, kept, kept_without, n_docs``.

    Documents first become counts of distinct masks, so this reads a few rows for
    each rule however many documents there are.
    """
    masks = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("mask")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(BITS[r]).alias("bit")) for r in policy.rules)))
    each = masks.select("mask", "n", rules.alias("r")).select("mask", "n", "r.rule", F.col("r.bit").cast("long").alias("bit"))
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy("rule").agg(
        n(F.col("mask").bitwiseAND(F.col("bit")) != 0).alias("failed"),
        n(F.col("mask") == F.col("bit")).alias("failed_alone"),
        n(F.col("mask") == 0).alias("kept"),
        n((F.col("mask") == 0) | (F.col("mask") == F.col("bit"))).alias("kept_without"),
        F.sum("n").alias("n_docs"),
    )


def op1_quality(spark, sf_dir: str) -> DataFrame:
    entries = ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    judged = apply_policy(apply_policy(entries, STANDARD), BASE, "_base_ok")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("_base_ok")).alias("base_failed"), "kept", "fail_bits"
    )


_SQL_BITS = " + ".join(f"CASE WHEN {rule} THEN {BITS[name]} ELSE 0 END" for name, rule in RULES.items())
OP1_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, doc_id, text, regexp_extract_all(text, '{WORD}') AS ws, string_split(text, chr(10)) AS ls FROM d),
tok AS (
  SELECT k, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM tok) WHERE n > 1),
cov AS (SELECT k, count(DISTINCT i + o) AS n FROM rep, (VALUES (0), (1), (2)) AS x(o) GROUP BY k),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(list_filter(ls, lambda x: regexp_matches(x, '{WORD}'))) AS BIGINT) AS n_lines,
         CAST(len(list_filter(ls, lambda x: regexp_matches(x, '{WORD}'))) - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '{WORD}')))) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals,
         length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters
  FROM w LEFT JOIN cov USING (k)),
b AS (SELECT *, CAST({_SQL_BITS} AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & {BASE.mask}) <> 0 AS base_failed, (fail_bits & {STANDARD.mask}) = 0 AS kept, fail_bits
FROM b
"""
