"""Quality by perplexity under an interpolated modified Kneser-Ney n-gram model.

The units are characters (code points, none folded), the order is ``ORDER``. Tasks count
the n-grams of the trusted texts they read; the partial counts are shuffled into shards
by n-gram and added up, so the model grows with the corpus and no task or driver holds
it. Every order is a table: n-grams with their probability, histories with the weight
they leave to the next lower order.

Documents are scored by joins with these shards. Neighbouring documents form a chunk of
about ``CHUNK_BYTES``, which asks once for each different n-gram it has; the different
n-grams of all chunks are looked up order by order from the shortest upwards, and the
answers go back to the chunks, packed, where they meet the compressed texts. So what is
shuffled are the chunks' different n-grams and the texts once, not a row per character.
A chunk is known by a digest of its texts; one that lacks an answer is an error.

A document's perplexity is per character. Its language's threshold is a quantile over
the trusted documents of that language that were held out from the counts (one in
``HELD_OUT`` by hash of the id), found exactly from a histogram of perplexities in steps
of ``STEP``; a language without any uses those of all languages.

Defined results: null and empty texts have a null perplexity and are not kept; without
trusted documents every n-gram is as likely as any other, nothing is known to be bad and
all texts with characters are kept; if none is held out, thresholds come from all trusted
ones; a null language is a language of its own; repeated rows are scored alike; a
document labelled twice is trusted if either label says so; a text of any length is
scored whole; equal perplexities are on the same side of the threshold; U+0000 counts as
U+FFFD and U+FDD0 as the edge of a text; empty tables give empty results. Only id, text
and language are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphcover.functions.scratch import materialize, release, sweep
from graphcover.llm.bitset import bitset, passes
from graphcover.llm.words import batched, chunks, text_column

ORDER = 5
QUANTILE = 0.995
STEP = 0.01
HELD_OUT = 8
EDGE = 0xFDD0
CHUNK_BYTES = 32 << 20
PIECE_BYTES = 2 << 20
ANSWERS = 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


# --- n-grams of texts


def sequence(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts with ``ORDER - 1`` edges before and one after each; where each begins, and its n-grams."""
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
    n = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    size = n + ORDER
    start = np.cumsum(size) - size
    inside = np.ones(int(size.sum()), bool)
    for k in range(ORDER - 1):
        inside[start + k] = False
    inside[start + size - 1] = False
    seq = np.full(len(inside), EDGE, np.uint32)
    seq[inside] = np.where(points == 0, 0xFFFD, points)
    return seq, start, n + 1


def coded(seq: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each n-gram inside a text its number among the different ones; those as rows of code points."""
    at = np.arange(int(n.sum())) + np.repeat(start - (np.cumsum(n) - n), n)
    if not len(at):
        return at, np.zeros((0, ORDER), np.uint32)
    place, letters = pd.factorize(seq)
    place, size = place.astype(np.int64), len(letters)
    code = place[at]
    for k in range(1, ORDER):
        if int(code.max(initial=0) + 1) * size >= 1 << 62:  # a large alphabet: number what is there
            code = pd.factorize(code)[0].astype(np.int64)
        code = code * size + place[at + k]
    number, kinds = pd.factorize(code)
    first = np.empty(len(kinds), np.int64)
    first[number[::-1]] = np.arange(len(at) - 1, -1, -1)  # the last write is the first place
    return number, seq[at[first][:, None] + np.arange(ORDER)]


def grams_of(rows: np.ndarray) -> pa.Array:
    """Rows of code points as strings."""
    return pa.array(np.ascontiguousarray(rows, np.uint32).view(f"<U{ORDER}").ravel(), pa.string())


def digests(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of code points."""
    out = np.zeros(len(rows), np.uint64)
    for k in range(ORDER):
        out = (out ^ rows[:, k].astype(np.uint64)) * _MIX
        out ^= out >> np.uint64(29)
    return out


def count_ngrams(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """``gram, n``: how often each n-gram occurs."""

    def run(batches):
        for batch in batches:
            column = text_column(batch.column(0))
            column = column.filter(pc.greater(pc.binary_length(column), 0))
            for a, b in chunks(column, PIECE_BYTES):
                number, rows = coded(*sequence(column.slice(a, b - a)))
                yield pa.RecordBatch.from_arrays([grams_of(rows), pa.array(np.bincount(number, minlength=len(rows)))], ["gram", "n"])

    return batched(texts.select(text_col)).mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


# --- the model


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from how many n-grams occur 1 to 4 times."""
    n1, n2, n3, n4 = (max(x, 1) for x in (n1, n2, n3, n4))
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.01), k - 0.01) for k, d in enumerate(found, 1))


class Model:
    """``grams[k]`` has ``gram, p`` of order ``k``, ``weights[k]`` ``history, weight``; ``floor`` is the probability of an unknown character.

    ``counts`` is a written table, which goes with the other steps of the model as soon as nothing reads it.
    """

    def __init__(self, counts: DataFrame):
        of = {ORDER: counts}
        for k in range(ORDER - 1, 0, -1):  # lower orders count the different characters seen before
            of[k] = materialize(of[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count(F.lit(1)).alias("n")), "ngrams")
        self.grams, self.weights, self.floor = {}, {}, 1.0
        self._sums = {}
        for k in range(1, ORDER + 1):
            row = of[k].agg(F.count(F.lit(1)), F.sum("n"), *(F.count_if(F.col("n") == c) for c in (1, 2, 3, 4)), F.count_if(F.col("n") >= 3)).first()
            d = discounts(*row[2:6])
            less = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
            if k == 1:
                total = max(row[1] or 0, 1)
                left = (d[0] * row[2] + d[1] * row[3] + d[2] * row[6]) / total if row[0] else 1.0
                self.floor = left / (row[0] + 1)
                self.grams[1] = materialize(of[1].select("gram", ((F.col("n") - less) / total + F.lit(self.floor)).alias("p")), "model")
                continue
            history = F.substring("gram", 1, k - 1).alias("history")
            sums = of[k].groupBy(history).agg(F.sum("n").alias("total"), F.sum(less).alias("left"))
            sums = materialize(sums.select("history", "total", (F.col("left") / F.col("total")).alias("weight")), "histories")
            lower = self.grams[k - 1].select(F.col("gram").alias("suffix"), F.col("p").alias("lower"))
            own = of[k].withColumn("history", history).withColumn("suffix", F.substring("gram", 2, k - 1)).join(sums, "history").join(lower, "suffix")
            self.grams[k] = materialize(own.select("gram", ((F.col("n") - less) / F.col("total") + F.col("weight") * F.col("lower")).alias("p")), "model")
            self.weights[k], self._sums[k] = sums.select("history", "weight"), sums
        release(*of.values())

    def release(self) -> None:
        """Delete the model's tables."""
        release(*self.grams.values(), *self._sums.values())

    def look_up(self, grams: DataFrame) -> DataFrame:
        """``gram, p`` of different n-grams of order ``ORDER``, seen or not."""
        asked = {ORDER: grams}
        for k in range(ORDER - 1, 0, -1):
            asked[k] = materialize(asked[k + 1].select(F.substring("gram", 2, k).alias("gram")).distinct(), "asked")
        found = asked[1].join(self.grams[1], "gram", "left").select("gram", F.coalesce("p", F.lit(self.floor)).alias("p"))
        for k in range(2, ORDER + 1):
            answers = materialize(found, "answers")
            if k > 2:
                release(before, asked[k - 2])
            before, lower = answers, answers.select(F.col("gram").alias("suffix"), F.col("p").alias("lower"))
            parts = asked[k].withColumn("history", F.substring("gram", 1, k - 1)).withColumn("suffix", F.substring("gram", 2, k - 1))
            joined = parts.join(self.grams[k], "gram", "left").join(self.weights[k], "history", "left").join(lower, "suffix")
            found = joined.select("gram", F.coalesce("p", F.coalesce("weight", F.lit(1.0)) * F.col("lower")).alias("p"))
        return found


# --- scoring


def _chunked(batches):
    """``digest, batches`` of each chunk of neighbouring documents (id, language, text)."""
    held, size, mark = [], 0, xxhash.xxh64()
    for batch in batches:
        texts = text_column(batch.column(2))
        for a, b in chunks(texts, PIECE_BYTES):
            piece = pa.concat_arrays([texts.slice(a, b - a)])
            raw = "".join(piece.to_pylist()).encode()
            ends = pc.binary_length(piece)
            mark.update(raw)
            mark.update(ends.to_numpy(zero_copy_only=False).tobytes())
            held.append((batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), ends, len(raw), pa.compress(raw, "zstd", asbytes=True)))
            size += len(raw)
            if size >= CHUNK_BYTES:
                yield np.uint64(mark.intdigest()).view(np.int64), held
                held, size, mark = [], 0, xxhash.xxh64()
    if held:
        yield np.uint64(mark.intdigest()).view(np.int64), held


def _texts(ends: pa.Array, size: int, packed: bytes) -> pa.Array:
    raw = pa.decompress(packed, size, "zstd") if size else b""
    offsets = np.concatenate(([0], np.cumsum(ends.to_numpy(zero_copy_only=False)))).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)])


def requests(slim: DataFrame) -> DataFrame:
    """``chunk, gram``: the different n-grams of each chunk."""

    def run(batches):
        for chunk, pieces in _chunked(batches):
            seen = np.zeros(0, np.uint64)
            for _, _, ends, size, packed in pieces:
                _, rows = coded(*sequence(_texts(ends, size, packed)))
                own = digests(rows)
                new = ~np.isin(own, seen)
                seen = np.concatenate([seen, own[new]])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(new.sum()), chunk)), grams_of(rows[new])], ["chunk", "gram"])

    return batched(slim).mapInArrow(run, "chunk long, gram string")


def _packed_answers(asked: DataFrame, found: DataFrame) -> DataFrame:
    """``chunk, size, grams, logs``: each task's answers to a chunk, some rows packed as one."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= ANSWERS:
                yield from packs(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield from packs(pa.Table.from_batches(held))

    def packs(table):
        chunk = table["chunk"].to_numpy()
        order = np.argsort(chunk, kind="stable")
        rows = []
        for own in np.split(order, np.flatnonzero(np.diff(chunk[order])) + 1):
            if len(own):
                grams = "".join(table["gram"].take(pa.array(own)).to_pylist()).encode()
                logs = np.log2(table["p"].to_numpy()[own]).astype(np.float32).tobytes()
                rows.append((chunk[own[0]], len(grams), pa.compress(grams, "zstd", asbytes=True), logs))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["chunk", "size", "grams", "logs"])

    return asked.join(found, "gram").select("chunk", "gram", "p").mapInArrow(run, "chunk long, size long, grams binary, logs binary")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id, lang, perplexity`` of every document."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    asked = materialize(requests(slim), "requests")
    different = materialize(asked.select("gram").distinct(), "asked")
    sweep(docs.sparkSession)
    found = materialize(model.look_up(different), "answers")
    model.release()
    release(different)
    sweep(docs.sparkSession)
    answers = materialize(batched(_packed_answers(asked, found)), "packed")
    release(asked, found)
    sweep(docs.sparkSession)

    def pack(batches):
        for chunk, pieces in _chunked(batches):
            for ids, langs, ends, size, packed in pieces:
                ids, langs, ends = (pa.array([x.to_pylist()], pa.list_(x.type)) for x in (ids, langs, ends.cast(pa.int32())))
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), ids, langs, ends, pa.array([size], pa.int64()), pa.array([packed], pa.binary())], ["chunk", "ids", "langs", "ends", "size", "packed"])

    pieces = batched(slim).mapInArrow(pack, f"chunk long, ids array<{kind}>, langs array<string>, ends array<int>, size long, packed binary")

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = [np.frombuffer(pa.decompress(g, n, "zstd", asbytes=True).decode().encode("utf-32-le"), np.uint32).reshape(-1, ORDER) for n, g in zip(right["size"].to_pylist(), right["grams"].to_pylist())]
        known = digests(np.concatenate(rows)) if rows else np.zeros(0, np.uint64)
        logs = np.concatenate([np.frombuffer(x, np.float32) for x in right["logs"].to_pylist()]) if rows else np.zeros(0, np.float32)
        known, first = np.unique(known, return_index=True)
        logs = logs[first].astype(np.float64)
        ids, langs, out = [], [], []
        for row in range(left.num_rows):
            ends = left["ends"][row].values
            texts = _texts(ends, left["size"][row].as_py(), left["packed"][row].as_py())
            seq, start, n = sequence(texts)
            number, own = coded(seq, start, n)
            own = digests(own)
            at = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
            if len(own) and (not len(known) or (known[at] != own).any()):
                raise RuntimeError("n-grams of a chunk have no answer: the documents changed between two reads")
            upto = np.concatenate(([0.0], np.cumsum(logs[at][number]))) if len(own) else np.zeros(1)
            end = np.cumsum(n)
            found = np.where(n > 1, 2.0 ** (-(upto[end] - upto[end - n]) / n), np.nan)
            ids.append(left["ids"][row].values)
            langs.append(left["langs"][row].values)
            out.append(pa.array(found, from_pandas=True))
        return pa.table([pa.chunked_array(ids, left["ids"].type.value_type), pa.chunked_array(langs, pa.string()), pa.chunked_array(out, pa.float64())], ["id", "lang", "perplexity"])

    return pieces.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(answer, f"id {kind}, lang string, perplexity double")


def thresholds(scored: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """``lang, most``: the steps of perplexity up to which a language's documents are kept; a null key is for all.

    ``scored`` has ``lang`` (never null) and ``steps``. Counts of equal steps come
    first, so the windows hold a few thousand rows for each language.
    """
    counts = scored.filter("steps IS NOT NULL").groupBy("lang", "steps").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.unionByName(counts.groupBy("steps").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "steps", "n"))
    upto = Window.partitionBy("lang").orderBy("steps")
    shares = counts.withColumn("below", F.sum("n").over(upto) / F.sum("n").over(Window.partitionBy("lang")))
    return shares.filter(F.col("below") >= quantile).groupBy("lang").agg(F.min("steps").alias("most"))


def _trusted_texts(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts whose id is trusted. Ids are as many as trusted documents, so they are joined, not sent along;
    a bitset of their hashes goes ahead and spares other texts the shuffle."""
    key = lambda c: F.xxhash64(F.col(c).cast("string"))
    bits = texts.sparkSession.sparkContext.broadcast(bitset(ids.select(key("_trusted").alias("id"))))

    def likely(batches):
        for batch in batches:
            yield batch.filter(pa.array(passes(bits.value, batch.column(2).to_numpy(zero_copy_only=False)))).select([0, 1])

    kind = texts.schema["_id"].dataType.simpleString()
    keyed = batched(texts.filter(F.col("_id").isNotNull()).withColumn("_key", key("_id")))
    found = keyed.mapInArrow(likely, f"_id {kind}, _text string")
    return found.join(ids.hint("merge"), found["_id"] == ids["_trusted"], "left_semi")


def held_out(ids) -> F.Column:
    return F.pmod(F.xxhash64(ids.cast("string")), F.lit(HELD_OUT)) == 0


def classify(
    docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE
) -> DataFrame:
    """``id, perplexity, threshold, kept`` for every document; ``trusted_ids`` has the ids of trusted text."""
    ids = materialize(trusted_ids.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_trusted")).distinct(), "trusted")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    counts = materialize(count_ngrams(_trusted_texts(texts, ids.filter(~held_out(F.col("_trusted")))), "_text"), "counts")
    sweep(docs.sparkSession)
    model = Model(counts)
    sweep(docs.sparkSession)
    scored = score(docs, model, id_col, text_col, lang_col)
    lang = F.coalesce(F.concat(F.lit("l"), F.col("lang")), F.lit("n"))
    scored = materialize(scored.select("id", lang.alias("lang"), "perplexity", F.ceil(F.col("perplexity") / STEP).alias("steps")), "perplexities")
    trusted = scored.join(ids, scored["id"] == ids["_trusted"], "left_semi").select("lang", "steps", held_out(F.col("id")).alias("out"))
    trusted = materialize(trusted, "trusted-steps")
    most = materialize(thresholds(trusted.filter("out"), quantile), "thresholds")
    overall = most.filter("lang IS NULL").agg(F.max("most")).first()[0]
    if overall is None:
        most = materialize(thresholds(trusted, quantile), "thresholds")
        overall = most.filter("lang IS NULL").agg(F.max("most")).first()[0]
    limit = F.coalesce(F.col("most"), F.lit(overall).cast("long"))
    most = most.withColumnRenamed("lang", "_lang")
    return scored.join(most, scored["lang"] == most["_lang"], "left").select(
        F.col("id").alias(id_col), "perplexity", (limit * STEP).alias("threshold"), F.coalesce(F.col("steps") <= F.coalesce(limit, F.col("steps")), F.lit(False)).alias("kept")
    )


def op5_perplexity(spark, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels.filter("quality = 1").select("doc_id"))
