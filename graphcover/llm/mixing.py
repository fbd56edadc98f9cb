"""Mix sources to target weights by capped water-filling.

Everything is DataFrame code. A source's share of the budget is its weight's,
clamped where it would need more than ``max_epochs`` passes over the source; the
excess is shared again by weight until no source is above its clamp. Whole
repetitions then go to every document of a source; the remaining words go, as
one more repetition each, to its documents in seeded order. The document at which
they run out gives the fraction that is left, so a source's taken words differ
from its target by rounding only.

The running sum that finds this point never holds a source, or many equal rows, in one
task: equal rows of a task are one row with a count, these fall into hash buckets, the
buckets' sums are added up per source, and rows are ordered inside their bucket only.
There are as many buckets as hold about ``BUCKET_ROWS`` rows each; since they follow the
order itself, their number does not change the result.

Null texts count no words; a null source is a source of its own, last in order, and a
null id is an id. Empty tables give empty results. Rows that repeat are documents of
their own: if the words run out among equal rows, as many of them are taken as fit, which
of them being all the same. Texts of any length count whole. Only the named columns are
read; others may have any name, but ``mix_repetition`` and ``mix_words`` are replaced in
``mixed_documents``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphcover.functions.scratch import materialize
from graphcover.llm.words import WORD, free_prefix

MAX_EPOCHS = 3
SEED = "mix-1"
BUCKET_ROWS = 50_000


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source) -> F.Column:
    """A key that is never null and tells a null source from every other."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def ranked(sources: DataFrame, name: str = "source") -> DataFrame:
    """``rank`` from 1 in code point order, null last, without one task for all rows."""
    spread = sources.repartitionByRange(F.col(name).asc_nulls_last()).withColumn("_part", F.spark_partition_id())
    spread = materialize(spread, "ranked")
    counts = spread.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # a row for each range partition, so this window is as small as the plan's parallelism
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    within = Window.partitionBy("_part").orderBy(F.col(name).asc_nulls_last())
    return (
        spread.withColumn("_row", F.row_number().over(within))
        .join(before, "_part")
        .withColumn("rank", F.col("_before") + F.col("_row"))
        .drop("_part", "_before", "_row")
    )


def water_fill(sources: DataFrame, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Add ``target`` to ``source_size, weight`` rows; the budget is the sum of all sizes.

    Every pass is one aggregate of one row over the sources; a source once clamped
    stays clamped, so the passes end.
    """
    cap = F.lit(float(max_epochs)) * F.col("source_size")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, clamped = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > cap if clamped >= 0 else F.lit(False)
        n, held, free = sources.agg(F.count_if(over), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).first()
        if (n or 0) == clamped or not free:
            break
        clamped, level = n or 0, (total - (held or 0.0)) / free
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def _taken(docs: DataFrame, weights, id_col: str, text_col: str, source_col: str, max_epochs: int, seed: str) -> DataFrame:
    """Equal rows of a task as one row with their number ``_n``: size, order, whole and further words taken, the source's target."""
    sized = materialize(
        docs.select(F.col(id_col).alias("_id"), word_count(F.col(text_col)).alias("size"), F.col(source_col).alias("source"), _order(F.col(id_col), seed).alias("_order"))
        .withColumn("_key", source_key(F.col("source")))
        .withColumn("_part", F.spark_partition_id()),
        "sized",
    )
    sources = sized.groupBy("_key", "source").agg(F.sum("size").alias("source_size"))
    if weights is None:
        sources = ranked(sources).withColumn("weight", 1 + (F.col("rank") - 1) % 3).drop("rank")
    else:
        given = weights.select(source_key(F.col("source")).alias("_key"), F.col("weight").alias("weight"))
        sources = sources.join(given, "_key", "left").fillna(0, ["weight"])
    sources = materialize(sources, "sources")
    quota = F.round("target").cast("long")
    plan = materialize(
        water_fill(sources, max_epochs)
        .withColumn("_whole", F.when(F.col("source_size") > 0, F.least(F.lit(max_epochs), F.floor(quota / F.col("source_size")))).otherwise(0).cast("long"))
        .withColumn("_rest", quota - F.col("_whole") * F.col("source_size"))
        .drop("source", "weight"),
        "targets",
    )
    digits = max(1, math.ceil(math.log(max(sized.count() / BUCKET_ROWS, 1), 16)))
    equal = sized.groupBy("_key", "source", "_order", "_id", "size", "_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_bucket", F.substring("_order", 1, digits))
    equal = materialize(equal.withColumn("_words", F.col("size") * F.col("_n")), "equal")
    sums = equal.groupBy("_key", "_bucket").agg(F.sum("_words").alias("_sum"))
    up_to = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_key", "_bucket", F.coalesce(F.sum("_sum").over(up_to), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_key", "_bucket").orderBy("_order", "_id", "size", "_part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_offset") + F.coalesce(F.sum("_words").over(inside), F.lit(0))
    extra = F.greatest(F.lit(0), F.least(F.col("_words"), F.col("_rest") - F.col("_before")))
    return equal.join(offsets, ["_key", "_bucket"]).withColumn("_before", before).join(plan, "_key").withColumn("_extra", extra.cast("long"))


def _shares(n, size, extra) -> F.Column:
    """What each of ``n`` equal rows of ``size`` words gets of their ``extra`` words: whole rows first."""
    return F.transform(F.sequence(F.lit(1).cast("long"), n), lambda k: F.greatest(F.lit(0).cast("long"), F.least(size, extra - (k - 1) * size)))


def _order(own, seed: str) -> F.Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(own.cast("string"), F.lit(""))))


def mix(
    docs: DataFrame,
    weights: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """``id, size, source, source_size, target, taken`` for every document.

    ``weights`` has ``source, weight``; without it, sources in code point order
    weigh 1, 2, 3, 1, 2, 3 and so on. A source without a weight weighs nothing.
    """
    told = _taken(docs, weights, id_col, text_col, source_col, max_epochs, seed)
    told = told.withColumn("_share", F.explode(_shares(F.col("_n"), F.col("size"), F.col("_extra"))))
    taken = (F.col("_whole") * F.col("size") + F.col("_share")).cast("long").alias("taken")
    return told.select(F.col("_id").alias(id_col), "size", "source", "source_size", "target", taken)


def mixed_documents(
    docs: DataFrame,
    weights: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """The mix itself: a row for each repetition of a document, whole texts with all their columns.

    ``mix_repetition`` counts from 1, ``mix_words`` tells how many of its words the
    repetition gives: all of them but for the one document of a source at which its
    words run out. Documents without words are in no mix. Documents find their
    repetitions by comparing themselves with that document of their source, a row per
    source, so texts are not shuffled; only rows equal to it are counted, by all columns.
    """
    told = _taken(docs, weights, id_col, text_col, source_col, max_epochs, seed)
    last = F.max(F.when(F.col("_extra") > 0, F.struct("_order", "_id", "size")))
    cuts = materialize(told.groupBy("_key").agg(F.first("_whole").alias("_whole"), last.alias("_last")), "cuts")
    at_cut = told.drop("_whole").join(cuts, "_key").filter(F.struct("_order", "_id", "size").eqNullSafe(F.col("_last")))
    given = materialize(at_cut.groupBy(F.col("_key").alias("_cut_key")).agg(F.sum("_extra").alias("_given")), "given")
    x = free_prefix(docs)
    at = lambda name: F.col(f"`{x}{name}`")
    rows = cuts.join(given, cuts["_key"] == given["_cut_key"], "left").select(
        F.col("_key").alias(f"{x}key"), F.col("_whole").alias(f"{x}whole"), F.col("_last._order").alias(f"{x}order"), F.col("_last._id").alias(f"{x}id"), F.col("_last.size").alias(f"{x}size"),
        F.col("_last").isNotNull().alias(f"{x}cut"), "_given",
    ).withColumnRenamed("_given", f"{x}given")
    rows = materialize(rows, "cuts")  # a row per source, whose size Spark then knows
    kept = [c for c in docs.columns if c.lower() not in ("mix_repetition", "mix_words")]
    own = F.col(f"`{id_col}`")
    slim = docs.select(*(F.col(f"`{c}`") for c in kept)).withColumns({f"{x}source": source_key(F.col(f"`{source_col}`")), f"{x}place": _order(own, seed)})
    told = slim.join(rows, at("source") == at("key")).drop(f"{x}key", f"{x}source")
    count = word_count(F.col(f"`{text_col}`"))
    near = at("cut") & at("place").eqNullSafe(at("order")) & own.eqNullSafe(at("id"))  # only such rows' words are counted twice
    mine, cut = F.struct(at("place").alias("a"), own.alias("b"), at("words").alias("c")), F.struct(at("order").alias("a"), at("id").alias("b"), at("size").alias("c"))
    gone = [f"{x}order", f"{x}id", f"{x}size", f"{x}cut", f"{x}place"]
    plain = told.withColumn(f"{x}words", count).filter((at("words") > 0) & ~(near & (at("words") == at("size"))))
    plain = plain.withColumn(f"{x}extra", F.when(at("cut") & (mine < cut), at("words")).otherwise(F.lit(0).cast("long"))).drop(*gone, f"{x}given")
    same = told.filter(near).withColumn(f"{x}words", count).filter((at("words") > 0) & (at("words") == at("size"))).drop(*gone)
    same = same.groupBy(*(F.col(f"`{c}`") for c in same.columns)).agg(F.count(F.lit(1)).alias(f"{x}n"))
    # different rows of one id and size, if there are any, in an order of their own
    turn = Window.partitionBy(at("place_key")).orderBy(at("hash")).rowsBetween(Window.unboundedPreceding, -1)
    texts = [F.col(f"`{c}`").cast("string") for c in kept]
    same = same.withColumns({f"{x}place_key": source_key(F.col(f"`{source_col}`")), f"{x}hash": F.sha2(F.concat_ws("|", *(F.coalesce(F.concat(F.lit("s"), t), F.lit("n")) for t in texts)), 256)})
    left = at("given") - F.coalesce(F.sum(at("n") * at("words")).over(turn), F.lit(0))
    same = same.withColumn(f"{x}left", left).withColumn(f"{x}extra", F.explode(_shares(at("n"), at("words"), at("left"))))
    same = same.drop(f"{x}place_key", f"{x}hash", f"{x}left", f"{x}n", f"{x}given")
    both = plain.unionByName(same)
    times = (at("whole") + F.when(at("extra") > 0, 1).otherwise(0)).cast("int")
    both = both.withColumn(f"{x}times", times).filter(at("times") > 0).withColumn(f"{x}turn", F.explode(F.sequence(F.lit(1), at("times"))))
    words = F.when(at("turn") <= at("whole"), at("words")).otherwise(at("extra")).cast("long")
    return both.select(*(F.col(f"`{c}`") for c in kept), at("turn").alias("mix_repetition"), words.alias("mix_words"))


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).drop("source")


OP4_SQL = rf"""
WITH s AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS BIGINT) AS w
  FROM s GROUP BY source),
run AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap,
         ((SELECT sum(source_size) FROM src) - coalesce(sum(3.0::DOUBLE * source_size) OVER before, 0.0))
           / sum(w) OVER (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM src
  WINDOW before AS (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT lvl FROM run WHERE w * lvl <= cap ORDER BY cap / w, source NULLS LAST LIMIT 1),
plan AS (
  SELECT source, source_size, CASE WHEN w * lvl > cap THEN cap ELSE w * lvl END AS target
  FROM (SELECT source, source_size, w, cap FROM run), level),
quota AS (
  SELECT *, CAST(round(target) AS BIGINT) AS q,
         CASE WHEN source_size > 0 THEN least(3, CAST(round(target) AS BIGINT) // source_size) ELSE 0 END AS whole
  FROM plan),
cum AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('{SEED}:' || doc_id), doc_id, size
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM s)
SELECT c.doc_id, c.size, q.source_size, q.target,
       CAST(whole * c.size + greatest(0, least(c.size, q.q - whole * q.source_size - c.before)) AS BIGINT) AS taken
FROM cum c JOIN quota q ON c.source IS NOT DISTINCT FROM q.source
"""
