"""A corpus pipeline of five stages over ``documents``.

Each stage is one operator; its result is written as Parquet and read again as the
next one's documents. Stages but the last return the columns they are given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphcover.functions.scratch import materialize
from graphcover.llm import decontam, linededup, mixing, neardup, simhash, toxicity

#: Words of a shingle in the sets that the near-duplicate stage compares; its fingerprints have ``simhash.SHINGLE``.
SHINGLE = 5


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score ``toxicity.REJECT`` or more go."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def repeated_lines_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line equals or nearly equals go; every document stays."""
    return linededup.drop_lines(docs, linededup.repeated_lines(docs, short=True))


def one_of_each_group_stays(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays.

    Links are those of ``op3_simhash`` and, besides, texts ``neardup.LEAST`` similar or more.
    """
    return neardup.drop_near_copies(docs, shingle=SHINGLE, radius=simhash.RADIUS)


def benchmark_passages_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sources_are_mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each repetition of a document that the target weights call for."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("toxicity", toxic_documents_go),
    ("line dedup", repeated_lines_go),
    ("simhash near-dedup", one_of_each_group_stays),
    ("benchmark decontamination", benchmark_passages_go),
    ("mixing sources", sources_are_mixed),
]

#: Boosted trees and edit joins have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
