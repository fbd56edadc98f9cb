"""The pipeline's stages on a small corpus with planted cases, and on awkward rows."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphcover.llm import linededup, simhash

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "ru", "sa", "ti", "vo") for b in ("ban", "der", "fil", "gos", "hum", "jor", "kel", "")]


def line(rng, n=14):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    at = tmp_path_factory.mktemp("corpus")
    docs = {i: [line(rng) for _ in range(4)] for i in range(120)}
    items = [line(rng, 12) for _ in range(3)]
    toxic = set(range(0, 120, 6))
    for i in toxic:
        docs[i][1] += " moron scum idiot"
    docs[7] = list(docs[5])  # an exact copy
    docs[11][2] = docs[9][2]  # a repeated line
    docs[13][2] = docs[9][2][:-1] + "#"  # a near copy of it
    docs[17][3] = "start " + items[0].upper() + " end"
    rows = [(i, "\n".join(x), "en", f"s{i % 3}", 0) for i, x in docs.items()]
    rows += [(200, None, None, None, None), (201, "", "en", "s1", 0), (202, "tiny", "en", None, 4), (203, line(rng, 9000), "de", "s2", 0), rows[8]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit("clash")).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in docs], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), docs, toxic


def test_stages(spark, corpus):
    at, docs, toxic = corpus
    df = spark.read.parquet(f"{at}/documents.parquet")
    columns = df.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line dedup", "simhash near-dedup", "benchmark decontamination", "mixing sources"]
    kept = stages["toxicity"](spark, df, at)
    assert kept.columns == columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in df.collect()} - toxic
    lines = stages["line dedup"](spark, kept, at)
    text = {r["doc_id"]: r for r in lines.collect()}
    assert lines.columns == columns and set(text) == {r["doc_id"] for r in kept.collect()}
    assert text[7]["text"] == "" and text[200]["text"] is None and text[202]["text"] == "tiny"
    assert docs[9][2] in text[9]["text"] and text[11]["text"].split("\n") == docs[11][:2] + docs[11][3:] and text[13]["text"].split("\n") == docs[13][:2] + docs[13][3:]
    assert text[11]["n_chars"] == len(text[11]["text"]) and text[1]["text"] == "\n".join(docs[1])
    near = stages["simhash near-dedup"](spark, kept, at)
    ids = [r["doc_id"] for r in near.collect()]
    assert near.columns == columns and len(ids) == len(set(ids)) and 5 in ids and 7 not in ids and 200 in ids and 201 not in ids
    assert set(ids) == {r["doc_id"] for r in kept.collect()} - {7, 201}
    clean = stages["benchmark decontamination"](spark, kept, at)
    assert clean.columns == columns and {r["doc_id"] for r in kept.collect()} - {r["doc_id"] for r in clean.collect()} == {17}
    mixed = stages["mixing sources"](spark, clean, at)
    plan, got = Counter(), Counter()
    for r in corpus_pipeline.mixing.mix(clean).collect():
        plan[r["doc_id"]] += r["taken"]
    for r in mixed.collect():
        got[r["doc_id"]] += r["mix_words"]
        assert r["mix_words"] <= len(re.findall(r"\S+", r["text"] or ""))
    assert got == +plan
    assert mixed.columns == [*columns, "mix_repetition", "mix_words"]


def test_near_dedup_keeps_one_of_each_simhash_component(spark, corpus):
    """A line repeated sets the fingerprint, the words after it the Jaccard similarity."""
    at, _, _ = corpus
    rng = random.Random(4)
    rows = [(i, "\n".join([line(random.Random(i // 3), 15)] * 90) + " " + line(rng, 40)) for i in range(12)] + [(20, line(rng, 60)), (21, None), (22, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    component = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert set(component.values()) == {0, 3, 6, 9, 20, 21}
    assert {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["simhash near-dedup"](spark, df, at).collect()} == set(component.values())


@pytest.mark.parametrize("copies", [1, 2, 7])
def test_mix_of_repeated_rows_and_clashing_names(spark, copies):
    """Totals by id and source equal the plan's, wherever the words run out."""
    rng = random.Random(copies)
    rows = []
    for i in range(40):
        own = (i if i % 9 else None, line(rng, rng.randrange(0, 9)), f"s{i % 4}" if i % 4 else None)
        rows += [own] * rng.randrange(1, copies + 1)
    rows += [(3, line(rng, 5), "s3"), (3, line(rng, 5), "s3"), (50, None, "s1")]  # one id, two texts
    names = ("_last", "_whole", "_size", "_n", "_extra", "_key", "_order", "__words", "_id", "size", "target", "mix_words", "Mix_Repetition")
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("clash") for c in names}).repartition(3)
    plan, got, size = Counter(), Counter(), Counter()
    planned = corpus_pipeline.mixing.mix(df).collect()
    assert len(planned) == len(rows)
    for r in planned:
        plan[r["doc_id"], r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
    mixed = corpus_pipeline.mixing.mixed_documents(df)
    assert mixed.columns == [c for c in df.columns if c.lower() not in ("mix_words", "mix_repetition")] + ["mix_repetition", "mix_words"]
    for r in mixed.collect():
        assert r["_size"] == r["_n"] == r["__words"] == "clash"
        got[r["doc_id"], r["source"]] += r["mix_words"]
    assert got == +plan and sum(size.values()) - 3 < sum(got.values()) < sum(size.values()) + 3


def test_dropping_lines_keeps_clashing_columns(spark):
    rows = [(1, "a line of more than thirty-two characters\nx", 0), (2, "a line of more than thirty-two characters\ny", 0), (None, "a line of more than thirty-two characters", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumns({c: F.lit("clash") for c in ("_gone", "_gone_id", "_id", "removed_lines", "id", "line_no", "__gone")})
    out = linededup.drop_lines(df, linededup.repeated_lines(df))
    assert out.columns == df.columns
    assert {r["doc_id"]: (r["text"], r["_gone"], r["__gone"]) for r in out.collect()} == {1: ("x", "clash", "clash"), 2: ("y", "clash", "clash"), None: (rows[0][1][:-2], "clash", "clash")}


def test_run_is_the_stages_in_turn(spark, corpus):
    at, _, toxic = corpus
    rows = corpus_pipeline.run(spark, at).collect()
    assert rows and not {r["doc_id"] for r in rows} & (toxic | {7, 17})
    again = corpus_pipeline.run(spark, at).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_empty_tables(spark, corpus):
    at, _, _ = corpus
    none = spark.read.parquet(f"{at}/documents.parquet").filter("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, at).count() == 0


def test_repeats_of_one_document_stay(spark, corpus):
    at, _, _ = corpus
    rows = spark.read.parquet(f"{at}/documents.parquet").filter("doc_id = 8")
    assert rows.count() == 2
    assert [r["removed_lines"] for r in linededup.repeated_lines(rows).collect()] == [[]]
