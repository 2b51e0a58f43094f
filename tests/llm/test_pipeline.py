"""The queries of the package against their SQL, and the stages of the pipeline on rows with all kinds of faults."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bagsieve.llm import queries, secrets

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def _key(row):
    return tuple(f"{x:.6f}" if isinstance(x, float) else str(x) for x in row)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, want = queries.queries()[name](spark, SF), duck.sql(queries.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(_key, got.select(columns).collect())) == sorted(map(_key, want.select(*columns).fetchall()))


@pytest.mark.parametrize("name", ["op1_language_id", "op5_fingerprints", "op8_suffix_dedup", "op9_pii", "op10_secrets"])
def test_query_gives_a_row_for_each_document(spark, name):
    rows = queries.queries()[name](spark, SF).select("doc_id").collect()
    assert sorted(r[0] for r in rows) == sorted(r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())


@pytest.fixture(scope="module")
def faulty(spark):
    """Documents of sf0.001 with nulls in every column, empty, repeated and long rows, and columns of clashing names."""
    own = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").orderBy("doc_id").limit(60).collect()
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("text IS NOT NULL").orderBy("item_id").first().text
    rng = random.Random(4)
    text = "the and of to a in is it that was for on are as with his they at be this ".split()
    prose = " ".join(rng.choice(text) + rng.choice("abcde") for _ in range(300))
    rows = [tuple(r) for r in own] + [tuple(own[3]), (None, own[4].text, None, None, None), (None, None, None, None, None), (9001, "", "en", "s", 0), (9002, None, "en", "s", None)]
    rows += [(9003, own[5].text + " " + item, "en", None, 5), (9004, " ".join(rng.sample(own[6].text.split(), len(own[6].text.split()))) + '\npassword = "hunter2hunter2!"\n', "en", "s", 9), (9005, prose * 300, "en", "s", 9), (9006, own[7].text + " oneword", "en", "s", 9)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in ("key", "size", "copy", "rep", "_other", "_bad", "hits", "taken_", "row", "_lang", "_id", "_url", "entry", "meta.url"):
        frame = frame.withColumn(name, F.lit("own"))
    return frame.withColumn("tags", F.create_map(F.lit("k"), F.lit("v"))).repartition(3)


def test_stages(spark, faulty):
    seen, docs, columns = {}, faulty, faulty.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.written(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns and docs.count() <= before.count()
        seen[name] = docs.collect()
    ids = {name: [r.doc_id for r in rows] for name, rows in seen.items()}
    assert 9001 not in ids["language_id"] and 9002 not in ids["language_id"] and {9003, 9004, 9006} <= set(ids["language_id"])
    assert 9006 not in ids["ngram_join"] and 9003 not in ids["decontaminate"] and None in ids["decontaminate"]
    before, after = ({r.doc_id: r.text for r in seen[x]} for x in ("decontaminate", "secrets"))
    assert after == {k: secrets.redacted(t) for k, t in before.items()} and "hunter2hunter2!" not in after[9004]
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    total = mixed.groupBy("source").agg(F.sum("size").alias("taken"), F.max("target").alias("target"), F.max("size").alias("most")).collect()
    assert total and all(abs(r.taken - r.target) <= 0.25 * r.target + 2 * r.most for r in total)


def test_stages_of_empty_tables(spark, faulty):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, faulty.where("false"), SF).count() == 0


def test_pipeline_equals_its_stages_and_reruns_agree(spark):
    first, again = (sorted((r.doc_id, r["copy"], r.text) for r in corpus_pipeline.run(spark, SF).select("doc_id", "copy", "text").collect()) for _ in range(2))
    assert first == again and len(first) > 50
