"""Operators on tables whose other columns have dots, map types and the operators' own names; training on repeated and null ids."""

import datetime

import pytest
from pyspark.sql import functions as F

from bagsieve.llm import decontam, langid, mixing, ngram_join, pii, secrets, urlfilter

NAMES = ("meta.url", "_lang", "_id", "_url", "_captured", "_lists", "entry", "lists", "blocked", "size", "taken", "key", "bad", "place", "number", "spans", "levels", "c0", "_column_0")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "the cat sat on the mat and it was good to be there", "en", "s"), (1, "le chat est sur la table et il est bon", "fr", None), (None, None, None, "s"), (2, "", "en", "t"), (3, "password = 'hunter2hunter2' mail a@b.com", "en", "t")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in NAMES:
        frame = frame.withColumn(name, F.lit("own"))
    return frame.withColumn("tags", F.create_map(F.lit("k"), F.lit("v"))).repartition(2)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "sat on the mat and it was good to be")], "item_id long, text string")


def test_row_operators(spark, docs, items):
    model = langid.train(docs)
    calls = {
        "language": lambda d: langid.keep_identified(d, model),
        "near copies": lambda d: ngram_join.keep_one(d),
        "documents": lambda d: decontam.remove_documents(d, items),
        "spans": lambda d: decontam.remove_spans(d, items),
        "secrets": secrets.redact,
        "personal": pii.sanitise,
    }
    for name, call in calls.items():
        out = call(docs)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r["meta.url"] == "own" and r["tags"] == {"k": "v"} for r in rows), name
        assert call(docs.where("false")).count() == 0, name
    assert "hunter2" not in " ".join(r.text or "" for r in secrets.redact(docs).collect())
    assert sorted(str(r.doc_id) for r in decontam.remove_documents(docs, items).collect()) == ["2", "3", "None"]


def test_mix_and_emit(docs):
    mixed = mixing.mix(docs)
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies", "taken")]
    assert mixed.columns == [*own, "size", "source_size", "target", "copies", "taken"] and mixed.count() == docs.count()
    out = mixing.emit(mixed)
    assert out.count() == mixed.agg(F.sum("copies")).first()[0] and "meta.url" in out.columns


def test_judge(spark, docs):
    captures = docs.withColumn("url", F.lit("http://a.b.com/x/")).withColumn("captured", F.lit(datetime.date(2024, 2, 1)))
    log = spark.createDataFrame([("spam", "b.com", datetime.date(2024, 1, 1), "add")], "list string, entry string, at date, action string")
    found = urlfilter.judge(captures, log)
    assert len(set(found.columns)) == len(found.columns)
    rows = found.collect()
    assert len(rows) == 5 and all((r["lists"], r["entry"], r["blocked"], r["meta.url"]) == ("spam", "b.com", True, "own") for r in rows)
    assert {r["blocked"] for r in urlfilter.judge(captures, log.where("false")).collect()} == {False}


def test_training_sample_is_bounded_whatever_repeats(spark):
    one = spark.range(5000).select(F.lit(7).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("aa").alias("lang"))
    same = spark.range(5000).select(F.lit(8).alias("doc_id"), F.lit("all alike").alias("text"), F.lit("bb").alias("lang"))
    without = spark.range(20).select(F.lit(None).cast("int").alias("doc_id"), F.concat(F.lit("sans "), "id").alias("text"), F.lit("cc").alias("lang"))
    found = langid.training_sample(one.unionByName(same).unionByName(without), 400, 20_000)
    assert {k: len(v) for k, v in found.items()} == {"aa": 400, "bb": 400, "cc": 20}
    assert len(set(found["aa"])) == 400


def test_many_languages(spark):
    rows = spark.range(1500).select("id", F.concat(F.lit("w"), F.md5(F.col("id").cast("string"))).alias("text"), F.concat(F.lit("l"), "id").alias("lang")).withColumnRenamed("id", "doc_id")
    model = langid.train(rows)
    assert len(model.languages) == 1500
    found = langid.identify(rows.where("doc_id < 50"), model).collect()
    assert all(r.lang_pred == f"l{r.doc_id}" for r in found)
