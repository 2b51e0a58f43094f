"""The thin queries over the operators of this package, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, filter_audit, iblt, langid, mixing, ngram_join, periodic, pii, secrets, substring, suffix_dedup, urlfilter


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))  # a null id is learned from
    model = langid.train(docs.where(~held_out))
    found = langid.identify(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.report(_documents(spark, sf_dir, "doc_id", "text"), items)


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_documents(spark, sf_dir, "doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_documents(spark, sf_dir, "doc_id", "text")).drop("terms")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_documents(spark, sf_dir, "doc_id", "text"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(_documents(spark, sf_dir, "doc_id", "text"), n=4, percent=85)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.deduplicate(_documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.deduplicate(_documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprints(_documents(spark, sf_dir, "doc_id", "text"), digest=iblt.bounded_digests)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    found = urlfilter.judge(spark.sql(urlfilter.CAPTURES, pages=pages), spark.sql(urlfilter.LOG, pages=pages))
    return found.select("page_id", F.col("captured").cast("string").alias("captured"), "n_lists", "lists", "entry", "blocked")


def op11_bpe(spark: SparkSession, sf_dir: str, tokenizer: str = "") -> DataFrame:
    """``tokenizer`` is the path of a tokenizer file; unless given, that of the public file byte_bpe_50k.json."""
    if not tokenizer:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    found = bpe.decode(bpe.encode(_documents(spark, sf_dir, "doc_id", "text"), tokenizer), tokenizer)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_documents(spark, sf_dir, "doc_id", "text", "source"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report(periodic.repeat_some(_documents(spark, sf_dir, "doc_id", "text")))


QUERIES = [op5_fingerprints, op8_suffix_dedup, op3_substring_dedup, op2_ngram_join, op9_pii, op10_secrets, op1_language_id, op6_mix_sources, op7_decontaminate, op4_url_filter, op11_bpe, op12_filter_audit, op13_periodic_runs]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op3_substring_dedup": substring.ORACLE, "op2_ngram_join": ngram_join.ORACLE, "op6_mix_sources": mixing.ORACLE, "op7_decontaminate": decontam.ORACLE, "op4_url_filter": urlfilter.ORACLE, "op12_filter_audit": filter_audit.ORACLE}
