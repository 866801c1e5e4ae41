"""Registered queries of the training-data operators: thin wrappers with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusflow.llm import decontaminate, html_extract, language_id, packing, quality_classifier, quality_rules, secrets, simhash_dedup, suffix_dedup, toxicity
from corpusflow.llm.common import fold, table


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(fold("doc_id", 5) != 0))
    return language_id.identify(docs, model).withColumn("held_out", fold("doc_id", 5) == 0)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    model = quality_classifier.train(docs, labels)
    return quality_classifier.score(docs, model).withColumn("held_out", fold("doc_id", 5) == 0)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.dedup(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.Packing(public_tokenizers.path("word_bpe_49k.json")))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = secrets.train(secrets.random_strings(spark).unionByName(secrets.corpus_samples(docs)))
    return secrets.scan(docs, models).drop("found")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 4) != 2))
    return toxicity.score(docs, model).withColumn("held_out", fold("doc_id", 4) == 2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extract": op1_html_extract,
    "op2_language_id": op2_language_id,
    "op3_quality_rules": op3_quality_rules,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_decontaminate": op5_decontaminate,
    "op6_simhash_dedup": op6_simhash_dedup,
    "op7_packing": op7_packing,
    "op8_secret_scan": op8_secret_scan,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_toxicity": op10_toxicity,
}

ORACLES: dict[str, str] = {
    "op3_quality_rules": quality_rules.oracle(),
    "op5_decontaminate": decontaminate.oracle(),
}
