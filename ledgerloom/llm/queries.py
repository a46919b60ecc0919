"""Registered queries of the operators, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import (
    decontaminate,
    embedding_dedup,
    html_text,
    language_id,
    license_scan,
    merkle,
    mixing,
    ngram_join,
    pii,
    sharding,
    spelling,
    token_output,
    url_filter,
)
from ledgerloom.llm.oracles import ORACLE  # noqa: F401  re-exported beside the queries
from ledgerloom.session import new_folder

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    return found.drop("spans")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), url_filter.rules_frame(spark, url_filter.RULES))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_rows(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return language_id.predict_languages(documents, language_id.train(documents))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_embeddings(table(spark, sf_dir, "embeddings"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = ngram_join.join_near_texts(table(spark, sf_dir, "documents"))
    return linked.select("doc_id", "class_id", "n_links", "component_id", "kept")


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = sharding.write_shards(table(spark, sf_dir, "documents"), new_folder(spark, "shards"))
    return sharding.shard_report(stored)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spelling.word_counts(table(spark, sf_dir, "documents"), damage=31))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = merkle.document_leaves(table(spark, sf_dir, "documents"), merkle.chosen_rows(5))
    rows = merkle.build_manifest(leaves)
    rows = rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root")
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_url_filter,
        op3_decontamination,
        op4_token_output,
        op5_pii,
        op6_html_text,
        op7_mixing,
        op8_language_id,
        op9_embedding_dedup,
        op10_ngram_join,
        op11_sharding,
        op12_spelling_variants,
        op13_merkle_manifest,
    )
} | {"pipeline": _pipeline}
