"""Registered queries over the training-data operators; each applies one to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pkgatlas.llm import (
    ann, decontaminate, hard_negatives, licenses, line_dedup, mixing, oracles, packing, quality, secrets, sharding,
    simhash, spelling, token_files,
)
from pkgatlas.llm.common import new_work_path
from pkgatlas.llm.tokens import byte_level_encoder, word_encoder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha256(text: str):
    return F.sha2(F.col(text).cast("binary"), 256)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", _sha256("text").alias("kept_sha256")
    )


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    # rows alike in all three columns take the same number of copies each
    return mixing.mix(docs).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target",
        (F.col("size") * F.col("copies")).alias("taken"), "source", "copies",
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("row"),
    ).drop("row")


def packed(docs: DataFrame) -> DataFrame:
    return packing.pack(docs, word_encoder, public_tokenizers.path("word_bpe_49k.json"), 2)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    # the contract's query set
    return ann.nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.secret_digest(secrets.scan_secrets(docs))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.score_documents(docs, _table(spark, sf_dir, "labels")).drop("mark", "lang")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_work_path(spark, "token-files")
    token_files.write_token_files(
        _table(spark, sf_dir, "documents").select("doc_id", "text"), path, byte_level_encoder,
        public_tokenizers.path("byte_bpe_50k.json"), 0,
    )
    return token_files.read_token_files(spark, path).select(
        F.col("doc").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.benchmark_overlap(docs, _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("vec_id")
    # the contract's labels
    vectors = _table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", F.when(key % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label")
    )
    return hard_negatives.hard_negatives(vectors, key % 100 == 0)


LLM_QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_source_mixing": op2_source_mixing,
    "op3_packing": op3_packing,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_sharding": op5_sharding,
    "op6_learned_partitions": op6_learned_partitions,
    "op7_secret_scan": op7_secret_scan,
    "op8_license_scan": op8_license_scan,
    "op9_quality_rules": op9_quality_rules,
    "op10_token_files": op10_token_files,
    "op11_decontamination": op11_decontamination,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_hard_negatives": op13_hard_negatives,
}

LLM_ORACLES = {
    "op1_line_dedup": oracles.LINE_DEDUP,
    "op7_secret_scan": oracles.secret_scan(),
    "op9_quality_rules": oracles.quality_rules(),
    "op11_decontamination": oracles.DECONTAMINATION,
    "op13_hard_negatives": oracles.HARD_NEGATIVES,
}
