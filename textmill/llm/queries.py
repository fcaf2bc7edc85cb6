"""The queries opN_<name> over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann, byte_bpe, chat, dedup_substring, jaccard_join, oracles, packing, runs, sharding, suffix_tree, syncmers, token_counts, toxicity, whitening


def op1_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op2_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), 8)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = dedup_substring.remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), 50)
    return rows.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_suffix_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 5, 75)


def op8_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), keep="digest")


def op10_chat_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), 1024)


def op12_svd_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.by_component(whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 32))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.periodic_runs(runs.planted(spark.read.parquet(f"{sf_dir}/documents.parquet"))))


ORACLE_SQL: dict[str, str] = {
    "op2_hash_tree_sharding": oracles.SHARDS,
    "op3_substring_dedup": oracles.REPEATS,
    "op7_ngram_jaccard_join": oracles.NEAR,
    "op13_periodic_runs": oracles.RUNS,
}

QUERIES = {
    f.__name__: f
    for f in (
        op1_multi_index_hashing,
        op2_hash_tree_sharding,
        op3_substring_dedup,
        op4_toxicity,
        op5_closed_syncmers,
        op6_suffix_tree_scoring,
        op7_ngram_jaccard_join,
        op8_nnls_packing,
        op9_byte_bpe,
        op10_chat_role_repair,
        op11_token_counts,
        op12_svd_whitening,
        op13_periodic_runs,
    )
}
