"""From raw documents to packed training sequences, in four stages over all documents.

1. toxicity: documents whose calibrated score reaches the threshold go.
2. ngram_jaccard_join: of each group of near copies (5-word shingles, Jaccard 0.75) the
   document with the smallest doc_id stays. Rows with a null doc_id all stay; rows that
   repeat a doc_id and text are one document.
3. substring_dedup: words of 50-word passages that an earlier document has are removed;
   what is left is joined by single spaces. Documents without such passages keep their
   text unchanged; documents of which nothing is left go.
4. packing: the rest is tokenised and packed into sequences of 2048 tokens.

Stages 1 to 3 return the columns of documents (and any further ones, whatever their names, unchanged).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm import dedup_substring, jaccard_join, packing, toxicity
from textmill.llm.common import anti_by_id, fresh, materialize, quoted, semi_by_id


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs.select("doc_id", "text"), toxicity.learnable(labels))
    chance, flag = fresh(docs.columns, "chance", "flag")
    return toxicity.score(docs, model, docs.columns, out=(chance, flag)).where(F.col(flag) == 0).select(*map(quoted, docs.columns))


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = materialize(jaccard_join.near_duplicates(docs, 5, 75))
    stays = groups.where("doc_id = component_id").select("doc_id").distinct()
    goes = groups.where("doc_id <> component_id").select("doc_id").distinct().join(stays, "doc_id", "left_anti")
    kept = anti_by_id(docs, materialize(goes))
    again = materialize(groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return kept
    return anti_by_id(kept, again).unionByName(semi_by_id(kept, again).dropDuplicates(["doc_id", "text"]).select(*map(quoted, kept.columns)))


def substring_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, changed = dedup_substring.remove_repeats(docs, 50)
    gone = materialize(rows.where("n_words > 0 and n_removed = n_words").select("doc_id", "tk").distinct())
    ids = materialize(changed.select("doc_id").unionByName(gone.select("doc_id")).distinct())
    same = anti_by_id(docs, ids)
    tk, of, of_tk, left = fresh(docs.columns, "tk", "of", "of_tk", "left")
    same_row = (F.col("doc_id") == F.col(of)) & (F.col(tk) == F.col(of_tk))
    row = (F.col("doc_id").alias(of), F.col("tk").alias(of_tk))
    edited = semi_by_id(docs, ids).withColumn(tk, F.xxhash64("text")).join(gone.select(*row), same_row, "left_anti")
    edited = edited.join(changed.select(*row, F.col("kept").alias(left)), same_row, "left").withColumn("text", F.coalesce(left, "text"))
    if "n_chars" in docs.columns:
        edited = edited.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return same.unionByName(edited.select(*map(quoted, docs.columns)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_filter),
    ("ngram_jaccard_join", near_duplicate_filter),
    ("substring_dedup", substring_filter),
    ("packing", pack),
]

#: The stages are no SQL; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
