"""Five stages from raw documents to packed training sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellisgraph.llm import decontamination, language_id, ngram_jaccard, packing, secrets
from trellisgraph.llm.common import saved


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text a learnt language explains; ``und`` and undecided ones (score under one half) go.

    Null texts and texts without a letter are ``und``. Repeated rows are judged each for itself.
    """
    trees = language_id.train(docs)
    rows = language_id.predict(docs, trees, F.struct("*"))
    return rows.where("lang_pred <> 'und' and score >= 0.5").select("_row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least doc_id of each group of linked texts; empty texts and null ids are no group.

    Rows that repeat an id are told apart by their text; rows equal to the one that stays in both stay too.
    """
    groups = ngram_jaccard.jaccard_join(docs)
    other = groups.where("doc_id <> component_id").select("doc_id", "text_hash")
    rows = docs.select(F.col("doc_id"), F.xxhash64("text").alias("text_hash"), F.struct("*").alias("row"))
    return rows.join(other, ["doc_id", "text_hash"], "left_anti").select("row.*")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item; null texts hold none, repeated ids are judged row by row."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets in their texts replaced; n_chars follows the text. Null texts stay null."""
    rows = secrets.redacted(docs)
    if "n_chars" not in docs.columns:
        return rows
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return rows.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(length))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every text with its place in a sequence of at most 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", known_language), ("ngram_jaccard_join", one_of_each_group), ("benchmark_decontamination", without_benchmark), ("secret_scans", without_secrets), ("best_fit_packing", packed)]

#: Hashing trees, byte statistics and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``, each written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
