"""The corpus operators as queries over the test tables, with DuckDB SQL where that can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellisgraph.llm import decontamination, fill_in_middle, hash_tree, language_id, lm_scoring, ngram_jaccard, packing, prefix_trie, projection_dedup, secrets, sentence_spans, suffix_dedup, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _fold(n: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_join(_read(spark, sf_dir, "documents"), percent=75, width=5)


def op2_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.removed(_read(spark, sf_dir, "documents"), words=20, long=25)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held_out = F.coalesce(_fold(4) == 2, F.lit(False))
    trees = language_id.train(docs.where(~held_out), order=3, per_language=400)
    rows = language_id.predict(docs, trees, F.struct("doc_id", held_out.alias("held_out")))
    return rows.select("_row.*", "lang_pred", "score")


def op4_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_tree.shard(_read(spark, sf_dir, "documents"), shards=16)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op6_projection_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_dedup.near_vectors(_read(spark, sf_dir, "embeddings"), threshold=0.9)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scored(_read(spark, sf_dir, "documents"), learn=_fold(10) != 0)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), max_error=0.1, q=8)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats_removed(_read(spark, sf_dir, "documents"), length=50)


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return secrets.digest(docs, secrets.history(docs))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digest(_read(spark, sf_dir, "documents"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = _read(spark, sf_dir, "documents"), F.coalesce(_fold(3) == 1, F.lit(False))
    model = toxicity.train(docs, _read(spark, sf_dir, "labels").where(~held_out), most=20_000)
    return toxicity.scored(docs, model, F.struct("doc_id", held_out.alias("held_out")), threshold=0.7).select("_row.*", "score", "predicted")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(_read(spark, sf_dir, "conversations"), local_turns=500_000)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_ngram_jaccard, op2_sentence_spans, op3_language_id, op4_hash_tree, op5_packing, op6_projection_dedup, op7_lm_scoring, op8_decontamination, op9_suffix_dedup, op10_secret_scans, op11_fill_in_middle, op12_toxicity, op13_prefix_trie, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op2_sentence_spans": sentence_spans.ORACLE, "op11_fill_in_middle": fill_in_middle.ORACLE, "op13_prefix_trie": prefix_trie.ORACLE}
