"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, divergence, language, line_dedup, mixing, near_dedup, ordering, quality, substring_dedup, toxicity, vector_codes, warc
from .common import Staging, in_fold, table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    staging = Staging(spark, "order")
    docs = table(spark, sf_dir, "documents")
    return ordering.training_order(docs, tokenizer_file("byte_bpe_50k.tiktoken"), staging.path("shards"), staging=staging)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_decisions(table(spark, sf_dir, "documents"))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score_toxicity(docs, index).select(
        "doc_id", in_fold(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), F.col("toxic_predicted").alias("predicted"), "evidence"
    )


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, num=85, den=100)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit_language_model(docs)
    return language.predict_language(docs.select("doc_id", "text"), model).select(
        "doc_id", in_fold(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected"
    )


def op9_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest_neighbours(vectors, vectors.where("vec_id % 20 = 0"))


def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeated_passages(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress_vectors(table(spark, sf_dir, "embeddings"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_source_mix, op2_training_order, op3_line_dedup, op4_bpe_round_trip, op5_quality_rules, op6_toxicity,
        op7_near_duplicates, op8_language, op9_nearest_vectors, op10_warc_round_trip,
        op11_substring_dedup, op12_vector_codes, op13_source_divergence,
    )
}
