"""Corpus pipeline: stages applied to ``documents`` one after the other.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept and returns a DataFrame, which is written as Parquet and read again as
the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import bpe, line_dedup, mixing, near_dedup, toxicity
from tallyweave.llm.common import Staging, table
from tallyweave.llm.queries import tokenizer_file


def _small_batches(spark: SparkSession) -> None:
    """At most 1,000 rows in an Arrow batch of this session: whole texts travel in them, in both directions."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= 1_000:
        spark.conf.set(key, "1000")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; labels come from ``labels``, their texts from ``docs``."""
    _small_batches(spark)
    index = toxicity.fit_toxicity(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = toxicity.score_toxicity(docs, index)
    return scored.where("toxic_predicted = 0").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines alike (character shingles, 0.8) the first stays; ``n_chars`` follows the text."""
    _small_batches(spark)
    cut = line_dedup.drop_repeated_lines(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents alike (five-word shingles, 0.8) the one with the smallest doc_id stays."""
    _small_batches(spark)
    return near_dedup.keep_one_of_each(docs).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources to their weights; a document may come twice or not at all."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text that the mix holds."""
    _small_batches(spark)
    return bpe.encode_documents(docs.select("doc_id", "source", "text"), tokenizer_file("byte_bpe_50k.json"), keep_text=False, lean=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix),
    ("bpe", encode),
]

#: Scores, fuzzy groups and token ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of each but the last are written and read again."""
    staged = Staging(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged.save(docs, f"{k}-{name}")
    return docs
