"""The corpus pipeline: quality, near-duplicates, repeated passages, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as
the next stage's docs; all but the last return the columns of documents, extra ones too.

Null texts and empty ones pass the first three stages (a null id too) and have no words to mix; of rows with one id
and text near-dedup keeps one; very long texts go whole through every stage; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm import bpe, minhash, mixing, quality, spans
from gaugeline.llm.common import shared_folder, table, unused
from gaugeline.llm.queries import tokenizer


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8."""
    return minhash.keep_one(docs)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of sentences are cut; a document of which nothing but white space is left goes."""
    removed = unused("span_removed", docs.columns)
    cut = spans.dedup_spans(docs, sentences_col=unused("span_sentences", docs.columns), removed_col=removed)
    gone = (F.col(removed) > 0) & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")
    cut = cut.where(~F.coalesce(gone, F.lit(False)))
    return cut.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a row for each pass over a document, partly taken ones cut."""
    return mixing.mix_texts(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids (packed), and the digests of the ids and of the text that they decode to."""
    ranks, pattern = tokenizer()
    out = bpe.encode(docs.select("doc_id", "source", "text"), ranks, pattern, bytes_col="decoded")
    return out.select("doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", quality_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("substring_dedup", substring_dedup_stage),
    ("mix_sources", mixing_stage),
    ("byte_bpe", tokens_stage),
]

#: A trained classifier is no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
