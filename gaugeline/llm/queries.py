"""The registered queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, imatch, importance, langid, license, media, minhash, mixing, packing, quality, runs, spans, urlfilter
from .common import table


def tokenizer() -> tuple[bytes, str]:
    """The vocabulary (under 1 MB) and the pattern of the installed public tokenizer."""
    import public_tokenizers

    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80).drop("class_id", "text_hash")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs.where(~langid.held_out("doc_id"))))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.dedup_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_imatch_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), *tokenizer())


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.store_texts(table(spark, sf_dir, "documents")))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = packing.read_ranks(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.packed(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(table(spark, sf_dir, "documents"))


def queries() -> dict:
    every = (op1_mix_sources, op2_minhash_near_dedup, op3_quality_classifier, op4_license_scan, op5_url_filter, op6_language_id, op7_substring_dedup, op8_imatch_fingerprint, op9_byte_bpe, op10_media_columns, op11_best_fit_packing, op12_importance_resampling, op13_periodic_runs)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": mixing.MIX_SQL, "op2_minhash_near_dedup": minhash.MINHASH_SQL, "op4_license_scan": license.license_sql(), "op12_importance_resampling": importance.IMPORTANCE_SQL}
