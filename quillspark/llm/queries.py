"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, filter_audit, labelled, line_templates, ngram_join, periodic_runs, quality_classifier, quality_rules, recompression, secrets, suffix_array, toxicity, warc
from .common import ensure_checkpoint_dir, read
from .oracles import ORACLE_SQL


def _scored(rows: DataFrame, fold: tuple[int, int]) -> DataFrame:
    return rows.select("doc_id", labelled.held_out(fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = read(spark, sf_dir, "documents"), (5, 0)
    machine = toxicity.fit(docs, read(spark, sf_dir, "labels"), "toxic", fold)
    return _scored(toxicity.classify(docs, machine), fold)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_templates.drop_lines(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_dropped", F.length("text").cast("long").alias("n_chars_kept"), F.sha2("text", 256).alias("kept_sha256"))


def op4_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = read(spark, sf_dir, "documents"), (3, 1)
    space = quality_classifier.fit(docs, read(spark, sf_dir, "labels"), "quality", fold)
    return _scored(quality_classifier.classify(docs, space), fold)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(read(spark, sf_dir, "documents")))


def op6_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recompression.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_array.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.digest(quality_rules.judge(read(spark, sf_dir, "documents")))


def op10_bpe_tokens(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    rows = bpe.tokenize(read(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/warc-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
    return warc.round_trip(read(spark, sf_dir, "pages"), folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(read(spark, sf_dir, "documents"), double=True)


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_decontamination": op2_decontamination,
    "op3_line_templates": op3_line_templates,
    "op4_quality_knn": op4_quality_knn,
    "op5_secret_scan": op5_secret_scan,
    "op6_recompression": op6_recompression,
    "op7_suffix_array": op7_suffix_array,
    "op8_ngram_join": op8_ngram_join,
    "op9_quality_rules": op9_quality_rules,
    "op10_bpe_tokens": op10_bpe_tokens,
    "op11_warc": op11_warc,
    "op12_filter_audit": op12_filter_audit,
    "op13_periodic_runs": op13_periodic_runs,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
