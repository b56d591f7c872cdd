"""The corpus pipeline: quality rules, line dedup, near duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all
that the stage before kept. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, decontaminate, line_templates, ngram_join, quality_rules
from quillspark.llm.common import ensure_checkpoint_dir, read, short_batches


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    short_batches(spark)
    kept = quality_rules.judge(docs, keep_text=True).filter("kept")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur across documents go; so do documents that lose every word."""
    short_batches(spark)
    return line_templates.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8 or more."""
    short_batches(spark)
    return ngram_join.clean(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    short_batches(spark)
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and the text decoded from them."""
    short_batches(spark)
    rows = bpe.tokenize(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("bpe_tokens", tokens),
]

#: Weak supervision, template trees and the near-duplicate components are not expressible in SQL; tests/llm/test_pipeline.py has the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written as Parquet into the checkpoint folder and read again.

    A stage's rows are deleted once the next stage is written; the last one's stay, as the result reads them.
    """
    ensure_checkpoint_dir(spark)
    at = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
    docs, before = read(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        written = f"{at}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(written)
        docs = spark.read.parquet(written)
        if before:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        before = written
    return docs
