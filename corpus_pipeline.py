"""The corpus pipeline: each stage works on all that the one before it kept.

All stages but the last return the columns of ``documents``, and no others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelarium.llm import bpe, common, linededup, mixing, quality, simhash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_text(docs: DataFrame, text) -> DataFrame:
    """The columns of documents with a new text and its length."""
    return docs.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, and so do the failing lines of those that stay.

    A text that is null or empty is rejected. Repeated rows get the same verdict.
    """
    judged = quality.quality_rules(docs.select(*COLUMNS))
    # the filter stays above the verdicts by what isn't deterministic; below them it would evaluate all rules a second time
    once = judged.withColumn("part", F.spark_partition_id())
    return _with_text(once.where(F.col("kept") & (F.col("part") >= 0)), F.col("clean_text"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of later repeated runs go; documents of which no word is left go too.

    A null or empty text loses no line and stays. Repeated rows are one document and stay alike.
    """
    cleaned = linededup.line_dedup(docs.select(*COLUMNS))
    return _with_text(cleaned.where((F.col("n_removed") == 0) | F.col("clean_text").rlike(common.WORD_PATTERN)), F.col("clean_text"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: shingles of five words, a similarity of 0.8 or more.

    Repeated rows stay once, and so do texts without words. Ties go to the smallest id, null last, then to the hash of the text.
    """
    return simhash.keep_one_of_similar(docs.select(*COLUMNS), width=5, similarity=0.8)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mix takes it. Texts without words are taken no times; a null source is a source."""
    return mixing.repeat_documents(docs.select(*COLUMNS))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, ids)`` of each row's text; null and empty texts have no ids, repeated rows a row each."""
    import public_tokenizers

    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_dedup_stage),
    ("simhash near-dedup", simhash_stage),
    ("source mixing", mixing_stage),
    ("byte-level BPE", encoding_stage),
]

#: SQL can't express fingerprints of hashed shingles, a seeded knapsack or byte pair merges; tests hold the rows
#: of every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.materialize(docs, f"stage{k}")
    return docs
