"""A corpus clean-up in five stages, each an operator of quadloom.llm.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents, with
n_chars brought up to date where the text changes.  The last returns packed pieces.

Defined results, of every stage unless it says otherwise: a null in any column is kept; a null text is empty where it is
scored, compared or packed; empty and very long texts are taken whole; rows that repeat are rows of their own; an empty table
gives an empty one; columns beyond those of documents are kept whatever their names, but for the last stage, which ignores them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm import line_dedup, ngram_join, packing, pii, toxicity


def _recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more for toxicity go.

    Labels are the table's; empty texts have the calibrated rate of such texts, so they stay unless most are toxic.
    """
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of 50 words or more go; so do documents that lose all their words by it.

    Documents that had no words stay.  Earlier is by doc_id (null first), then by row key; rows that repeat both doc_id and
    text are one document, and lose the same.
    """
    done = line_dedup.apply(docs)
    emptied = (F.col("lines_removed") > 0) & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")
    return _recounted(done.where(~F.coalesce(emptied, F.lit(False))), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: the one of least doc_id, then row key.

    Texts without words stay, each for itself; of rows that repeat both doc_id and text one stays.
    """
    return ngram_join.keep_one(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to their kinds in brackets; a null text stays null, and texts without any stay as they are."""
    return _recounted(pii.mask(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens; an empty or null text is its end token alone."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_repeated_lines), ("n-gram Jaccard join", drop_near_copies), ("PII", mask_personal_data), ("best-fit packing", pack)]

#: Tokenisers and trained models aren't SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
