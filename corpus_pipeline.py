"""A training-data pipeline of five stages over documents; each reads what the one before wrote.

Each stage takes tables with at least the columns of documents; further columns go at the first stage, whatever their names. Rows of equal or null
doc_id are rows of their own throughout, null texts count as empty, and an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessarium.llm import near_copies, packing, quality_rules, secret_scan, substrings
from tessarium.llm.warc import folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Stands in for a secret.
MARK = "[SECRET]"


def _with_text(found: DataFrame, text: str) -> DataFrame:
    """Documents with another text, which each row has beside it, so that rows of equal or null doc_id stay apart; n_chars follows."""
    return found.select("doc_id", F.col(text).alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; those without ten words, null and empty texts among them, are rejected. Equal rows are judged alike."""
    # a filter on a generated column stays above the measures; pushed below, it would repeat them in each of its terms
    return quality_rules.judged(docs).select(*COLUMNS, F.explode(F.array("_kept")).alias("_keep")).where("_keep").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (sets of five-word shingles at a Jaccard similarity of 0.8, and chains of these) one row stays, that of smallest doc_id, null after
    all others. Candidates are texts whose SimHash fingerprints of these shingles differ in at most 4 bits, searched by op4's operator, and, as that limit misses
    most such copies, those that share a MinHash key; whole sets decide. Rows equal in all columns are one row; texts without words are one group."""
    return near_copies.first_rows(docs.select(*COLUMNS), words=5, similarity=0.8, limit=4)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated windows of 20 words are cut out where they don't stand first; a document of which nothing stays goes, null and empty texts among them. Of rows of
    equal doc_id and text the windows repeat."""
    cut = _with_text(substrings.cut(docs, texts=True, carried=("lang", "source")), "kept_text")
    return cut.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every row stays, texts without secrets as they are, null ones too."""
    found = secret_scan.scan(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, mark=MARK, carried=("lang", "source"))
    return _with_text(found, "clean_text")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences; null and empty texts are pieces of the end token alone, repeated rows are packed each."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality), ("simhash near-dedup", near_dedup), ("substring dedup", substring_dedup), ("secret scan", secrets), ("best-fit packing", pack)]
#: Similarity of shingle sets and byte-pair tokens are beyond SQL; tests compare near-dedup with brute force, and run() with the stages by row count.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each result written below the checkpoint folder and read again."""
    at, docs = folder(spark, None), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{at}/{k}-{uuid.uuid4().hex}")
        docs = spark.read.parquet(path)
    return docs
