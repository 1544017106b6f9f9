"""Corpus pipeline: quality rules, n-gram Jaccard join, secret scans, source mixing, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
one's docs. All but the last return the columns of `documents`; the last returns the packed pieces.

Defined results of all stages: an empty table gives no rows; further columns stay as they are, whatever they are called
(the last stage returns its own columns only); very long texts are worked on whole; null ids, languages and sources stay.
A null or empty text fails the quality rules, counts as no near copy, holds no secret, has no tokens to mix, and is packed
as its end id. Repeated rows are judged alike; the second stage makes them one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import jaccard, mixing, packing, quality, secrets
from larkspur.llm._common import materialize
from larkspur.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule go."""
    return quality.keep(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return jaccard.keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; every document stays. n_chars is that of the new text."""
    masked = secrets.mask(docs)
    length = F.coalesce(F.length("text").cast("long"), F.col("n_chars")).alias("n_chars")
    return masked.select(*(length if c == "n_chars" else F.col("`" + c.replace("`", "``") + "`") for c in masked.columns))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken to the target weights; one that several epochs take is repeated."""
    return mixing.taken(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), "dropped", 0)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", mixing_sources),
    ("best-fit packing", best_fit_packing),
]

#: The tokenizer, MinHash and the trained field have no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the whole of `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage{i}")
    return docs
