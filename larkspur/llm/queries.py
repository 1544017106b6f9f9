"""The ten queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import html, jaccard, mixing, packing, quality, records, secrets, suffixes, vectors, warc


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(_table(spark, sf_dir, "documents")).drop("h")


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.token_records(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), "kept", 2)


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(_table(spark, sf_dir, "documents"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.cut_repeats(_table(spark, sf_dir, "documents"), words=suffixes.WORDS)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), "dropped", 0)


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_table(spark, sf_dir, "pages"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_jaccard_join, op2_token_records, op3_embedding_near_dedup, op4_quality_rules, op5_main_text, op6_source_mixing, op7_suffix_array_dedup, op8_best_fit_packing, op9_warc_revisits, op10_secret_scans)}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": jaccard.ORACLE_SQL, "op3_embedding_near_dedup": vectors.ORACLE_SQL, "op4_quality_rules": quality.ORACLE_SQL, "op6_source_mixing": mixing.ORACLE_SQL, "op9_warc_revisits": warc.ORACLE_SQL}
