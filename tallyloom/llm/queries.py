"""The queries opN_<name> of the corpus operators over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, crossalign, decontam, hardneg, maintext, neardup, ordinal, packing, pii, secrets, sharding, tokencount, urlrules


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op3_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_table(spark, sf_dir, "documents"))


def op4_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencount.section_tokens(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_neighbour_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal(_table(spark, sf_dir, "documents"))


def op7_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("spans")


def op8_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), 16)


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge_urls(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op10_minmax_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_pointer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    # the ranks of byte_bpe_50k.json: the same ids, found faster
    return crossalign.align(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, tokenizer("piece_bpe_32k.model"))


def op12_threshold_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op13_dom_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.extract(_table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ordinal_quality, op2_binary_packing, op3_secret_forest, op4_section_tokens, op5_neighbour_descent, op6_personal_data, op7_fm_decontamination, op8_jump_sharding, op9_url_rules, op10_minmax_neardup, op11_pointer_alignment, op12_threshold_negatives, op13_dom_trees)}


def oracle_sql() -> dict[str, str]:
    """None of them is plain SQL: models, tokenizers, hashes and graph walks. They are tested against brute force."""
    return {}
