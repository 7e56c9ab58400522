"""The subpackage's queries, one for each operator, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm.common import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataflow.llm.pieces import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataflow.llm.mixing import mix_report

    return mix_report(table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataflow.llm.cws import fingerprint_report

    return fingerprint_report(table(spark, sf_dir, "documents"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataflow.llm.wrapper import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataflow.llm.quality import quality_report

    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataflow.llm.sharding import lpt_shards

    return lpt_shards(table(spark, sf_dir, "documents"), 16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataflow.llm.tiff import media_report

    return media_report(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataflow.llm.simhash import simhash_components

    found = simhash_components(table(spark, sf_dir, "documents"), radius=3, shingle=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataflow.llm.token_files import token_file_report

    return token_file_report(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataflow.llm.attribution import attribute_tokens

    return attribute_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataflow.llm.hard_negatives import hard_negatives

    return hard_negatives(table(spark, sf_dir, "embeddings"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataflow.llm.divergence import divergence

    return divergence(table(spark, sf_dir, "documents"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataflow.llm.pii import pii_report

    return pii_report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_sentencepiece, op2_mixing, op3_fingerprints, op4_html, op5_quality, op6_sharding, op7_media, op8_simhash, op9_token_files, op10_token_counts, op11_hard_negatives, op12_divergence, op13_pii]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from strataflow.llm import divergence, hard_negatives

    return {"op11_hard_negatives": hard_negatives.SQL, "op12_divergence": divergence.SQL}
