"""The operators as queries over the given tables, with DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adfunnel.llm import (
    blocktopk, divergence, exactdup, licenses, mixing, multiindex, neardup, packing, quality, sentencepieces, sharding,
    toxicity, whitening,
)
from adfunnel.llm.common import table


def op1_multi_index(spark: SparkSession, sf: str) -> DataFrame:
    return multiindex.search(table(spark, sf, "embeddings"), "vec_id", "embedding", F.col("id") % 20 == 0)


def op2_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.document_mix(table(spark, sf, "documents"))


def op3_shard_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.document_shards(table(spark, sf, "documents"))


def op4_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.document_licenses(table(spark, sf, "documents"))


def op5_block_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return blocktopk.search(table(spark, sf, "embeddings"), "vec_id", "embedding", F.col("id") % 100 == 0)


def op6_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.document_toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op7_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf, "documents"))


def op8_gumbel_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return sentencepieces.document_segmentations(table(spark, sf, "documents"))


def op9_quality_votes(spark: SparkSession, sf: str) -> DataFrame:
    return quality.document_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op10_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exactdup.document_dedup(table(spark, sf, "documents"))


def op11_source_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf, "documents"))


def op12_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whitened_vectors(table(spark, sf, "embeddings"))


def op13_bin_completion(spark: SparkSession, sf: str) -> DataFrame:
    return packing.document_packing(table(spark, sf, "documents"))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_multi_index": op1_multi_index,
        "op2_mix_sources": op2_mix_sources,
        "op3_shard_bytes": op3_shard_bytes,
        "op4_license_scan": op4_license_scan,
        "op5_block_top_k": op5_block_top_k,
        "op6_toxicity": op6_toxicity,
        "op7_near_duplicates": op7_near_duplicates,
        "op8_gumbel_pieces": op8_gumbel_pieces,
        "op9_quality_votes": op9_quality_votes,
        "op10_suffix_dedup": op10_suffix_dedup,
        "op11_source_divergence": op11_source_divergence,
        "op12_whitening": op12_whitening,
        "op13_bin_completion": op13_bin_completion,
    }


def llm_oracle_sql() -> dict[str, str]:
    return {"op2_mix_sources": mixing.SQL, "op11_source_divergence": divergence.SQL}
