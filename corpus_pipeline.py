"""The corpus pipeline: quality, near duplicates, repeated passages, mixing, segmentation.

Each stage takes what its predecessor kept; ``run`` writes every stage's rows as Parquet
below the checkpoint folder and reads them again as the next one's documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adfunnel.llm import exactdup, mixing, neardup, quality, sentencepieces
from adfunnel.llm.common import ensure_checkpoint_dir, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (op 9)."""
    model = quality.trained(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model).where("score >= 0.5").select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (op 7), one row for each id.

    Rows without an id take no part. Of several rows of an id the one with the smallest
    text hash stays.
    """
    gone = neardup.near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("__id"))
    again = docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__id")) \
        .agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("__id")
    same = F.col("doc_id") == F.col("__id")
    single = docs.join(gone.union(again).distinct(), same, "left_anti")
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    several = docs.join(again, same, "left_semi").join(gone.distinct(), same, "left_anti") \
        .groupBy("doc_id").agg(F.min_by(every, F.xxhash64("text")).alias("row")).select("row.*")
    return single.unionByName(several)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that start earlier in the corpus (op 10)."""
    return exactdup.deduplicated_texts(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: rows of the taken words, once per epoch (op 2)."""
    return mixing.mixed_texts(docs)


def segmented(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every row (op 8)."""
    return sentencepieces.sampled_segmentations(docs, "doc_id", "text", k=2)


STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", one_of_each),
    ("suffix-array dedup", without_repeats),
    ("mixing sources to target weights", mixed),
    ("SentencePiece encoding and decoding", segmented),
]

# A fitted classifier and hashed sketches have no SQL form; tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
    return docs
