"""Labelled rows, held-out folds and bounded training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's text modulo ``folds`` (NULL id: of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def training_sample(labels: DataFrame, label: str, usable: Column, per_class: dict[int, int]) -> DataFrame:
    """At most ``per_class[y]`` ids of each class with label 0 or 1 among usable rows.

    Ids are taken in order of a seeded hash, so reruns agree. An id labelled both ways,
    or with a NULL label, is left out. The result (doc_id, y) is bounded by the parameter.
    """
    known = labels.where(usable & F.col("doc_id").isNotNull()) \
        .groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("top")) \
        .where("y = top AND y IN (0, 1)").select("doc_id", F.col("y").cast("int").alias("y"))
    out = None
    for y, n in sorted(per_class.items()):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id").limit(n)
        out = part if out is None else out.union(part)
    return out


def sample_texts(documents: DataFrame, sample: DataFrame) -> DataFrame:
    """(doc_id, text, y) of the sampled ids, one row each; the sample is bounded, so it is broadcast.

    Of several texts of an id the one with the smallest hash counts.
    """
    rows = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    return rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.min("y").alias("y"))
