"""Contiguous byte-balanced shards from global prefix sums (DataFrame functions only).

Rows are put in order over range partitions. Each partition's totals (one row per
partition) give the bytes and rows before it; a running sum inside the partition adds
the rest, so no task ever sees more than its own range. A row goes to the shard in
which the middle of its bytes falls, so a shard's bytes differ from ``total / shards``
by at most the size of its largest row.

Defined results: a NULL size counts 0; NULL order keys come first; rows with equal keys
are ordered by a hash of their columns (which also splits a hot key over several
ranges); an empty table gives no rows; input columns named like an output are replaced.
When every size is 0, rows are spread evenly by count. ``2 * shards * total`` must fit
in a long (115 PB at 40 shards).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adfunnel.llm.common import checkpointed, shuffle_partitions

P = "__shard_"


def _row_hash(df: DataFrame) -> Column:
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields
             if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return F.xxhash64(*plain)


def contiguous_shards(df: DataFrame, shards: int, size: Column, order: list[str],
                      partitions: int | None = None) -> DataFrame:
    """``df`` with ``size``, ``shard`` (0 to ``shards - 1``) and ``slot`` (0-based, gapless)."""
    keep = [c for c in df.columns if c not in ("size", "shard", "slot")]
    sized = df.withColumn(P + "size", F.coalesce(size.cast("long"), F.lit(0))) \
              .withColumn(P + "tie", _row_hash(df))
    keys = [F.col(f"`{c}`").asc_nulls_first() for c in order] + [F.col(P + "tie").asc()]
    ranged = sized.repartitionByRange(partitions or shuffle_partitions(df.sparkSession), *keys)
    # Range bounds are sampled anew by each run, so the partition numbers are fixed once.
    ranged = checkpointed(ranged.withColumn(P + "part", F.spark_partition_id()))

    totals = ranged.groupBy(P + "part").agg(F.sum(P + "size").alias(P + "bytes"),
                                            F.count(F.lit(1)).alias(P + "rows"))
    parts = Window.orderBy(P + "part")
    everything = Window.partitionBy()
    before = totals.select(
        P + "part",
        (F.sum(P + "bytes").over(parts) - F.col(P + "bytes")).alias(P + "bytes0"),
        (F.sum(P + "rows").over(parts) - F.col(P + "rows")).alias(P + "rows0"),
        F.sum(P + "bytes").over(everything).alias(P + "total"),
        F.sum(P + "rows").over(everything).alias(P + "count"))

    inside = Window.partitionBy(P + "part").orderBy(*keys)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # one row per range partition: bounded by the partition count
    placed = ranged.join(F.broadcast(before), P + "part")
    placed = placed.withColumn(P + "end", F.col(P + "bytes0") + F.sum(P + "size").over(running)) \
                   .withColumn(P + "row", F.col(P + "rows0") + F.row_number().over(inside) - 1)
    placed = placed.withColumn("shard", F.expr(
        f"cast(least({shards - 1}, CASE WHEN {P}total = 0 THEN ({P}row * {shards}) div {P}count "
        f"ELSE ((2 * {P}end - {P}size) * {shards}) div (2 * {P}total) END) AS int)"))
    firsts = placed.groupBy(F.col("shard").alias(P + "shard")).agg(F.min(P + "row").alias(P + "first"))
    # one row per shard
    out = placed.join(F.broadcast(firsts), F.col("shard") == F.col(P + "shard"))
    return out.select(*[F.col(f"`{c}`") for c in keep], F.col(P + "size").alias("size"), "shard",
                      (F.col(P + "row") - F.col(P + "first")).alias("slot"))


def write_shards(df: DataFrame, path: str) -> None:
    """Files of a sharded frame, one folder per shard, rows in slot order."""
    (df.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
       .write.partitionBy("shard").parquet(path))


def document_shards(documents: DataFrame, shards: int = 40) -> DataFrame:
    """The shards of ``documents`` by UTF-8 bytes plus 16, in doc_id order, as digest columns."""
    digest = documents.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    out = contiguous_shards(digest, shards, F.col("bytes") + 16, ["doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
