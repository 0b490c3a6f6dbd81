"""Mixing sources to target weights by Sainte-Lague apportionment (DataFrame functions only).

* Targets: sources (by code point, NULL last) weigh ``weights`` in turn and share
  ``share`` times all tokens; a target stops at ``epochs`` times its source's tokens and
  the excess is shared anew by weight. The fixed point is a water level: with sources in
  the order of cap over weight, prefix sums give the level at which the rest is uncapped.
* Apportionment: the mix is ``shards * blocks_per_shard`` blocks of equal tokens. Source
  ``s`` bids ``target / (2 j + 1)`` for its (j + 1)-th block and the highest quotients win.
  The method is house-monotone: seats in the order they are won fill shard after shard,
  so each shard has integer quotas and all shards together match the targets.
* Selection: a source's documents, in seeded order, are one stream of tokens cut into
  blocks. A quota takes every block as often as it covers them all, then the blocks with
  the smallest seeded hashes.
* Settling (``settle``; the pipeline's mix): where whole blocks miss a source's target by
  more than a word, its blocks are taken in the same order up to the target's words, the
  last of them in part. Seats and placements still tell of whole blocks.

Only the per-source and per-block tables (their size is set by the parameters, not by the
data) are gathered; documents get their place in the stream from prefix sums over 4096
hash ranges per source, so a hot source is spread over many tasks.

Defined results: NULL or negative sizes count 0; a NULL source is a source of its own; a
source without tokens has target 0; an empty table gives no rows; rows with equal keys
and sizes are interchangeable; input columns named like an output are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adfunnel.llm.common import WORD, checkpointed, word_count

P = "__mix_"
OUTPUTS = ("size", "source_size", "target", "taken")
MAX_BROADCAST_SOURCES = 50_000


@dataclass(frozen=True)
class Mix:
    """``sources``: targets and quotas; ``seats``: each block won and its shard;
    ``blocks``: how often each block of a source's stream is taken; ``documents``: the
    input rows with size, source_size, target and taken; ``block_tokens``: block size."""

    sources: DataFrame
    seats: DataFrame
    blocks: DataFrame
    documents: DataFrame
    block_tokens: int

    def placements(self) -> DataFrame:
        """(source, block, epoch, shard) of every block instance of the mix."""
        b = self.blocks.withColumn("epoch", F.explode(F.expr("sequence(0, greatest(times, 1) - 1)"))) \
                       .where("times > 0")
        b = b.withColumn("seat", F.col("epoch") * F.col("n_blocks") + F.col("turn") - 1)
        return b.join(self.seats.select("sid", "seat", "shard"), ["sid", "seat"]) \
                .select("source", "block", "epoch", "shard")


def source_targets(per_source: DataFrame, total: int, weights: tuple[int, ...], share: float,
                   epochs: int) -> DataFrame:
    """``per_source`` (source, source_size) with sid, weight and target."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cases = F.element_at(F.array(*[F.lit(int(w)) for w in weights]),
                         ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    s = per_source.withColumn("sid", F.row_number().over(by_name)).withColumn("weight", cases)
    s = s.withColumn("cap", F.col("source_size") * epochs)
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    upto = Window.orderBy("ratio", "sid").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("ratio", "sid").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.lit(share * total) - F.coalesce(F.sum("cap").over(upto), F.lit(0))) \
        / F.sum("weight").over(onward)
    s = s.withColumn("level", level)
    # the first source, by ratio, whose level does not exceed its own cap sets the level
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "sid", "level"))) \
        .over(Window.partitionBy())
    water = F.coalesce(first["level"], F.lit(float("inf")))
    return s.withColumn("target", F.least(F.col("cap").cast("double"), water * F.col("weight"))) \
            .select("sid", "source", "source_size", "weight", "target")


def mix_sources(docs: DataFrame, key: str, source: str, size: Column, *,
                weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, epochs: int = 2,
                shards: int = 40, blocks_per_shard: int = 1000, seed: str = "mix",
                settle: bool = False) -> Mix:
    """Mix ``docs`` (any columns; ``key`` seeds the order) to the target weights."""
    keep = [c for c in docs.columns if c not in OUTPUTS]
    rows = docs.withColumn(P + "size", F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0))) \
               .withColumn(P + "hash", F.md5(F.concat(
                   F.lit(seed + "|"), F.coalesce(F.col(key).cast("string"), F.lit("")))
                   .cast("binary"))) \
               .withColumn(P + "range", F.substring(P + "hash", 1, 3))
    ranges = checkpointed(rows.groupBy(F.col(source).alias("source"), P + "range")
                          .agg(F.sum(P + "size").alias(P + "sum")))
    per_source = ranges.groupBy("source").agg(F.sum(P + "sum").alias("source_size"))
    total, n_sources = per_source.agg(F.sum("source_size"), F.count(F.lit(1))).first()
    total = int(total or 0)
    block = max(1, math.ceil(share * total / (shards * blocks_per_shard)))
    seats_n = max(1, math.floor(share * total / block + 0.5))

    targets = checkpointed(source_targets(per_source, total, weights, share, epochs))
    bids = targets.where("target > 0") \
        .withColumn("n_blocks", F.expr(f"(source_size + {block - 1}) div {block}")) \
        .withColumn("seat", F.explode(F.expr(
            f"sequence(0L, least({epochs} * n_blocks, 2 * cast(ceil(target / {block}) AS bigint) + 2) - 1)")))
    bids = bids.withColumn("won", F.row_number().over(Window.orderBy(
        (F.col("target") / (2 * F.col("seat") + 1)).desc(), F.col("sid"), F.col("seat"))))
    seats = checkpointed(bids.where(F.col("won") <= seats_n).select(
        "sid", "source", "n_blocks", "seat",
        F.expr(f"cast(((won - 1) * {shards}) div {seats_n} AS int)").alias("shard")))
    quotas = seats.groupBy("sid").agg(F.count(F.lit(1)).alias("quota"))

    cut = targets.join(quotas, "sid", "left").fillna({"quota": 0}).where("source_size > 0") \
        .withColumn("n_blocks", F.expr(f"(source_size + {block - 1}) div {block}")) \
        .withColumn("block", F.explode(F.expr("sequence(0L, n_blocks - 1)")))
    turn = Window.partitionBy("sid").orderBy(
        F.md5(F.concat(F.lit(seed + "|block|"), F.col("sid").cast("string"), F.lit("|"),
                       F.col("block").cast("string")).cast("binary")), "block")
    cut = cut.withColumn("turn", F.row_number().over(turn))
    cut = cut.withColumn("times", F.expr("quota div n_blocks + int(turn <= quota % n_blocks)"))
    length = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    cut = cut.withColumn("part", F.lit(0).cast("long"))
    if settle:
        won = F.sum(F.col("times") * length).over(Window.partitionBy("sid"))
        earlier = Window.partitionBy("sid").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
        cut = cut.withColumn("words", F.round("target").cast("long")) \
            .withColumn("open", F.abs(F.col("target") - won) > 1) \
            .withColumn("rest", F.expr("words % source_size") - F.coalesce(F.sum(length).over(earlier), F.lit(0)))
        cut = cut.withColumn("times", F.when(F.col("open"), F.expr("words div source_size")
                                             + (F.col("rest") >= length).cast("long")).otherwise(F.col("times"))) \
            .withColumn("part", F.when(F.col("open") & (F.col("rest") > 0) & (F.col("rest") < length), F.col("rest"))
                        .otherwise(F.col("part")))
    along = Window.partitionBy("sid").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("before", F.coalesce(F.sum(F.col("times") * length + F.col("part")).over(along), F.lit(0)))
    blocks = checkpointed(cut.select("sid", "source", "n_blocks", "block", "turn", "times", "before",
                                     "part", (F.col("times") * length + F.col("part")).alias("taken")))

    cells = blocks.groupBy("sid").agg(
        F.sort_array(F.collect_list(F.struct("block", "times", "before", "part"))).alias(P + "cells"),
        F.sum("taken").alias(P + "all"))
    lookup = targets.join(cells, "sid", "left").select(
        F.col("source").alias(P + "source"), F.col("source_size").alias(P + "source_size"),
        F.col("target").alias(P + "target"),
        F.col(P + "cells.times").alias(P + "times"), F.col(P + "cells.before").alias(P + "before"),
        F.col(P + "cells.part").alias(P + "parts"),
        F.coalesce(P + "all", F.lit(0)).alias(P + "all"))
    if n_sources <= MAX_BROADCAST_SOURCES:  # at most that many rows, shards * blocks_per_shard cells
        lookup = F.broadcast(lookup)

    start = Window.partitionBy("source").orderBy(P + "range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select(F.col("source").alias(P + "s"), F.col(P + "range").alias(P + "r"),
                           F.coalesce(F.sum(P + "sum").over(start), F.lit(0)).alias(P + "start"))
    inside = Window.partitionBy(F.col(f"`{source}`"), P + "range").orderBy(P + "hash", P + "size") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn(P + "end", F.sum(P + "size").over(inside)) \
        .join(starts, F.col(f"`{source}`").eqNullSafe(F.col(P + "s"))
              & (F.col(P + "range") == F.col(P + "r"))) \
        .withColumn(P + "end", F.col(P + "start") + F.col(P + "end")) \
        .withColumn(P + "begin", F.col(P + "end") - F.col(P + "size")) \
        .join(lookup, F.col(f"`{source}`").eqNullSafe(F.col(P + "source")))

    def upto(at: str) -> Column:  # tokens taken from the stream before position ``at``
        i = f"cast({P}{at} div {block} AS int)"
        return F.expr(f"coalesce(get({P}before, {i}) + get({P}times, {i}) * ({P}{at} % {block})"
                      f" + least({P}{at} % {block}, get({P}parts, {i})), {P}all)")

    out = placed.withColumn("taken", upto("end") - upto("begin"))
    names = [F.col(f"`{c}`") for c in keep]
    documents = out.select(*names, F.col(P + "size").alias("size"),
                           F.col(P + "source_size").alias("source_size"),
                           F.col(P + "target").alias("target"), "taken",
                           F.col(P + "begin"), F.col(P + "times"), F.col(P + "parts"))
    return Mix(targets.join(quotas, "sid", "left").fillna({"quota": 0}), seats, blocks, documents, block)


def document_mix(documents: DataFrame, **params) -> DataFrame:
    """The mix of ``documents`` by words, as digest columns."""
    narrow = checkpointed(documents.select("doc_id", "source", word_count(F.col("text")).alias("words")))
    mix = mix_sources(narrow, "doc_id", "source", F.col("words"), settle=True, **params)
    return mix.documents.select("doc_id", *OUTPUTS)


def mixed_texts(documents: DataFrame, **params) -> DataFrame:
    """The mix itself, settled: rows of ``documents``, one per document and epoch it is taken in.

    ``text`` holds the words of the taken blocks (the untouched text where all of them
    are) and ``n_chars``, where present, its length.
    """
    mix = mix_sources(documents, "doc_id", "source", word_count(F.col("text")), settle=True, **params)
    epochs = params.get("epochs", 2)
    b = mix.block_tokens
    d = mix.documents.where("taken > 0")
    for name, of in (("span", "times"), ("edge", "parts")):
        d = d.withColumn(P + name, F.expr(
            f"slice({P}{of}, cast({P}begin div {b} AS int) + 1, "
            f"cast(({P}begin + size - 1) div {b} - {P}begin div {b} AS int) + 1)"))
    d = d.withColumn(P + "epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs)))) \
         .where((F.array_max(P + "span") >= F.col(P + "epoch"))
                | F.expr(f"exists({P}edge, x -> x > 0)"))
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))

    def taken(w: Column, i: Column) -> Column:
        at = F.floor((F.col(P + "begin") % b + i) / b).cast("int")
        again = (F.col(P + "begin") + i) % b < F.get(F.col(P + "edge"), at)
        return F.get(F.col(P + "span"), at) + again.cast("long") >= F.col(P + "epoch")

    whole = F.array_min(P + "span") >= F.col(P + "epoch")
    d = d.withColumn(P + "some", F.when(~whole, F.filter(words, taken))) \
         .where(whole | (F.size(P + "some") > 0))
    d = d.withColumn("text", F.when(whole | (F.size(P + "some") == F.col("size")), F.col("text"))
                     .otherwise(F.array_join(P + "some", " ")))
    if "n_chars" in documents.columns:
        d = d.withColumn("n_chars", F.length("text").cast("long"))
    return d.select(*documents.columns)


# The same rows as DuckDB SQL (documents is a view). Fixed values as in the query.
SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix|' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) AS sid
  FROM d GROUP BY source),
g AS (
  SELECT sum(source_size)::BIGINT AS total,
         greatest(1, ceil(1.5 * sum(source_size)::DOUBLE / 40000))::BIGINT AS b FROM s0),
g2 AS (SELECT *, greatest(1, floor(1.5 * total::DOUBLE / b + 0.5))::BIGINT AS n FROM g),
s1 AS (SELECT s0.*, [3, 1, 2][((sid - 1) % 3 + 1)::INT] AS weight, 2 * source_size AS cap FROM s0),
s2 AS (SELECT s1.*, cap::DOUBLE / weight AS ratio FROM s1),
s3 AS (
  SELECT s2.*,
         (1.5::DOUBLE * (SELECT total FROM g) - coalesce(sum(cap) OVER w, 0)::DOUBLE)
           / sum(weight) OVER v::DOUBLE AS level
  FROM s2
  WINDOW w AS (ORDER BY ratio, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         v AS (ORDER BY ratio, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
lv AS (SELECT level FROM s3 WHERE level <= ratio ORDER BY ratio, sid LIMIT 1),
t AS (
  SELECT sid, source, source_size,
         least(cap::DOUBLE, coalesce((SELECT level FROM lv), 'Infinity'::DOUBLE) * weight) AS target,
         (source_size + b - 1) // b AS n_blocks, b, n
  FROM s3, g2),
bids AS (
  SELECT sid, unnest(range(0, least(2 * n_blocks, 2 * ceil(target / b)::BIGINT + 2))) AS seat, target, n
  FROM t WHERE target > 0),
won AS (
  SELECT sid, row_number() OVER (ORDER BY target / (2 * seat + 1) DESC, sid, seat) AS r, n FROM bids),
q AS (SELECT sid, count(*) AS quota FROM won WHERE r <= n GROUP BY sid),
bl AS (
  SELECT t.sid, t.b, t.n_blocks, t.source_size, t.target, coalesce(q.quota, 0) AS quota,
         unnest(range(0, t.n_blocks)) AS block
  FROM t LEFT JOIN q USING (sid) WHERE source_size > 0),
bt AS (
  SELECT *, least(b, source_size - block * b) AS length,
         row_number() OVER (PARTITION BY sid ORDER BY md5('mix|block|' || sid || '|' || block), block) AS turn
  FROM bl),
bw AS (
  SELECT *, quota // n_blocks + CASE WHEN turn <= quota % n_blocks THEN 1 ELSE 0 END AS won,
         round(target)::BIGINT AS words,
         round(target)::BIGINT % source_size - coalesce(sum(length) OVER (PARTITION BY sid ORDER BY turn
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
  FROM bt),
bo AS (SELECT *, abs(target - sum(won * length) OVER (PARTITION BY sid)) > 1 AS off FROM bw),
bs AS (
  SELECT *, CASE WHEN off THEN words // source_size + CASE WHEN rest >= length THEN 1 ELSE 0 END ELSE won END AS times,
         CASE WHEN off AND rest > 0 AND rest < length THEN rest ELSE 0 END AS part
  FROM bo),
bb AS (
  SELECT *, coalesce(sum(times * length + part) OVER (PARTITION BY sid ORDER BY block
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM bs),
al AS (SELECT sid, sum(times * length + part) AS everything FROM bs GROUP BY sid),
p AS (
  SELECT d.doc_id, d.size, t.sid, t.source_size, t.target, t.b,
         sum(d.size) OVER (PARTITION BY t.sid ORDER BY d.h, d.size
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS e
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT p.doc_id, p.size, p.source_size, p.target,
       (coalesce(x.before + x.times * (p.e % p.b) + least(p.e % p.b, x.part), al.everything, 0)
        - coalesce(y.before + y.times * ((p.e - p.size) % p.b) + least((p.e - p.size) % p.b, y.part),
                   al.everything, 0))::BIGINT AS taken
FROM p LEFT JOIN al ON al.sid = p.sid
LEFT JOIN bb x ON x.sid = p.sid AND x.block = p.e // p.b
LEFT JOIN bb y ON y.sid = p.sid AND y.block = (p.e - p.size) // p.b
"""
