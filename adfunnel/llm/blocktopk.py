"""Exact top-k by integer inner product with block-at-a-time pruning.

Vectors become integer weights ``floor(scale * x)`` of terms (their positions). Rows are
reordered by the nearest of a few k-means centres (fitted on a bounded sample; they only
decide the order) and cut into ranges of ``BLOCK`` rows. A block keeps its forward index
(the integer matrix) and each term's largest and smallest weight. A query bounds a block
by the sum over its terms of weight times that extreme, visits blocks by descending bound,
scores whole blocks through their forward index, and stops at the first block whose bound
falls below its k-th score; blocks that tie with it are still scored, so equal scores are
decided by id.

Blocks lie in shards of bounded size; queries meet every shard in bounded groups (a stated
query set against all rows, in blocks).

Defined results: NULL or non-finite vectors, vectors of an uncommon length and rows without
an id take no part, nor do vectors with a weight of 2^60 or more, zero vectors do; scores
are exact integers whatever their size, and ranked as such (NULL where one does not fit a
long); rows with the query's id are never its partners; a repeated id counts once per query,
at its best score; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adfunnel.llm.common import checkpointed
from adfunnel.llm.multiindex import ranked
from adfunnel.llm.vectors import (
    QUERY_GROUP, kmeans, laid_out, matrix, nearest, packed, sample_matrix, usable_vectors,
)

SAMPLE = 10_000
BLOCK = 256
SCORE = pa.decimal128(38, 0)
LARGEST = 2.0 ** 60  # weights below it are exact in 64 bits, scores of 100 terms in 38 digits


def integer_weights(x: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(scale * x).astype(np.int64)


def exact_type(w: np.ndarray, q: np.ndarray) -> type:
    """The cheapest number type in which all scores of ``w`` and ``q`` are exact."""
    most = float(np.abs(w).max()) * float(np.abs(q).max()) * w.shape[1]
    return np.float64 if most < 2.0 ** 53 else np.int64 if most < 2.0 ** 62 else object


class Blocks:
    """Forward indexes and term extremes of the ranges of one shard."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, cell: np.ndarray):
        order = np.lexsort((ids, cell))
        self.ids, self.weights = ids[order], weights[order]
        self.starts = np.arange(0, len(ids), BLOCK)
        self.high = np.maximum.reduceat(self.weights, self.starts, axis=0)
        self.low = np.minimum.reduceat(self.weights, self.starts, axis=0)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        return np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T

    def top(self, q: np.ndarray, bound: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        ids, scores = np.zeros(0, np.int64), np.zeros(0, q.dtype)
        for b in np.argsort(-bound, kind="stable"):
            if len(ids) >= k and bound[b] < scores[k - 1]:
                break
            rows = slice(self.starts[b], self.starts[b] + BLOCK)
            other = self.ids[rows] != own
            ids = np.concatenate([ids, self.ids[rows][other]])
            scores = np.concatenate([scores, (self.weights[rows] @ q)[other]])
            by_id = np.argsort(ids, kind="stable")
            best = by_id[np.argsort(-scores[by_id], kind="stable")]
            # a repeated id counts once
            _, first = np.unique(ids[best], return_index=True)
            best = best[np.sort(first)[:k]]
            ids, scores = ids[best], scores[best]
        return ids, scores


def search(embeddings: DataFrame, id_col: str, vec_col: str, queries: Column, k: int = 10,
           scale: float = 1024.0) -> DataFrame:
    """(query_id, rank, vec_id, score long): the exact top ``k`` of every query row."""
    rows = usable_vectors(embeddings.select(id_col, vec_col), id_col, vec_col, True)
    rows = checkpointed(rows.where(F.forall("vec", lambda x: F.abs(x * scale) < LARGEST)))
    n = rows.count()
    if not n:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    centres = kmeans(sample_matrix(rows, SAMPLE), int(min(1024, max(1, n // 1024))))

    def assign(batches):
        for batch in batches:
            x = matrix(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(nearest(x, centres).astype(np.int32) if len(x) else [], pa.int32())],
                ["id", "vec", "cell"])

    cells = checkpointed(rows.mapInArrow(assign, "id long, vec array<double>, cell int"))
    sizes = {r["cell"]: r["n"] for r in cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = packed(sizes)
    shards = 1 + max(v[0] + v[2] - 1 for v in plan.values())
    asked = cells.where(queries).select("id", "vec")
    groups = max(1, -(-asked.count() // QUERY_GROUP))
    sent = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))) \
        .withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
    entries = laid_out(cells, plan) \
        .withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        cols: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            w, q = integer_weights(matrix(left.column("vec")), scale), integer_weights(matrix(right.column("vec")), scale)
            exact = exact_type(w, q)
            w, q = w.astype(exact), q.astype(exact)
            blocks = Blocks(left.column("id").to_numpy(), w, left.column("cell").to_numpy())
            bounds = blocks.bounds(q)
            for i, own in enumerate(right.column("id").to_numpy()):
                ids, s = blocks.top(q[i], bounds[i], own, k)
                for c, v in zip(cols, (np.full(len(ids), own), ids, [int(v) for v in s])):
                    c.append(v)
        a, b = (pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in cols[:2])
        return pa.table({"query_id": a, "vec_id": b, "score": pa.array([v for s in cols[2] for v in s], SCORE)})

    found = entries.groupBy("shard", "group").cogroup(sent.groupBy("shard", "group")) \
        .applyInArrow(score, "query_id long, vec_id long, score decimal(38,0)")
    return ranked(found, k).withColumn("score", F.col("score").try_cast("long"))
