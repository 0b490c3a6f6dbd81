"""Approximate nearest neighbours by an inverted multi-index.

Both halves of the vectors are quantised separately by k-means on a bounded sample
(``SAMPLE`` rows, a parameter); a row's cell is its pair of half codes, and every row is
indexed. A query orders the centroids of each half by how far their inner product falls
short of the best one, and walks the pairs by the sum of both distances with a heap until
the cells it passed hold its budget of distinct vectors (copies are ranked but cost nothing,
so a crowd of them does not keep a query from other cells). All rows of those cells are
ranked by the exact inner product on the original vectors.

Cells are laid into shards of bounded size (crowded cells are dealt over several by a hash
of the id); a query is sent once to each shard it visits, queries in bounded groups. The
cell table has at most ``CODES``^2 entries.

Defined results: NULL, zero or non-finite vectors, vectors of an uncommon length and rows
without an id take no part; rows with the query's id are never its neighbours; a repeated
id counts once per query, at its best score; equal scores go to the smaller id; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adfunnel.llm.common import checkpointed
from adfunnel.llm.vectors import (
    QUERY_GROUP, kmeans, laid_out, matrix, nearest, packed, sample_matrix, shards_of, usable_vectors,
)

SAMPLE = 20_000
CODES = 128  # of each half
SHARE = 0.4  # rows a query ranks, as a share of all; see the README for recall
LEAST = 2000  # and at least so many


def walk(du: np.ndarray, dv: np.ndarray, counts: np.ndarray, budget: int) -> list[int]:
    """Cells ``u * len(dv) + v`` by ascending ``du[u] + dv[v]`` until their ``counts`` reach ``budget``."""
    us, vs = np.argsort(du, kind="stable"), np.argsort(dv, kind="stable")
    a, b = du[us].tolist(), dv[vs].tolist()
    us, vs, width = us.tolist(), vs.tolist(), len(dv)
    heap, out, held = [(a[0] + b[0], 0, 0)], [], 0
    while heap and held < budget:
        _, i, j = heapq.heappop(heap)
        cell = us[i] * width + vs[j]
        if counts[cell]:
            out.append(cell)
            held += counts[cell]
        if j + 1 < width:
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):  # each pair has one way to be reached
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return out


def exact_products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products summed in component order (equal vectors, equal scores)."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * q[d]
    return out


def search(embeddings: DataFrame, id_col: str, vec_col: str, queries: Column, k: int = 20,
           share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows found for every query row."""
    rows = checkpointed(usable_vectors(embeddings.select(id_col, vec_col), id_col, vec_col, False)
                        .dropDuplicates(["id", "vec"]))
    sample = sample_matrix(rows.groupBy("vec").agg(F.min("id").alias("id")), SAMPLE)
    half = sample.shape[1] // 2
    cu = kmeans(sample[:, :half], CODES) if half else np.zeros((1, 0))
    cv = kmeans(sample[:, half:], CODES)
    width = len(cv)

    def assign(batches):
        for batch in batches:
            x = matrix(batch.column(1))
            cell = nearest(x[:, :half], cu) * width + nearest(x[:, half:], cv) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))],
                                             ["id", "vec", "cell"])

    cells = checkpointed(rows.mapInArrow(assign, "id long, vec array<double>, cell int"))
    sizes = {r["cell"]: r["n"] for r in cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    plan = packed(sizes)
    apart = cells.select("cell", F.xxhash64("vec").alias("v")).distinct().groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    apart = {r["cell"]: r["n"] for r in apart.collect()}
    counts = np.zeros(len(cu) * width, np.int64)
    counts[list(apart)] = list(apart.values())
    budget = max(least, int(share * counts.sum())) + 1
    asked = cells.where(queries).select("id", "vec")
    groups = max(1, -(-asked.count() // QUERY_GROUP))

    def visit(batches):
        for batch in batches:
            q = matrix(batch.column(1))
            where, shard, visited = [], [], []
            if len(q):
                du = q[:, :half] @ cu.T
                dv = q[:, half:] @ cv.T
                du, dv = du.max(1, keepdims=True) - du, dv.max(1, keepdims=True) - dv
            for i in range(len(q)):
                by_shard: dict[int, list[int]] = {}
                for cell in walk(du[i], dv[i], counts, budget):
                    for s in shards_of(cell, plan):
                        by_shard.setdefault(s, []).append(cell)
                for s, cs in by_shard.items():
                    where.append(i)
                    shard.append(s)
                    visited.append(np.array(cs, np.int32).tobytes())
            at = pa.array(where, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard, pa.int32()), batch.column(0).take(at), batch.column(1).take(at),
                 pa.array(visited, pa.binary())], ["shard", "id", "vec", "cells"])

    sent = asked.mapInArrow(visit, "shard int, id long, vec array<double>, cells binary") \
        .withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
    entries = laid_out(cells, plan) \
        .withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            x, ids = matrix(left.column("vec")), left.column("id").to_numpy()
            by_id = np.argsort(ids, kind="stable")
            x, ids = x[by_id], ids[by_id]
            head = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))  # first row of each id
            known, of = np.unique(left.column("cell").to_numpy()[by_id], return_inverse=True)
            q, qid = matrix(right.column("vec")), right.column("id").to_numpy()
            for lo in range(0, len(q), 256):
                scores = q[lo:lo + 256] @ x.T
                for i in range(len(scores)):
                    cs = np.frombuffer(right.column("cells")[lo + i].as_py(), np.int32)
                    ok = np.isin(known, cs)[of] & (ids != qid[lo + i])
                    s = np.where(ok, scores[i], -np.inf)
                    once = np.maximum.reduceat(s, head)
                    m = min(k, int((once > -np.inf).sum()))
                    if not m:
                        continue
                    kth = np.partition(once, len(once) - m)[len(once) - m]
                    near = np.flatnonzero(s >= kth - 1e-9 * max(1.0, abs(kth)))
                    exact = exact_products(x[near], q[lo + i])
                    best = np.lexsort((ids[near], -exact))
                    _, first = np.unique(ids[near][best], return_index=True)
                    best = best[np.sort(first)[:m]]
                    out.append((np.full(len(best), qid[lo + i]), ids[near][best], exact[best]))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()),
                         "score": pa.array(cols[2], pa.float64())})

    found = entries.groupBy("shard", "group").cogroup(sent.groupBy("shard", "group")) \
        .applyInArrow(rerank, "query_id long, vec_id long, score double")
    return ranked(found, k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best partners of every query, equal scores by smaller id."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
