"""Vector columns: which rows take part, bounded samples, k-means, bounded pieces of cells."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adfunnel.llm.textbytes import mix64

PIECE = 4096  # rows of a cell that stay together
SHARD = 8192  # rows of one group at least filled up to this
QUERY_GROUP = 4096


def usable_vectors(df: DataFrame, id_col: str, vec_col: str, allow_zero: bool) -> DataFrame:
    """(id, vec array<double>) of rows with an id and a vector of finite components.

    Vectors whose length is not the commonest one (the longer of equally common) are left out.
    """
    v = F.col(vec_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = df.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(finite)
    if not allow_zero:
        rows = rows.where(F.exists(v, lambda x: x != 0))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("vec"))
    common = rows.groupBy(F.size("vec").alias("d")).count() \
        .orderBy(F.col("count").desc(), F.col("d").desc()).first()
    return rows.where(F.size("vec") == (common["d"] if common else -1))


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy().reshape(n, -1) if n else np.zeros((0, 1))


def sample_matrix(rows: DataFrame, most: int) -> np.ndarray:
    """At most ``most`` vectors, in order of a seeded hash of their ids (reruns agree)."""
    t = rows.orderBy(F.xxhash64(F.lit(3), "id"), "id").limit(most).select("vec").toArrow()
    return matrix(t.column("vec"))


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1) - 2 * (x @ centres.T), axis=1)


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """At most ``k`` centres by Lloyd's method from seeded rows; empty ones are dropped."""
    if not len(x):
        return np.zeros((1, x.shape[1]))
    centres = x[np.random.default_rng(5).permutation(len(x))[:k]].astype(float)
    for _ in range(rounds):
        of = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        count = np.bincount(of, minlength=len(centres))
        centres = sums[count > 0] / count[count > 0, None]
    return centres


def packed(counts: dict[int, int]) -> dict[int, tuple[int, int, int]]:
    """cell -> (first shard, first piece in it, pieces): cells in order, cut into pieces of
    about ``PIECE`` rows, pieces laid into shards of about ``SHARD`` rows."""
    out, piece, per = {}, 0, max(1, SHARD // PIECE)
    filled = 0
    for cell in sorted(counts):
        n = counts[cell]
        pieces = -(-n // PIECE)
        if pieces == 1:
            if filled and filled + n > SHARD:
                piece, filled = piece + 1, 0
            out[cell] = (piece, 0, 1)
            filled += n
        else:
            if filled:
                piece, filled = piece + 1, 0
            out[cell] = (piece, 0, pieces)
            piece += -(-pieces // per)
    return out


def laid_out(cells: DataFrame, plan: dict[int, tuple[int, int, int]]) -> DataFrame:
    """``cells`` (id, vec, cell) with ``shard``: a crowded cell's rows go to one of its several,
    by id and vector, so rows of one id are dealt as well."""
    first = np.zeros(max(plan) + 1, np.int64)
    pieces = np.ones(max(plan) + 1, np.int64)
    for cell, (shard, _, n) in plan.items():
        first[cell], pieces[cell] = shard, n
    per = max(1, SHARD // PIECE)

    def run(batches):
        for batch in batches:
            cell = batch.column(2).to_numpy()
            bits = matrix(batch.column(1)).view(np.uint64) if len(cell) else np.zeros((0, 1), np.uint64)
            odd = mix64(np.arange(bits.shape[1], dtype=np.uint64)) | np.uint64(1)
            with np.errstate(over="ignore"):
                row = batch.column(0).to_numpy().view(np.uint64) + mix64((bits * odd).sum(1, dtype=np.uint64))
            turn = mix64(row) % pieces[cell].astype(np.uint64)
            shard = first[cell] + turn.astype(np.int64) // per
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard.astype(np.int32))],
                                             ["id", "vec", "cell", "shard"])

    return cells.mapInArrow(run, "id long, vec array<double>, cell int, shard int")


def shards_of(cell: int, plan: dict[int, tuple[int, int, int]]) -> range:
    first, _, pieces = plan[cell]
    return range(first, first + -(-pieces // max(1, SHARD // PIECE)))
