"""Embedding whitening from the bidiagonal form of a distributed QR.

Vectors become integers; every distinct one is in the fit list once. Blocks of the centred
fit list are reduced to triangular factors inside the tasks, the factors of eight tasks at a
time to one, until one is left (its order is the number of dimensions). The covariance is
never formed: ``bidiagonal`` finds singular values by dqds and directions by twisted
factorisations. Rows are centred exactly (``n * x - S`` in integers) before anything is
multiplied.

Defined results: rows whose vector is NULL, empty, or holds NULL, NaN, infinite or
beyond-2^52 scaled entries take no part, nor do those of an uncommon length (the commonest
counts, the longer of equally common ones); rows without an id and repeated rows are
returned like any other; components whose variance is nothing beside the largest (a singular
value below 1e-12 of it) are left out, so a fit list of equal vectors, one vector or none
gives no rows; ``deviation`` is NULL where it exceeds a long (``deviation_exact`` holds it
then); other columns are ignored. The sign of a component makes its largest entry positive.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adfunnel.llm.bidiagonal import bidiagonalised, right_vectors, squared_singular_values
from adfunnel.llm.common import checkpointed, stored
from adfunnel.llm.vectors import matrix

COMPONENTS = 16
SCALE, OFFSET = 64, 1_000_000  # fixed values of the contract
FAN = 8  # triangular factors reduced together
RANK = 1e-12
BLOCK = 4096  # rows of one QR

SCHEMA = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
          "identity_error double, deviation_exact decimal(38,0)")


class Model(NamedTuple):
    n: int
    sums: list[int]
    directions: np.ndarray  # dimensions x components, unit columns
    variances: np.ndarray
    trace: float


def integer_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, x array<long>) of the rows that take part."""
    v = F.col(f"`{vec_col}`")
    rows = df.where(v.isNotNull() & (F.size(v) > 0)) \
        .where(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < 2.0 ** 46))) \
        .select(F.col(f"`{id_col}`").cast("long").alias("vec_id"),
                F.transform(v, lambda c: F.floor(c.cast("double") * SCALE) + OFFSET).alias("x"))
    common = rows.groupBy(F.size("x").alias("d")).count() \
        .orderBy(F.col("count").desc(), F.col("d").desc()).first()
    return rows.where(F.size("x") == (common["d"] if common else -1))


def scaled_offsets(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums``, exactly: 64-bit integers where they hold it, else Python's."""
    small = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums), default=0)) < 2 ** 62
    return x * n - np.array(sums, np.int64) if small else x.astype(object) * n - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    y = scaled_offsets(x, n, sums)
    return (y / n).astype(float)


def _sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Size of the fit list and its exact sums per dimension."""
    def run(batches):
        n, total = 0, None
        for batch in batches:
            x = matrix(batch.column(0))
            if len(x):  # halves keep the sum of a batch inside 64 bits
                part = [(int(h) << 32) + int(l) for h, l in zip((x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0))]
                n, total = n + len(x), part if total is None else [a + b for a, b in zip(total, part)]
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([n] * len(total)), pa.array(range(len(total)), pa.int32()),
                 pa.array(total, pa.decimal128(38, 0))], ["n", "dim", "total"])

    rows = fit.mapInArrow(run, "n long, dim int, total decimal(38,0)") \
        .groupBy("dim").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total")) \
        .orderBy("dim").collect()  # one row per dimension
    return (rows[0]["n"], [int(r["total"]) for r in rows]) if rows else (0, [])


def _triangle(blocks) -> np.ndarray | None:
    """The triangular factor of all rows of ``blocks``, a block at a time."""
    r = None
    for block in blocks:
        for at in range(0, len(block), BLOCK):
            part = block[at:at + BLOCK]
            r = np.linalg.qr(part if r is None else np.vstack([r, part]), mode="r")
    return r


def triangular_factor(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """``R`` of the QR of the centred fit list, reduced ``FAN`` factors at a time."""
    d, schema = len(sums), "task long, r array<double>"

    def row(task: int, r: np.ndarray) -> dict[str, pa.Array]:
        whole = np.zeros((d, d))
        whole[:len(r)] = r
        return {"task": pa.array([task], pa.int64()),
                "r": pa.array([whole.ravel()], pa.list_(pa.float64()))}

    def reduce_rows(batches):
        from pyspark import TaskContext
        r = _triangle(centred(matrix(batch.column(0)), n, sums) for batch in batches if batch.num_rows)
        if r is not None:
            yield pa.RecordBatch.from_pydict(row(TaskContext.get().partitionId(), r))

    def reduce_factors(key, table):
        table = table.sort_by("task")
        return pa.table(row(key[0].as_py(), _triangle(matrix(table["r"]).reshape(-1, d, d))))

    factors = checkpointed(fit.mapInArrow(reduce_rows, schema))
    while factors.count() > FAN:
        ranks = factors.select(F.floor(F.col("task") / FAN).cast("long").alias("task"), "r")
        factors = checkpointed(ranks.groupBy("task").applyInArrow(reduce_factors, schema))
    return _triangle([np.array(f["r"]).reshape(d, d) for f in factors.orderBy("task").collect()])


def fitted(fit: DataFrame, components: int = COMPONENTS) -> Model:
    """The whitening of a table of distinct integer vectors (one column)."""
    n, sums = _sums(fit)
    if n < 2:
        return Model(n, sums, np.zeros((len(sums), 0)), np.zeros(0), 0.0)
    r = triangular_factor(fit, n, sums)
    whole = np.zeros((len(sums), len(sums)))
    whole[:len(r)] = r
    diagonal, above, right = bidiagonalised(whole)
    squares = np.maximum(squared_singular_values(diagonal, above), 0.0)
    wanted = int((squares[:components] > squares[0] * RANK ** 2).sum()) if squares[0] > 0 else 0
    vectors = right @ right_vectors(diagonal, above, squares, wanted)
    if wanted:
        top = np.abs(vectors).argmax(0)
        vectors = vectors * np.sign(vectors[top, np.arange(wanted)])
    return Model(n, sums, vectors, squares[:wanted] / n, float((whole * whole).sum()) / n)


def identity_error(fit: DataFrame, model: Model) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity."""
    n, sums, directions, k = model.n, model.sums, model.directions / np.sqrt(model.variances), len(model.variances)

    def run(batches):
        total, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = centred(matrix(batch.column(0)), n, sums) @ directions if batch.num_rows else np.zeros((0, k))
            total, products = total + w.sum(0), products + w.T @ w
        i, j = np.divmod(np.arange(k * k), k)
        yield pa.RecordBatch.from_pydict({"i": pa.array(i), "j": pa.array(j), "product": pa.array(products.ravel()),
                                          "total": pa.array(total[i])})

    rows = fit.mapInArrow(run, "i long, j long, product double, total double").groupBy("i", "j") \
        .agg(F.sum("product").alias("product"), F.sum("total").alias("total")).collect()  # components squared
    mean = {r["i"]: r["total"] / n for r in rows}
    return max((abs(r["product"] / n - mean[r["i"]] * mean[r["j"]] - (r["i"] == r["j"])) for r in rows), default=0.0)


def whitened_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                     components: int = COMPONENTS) -> DataFrame:
    """SCHEMA: every row that takes part, in each component, by the whitening of the distinct vectors."""
    rows = integer_vectors(df, id_col, vec_col)
    fit = stored(rows.select("x").distinct())
    model = fitted(fit, components)
    n, sums, k = model.n, model.sums, len(model.variances)
    if not k:
        return rows.sparkSession.createDataFrame([], SCHEMA)
    error = identity_error(fit, model)
    directions, explained = model.directions / np.sqrt(model.variances), model.variances / model.trace

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            y = scaled_offsets(matrix(batch.column(1)), n, sums)
            if y.dtype != object and float(np.abs(y).max()) ** 2 * y.shape[1] >= 2.0 ** 62:
                y = y.astype(object)
            exact = (y * y).sum(1).tolist()
            w = (y / n).astype(float) @ directions
            at, m = np.repeat(np.arange(len(w)), k), len(w)
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column(0).take(pa.array(at)), "component": pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                "n": pa.array(np.full(m * k, n)),
                "deviation": pa.array([v if v < 2 ** 63 else None for v in exact], pa.int64()).take(pa.array(at)),
                "whitened": pa.array(w.ravel()), "explained": pa.array(np.tile(explained, m)),
                "identity_error": pa.array(np.full(m * k, error)),
                "deviation_exact": pa.array([v if v < 10 ** 38 else None for v in exact], pa.decimal128(38, 0)).take(pa.array(at))})

    return rows.mapInArrow(run, SCHEMA)
