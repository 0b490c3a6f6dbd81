"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text's terms are 4-grams of character classes (small and capital letters, digits,
spaces, line ends, kinds of signs) hashed into ``BUCKETS`` columns, and repeated
neighbouring words. Term weights are square roots of relative frequencies times the
inverse document frequency over all documents. A truncated SVD of a bounded labelled
sample (``per_class`` rows of each class, a parameter) gives the latent axes; the axes
and the sample's latent vectors are broadcast (their size depends on the parameters
only). Every document is compared with every labelled vector by exact cosine in blocks,
and its ``neighbours`` nearest vote with their similarity as weight.

Defined results: a NULL or empty text has no terms and scores the sample's mean label;
a NULL doc_id is not held out; without any usable label every score is 0.5; repeated
rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adfunnel.llm.labelled import fold, sample_texts, training_sample
from adfunnel.llm.textbytes import lowered, per_row, span_hashes, text_runs, words

BUCKETS = 4096
TERMS = BUCKETS + 2  # and: word equal to the one before, word unlike it
PER_CLASS = 2000
AXES = 64
NEIGHBOURS = 15


def _classes() -> np.ndarray:
    c = np.array([10 + b % 6 for b in range(256)], np.uint32)
    c[97:123] = c[128:] = 1
    c[65:91] = 2
    c[48:58] = 3
    c[32] = 4
    c[[9, 10, 11, 12, 13]] = 5
    c[46], c[44], c[33], c[124] = 6, 7, 8, 9
    return c


_CLASS = _classes()
_BUCKET = ((np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
           >> np.uint64(52)).astype(np.uint16)


def term_counts(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """``(first row, counts)`` per run of rows; counts is rows x TERMS (float32)."""
    for first, last, buf, starts in text_runs(column):
        c = _CLASS[buf]
        gram = _BUCKET[(c[:-3] << 12) | (c[1:-2] << 8) | (c[2:-1] << 4) | c[3:]] if len(c) > 3 else c[:0]
        a, b = words(buf)
        h = span_hashes(lowered(buf), a, b)
        of = per_row(starts, a)
        for lo in range(0, last - first, 256):
            hi = min(lo + 256, last - first)
            counts = np.zeros((hi - lo, TERMS), np.float32)
            for i in range(lo, hi):
                g = gram[starts[i]:max(starts[i], starts[i + 1] - 4)]
                if len(g):
                    counts[i - lo, :BUCKETS] = np.bincount(g, minlength=BUCKETS)
                w = h[of[i]:of[i + 1]]
                if len(w) > 1:
                    same = np.count_nonzero(w[1:] == w[:-1])
                    counts[i - lo, BUCKETS:] = 4 * same, len(w) - 1 - same
            yield first + lo, counts


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def document_frequencies(documents: DataFrame) -> tuple[np.ndarray, int]:
    """Over all documents: how many hold each term, and their number."""
    def count(batches):
        df, n = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, counts in term_counts(batch.column(0)):
                df += (counts > 0).sum(0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(TERMS + 1)), pa.array(np.append(df, n))], ["term", "n"])

    rows = documents.select("text").mapInArrow(count, "term long, n long") \
        .groupBy("term").agg(F.sum("n").alias("n")).collect()  # TERMS + 1 rows
    out = np.zeros(TERMS + 1, np.int64)
    for r in rows:
        out[r["term"]] = r["n"]
    return out[:-1], int(out[-1])


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    axes: np.ndarray  # TERMS x AXES
    vectors: np.ndarray  # labelled rows x AXES, unit length
    labels: np.ndarray

    @property
    def prior(self) -> float:
        return float(self.labels.mean()) if len(self.labels) else 0.5


def latent_axes(x: np.ndarray, axes: int) -> np.ndarray:
    """Right singular vectors of ``x`` by randomised subspace iteration (fixed seed)."""
    k = min(axes, *x.shape)
    y = x @ np.random.default_rng(1).standard_normal((x.shape[1], min(k + 16, x.shape[1])), np.float32)
    for _ in range(3):
        q, _ = np.linalg.qr(y)
        q, _ = np.linalg.qr(x.T @ q)
        y = x @ q
    q, _ = np.linalg.qr(y)
    _, _, vt = np.linalg.svd(q.T @ x, full_matrices=False)
    return np.ascontiguousarray(vt[:k].T)


def latent(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    z = x @ axes
    return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)


def fit(documents: DataFrame, sample: DataFrame) -> Model:
    df, n = document_frequencies(documents)
    idf = np.log((n + 1) / (df + 1)).astype(np.float32) + np.float32(1)

    def vectors(batches):
        for batch in batches:
            ids, ys = batch.column(0), batch.column(2)
            for first, counts in term_counts(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(counts)), ys.slice(first, len(counts)),
                     pa.array([r.astype(np.float32).tobytes() for r in counts], pa.binary())],
                    ["doc_id", "y", "counts"])

    rows = sample_texts(documents, sample).select("doc_id", "text", "y") \
        .mapInArrow(vectors, "doc_id long, y int, counts binary").orderBy("doc_id").collect()
    if not rows:
        return Model(idf, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    x = weigh(np.stack([np.frombuffer(r["counts"], np.float32) for r in rows]), idf)
    y = np.array([r["y"] for r in rows], float)
    axes = latent_axes(x, AXES)
    return Model(idf, axes, latent(x, axes), y)


def model_parts(model: Model) -> tuple:
    """What a broadcast holds: executors may lack this package, so no class of it."""
    return model.idf, model.axes, model.vectors, model.labels


def vote(z: np.ndarray, model: Model, neighbours: int) -> np.ndarray:
    """Similarity-weighted labels of the nearest labelled vectors."""
    if not len(model.labels):
        return np.full(len(z), 0.5)
    sims = z @ model.vectors.T
    k = min(neighbours, sims.shape[1])
    near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    w = np.maximum(np.take_along_axis(sims, near, 1), 0).astype(float) ** 4
    total = w.sum(1)
    return np.where(total > 0, (w * model.labels[near]).sum(1) / np.maximum(total, 1e-300), model.prior)


def score_quality(documents: DataFrame, model: Model, neighbours: int = NEIGHBOURS) -> DataFrame:
    """``documents`` (its columns kept) with ``score``."""
    shared = documents.sparkSession.sparkContext.broadcast(model_parts(model))
    keep = [c for c in documents.columns if c != "score"]
    source = documents.select(*[F.col(f"`{c}`") for c in keep])
    at = keep.index("text")

    def run(batches):
        m = Model(*shared.value)
        for batch in batches:
            out = np.empty(batch.num_rows)
            for first, counts in term_counts(batch.column(at)):
                s = vote(latent(weigh(counts, m.idf), m.axes), m, neighbours)
                out[first:first + len(counts)] = np.where(counts.any(1), s, m.prior)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*keep, "score"])

    schema = T.StructType([*source.schema.fields, T.StructField("score", T.DoubleType())])
    return source.mapInArrow(run, schema)


def trained(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    usable = fold(F.col("doc_id"), 3) != 1
    sample = training_sample(labels, "quality", usable, {0: per_class, 1: per_class})
    return fit(documents, sample)


def document_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    model = trained(documents, labels)
    scored = score_quality(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
