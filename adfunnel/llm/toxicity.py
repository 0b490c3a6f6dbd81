"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

1. Terms: letter runs of the text in ASCII small letters, whole and by their first four,
   five and six bytes. From a bounded labelled sample (``SAMPLE`` rows of each class)
   the terms with the strongest log-likelihood ratio for toxic rows become the lexicon
   (at most ``TERMS``, a parameter).
2. Voters: the lexicon dealt into ``LEXICONS`` parts by kind and rank (each votes 1 when
   one of its terms occurs), patterns (four different terms, three hits, dense hits) and
   two voters for 0 (no term, hardly any hit). Votes are one bit each.
3. Label model: EM over the counts of vote patterns of all training-side documents
   estimates the class balance and each voter's accuracy under both classes. Correlations
   between voters given the class are measured from the same pass, and a voter's evidence
   is divided by the number of voters it effectively repeats; EM then runs to its end with
   these weights. Patterns stay a distributed table, a round sends sums to the driver.
4. Classifier: logistic regression on the terms and pattern votes of a bounded sample of
   documents, trained on the posterior labels. It scores every document.

Whole texts are read once; later steps use the list of lexicon terms per document.

Defined results: a NULL or empty text holds no term and scores like any text without
one; a NULL doc_id is held out (the checksum of an empty id is 0); without usable labels of both classes the score is the
known class's rate (0.5 when there is none, else 0.0 or 1.0 smoothed); repeated rows get
equal scores; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adfunnel.llm.common import checkpointed
from adfunnel.llm.labelled import fold, sample_texts, training_sample
from adfunnel.llm.textbytes import (
    letter_runs, lowered, mix64, per_row, span_hashes, text_runs,
)

SAMPLE = {0: 4000, 1: 2500}
FIT_ROWS = 12_000
TERMS = 512
KINDS = (0, 4, 5, 6)  # whole run, first bytes
PARTS = 5  # lexicon voters of each kind
LEXICONS = PARTS * len(KINDS)
PATTERNS = 5
VOTERS = LEXICONS + PATTERNS
DENSE, HARDLY = 0.01, 0.0002  # hits per letter run


def term_keys(buf: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """One 64-bit key per letter run and kind; 0 where a run is too short for a prefix."""
    with np.errstate(over="ignore"):
        out = [span_hashes(buf, a, b)]
        padded = np.append(buf, np.zeros(8, np.uint8))
        code = np.zeros(len(a), np.uint64)
        for i in range(6):
            code = code | (padded[a + i].astype(np.uint64) << np.uint64(8 * i))
            if i + 1 in KINDS:
                key = mix64(code + np.uint64((i + 1) << 56))
                out.append(np.where(b - a > i + 1, key, np.uint64(0)))
    return out


def _rows(column: pa.Array):
    """``(first, last, keys by kind, run bounds per row)`` for batches of texts."""
    for first, last, buf, starts in text_runs(column):
        small = lowered(buf)
        a, b = letter_runs(small)
        yield first, last, term_keys(small, a, b), per_row(starts, a)


def mine_terms(documents: DataFrame, sample: DataFrame, most: int) -> list[tuple[int, int]]:
    """``(kind, key)`` of the terms that mark class 1, the strongest first."""
    def count(batches):
        for batch in batches:
            ys = batch.column(1).to_numpy()
            for first, last, keys, of in _rows(batch.column(0)):
                for kind, key in zip(KINDS, keys):
                    key = key.view(np.int64)
                    held = [np.unique(key[of[i]:of[i + 1]]) for i in range(last - first)]
                    y = np.repeat(ys[first:last], [len(k) for k in held])
                    uniq, inv = np.unique(np.concatenate(held), return_inverse=True)
                    pos = np.bincount(inv, weights=y, minlength=len(uniq)).astype(np.int64)
                    allof = np.bincount(inv, minlength=len(uniq))
                    if len(uniq):
                        pos[uniq == 0] = allof[uniq == 0] = 0  # too short for the prefix
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(uniq), kind, np.int32)), pa.array(uniq),
                         pa.array(pos), pa.array(allof - pos)], ["kind", "key", "pos", "neg"])

    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return []
    c = checkpointed(sample_texts(documents, sample).select("text", "y")
                     .mapInArrow(count, "kind int, key long, pos long, neg long")
                     .where("pos + neg > 0").groupBy("kind", "key")
                     .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    # G statistic against equal rates; the bar rises with the number of terms tried
    held, rate = F.col("pos") + F.col("neg"), n1 / (n1 + n0)
    g = 2 * (F.col("pos") * F.log(F.col("pos") / (held * rate))
             + F.when(F.col("neg") > 0, F.col("neg") * F.log(F.col("neg") / (held * (1 - rate))))
             .otherwise(0.0))
    bar = 2 * np.log(max(c.count(), 2)) + 6
    ratio = (F.col("pos") / n1) / ((F.col("neg") + 0.1) / n0)
    rows = c.where((F.col("pos") > 0) & (ratio > 60)).withColumn("g", g).where(F.col("g") > float(bar)) \
        .orderBy(F.col("g").desc(), "kind", "key").limit(most).collect()
    return [(r["kind"], r["key"]) for r in rows]


def voters_of(terms: list[tuple[int, int]]) -> np.ndarray:
    """The lexicon voter of each term: terms of a kind are dealt by rank."""
    rank = dict.fromkeys(KINDS, 0)
    out = np.zeros(len(terms), np.int64)
    for i, (kind, _) in enumerate(terms):
        out[i] = KINDS.index(kind) * PARTS + rank[kind] % PARTS
        rank[kind] += 1
    return out


def term_hits(documents: DataFrame, terms: list[tuple[int, int]]) -> DataFrame:
    """(doc_id, votes, terms array<int>): each document's votes and lexicon terms, once each."""
    voter = voters_of(terms)

    def find(batches):
        tables = []
        for kind in KINDS:
            pairs = sorted((k, i) for i, (q, k) in enumerate(terms) if q == kind)
            keys = np.array([k for k, _ in pairs], np.int64)
            seen = np.zeros(1 << 16, bool)
            seen[keys.view(np.uint64) >> np.uint64(48)] = True
            tables.append((keys, np.array([i for _, i in pairs], np.int64), seen))
        for batch in batches:
            for first, last, keys, of in _rows(batch.column(1)):
                n = last - first
                hit = np.zeros(int(of[-1]), bool)
                at, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for key, (sorted_keys, index, seen) in zip(keys, tables):
                    maybe = np.flatnonzero(seen[key >> np.uint64(48)])
                    if not len(maybe) or not len(sorted_keys):
                        continue
                    k = key[maybe].view(np.int64)
                    slot = np.minimum(np.searchsorted(sorted_keys, k), len(sorted_keys) - 1)
                    ok = sorted_keys[slot] == k
                    hit[maybe[ok]] = True
                    at.append(maybe[ok])
                    which.append(index[slot[ok]])
                total = np.concatenate([[0], np.cumsum(hit)])
                hits = total[of[1:]] - total[of[:-1]]
                row = np.searchsorted(of, np.concatenate(at), "right") - 1
                found = np.unique(row * max(len(terms), 1) + np.concatenate(which))
                row, term = found // max(len(terms), 1), found % max(len(terms), 1)
                bounds = np.searchsorted(row, np.arange(n + 1))
                votes = np.zeros(n, np.int64)
                if len(terms):
                    np.bitwise_or.at(votes, row, np.int64(1) << voter[term])
                distinct = np.diff(bounds)
                rate = hits / np.maximum(np.diff(of), 1)
                for i, on in enumerate((distinct >= 4, hits >= 3, rate >= DENSE, distinct == 0,
                                        rate < HARDLY)):
                    votes |= on.astype(np.int64) << (LEXICONS + i)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)),
                                                 pa.array(term.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), pa.array(votes), lists],
                    ["doc_id", "votes", "terms"])

    return documents.select("doc_id", "text").mapInArrow(
        find, "doc_id long, votes long, terms array<int>")


def _bits(votes: np.ndarray) -> np.ndarray:
    return ((votes[:, None] >> np.arange(VOTERS)) & 1).astype(float)


@dataclass(frozen=True)
class LabelModel:
    balance: float
    on: np.ndarray  # 2 x VOTERS: P(vote | class)
    discount: np.ndarray  # VOTERS: 1 / (voters it repeats)

    def posterior(self, bits: np.ndarray) -> np.ndarray:
        yes = np.log(self.on[1] / self.on[0]) * self.discount
        no = np.log((1 - self.on[1]) / (1 - self.on[0])) * self.discount
        z = np.log(self.balance / (1 - self.balance)) + no.sum() + bits @ (yes - no)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _expected(patterns: DataFrame, model: LabelModel) -> tuple[np.ndarray, ...]:
    """Expected class sizes (2), votes (2 x VOTERS) and joint votes (2 x VOTERS x VOTERS)."""
    def sums(batches):
        out = np.zeros((2, 1 + VOTERS + VOTERS * VOTERS))
        for batch in batches:
            bits, n = _bits(batch.column(0).to_numpy()), batch.column(1).to_numpy()
            p = model.posterior(bits)
            for k, w in ((0, n * (1 - p)), (1, n * p)):
                out[k, 0] += w.sum()
                out[k, 1:1 + VOTERS] += w @ bits
                out[k, 1 + VOTERS:] += ((bits * w[:, None]).T @ bits).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size)), pa.array(out.ravel())], ["i", "v"])

    total = np.zeros((2, 1 + VOTERS + VOTERS * VOTERS))
    for r in patterns.mapInArrow(sums, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        total.flat[r["i"]] = r["v"]
    return total[:, 0], total[:, 1:1 + VOTERS], total[:, 1 + VOTERS:].reshape(2, VOTERS, VOTERS)


def fit_label_model(patterns: DataFrame, balance: float, rounds: int = 4) -> LabelModel:
    """``patterns``: (votes, n), one row per vote pattern of the training-side documents."""
    on = np.full((2, VOTERS), 0.02)
    on[1, :LEXICONS + 3] = 0.3
    on[0, LEXICONS + 3:], on[1, LEXICONS + 3:] = 0.95, 0.05
    model = LabelModel(min(max(balance, 1e-3), 0.999), on, np.ones(VOTERS))
    for step in range(2 * rounds):
        n, ones, both = _expected(patterns, model)
        if not n.sum():
            return model
        on = np.clip((ones + 0.05) / (n[:, None] + 0.1), 1e-4, 1 - 1e-4)
        discount = model.discount
        if step == rounds - 1:  # correlations given the class, then EM goes on with them
            sd = np.sqrt(on * (1 - on))
            cov = np.maximum(both / np.maximum(n, 1e-9)[:, None, None] - on[:, :, None] * on[:, None, :], 0)
            rho = (cov / (sd[:, :, None] * sd[:, None, :]) * (n / n.sum())[:, None, None]).sum(0)
            np.fill_diagonal(rho, 0)
            discount = 1 / (1 + np.where(rho > 0.05, np.minimum(rho, 1), 0).sum(0))
        model = LabelModel(float(np.clip(n[1] / n.sum(), 1e-4, 1 - 1e-4)), on, discount)
    return model


def _features(rows: int, bounds: np.ndarray, term: np.ndarray, votes: np.ndarray, n_terms: int) -> np.ndarray:
    x = np.zeros((rows, n_terms + PATTERNS + 1), np.float32)
    x[np.repeat(np.arange(rows), np.diff(bounds)), term] = 1
    x[:, n_terms:-1] = (votes[:, None] >> (LEXICONS + np.arange(PATTERNS))) & 1
    x[:, -1] = 1
    return x


def train_classifier(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression (accelerated gradient steps, slight ridge)."""
    weight, y = (weight / weight.sum()).astype(np.float32), y.astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32)
    step = np.float32(4 / max((weight @ (x * x)).sum(), 1e-9))  # below 1 / curvature
    for i in range(300):
        g = x.T @ (weight * (1 / (1 + np.exp(-np.clip(x @ v, -40, 40))) - y)) + np.float32(1e-5) * v
        new = v - step * g
        v, w = new + np.float32(i / (i + 3)) * (new - w), new
    return w.astype(float)


def fit_classifier(hits: DataFrame, model: LabelModel, n_terms: int, fit_rows: int) -> np.ndarray:
    """Trained on posterior labels of at most ``fit_rows`` rows of ``hits``, half with terms."""
    some = F.size("terms") > 0
    counts = {r["t"]: r["n"] for r in hits.groupBy(some.alias("t")).agg(F.count(F.lit(1)).alias("n")).collect()}
    xs, ys, ws = [], [], []
    for flag, n in counts.items():
        rows = hits.where(some == F.lit(flag)).orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id") \
            .limit(fit_rows // 2).select("votes", "terms").toArrow()
        votes = rows.column("votes").to_numpy()
        lists = rows.column("terms").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in lists])]).astype(np.int64)
        xs.append(_features(len(votes), bounds, lists.flatten().to_numpy(), votes, n_terms))
        ys.append(model.posterior(_bits(votes)))
        ws.append(np.full(len(votes), n / len(votes)))
    return train_classifier(np.concatenate(xs), np.concatenate(ys), np.concatenate(ws))


def document_toxicity(documents: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE,
                      fit_rows: int = FIT_ROWS) -> DataFrame:
    held = fold(F.col("doc_id"), 5) == 0
    ids = checkpointed(training_sample(labels, "toxic", ~held, sample))
    terms = mine_terms(documents, ids, TERMS)
    hits = checkpointed(term_hits(documents, terms))
    known = labels.where(~held).agg(F.avg("toxic").alias("rate"), F.count("toxic").alias("n")).first()
    rate = float(known["rate"]) if known["n"] else 0.5
    train = hits.where(~held)
    if terms and not train.isEmpty():
        patterns = checkpointed(train.groupBy("votes").agg(F.count(F.lit(1)).alias("n")))
        w = fit_classifier(train, fit_label_model(patterns, rate), len(terms), fit_rows)
    else:
        w = np.zeros(len(terms) + PATTERNS + 1)
        w[-1] = np.log((rate + 1e-3) / (1 - rate + 1e-3))

    def score(batches):
        for batch in batches:
            lists = batch.column(2)
            bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
            votes = batch.column(1).to_numpy()
            z = ((votes[:, None] >> (LEXICONS + np.arange(PATTERNS))) & 1) @ w[len(terms):-1] + w[-1]
            row = np.repeat(np.arange(len(votes)), np.diff(bounds))
            z += np.bincount(row, weights=w[lists.flatten().to_numpy()], minlength=len(votes))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], ["doc_id", "score"])

    out = hits.mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", held.alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))
