"""Source divergence, whitening and packing against brute force and their edge cases."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import types as T

from adfunnel.llm import bidiagonal, bincompletion, divergence, packing, whitening

LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def audited(rows):
    """The audit's rows by plain loops over (lang, source, text)."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        words = LETTERS.findall((text or "").translate(lower))
        groups[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= 3]
        mine = {s: c for (g, s), c in groups.items() if g == lang}
        whole = sum(mine.values(), Counter())

        def share(c):
            size = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10 ** 9 * (c[t] + 1) // size for t in kept}

        p, q = {s: share(c) for s, c in mine.items()}, share(whole)
        for s in mine:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in mine if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if mine[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:200])):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(found)]
    return sorted(out)


def as_rows(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("blocks", [{}, {"group_block": 2, "term_block": 7}])
def test_divergence_is_the_plain_one(spark, docs, rows, empty, blocks):
    assert as_rows(divergence.source_divergence(docs, **blocks)) == audited([(r[2], r[3], r[1]) for r in rows])
    assert divergence.source_divergence(empty, **blocks).count() == 0


def test_divergence_of_a_hot_source_ties_and_groups_without_terms(spark):
    rng = random.Random(2)
    words = ["Alpha", "beta", "été", "ΣΑΣ", "x1y", "a-b"]
    rows = [("en", "hot", " ".join(rng.choices(words, k=9))) for _ in range(60)]
    rows += [(None, f"s{i % 7}", " ".join(rng.choices(words, k=4))) for i in range(40)]
    rows += [("en", None, ""), ("en", "none", None), ("fr", "a", "once"), ("fr", "b", "12 34"), ("fr", "b", "12 34"),
             ("en", "long", "word " * 20_000), ("de", "t1", "eins"), ("de", "t2", "eins"), ("de", "t3", "eins")]
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    assert as_rows(divergence.source_divergence(df, group_block=3, term_block=2)) == audited(rows)


def test_divergence_sql(spark):
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    got = divergence.source_divergence(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    want = con.execute(divergence.SQL)
    assert [d[0] for d in want.description] == got.columns
    assert as_rows(got) == sorted(want.fetchall())


def test_share_is_exact_for_large_counts(spark):
    for n, size in ((10 ** 15, 3 * 10 ** 15), (0, 1), (8 * 10 ** 15, 8 * 10 ** 15 + 7), (12345678901, 98765432109)):
        want = 1 + 10 ** 9 * (n + 1) // size
        assert int(divergence.share(np.array([n]), np.array([size]))[0]) == want
        row = spark.range(1).selectExpr(f"{n}L AS n", f"{size}L AS size")
        assert row.select(divergence.share_column(row.n, row["size"])).first()[0] == want


@pytest.mark.parametrize("r", [
    np.eye(6), np.zeros((4, 4)), np.ones((5, 5)), np.diag([3.0, 0, 2, 0, 1]), np.array([[2.0]]),
    np.random.default_rng(1).normal(size=(20, 20)) * np.logspace(0, -7, 20),
    np.kron(np.eye(3), np.random.default_rng(2).normal(size=(4, 4))),
    *(np.random.default_rng(s).integers(-1, 2, size=(n, n)).astype(float) for s in range(8) for n in (2, 3, 7))])
def test_bidiagonal_solver(r):
    d, e, v = bidiagonal.bidiagonalised(r)
    b = np.diag(d) + np.diag(e, 1)
    gram = r.T @ r
    assert np.allclose(v @ b.T @ b @ v.T, gram, rtol=0, atol=1e-12 * max(1, np.abs(gram).max()))
    s, w = bidiagonal.squared_singular_values(d, e), np.linalg.svd(r, compute_uv=False) ** 2
    assert np.allclose(s, w, rtol=1e-9, atol=1e-13 * max(w[0], 1e-300))
    k = int((s > s[0] * 1e-24).sum()) if s[0] > 0 else 0
    z = v @ bidiagonal.right_vectors(d, e, s, k)
    assert np.abs(z.T @ z - np.eye(k)).max(initial=0) < 1e-9
    assert np.abs(gram @ z - z * s[:k]).max(initial=0) <= 1e-11 * max(s[0], 1e-300)


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                        T.StructField("n", T.StringType()), T.StructField("whitened", T.StringType())])


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS).repartition(3)


def test_whitening_is_the_plain_one(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 20)) * np.linspace(3, 0.2, 20)
    hot = [float(v) for v in x[0]]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000 + i, hot) for i in range(300)]
    rows += [(None, hot), (5, hot), (7, None), (8, []), (9, [1.0, None] * 10), (10, [float("nan")] * 20),
             (11, [float("inf")] * 20), (12, [1.0] * 19)]
    got = whitening.whitened_vectors(vectors(spark, rows)).toPandas()
    used = [r for r in rows if r[1] and len(r[1]) == 20 and all(v is not None and np.isfinite(v) for v in r[1])]
    ints = np.floor(np.float32([r[1] for r in used]).astype(float) * 64).astype(np.int64) + 1_000_000
    fit = np.unique(ints, axis=0)
    n, sums = len(fit), fit.sum(0)
    e, q = np.linalg.eigh(((fit * n - sums) / n).T @ ((fit * n - sums) / n) / n)
    e, q = e[::-1], q[:, ::-1]
    assert len(got) == 16 * len(used) and set(got.n) == {n} and got.identity_error.nunique() == 1
    assert got.identity_error.iloc[0] < 1e-9
    want = defaultdict(list)
    for r, x in zip(used, ints):
        y = x * n - sums
        want[r[0]].append((int(y @ y), np.abs((y / n) @ q[:, :16] / np.sqrt(e[:16]))))
    for c, g in got.groupby("component"):
        assert np.allclose(g.explained, e[c - 1] / e.sum(), rtol=1e-9)
        for vec_id, deviation, w in zip(g.vec_id, g.deviation, g.whitened):
            found = want[None if vec_id != vec_id else int(vec_id)]
            assert any(d == deviation and abs(v[c - 1] - abs(w)) < 1e-8 for d, v in found)
    signs = got[got.vec_id == 3].sort_values("component").whitened.to_numpy()
    y = (ints[3] * n - sums) / n
    assert len(set(np.round(got[got.vec_id == 1000].whitened.to_numpy(), 9))) == 16 and len(signs) == 16 and y.any()


def test_whitening_without_variance_or_rows(spark):
    one = [1.0, 2.0, 3.0]
    assert whitening.whitened_vectors(vectors(spark, [])).count() == 0
    assert whitening.whitened_vectors(vectors(spark, [(1, one), (2, one)])).count() == 0
    line = whitening.whitened_vectors(vectors(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(6)])).toPandas()
    assert set(line.component) == {1} and np.allclose(line.explained, 1) and abs(line.whitened.sum()) < 1e-9


def test_whitening_reduces_many_blocks_and_large_numbers(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) * 2 ** 20 for v in r]) for i, r in enumerate(rng.normal(size=(900, 3)))]
    df = vectors(spark, rows)
    got = whitening.whitened_vectors(df).toPandas()
    x = np.floor(np.float32([r[1] for r in rows]).astype(float) * 64).astype(np.int64) + 1_000_000
    exact = {i: sum(int(v) ** 2 for v in row.astype(object) * len(x) - x.sum(0).astype(object)) for i, row in enumerate(x)}
    assert all(int(e) == exact[i] for i, e in zip(got.vec_id, got.deviation_exact))
    assert got.identity_error.max() < 1e-9
    big = [v for v in exact.values() if v >= 2 ** 63]
    assert got.deviation.isna().sum() == 3 * len(big)
    fit = whitening.integer_vectors(df, "vec_id", "embedding").select("x").repartition(40)
    r = whitening.triangular_factor(fit, len(x), [int(v) for v in x.sum(0)])  # more blocks than fit one reduction
    y = (x - x.mean(0)).astype(float)
    assert np.allclose(r.T @ r, y.T @ y, rtol=1e-9)


def fewest(items, capacity):
    best, items = [len(items)], sorted(items, reverse=True)

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms) if r >= items[i]}.values():
            go(i + 1, [r - items[i] * (k == j) for k, r in enumerate(rooms)])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best[0]


def test_bin_completion_finds_the_fewest():
    rng, better = random.Random(1), 0
    for t in range(250):
        capacity = rng.choice([10, 20, 50, 100])
        low, high = (1, capacity) if t % 2 else (capacity // 6 + 1, capacity // 2)
        items = Counter(rng.randint(low, high) for _ in range(rng.randint(0, 11)))
        bins = bincompletion.completed(items, capacity)
        assert sum(map(Counter, bins), Counter()) == items and all(sum(b) <= capacity for b in bins)
        least = fewest(list(items.elements()), capacity)
        assert len(bins) == least and bincompletion.least_bins(items, capacity) <= least
        better += len(bincompletion.best_fit(items, capacity)) > least
    assert better  # the search is needed


def test_fillings_are_the_undominated_ones():
    rng = random.Random(5)
    for _ in range(60):
        counts = Counter(rng.randint(1, 12) for _ in range(6))
        room, waste = rng.randint(3, 20), rng.randint(0, 6)
        items = list(counts.elements())
        sets = {tuple(sorted((items[i] for i in c), reverse=True)) for k in range(7)
                for c in itertools.combinations(range(6), k)}
        sets = {s for s in sets if room - waste <= sum(s) <= room}

        def dominated(s):
            slack, spare = room - sum(s), [x for x, n in counts.items() if n > s.count(x)]
            pairs = {x + y for x, y in itertools.combinations(s, 2)}
            return any(y <= slack or any(x < y <= x + slack for x in s) or any(p <= y <= p + slack for p in pairs)
                       for y in spare)

        found = list(bincompletion.fillings(counts, room, waste))
        assert set(found) == {s for s in sets if not dominated(s)} and len(set(found)) == len(found)
        assert [room - sum(f) for f in found] == sorted(room - sum(f) for f in found)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(packing.TOKENIZER)


def test_units_tokenize_like_whole_texts(tokenizer):
    import pyarrow as pa
    rng = random.Random(3)
    bits = ["don't", "'start", "a,'s", "It's", "Word", "W0RD123", "<|endoftext|>", "a<|startoftext|>b", "<|", "<|ENDOFTEXT|>",
            "é", "Élan", "é", "É́", "ß", "À", "×", "÷", "x×y", "ÿ", "ΟΔΟΣ", "…", "«mot»", "日本語", " ", " ",
            "\x1c", "\x00", "\x7f", "\u0085", "...", "a-b_c", "</w>", "x</w>", "ﬁ", "İ", "½", "²", "٣", "😀", "''s", "`", "K"]
    texts = [None, "", " \n"] + ["".join(rng.choice(bits) + rng.choice(["", " ", "", "\n"]) for _ in range(rng.randrange(12)))
                                for _ in range(4000)]
    with open(packing.TOKENIZER, encoding="utf-8") as f:
        table = packing.WordIds(f.read())
    got = [ids[i:j].tolist() for _, ids, bounds in packing.tokenized_rows(pa.array(texts, pa.string()), table, 0)
           for i, j in zip(bounds, bounds[1:])]
    assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]


def test_packing_round_trip(spark, docs, rows, empty, tokenizer):
    packed = packing.packed_pieces(docs, capacity=64, shard_bins=4).cache()
    got = packed.toPandas()
    want = Counter()
    for r in rows:
        ids = np.array(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4")
        for i in range(0, len(ids), 64):
            want[r[0], i // 64, i, ids[i:i + 64].tobytes()] += 1
    key = [None if d != d else int(d) for d in got.doc_id]
    assert Counter(zip(key, got.piece, got.start, map(bytes, got.ids))) == want
    assert all(zlib.crc32(i) == c and len(i) == 4 * n for i, c, n in zip(got.ids, got.ids_crc32, got.length))
    whole = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    for s, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 64
        assert bytes(whole[s].ids) == b"".join(map(bytes, g.ids)) and whole[s]["length"] == g.length.sum()
    lengths = Counter(got.length.tolist())
    assert got.sequence_id.nunique() <= len(bincompletion.best_fit(lengths, 64)) + 3
    assert packing.document_packing(empty).count() == 0


def test_placements_of_many_equal_and_empty_documents(spark):
    rng = random.Random(6)
    lengths = [1] * 3000 + [40] * 900 + [rng.randint(1, 100) for _ in range(2000)] + [100] * 50
    items = spark.createDataFrame(list(enumerate(lengths)), "uid long, length long").repartition(6)
    got = packing.placements(items, capacity=100, shard_bins=64).toPandas().sort_values(["sequence_id", "offset"])
    assert sorted(got.uid) == list(range(len(lengths)))
    got["length"] = [lengths[u] for u in got.uid]
    for _, g in got.groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 100
    assert got.sequence_id.nunique() <= len(bincompletion.best_fit(Counter(lengths), 100)) * 1.02
