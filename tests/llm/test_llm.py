"""Every operator against a brute-force version on a small table of odd cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from adfunnel.llm import (
    blocktopk, exactdup, licenses, mixing, multiindex, neardup, quality, sentencepieces, sharding, toxicity,
)
from adfunnel.llm.suffixes import suffix_order
from adfunnel.llm.textbytes import mix64

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_suffix_order_is_sorted():
    rng = random.Random(1)
    for _ in range(1500):
        t = [rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randrange(14))]
        assert suffix_order(t) == sorted(range(len(t)), key=lambda i: t[i:])


def test_shards(docs, rows, empty):
    out = sharding.document_shards(docs, 5).toPandas()
    assert len(out) == len(rows) and sharding.document_shards(empty).count() == 0
    size = {r[0]: len((r[1] or "").encode()) + 16 for r in rows}
    crc = {r[0]: zlib.crc32((r[1] or "").encode()) for r in rows}
    known = out[out.doc_id.notna()]
    assert all(size[i] == s and crc[i] == c for i, s, c in zip(known.doc_id, known["size"], known.text_crc32))
    out["key"] = out.doc_id.fillna(-1)  # NULL comes first
    order = out.sort_values(["shard", "slot"])
    assert order.key.is_monotonic_increasing
    target = out["size"].sum() / 5
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
        assert abs(g["size"].sum() - target) <= out["size"].max()


def test_mix(docs, rows, empty, spark):
    out = mixing.document_mix(docs).toPandas()
    again = mixing.document_mix(docs.repartition(2)).toPandas()
    key = ["doc_id", "size", "source_size", "target", "taken"]
    assert out.sort_values(key).values.tolist().__repr__() == again.sort_values(key).values.tolist().__repr__()
    assert len(out) == len(rows) and mixing.document_mix(empty).count() == 0
    count = {r[0]: len(WORDS.findall(r[1] or "")) for r in rows}
    assert all(count[None if d != d else int(d)] == s for d, s in zip(out.doc_id, out["size"]))
    assert (out.taken <= 2 * out["size"]).all() and (out.taken >= 0).all()
    sources = {r[0]: r[3] for r in rows}
    out["source"] = [str(sources[None if d != d else int(d)]) for d in out.doc_id]
    per = out.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), cap=("source_size", "first"))
    assert abs(per.target.sum() - 1.5 * out["size"].sum()) < 1e-6
    assert ((per.target - per.taken).abs() <= 1).all() and (per.target <= 2 * per.cap).all()
    texts = mixing.mixed_texts(docs)
    assert texts.columns == docs.columns
    assert texts.select(F.sum(mixing.word_count(F.col("text")))).first()[0] == out.taken.sum()


@pytest.mark.parametrize("blocks", [5, 7, 60])
def test_mixed_texts_meet_the_targets_of_rare_sources(spark, blocks):
    sizes = {"a": [400] * 5, "b": [300] * 4, "rare": [7, 5], "one": [330], "few": [90, 25]}
    rows = [(n * 10 + i, " ".join(f"{s}{i}w{j}" for j in range(k)), s)
            for n, (s, ks) in enumerate(sizes.items()) for i, k in enumerate(ks)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = {"shards": 2, "blocks_per_shard": blocks}
    target = {r.source: r.target for r in mixing.mix_sources(
        docs, "doc_id", "source", mixing.word_count(F.col("text")), **mix).sources.collect()}
    taken, times = defaultdict(int), defaultdict(int)
    for r in mixing.mixed_texts(docs, **mix).collect():
        taken[r.source] += len(r.text.split())
        for w in r.text.split():
            times[w] += 1
        assert r.text
    assert max(times.values()) <= 2 and set(times) <= {w for r in rows for w in r[1].split()}
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items()), (taken, target)


def test_mix_sql():
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    from adfunnel.session import local_session
    spark = local_session(4)
    got = mixing.document_mix(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).toPandas()
    want = con.execute(mixing.SQL).df()
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist()))


def test_licences(spark):
    files = spark.createDataFrame(
        [(1, "/a/LICENSE", "Released under the MIT License.", "x"), (2, "/a/b/c/f.py", "code\nmore", "x"),
         (3, "/a/b/NOTICE.txt", "intro\nLicensed under CC BY-NC 4.0.", "x"), (4, "/z/g.py", None, "x"),
         (5, None, "Released under the MIT License.", "x"), (6, "/a/own.py", "Licensed under the Apache License, Version 2.0.", "x"),
         (7, "/a/h.py", "", "x"), (7, "/a/h.py", "", "x")], "id int, path string, text string, license string")
    got = {r.id: r for r in licenses.scan_licenses(files, "id", "path", "text").collect()}
    assert [got[i].license for i in range(1, 8)] == ["MIT", "CC-BY-NC-4.0", "CC-BY-NC-4.0", None, "MIT", "Apache-2.0", "MIT"]
    assert got[2].inherited_from == "/a/b/NOTICE.txt" and got[1].inherited_from is None and got[3].own_line == 1
    assert licenses.scan_licenses(files.where("false"), "id", "path", "text").count() == 0


@pytest.mark.parametrize("n", [300, 60_000])
def test_licence_headers_at_two_corpus_sizes(spark, n):
    heads = ["Copyright Acme. Released under the MIT License.",
             "# Acme tools: Licensed under the Apache License, Version 2.0.",
             "intro\nThis work is licensed under the GNU General\nPublic License, version 3.\ncode",
             "This Source Code Form is subject to\nthe terms of the Mozilla\nPublic License, v. 2.0.",
             "Redistribution and use in source\nand binary forms, with or\nwithout modification, are permitted."]
    own = F.element_at(F.array(*[F.lit(h) for h in heads]), (F.col("id") + 1).cast("int"))
    prose = F.when(F.col("id") % 8 == 0, "Released under the MIT License.") \
        .when(F.col("id") % 8 == 1, "Licensed under the Apache License, Version 2.0.") \
        .otherwise("the work of the day is subject to change\nand under the terms of the house")
    files = spark.range(n).withColumn("text", F.when(F.col("id") < len(heads), own).otherwise(prose)) \
        .withColumn("path", F.concat(F.lit("/"), F.col("id").cast("string"), F.lit("/f")))
    out = licenses.scan_licenses(files, "id", "path", "text")
    got = {r.id: (r.own_license, r.own_line) for r in out.where(f"id < {len(heads)}").collect()}
    assert got == {0: ("MIT", 0), 1: ("Apache-2.0", 0), 2: ("GPL-3.0", 1), 3: ("MPL-2.0", 0),
                   4: ("BSD-3-Clause", 0)}
    assert out.where("id >= 5 AND id % 8 > 1 AND own_license IS NOT NULL").count() == 0


def vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 8)).astype(np.float32)
    x[10:40] = 3 * x[10]  # ties, and nearest to one another
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(301, None), (302, [0.0] * 8), (303, [float("nan")] * 8), (304, [None] + [1.0] * 7), (None, [1.0] * 8),
             (305, [1.0]), rows[40]]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_block_top_k_is_exact(spark):
    x, df = vectors(spark)
    got = defaultdict(list)
    for r in blocktopk.search(df, "vec_id", "embedding", F.col("id") % 20 == 0, 10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    w = np.floor(1024.0 * x.astype(float)).astype(int)
    w = np.vstack([w, np.zeros((2, 8), int), np.zeros((1, 8), int)])  # id 302 is a zero vector
    ids = [*range(300), 302]
    for q in range(0, 300, 20):
        s = sorted(((-int(w[i] @ w[q]), i) for i in ids if i != q))[:10]
        assert got[q] == [(i, -v) for v, i in s]
    assert blocktopk.search(df.where("false"), "vec_id", "embedding", F.col("id") % 20 == 0).count() == 0


def test_multi_index(spark):
    x, df = vectors(spark)
    rows = multiindex.search(df, "vec_id", "embedding", F.col("id") % 20 == 0, 5, share=0.5, least=50) \
        .orderBy("query_id", "rank").collect()
    got, hits = defaultdict(list), 0
    for r in rows:
        got[r.query_id].append(r.vec_id)
    for q in range(0, 300, 20):
        s = sorted(((-float(np.dot(x[i].astype(float), x[q].astype(float))), i) for i in range(300) if i != q))[:5]
        hits += len(set(got[q]) & {i for _, i in s})
    assert set(got) == set(range(0, 300, 20)) and hits >= 0.9 * 75
    whole = multiindex.search(df, "vec_id", "embedding", F.col("id") == 20, 5, share=1.0).collect()
    assert [r.vec_id for r in sorted(whole, key=lambda r: r.rank)] == [10, 11, 12, 13, 14]  # ties by id
    assert multiindex.search(df.where("false"), "vec_id", "embedding", F.col("id") == 0).count() == 0


def recall(found, ids, x, queries, k):
    """Share of the exact ``k`` nearest distinct ids that ``found`` (query_id -> ids) holds; at least the ``k``-th score counts."""
    hits = 0
    for q in queries:
        s = {}
        for i, v in zip(ids, x @ x[ids.index(q)]):
            s[i] = max(v, s.get(i, -np.inf))
        del s[q]
        kth = sorted(s.values())[-k]
        hits += sum(s[i] >= kth - 1e-9 for i in found[q])
    return hits / k / len(queries)


def test_multi_index_with_a_hot_vector(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((6000, 32)) + 1
    x[::3] = 1.3  # a third of all rows, passed early by every query
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    queries = [q for q in range(1, 6000, 40) if q % 3]
    found = defaultdict(list)
    for r in multiindex.search(df, "vec_id", "embedding", F.col("id").isin(queries), 20, least=50).collect():
        found[r.query_id].append(r.vec_id)
    assert recall(found, list(range(6000)), x, queries, 20) >= 0.9


def test_multi_index_counts_repeated_ids_once(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((200, 8))
    x[1] = 5 * x[0]  # the best partner of 0
    near = [(1, (x[1] * f).tolist()) for f in np.linspace(0.9, 1, 100)]  # one id, a hundred vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(2 * rows + near, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in multiindex.search(df, "vec_id", "embedding", F.col("id") % 50 == 0, 20, share=1.0).orderBy("rank").collect():
        got[r.query_id].append((r.vec_id, r.rank))
    for q in range(0, 200, 50):
        best = {i: float(v @ x[q]) for i, v in enumerate(x)}
        for i, v in near:
            best[i] = max(best[i], float(np.dot(v, x[q])))
        want = sorted((i for i in best if i != q), key=lambda i: (-best[i], i))[:20]
        assert got[q] == [(i, n) for n, i in enumerate(want, 1)]


def test_rows_of_one_id_are_dealt(spark):
    x = np.random.default_rng(8).standard_normal((20_000, 2))
    cells = spark.createDataFrame([(1, v.tolist(), 0) for v in x], "id long, vec array<double>, cell int")
    shards = multiindex.laid_out(cells, multiindex.packed({0: len(x)})).groupBy("shard").count().collect()
    assert len(shards) == 3 and max(r["count"] for r in shards) < 9000


def labels_of(spark, rows, label):
    return spark.createDataFrame([(r[0], int(label(r[1]))) for r in rows if r[0] is not None],
                                 "doc_id long, quality int").withColumn("toxic", F.col("quality"))


@pytest.mark.parametrize("run", [quality.document_quality, toxicity.document_toxicity])
def test_classifiers_keep_every_row(spark, docs, rows, empty, run):
    labels = labels_of(spark, rows, lambda t: "a" in (t or ""))
    out = run(docs, labels).toPandas()
    assert len(out) == len(rows) and out.score.between(0, 1).all()
    folds = 3 if run is quality.document_quality else 5
    rest = 1 if folds == 3 else 0
    for d, h in zip(out.doc_id, out.held_out):
        assert h == (zlib.crc32(b"" if d != d else str(int(d)).encode()) % folds == rest)
    assert ((out.score >= 0.5) == (out.predicted == 1)).all()
    assert run(empty, labels).count() == 0
    assert run(docs, labels.where("false")).count() == len(rows)


@pytest.mark.parametrize("run, label", [(quality.document_quality, "quality"), (toxicity.document_toxicity, "toxic")])
def test_classifiers_on_held_out_rows(spark, run, label):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = run(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (out.predicted == out[label]).mean() > 0.95


def shingles(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORDS.findall(text or "")]
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.mark.parametrize("few", [64, 2])  # 2: crowded buckets go through blocks
def test_near_duplicates(docs, rows, empty, few, monkeypatch):
    monkeypatch.setattr(neardup, "FEW", few)
    monkeypatch.setattr(neardup, "BLOCK", 2)
    out = neardup.near_duplicates(docs).collect()
    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)
    assert neardup.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("batch", [2000, 1])  # 1: every group takes the distributed minimum
def test_repeated_strings(docs, rows, empty, batch, monkeypatch):
    monkeypatch.setattr(exactdup, "BATCH", batch)
    seen, want = set(), {}
    for i, t in sorted({r[0]: r[1] for r in rows if r[0] is not None}.items()):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for a in range(len(data) - 99):
            s = data[a:a + 100]
            if s in seen:
                gone[a:a + 100] = b"\1" * 100
            seen.add(s)
        spans = sum(1 for a in range(len(data)) if gone[a] and not (a and gone[a - 1]))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        want[i] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    out = exactdup.document_dedup(docs).collect()
    assert len(out) == len(rows) and sum(v[1] for v in want.values()) > 500
    for r in out:
        if r.doc_id is not None:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]
    assert exactdup.document_dedup(empty).count() == 0
    assert exactdup.deduplicated_texts(docs).columns == docs.columns


def test_sampled_segmentations(docs, rows, empty):
    voc = sentencepieces.load_vocabulary()
    out = sentencepieces.sampled_segmentations(docs, "doc_id", "text", 3, vocabulary=voc).collect()
    again = sentencepieces.sampled_segmentations(docs.repartition(5), "doc_id", "text", 3, vocabulary=voc).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    text = {r[0]: r[1] or "" for r in rows}
    per = defaultdict(set)
    for r in out:
        assert r.decoded_equal and 0 <= r.inclusion <= 1
        if r.ids:
            assert sentencepieces.decode(r.ids, voc) == text[r.doc_id]
        per[r.doc_id].add(tuple(r.ids))
    assert per[0] and len(per[0]) == 3 and per[15] == {()}
    assert sentencepieces.sampled_segmentations(empty, "doc_id", "text", vocabulary=voc).count() == 0


def test_segmentations_follow_the_lattice():
    voc = sentencepieces.load_vocabulary()
    n, seen, total = 3000, defaultdict(int), 0.0
    prob = {}
    for r in sentencepieces.encode_run(sentencepieces.Lattices(voc), ["the cat"] * n, mix64(np.arange(n, dtype=np.uint64)), 3):
        assert len({tuple(x[0]) for x in r}) == 3 and r[0][2] >= r[1][2] >= r[2][2]
        seen[tuple(r[0][0])] += 1
        prob.update({tuple(x[0]): np.exp(x[1]) for x in r})
        total += sum(np.exp(x[1]) / x[3] for x in r)
    assert max(abs(seen[k] / n - p) for k, p in prob.items()) < 0.04
    assert abs(total / n - 1) < 0.05  # inclusion scores make the estimate of the whole unbiased


def dedup_rows(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted((r.doc_id, r.n_removed, r.n_spans, r.kept_sha256) for r in exactdup.document_dedup(df).collect())


def test_one_id_with_two_texts_is_two_documents(spark):
    rng = random.Random(9)
    a, b, c = ("".join(rng.choices("abcdefgh ", k=300)) for _ in range(3))
    rows = [(1, a), (1, b), (2, a[:200] + c + b[50:]), (3, c[40:260])]
    got = dedup_rows(spark, rows)
    assert got == dedup_rows(spark, rows[::-1])
    assert [r[:3] for r in got] == [(1, 0, 0), (1, 0, 0), (2, 450, 2), (3, 220, 1)]


def test_the_suffix_order_decides(spark, monkeypatch):
    rng = random.Random(10)
    passage = "".join(rng.choices("abcdefgh ", k=180))
    rows = [(i, "".join(rng.choices("abcdefgh ", k=90)) + f"{chr(65 + i)}{passage}{chr(65 + i)}"
             + "".join(rng.choices("abcdefgh ", k=90))) for i in range(12)]
    assert [r[1] for r in dedup_rows(spark, rows)] == [0] + [180] * 11

    def shuffled(text):
        order = suffix_order(text)
        random.Random(1).shuffle(order)
        return order

    monkeypatch.setattr(exactdup, "suffix_order", shuffled)
    assert [r[1] for r in dedup_rows(spark, rows)] != [0] + [180] * 11


def test_block_top_k_of_large_weights(spark):
    rows = [(0, [200_000.0, 1.0]), (1, [200_000.0, 0.0]), (2, [150_000.0, 0.0]), (3, [2.0 ** 45, -3.0]),
            (4, [2.0 ** 45 + 1, -3.0]), (5, [1e200, 0.0]), (6, [-2.0 ** 45, 2.0])]
    got = {(r.query_id, r.vec_id): (r.rank, r.score) for r in blocktopk.search(
        spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", F.col("id") < 4).collect()}
    w = {i: [int(v * 1024) for v in x] for i, x in rows if i != 5}
    for q in range(4):
        best = sorted((-sum(a * b for a, b in zip(w[q], w[i])), i) for i in w if i != q)
        for rank, (s, i) in enumerate(best, 1):
            assert got[q, i] == (rank, -s if abs(s) < 2 ** 63 else None)
    assert got[0, 1][1] == 41943040000000000 + 0 and len(got) == 20


def test_rows_of_one_id_link_their_classes(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, "alone in the world with words")]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)]


def test_documents_without_an_id_are_kept_apart_by_the_licence_scan(spark):
    prose = "word " * 400
    rows = [(None, "Released under the MIT License.\ncode", "web", "en"), (None, prose, "web", "en"),
            (1, prose, "web", "de"), (2, prose, "web", "en")]
    got = licenses.document_licenses(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"))
    assert sorted(str(r.license) for r in got.collect()) == ["MIT", "None", "None", "None"]


def test_mix_takes_rare_sources(spark):
    rows = [(i, "w " * 6000, "big") for i in range(100)] + [(1000, "a b c d e", "rare")]
    out = mixing.document_mix(spark.createDataFrame(rows, "doc_id long, text string, source string"),
                              shards=2, blocks_per_shard=50).toPandas()
    rare = out[out.doc_id == 1000].iloc[0]
    assert rare.target == 10 and rare.taken == 10


def test_texts_of_a_run_are_searched_together(monkeypatch):
    """Random numbers are hashed for all texts at once, and each text's samples are those it has alone."""
    from adfunnel.llm import sentencepieces
    from adfunnel.llm.textbytes import mix64
    voc = sentencepieces.load_vocabulary()
    texts, keys = ["the cat", "", "a " + "x" * 30 + " né\n", "one two three"] * 25, mix64(np.arange(100, dtype=np.uint64))
    alone = [next(iter(sentencepieces.encode_run(sentencepieces.Lattices(voc), [t], keys[i:i + 1], 4)))
             for i, t in enumerate(texts[:8])]
    calls, hashed = [], sentencepieces.hashed
    monkeypatch.setattr(sentencepieces, "hashed", lambda *parts, **h: calls.append(1) or hashed(*parts, **h))
    got = [*sentencepieces.encode_run(sentencepieces.Lattices(voc), texts, keys, 2)]
    assert len(got) == 100 and len(calls) < 100  # not for each text and sample by itself
    got = [*sentencepieces.encode_run(sentencepieces.Lattices(voc), texts, keys, 4)]
    for a, b in zip(alone, got):
        assert [(x[0].tolist(), *x[1:3]) for x in a] == [(x[0].tolist(), *x[1:3]) for x in b]


def test_segmentation_reports_what_decodes(spark):
    df = spark.createDataFrame([(1, "a▁b c"), (2, "a b c"), (3, None)], "doc_id long, text string")
    got = {(r.doc_id, r.decoded_equal) for r in sentencepieces.document_segmentations(df).collect()}
    assert got == {(1, False), (2, True), (3, True)}


def test_sampled_texts_hold_one_row_an_id(spark):
    from adfunnel.llm.labelled import sample_texts
    docs = spark.createDataFrame([(1, f"text {i % 3}") for i in range(1000)] + [(2, "b")], "doc_id long, text string")
    sample = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, y int")
    assert sample_texts(docs, sample).count() == 2


def test_broadcasts_hold_no_class_of_the_package():
    import pickletools
    model = quality.Model(np.zeros(2), np.zeros((2, 1)), np.zeros((1, 1)), np.zeros(1))
    voc = sentencepieces.Vocabulary(["a"], {"a": (0, 0.0)}, [0])
    import pickle
    for value in (quality.model_parts(model), (voc.pieces, voc.weights, voc.byte_ids)):
        names = [arg for _, arg, _ in pickletools.genops(pickle.dumps(value)) if isinstance(arg, str)]
        assert not any("adfunnel" in n for n in names)
