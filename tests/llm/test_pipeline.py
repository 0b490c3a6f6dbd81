"""The stages of the pipeline, each against a plain version on its own input."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    texts = [" ".join(word() for _ in range(60)) for _ in range(20)]
    near = texts[0].split(" ")
    near[30] = "other"
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, texts[3]), (101, " ".join(near)), (4, texts[4]), (5, texts[5] + " x")]
    rows += [(200, None), (201, ""), (None, texts[6]), (None, texts[6])]
    return spark.createDataFrame([(i, t, "en", "ab"[k % 2], len(t or "")) for k, (i, t) in enumerate(rows)], SCHEMA).repartition(3)


def test_stages_are_the_dealt_ones_in_order():
    assert [s.split()[0] for s, _ in corpus_pipeline.STAGES] == ["quality", "MinHash", "suffix-array", "mixing", "SentencePiece"]


def test_one_document_of_each_group_stays(spark):
    docs = documents(spark)
    kept = corpus_pipeline.one_of_each(spark, docs, "")
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert ids == [(False, i) for i in [*range(20), 200, 201]] + [(True, 0)] * 2
    again = corpus_pipeline.one_of_each(spark, docs.repartition(5), "")
    assert kept.exceptAll(again).count() == 0
    assert corpus_pipeline.one_of_each(spark, docs.where("false"), "").count() == 0


def test_repeated_passages_go_and_clean_documents_stay(spark):
    docs = documents(spark).where("doc_id < 20").dropDuplicates(["doc_id"])
    kept = corpus_pipeline.without_repeats(spark, docs, "")
    assert kept.columns == docs.columns and kept.exceptAll(docs).count() == 0 and kept.count() == docs.count()


def test_mix_and_segmentation_follow_their_input(spark):
    docs = documents(spark).where("doc_id < 20").dropDuplicates(["doc_id"])
    mixed = corpus_pipeline.mixed(spark, docs, "")
    assert mixed.columns == docs.columns
    words = mixed.select(F.sum(F.size(F.split("text", " ")))).first()[0]
    assert abs(words - 1.5 * 60 * 20) <= 4
    out = corpus_pipeline.segmented(spark, mixed, "")
    assert out.count() == 2 * mixed.count() and out.where("decoded_equal").count() == out.count()
