import os
import random
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # extra columns named like outputs
    T.StructField("size", T.StringType()), T.StructField("score", T.StringType()),
    T.StructField("shard", T.StringType()), T.StructField("kept", T.StringType())])


@pytest.fixture(scope="session")
def spark():
    from adfunnel.session import local_session
    s = local_session(4, shuffle_partitions=4)
    yield s
    s.stop()


def make_rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    base = [" ".join(word() for _ in range(rng.randint(30, 80))) for _ in range(12)]
    passage = " ".join(word() for _ in range(30))
    texts = [*base, base[0], base[1], None, "", "one", "Two words", "two WORDS", " \n ",
             base[2].replace("a", "á"), passage + " " + base[3], base[4] + " " + passage,
             base[5][:150] + base[6][:150], "héé " * 60, " ".join(word() for _ in range(3000))]
    for t in base[7:10]:  # near copies: one word of many changed
        w = t.split(" ")
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    rows = [(i, t, "en", ["a", "b", None, ""][i % 4], len(t or ""), "x", "y", "z", "k")
            for i, t in enumerate(texts)]
    return rows + [rows[3], (None, base[8], "de", "a", 3, "x", "y", "z", "k")]  # a repeated row, a NULL id


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
