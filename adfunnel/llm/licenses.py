"""Licence scan (DataFrame functions only): TF-IDF headers, then directory inheritance.

Every line of every file, and every run of up to ``WRAP`` lines (a wrapped header), is
compared with the licence templates by sparse TF-IDF cosine. Terms are the templates' words;
document frequencies count all files. A word outside the templates weighs as much as the
compared template's words do on (quadratic) average, so long lines that merely contain some
template words score low, and a header with words of its own scores the same whatever the
size of the corpus and however common licences are in it. Runs whose shared words cannot reach the threshold (the shared
part of the template's squared weight bounds the squared cosine) are dropped before words
are spread over rows; nothing else is.

A file's own licence is its best run's template, its line the run's first. Files that state the licence of their
directory (``states_directory``) give it to the directory; every file without a licence of
its own takes that of the nearest ancestor directory which has one, found by joining the
distinct directories' ancestor paths with the licensed directories.

Defined results: NULL or empty text has no lines; a NULL path neither gives nor takes a
directory licence; equal scores go to the earlier line, the shorter run, then the template's name; several
licence files of a directory: the higher score, then the smaller path; repeated rows get
equal results; an empty table gives no rows; input columns named like an output are replaced.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adfunnel.llm.common import checkpointed

# Header lines of common licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
THRESHOLD = 0.6
WRAP = 3
P = "__lic_"
OUTPUTS = ("own_license", "own_score", "own_line", "license", "inherited_from")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _weights(idf: dict[str, float], templates: dict[str, str]) -> dict[str, dict[str, float]]:
    """Template -> term -> unit-length weight."""
    out = {}
    for name, text in templates.items():
        w: dict[str, float] = {}
        for t in re.findall(TOKEN, text.lower()):
            w[t] = w.get(t, 0.0) + idf[t]
        norm = math.sqrt(sum(x * x for x in w.values()))
        out[name] = {t: x / norm for t, x in w.items()}
    return out


def _shared(w: dict[str, float]) -> Column:
    """Squared weight of the template's terms among the line's words."""
    terms = F.create_map(*[x for t, v in w.items() for x in (F.lit(t), F.lit(v * v))])
    return F.aggregate(F.array_intersect(P + "words", F.array(*[F.lit(t) for t in w])), F.lit(0.0),
                       lambda s, t: s + F.element_at(terms, t))


def scan_licenses(files: DataFrame, key: str, path: str, text: str, templates: dict[str, str] = TEMPLATES,
                  threshold: float = THRESHOLD, states_directory: Column | None = None) -> DataFrame:
    """``files`` with own_license, own_score, own_line, license and inherited_from.

    ``states_directory``: which licensed files speak for their directory, over the columns
    ``path`` and own_*; by default those named like a licence file.
    """
    spark = files.sparkSession
    keep = [c for c in files.columns if c not in OUTPUTS]
    vocabulary = sorted({t for s in templates.values() for t in re.findall(TOKEN, s.lower())})
    vocab = F.array(*[F.lit(t) for t in vocabulary])

    held = files.select(F.explode(F.array_append(F.array_intersect(tokens(F.col(text)), vocab), F.lit(""))).alias("t"))
    count = {r["t"]: r["n"] for r in held.groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = files.count()  # the frequencies above skip files without text
    idf = {t: math.log((n + 1) / (count.get(t, 0) + 1)) + 1 for t in vocabulary}
    weights = _weights(idf, templates)
    foreign = {}  # squared weight of a word outside the templates
    for name, s in templates.items():
        terms = re.findall(TOKEN, s.lower())
        foreign[name] = sum((terms.count(t) * idf[t]) ** 2 for t in set(terms)) / len(set(terms))

    # rows without a key, or of one key, are told apart by their texts
    row = F.struct(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("text"))
    lines = F.split(F.col(text), "\n")
    line = files.select(row.alias(P + "key"), F.col(path).alias(P + "path"), F.posexplode(F.arrays_zip(
        *[F.slice(lines, i + 1, F.greatest(F.size(lines), F.lit(1))).alias(f"l{i}") for i in range(WRAP)])).alias(P + "line", P + "run"))
    # a run starts and ends with a line that has words of the templates
    for i in range(WRAP):
        line = line.withColumn(f"{P}w{i}", tokens(F.col(f"{P}run.l{i}")))
        if not i:
            line = line.where(F.arrays_overlap(P + "w0", vocab))
    runs = [F.when(F.arrays_overlap(f"{P}w{i}", vocab), F.concat(
        F.col(P + "w0"), *[F.coalesce(f"{P}w{j}", F.array().cast("array<string>")) for j in range(1, i + 1)]))
        for i in range(WRAP)]
    line = line.select(P + "key", P + "path", P + "line", F.posexplode(F.array(*runs)).alias(P + "span", P + "words")) \
        .where(F.col(P + "words").isNotNull())
    reach = None
    for w in weights.values():
        can = _shared(w) >= threshold ** 2
        reach = can if reach is None else reach | can
    at = [P + "key", P + "path", P + "line", P + "span"]
    counts = line.where(reach).withColumn("t", F.explode(P + "words")).groupBy(*at, "t") \
        .agg(F.count(F.lit(1)).alias("tf"))
    known = F.create_map(*[x for t, v in idf.items() for x in (F.lit(t), F.lit(v))])
    weighed = checkpointed(counts).withColumn("w", F.col("tf") * F.element_at(known, F.col("t")))  # NULL outside
    norms = weighed.groupBy(*at).agg(
        F.sum(F.col("w") * F.col("w")).alias("norm"),
        F.sum(F.when(F.col("w").isNull(), F.col("tf") * F.col("tf")).otherwise(0)).alias("outside"))
    square = F.create_map(*[x for name, v in foreign.items() for x in (F.lit(name), F.lit(v))])
    table = spark.createDataFrame([(t, name, v) for name, w in weights.items() for t, v in w.items()],
                                  "t string, template string, v double")
    dots = weighed.join(F.broadcast(table), "t").groupBy(*at, "template").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    same = [dots[c].eqNullSafe(norms[c]) for c in at]
    scored = dots.join(norms, same[0] & same[1] & same[2] & same[3]).select(
        *[dots[c] for c in at], "template", F.round(F.col("dot") / F.sqrt(
            F.col("norm") + F.col("outside") * F.element_at(square, F.col("template"))), 9).alias("score")) \
        .where(F.col("score") >= threshold)
    best = scored.groupBy(P + "key", P + "path").agg(
        F.min(F.struct(-F.col("score"), P + "line", P + "span", "template")).alias("b")) \
        .select(P + "key", P + "path", F.col("b.template").alias("own_license"),
                (-F.col("b.col1")).alias("own_score"), F.col("b." + P + "line").alias("own_line"))
    best = checkpointed(best)

    def parent(p: Column) -> Column:
        return F.regexp_replace(p, "/[^/]*$", "")

    if states_directory is None:
        states_directory = F.col("path").rlike(r"(?i)(^|/)(licen[cs]e|copying|notice)(\.[^/]*)?$")
    stated = best.withColumn("path", F.col(P + "path")).where(F.col("path").isNotNull() & states_directory) \
        .groupBy(parent(F.col("path")).alias("of")) \
        .agg(F.min(F.struct(-F.col("own_score"), "path", "own_license")).alias("b")) \
        .select("of", F.col("b.path").alias("from"), F.col("b.own_license").alias("given"))
    folders = files.where(F.col(path).isNotNull()).select(parent(F.col(path)).alias(P + "folder")).distinct()
    parts = F.split(P + "folder", "/")
    above = folders.withColumn("depth", F.explode(F.sequence(F.lit(1), F.size(parts)))) \
        .withColumn("of", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/"))
    nearest = above.join(stated, "of").groupBy(P + "folder").agg(
        F.max(F.struct("depth", "from", "given")).alias("b")) \
        .select(P + "folder", F.col("b.from").alias("from"), F.col("b.given").alias("given"))

    out = files.select(*[F.col(f"`{c}`") for c in keep]).join(
        best, row.eqNullSafe(F.col(P + "key")) & F.col(path).eqNullSafe(F.col(P + "path")), "left")
    out = out.join(nearest, parent(F.col(f"`{path}`")) == F.col(P + "folder"), "left")
    return out.select(*[F.col(f"`{c}`") for c in keep], "own_license", "own_score", "own_line",
                      F.coalesce("own_license", "given").alias("license"),
                      F.when(F.col("own_license").isNull(), F.col("from")).alias("inherited_from"))


def document_licenses(documents: DataFrame) -> DataFrame:
    """The scan over ``documents``, filed as ``source/lang/<id div 64>/<id>``.

    A document that opens with a licence line states its directory's licence. Documents
    without an id have no path, so they neither state nor inherit one.
    """
    files = documents.select("doc_id", "text", F.when(F.col("doc_id").isNotNull(), F.concat_ws(
        "/", F.lit(""), "source", "lang", F.floor(F.col("doc_id") / 64).cast("string"),
        F.col("doc_id").cast("string"))).alias("path"))
    found = scan_licenses(files, "doc_id", "path", "text", states_directory=F.col("own_line") == 0)
    return found.drop("text")
