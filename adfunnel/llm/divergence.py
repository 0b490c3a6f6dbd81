"""Source divergence audit by three-dimensional cube partitioning.

Every (lang, source) group of documents is compared with every other source of its
language, and with the language as a whole, by exact integer chi-square terms over the
terms that occur in at least ``MIN_DOCS`` documents of the language.

One pass over the texts counts terms per group (combined inside each Arrow batch and again
before the shuffle, so a hot source or term costs no more than its distinct terms). The
groups of a language are dealt into blocks of about ``group_block`` and its kept terms into
blocks of about ``term_block``. A slice holds the counts of one group block over one term
block. Slices are replicated to the cells (group block, group block, term block) of the
cube they belong to; a task owns a cell and adds up the partial divergences of its pairs of
groups, both ways, and the parts are summed along the term axis. A cell is bounded by
``group_block`` and ``term_block`` whatever the corpus is. Terms that occur in neither
block of a cell add the same amount to a pair, so they are counted, not visited.

Defined results: NULL text, lang and source are the empty string; every row is a document
(repeated rows count again); a group without terms and a language without kept terms are
compared as well (values 0 where nothing is kept); equal values are ranked by the item's
UTF-8 bytes; an empty table gives no rows; other columns are ignored. Counts up to 9e15 a
group are exact in 64-bit arithmetic.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adfunnel.llm.common import stored
from adfunnel.llm.textbytes import letter_bytes, letter_runs, lowered, text_runs

MIN_DOCS = 3
TOP_TERMS = 200
GROUP_BLOCK = 64
TERM_BLOCK = 4096
RUN = 16_000_000  # bytes of text counted together

COUNTS = "lang string, source string, term string, n long, docs long"
PARTS = "lang string, source string, item string, part long"


class Audit(NamedTuple):
    pairs: DataFrame  # lang, source, item (other source), value
    terms: DataFrame  # lang, source, item (term), value: all with p > q


def counted(batches):
    """Rows of COUNTS for Arrow batches (lang, source, text); a NULL term for every group."""
    for batch in batches:
        names = [batch.column(i).fill_null("").dictionary_encode() for i in (0, 1)]
        langs, sources = (x.dictionary for x in names)
        group, of = np.unique(names[0].indices.to_numpy().astype(np.int64) * len(sources)
                              + names[1].indices.to_numpy(), return_inverse=True)

        def rows(at, term, n, docs):
            return pa.RecordBatch.from_arrays(
                [langs.take(pa.array(group[at] // len(sources))).cast(pa.string()),
                 sources.take(pa.array(group[at] % len(sources))).cast(pa.string()),
                 term.cast(pa.string()), pa.array(n), pa.array(docs)], ["lang", "source", "term", "n", "docs"])

        zero = np.zeros(len(group), np.int64)
        yield rows(np.arange(len(group)), pa.nulls(len(group), pa.string()), zero, zero)
        for first, _, buf, starts in text_runs(batch.column(2), RUN):
            low = lowered(buf)
            a, b = letter_runs(low)
            if not len(a):
                continue
            offsets = np.concatenate(([0], np.cumsum(b - a)))
            words = pa.LargeStringArray.from_buffers(
                len(a), pa.py_buffer(offsets), pa.py_buffer(letter_bytes(low))).dictionary_encode()
            kinds, code = len(words.dictionary), words.indices.to_numpy().astype(np.int64)
            row = np.searchsorted(starts, a, "right") - 1
            doc, n = np.unique(row * kinds + code, return_counts=True)
            key = of[first + doc // kinds] * kinds + doc % kinds
            order = np.argsort(key)
            key, at = np.unique(key[order], return_index=True)
            yield rows(key // kinds, words.dictionary.take(pa.array(key % kinds)), np.add.reduceat(n[order], at),
                       np.diff(at, append=len(order)))


def share(n, size):
    """``1 + floor(10**9 * (n + 1) / size)`` in steps that stay inside 64 bits (numpy or ints)."""
    whole, rest = 0, n + 1
    for _ in range(3):
        rest = rest * 1000
        whole, rest = whole * 1000 + rest // size, rest % size
    return whole + 1


def share_column(n: Column, size: Column) -> Column:
    div = lambda a, b: F.call_function("div", a, b)
    whole, rest = F.lit(0).cast("long"), n + 1
    for _ in range(3):
        rest = rest * 1000
        whole, rest = whole * 1000 + div(rest, size), rest % size
    return whole + 1


def cell(table: pa.Table) -> pa.Table:
    """Partial divergences of one cell: rows of PARTS for its ordered pairs of groups.

    ``table`` holds the slices of one term block: one row, or two of different group blocks.
    """
    v, lang, first = table["v"][0].as_py(), table["lang"][0].as_py(), table["tb"][0].as_py() == 0

    def fields(scalar, *names):
        if scalar.values is None:
            return [np.zeros(0, np.int64)] * len(names)
        return [scalar.values.field(n).to_numpy(zero_copy_only=False) for n in names]

    slices = [(fields(table["members"][i], "g", "size", "source"), fields(table["entries"][i], "g", "t", "n"))
              for i in range(table.num_rows)]
    used = np.unique(np.concatenate([t for _, (_, t, _) in slices]))
    sides = []
    for (g, size, names), (at, t, n) in slices:
        place = np.zeros(g.max() + 1, np.int64)
        place[g] = np.arange(len(g))
        size, at = size + v, place[at]
        base = share(np.zeros(len(g), np.int64), np.maximum(size, 1))
        p = np.repeat(base[:, None], len(used), 1)
        p[at, np.searchsorted(used, t)] = share(n, size[at])
        sides.append((names, base, p))
    out = {"source": [], "item": [], "part": []}
    alone = table["one"][0] == table["other"][0]
    # a block that no group was dealt to sends no slice
    for one, other in [(0, 0)] if alone else [(0, 1), (1, 0)] if len(sides) == 2 else []:
        (names, base, p), (others, base2, q) = sides[one], sides[other]
        for i, name in enumerate(names):
            flat = (base[i] - base2) ** 2 // base2  # a term in neither group
            part = ((p[i] - q) ** 2 // q).sum(1) + flat * ((v if first else 0) - len(used))
            keep = [j for j in range(len(others)) if one != other or i != j]
            out["source"] += [name] * len(keep)
            out["item"] += [others[j] for j in keep]
            out["part"] += part[keep].tolist()
    n = len(out["part"])
    return pa.table({"lang": pa.array([lang] * n, pa.string()), "source": pa.array(out["source"], pa.string()),
                     "item": pa.array(out["item"], pa.string()), "part": pa.array(out["part"], pa.int64())})


def audit(documents: DataFrame, lang: str = "lang", source: str = "source", text: str = "text",
          min_docs: int = MIN_DOCS, group_block: int = GROUP_BLOCK, term_block: int = TERM_BLOCK) -> Audit:
    """The divergences of every group from the other sources of its language, and term by term."""
    counts = documents.select(*(F.col(f"`{c}`").cast("string").alias(a)
                                for c, a in ((lang, "lang"), (source, "source"), (text, "text")))) \
        .mapInArrow(counted, COUNTS) \
        .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # at most one row per source of a language and term
    same = Window.partitionBy("lang", "term").orderBy("source")
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counts = counts.select("lang", "source", "term", "n", F.sum("n").over(whole).alias("all"),
                           F.sum("docs").over(whole).alias("in_docs"),
                           (F.row_number().over(same) == 1).cast("long").alias("lead"))
    counts = stored(counts.where(F.col("term").isNull() | (F.col("in_docs") >= min_docs)).drop("in_docs"))

    def blocks(n: str, each: int) -> Column:
        return F.greatest(F.lit(1), F.ceil(F.col(n) / each)).cast("int")

    def block(name: str, n: Column) -> Column:
        return F.pmod(F.xxhash64(name), n).cast("int")

    # one row per language, joined by Spark's measured sizes
    is_term = F.col("term").isNotNull()
    langs = stored(counts.groupBy("lang").agg(
        F.count_if(~is_term).alias("groups"), F.sum(F.when(is_term, F.col("lead")).otherwise(0)).alias("v"),
        F.sum("n").alias("all_size")))
    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("size")).join(langs, "lang") \
        .withColumn("gbs", blocks("groups", group_block)).withColumn("gb", block("source", F.col("gbs")))
    groups = stored(groups.select(
        "lang", "source", "size", "v", "all_size", "gb", "gbs", blocks("v", term_block).alias("tbs"),
        (F.row_number().over(Window.partitionBy("lang", "gb").orderBy("source")) - 1).cast("int").alias("g")))
    placed = counts.where(is_term).join(groups, ["lang", "source"])

    # slices: bounded by a group block and a term block
    entries = placed.withColumn("tb", block("term", F.col("tbs"))) \
        .withColumn("t", F.dense_rank().over(Window.partitionBy("lang", "tb").orderBy("term")).cast("long")) \
        .groupBy("lang", "gb", "tb").agg(F.collect_list(F.struct("g", "t", "n")).alias("entries"))
    members = groups.groupBy("lang", "gb", "gbs", "tbs", "v") \
        .agg(F.collect_list(F.struct("g", "size", "source")).alias("members"))
    slices = members.withColumn("tb", F.explode(F.sequence(F.lit(0), F.col("tbs") - 1))) \
        .join(entries, ["lang", "gb", "tb"], "left")
    cube = slices.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("gbs") - 1))) \
        .select("lang", F.least("gb", "with").alias("one"), F.greatest("gb", "with").alias("other"),
                "tb", "v", "members", "entries")
    pairs = cube.groupBy("lang", "one", "other", "tb").applyInArrow(cell, PARTS) \
        .groupBy("lang", "source", "item").agg(F.sum("part").alias("value"))

    p, q = share_column(F.col("n"), F.col("size") + F.col("v")), share_column(F.col("all"), F.col("all_size") + F.col("v"))
    over = placed.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q") \
        .select("lang", "source", "item", F.expr("((p - q) * (p - q)) div q").alias("value"))
    return Audit(pairs, over)


def source_divergence(documents: DataFrame, top_terms: int = TOP_TERMS, **options) -> DataFrame:
    """The audit as ranked rows (lang, source, part, item, value, rank): all pairs, ``top_terms`` a group."""
    found = audit(documents, **options)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")

    def ranked(df: DataFrame, part: str) -> DataFrame:
        return df.select("lang", "source", F.lit(part).alias("part"), "item", "value",
                         F.row_number().over(order).cast("int").alias("rank"))

    return ranked(found.pairs, "pair").union(ranked(found.terms, "term").where(F.col("rank") <= top_terms))


# Fixed values of the contract: 10**9, one added to counts, three documents, 200 ranks.
SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
counts AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs
  FROM (SELECT r, lang, source, unnest(words) AS term FROM docs) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM counts GROUP BY lang, term HAVING sum(docs) >= 3),
vocabulary AS (SELECT lang, count(*) AS v, sum(n) AS size FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM docs),
grid AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS total
  FROM grp g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
sizes AS (SELECT lang, source, sum(n) AS size FROM grid GROUP BY lang, source),
shares AS (
  SELECT grid.lang, grid.source, term, n,
         1 + (1000000000::HUGEINT * (n + 1)) // (s.size + v.v) AS p,
         1 + (1000000000::HUGEINT * (total + 1)) // (v.size + v.v) AS q
  FROM grid JOIN sizes s ON s.lang = grid.lang AND s.source = grid.source JOIN vocabulary v ON v.lang = grid.lang),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
ranked AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value,
       (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM ranked QUALIFY part = 'pair' OR rank <= 200
"""
