"""Removal of repeated byte strings, decided by suffix orders built by linear grouping.

A byte goes when it lies in a ``LENGTH``-byte string of its document that also starts
earlier in the corpus (smaller doc_id, or earlier in the document). The text is never
gathered; it is cut by its own content:

* Every string of ``LENGTH`` bytes has an anchor: the leftmost smallest hash among the
  ``GRAM``-byte grams inside it, so equal strings have equal anchors. The strings of one
  anchor occurrence are neighbours; together they span one context of the text.
* One pass finds the anchors, one shuffle by gram drops those that occur once. Equal
  contexts become one class with its first occurrence; all later ones are wholly repeated.
  Where all contexts of a gram are equal, that is all; otherwise the bytes of each class's
  first occurrence are cut from its text.
* Classes with a common gram are brought together in bounded batches. A batch's text holds,
  for every class, the bytes from its anchor on and those before it in reverse, as symbols
  of ``SYMBOL`` bytes; its suffixes are sorted by linear grouping (``suffixes.py``). Two
  strings with ``a`` bytes before the anchor are equal if and only if their classes share
  ``LENGTH - a`` bytes to the right and ``a`` to the left, that is, if no smaller common
  prefix of neighbours lies between them in either order.
* A gram with more classes than a batch (``BATCH``) is not gathered: its strings are compared
  by a distributed minimum per string hash.

Equal texts are one document beforehand: later copies of ``LENGTH`` bytes or more go whole.

Sorting every byte suffix would cost about 15 microseconds a byte in Python, so the orders
are built over the contexts of repeated grams only.

Defined results: NULL is the empty text; texts shorter than ``LENGTH`` keep everything;
equal rows of one doc_id count as one document and get one result each; different texts of
one doc_id are different documents, in order of their hashes; a NULL doc_id keeps its bytes
and is no source of repetition; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adfunnel.llm.common import checkpointed, stored
from adfunnel.llm.suffixes import suffix_order
from adfunnel.llm.textbytes import mix64, span_hashes, text_runs

LENGTH = 100
GRAM = 32
GRAMS = LENGTH - GRAM + 1  # grams inside one string
BATCH = 20_000  # classes sorted together
SYMBOL = 34  # bytes of a symbol of the suffix orders
SLICE = 1_000_000


def anchors(buf: np.ndarray, starts: np.ndarray):
    """``(row, lo, hi, at, gram)`` of every anchor occurrence: its strings start at lo..hi."""
    parts = []
    n = len(buf)
    for s in range(0, max(n - LENGTH, 0), SLICE):
        e = min(s + SLICE, n - LENGTH)  # strings starting in [s, e); the last byte is a separator
        sub = buf[s:e + LENGTH]
        g = np.arange(len(sub) - GRAM + 1)
        h = span_hashes(sub, g, g + GRAM)
        value, at, width = h, g, 1
        while width < GRAMS:  # smallest gram of GRAMS in a row, the leftmost among equals
            step = min(width, GRAMS - width)
            right = value[step:] < value[:-step]
            at = np.where(right, at[step:], at[:-step])
            value = np.where(right, value[step:], value[:-step])
            width += step
        parts.append((np.arange(s, e), at[:e - s] + s, value[:e - s]))
    if not parts:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    q, at, gram = (np.concatenate(x) for x in zip(*parts))
    row = np.searchsorted(starts, q, "right") - 1
    inside = q + LENGTH <= starts[row + 1] - 1
    q, at, gram, row = q[inside], at[inside], gram[inside], row[inside]
    new = np.ones(len(q), bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(q)) - 1
    return row[head], q[head], q[tail], at[head], gram[head]


def anchor_rows(docs: DataFrame) -> DataFrame:
    """(gram, context, n, lead, rep, tie, lo, twice): every anchor occurrence of every document.

    ``context`` hashes the bytes spanned by the ``n`` strings from ``lo`` and the anchor's
    place ``lead`` in them; ``twice`` says that the gram occurs again in its document.
    """
    def run(batches):
        for batch in batches:
            ids, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, last, buf, starts in text_runs(batch.column(2)):
                row, lo, hi, at, gram = anchors(buf, starts)
                with np.errstate(over="ignore"):
                    context = mix64(span_hashes(buf, lo, hi + LENGTH)
                                    + (at - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                order = np.lexsort((gram, row))
                same = (gram[order][1:] == gram[order][:-1]) & (row[order][1:] == row[order][:-1])
                twice = np.zeros(len(row), bool)
                twice[order[1:]] |= same
                twice[order[:-1]] |= same
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram.view(np.int64)), pa.array(context.view(np.int64)),
                     pa.array((hi - lo + 1).astype(np.int8)), pa.array((at - lo).astype(np.int8)),
                     pa.array(ids[first + row]), pa.array(ties[first + row]),
                     pa.array((lo - starts[row]).astype(np.int64)), pa.array(twice)],
                    ["gram", "context", "n", "lead", "rep", "tie", "lo", "twice"])

    return docs.select("rep", "tie", "text").mapInArrow(
        run, "gram long, context long, n byte, lead byte, rep long, tie long, lo long, twice boolean")


BODIES = "gram long, context long, n byte, lead byte, body binary, rep long, tie long, lo long"


def class_bodies(docs: DataFrame) -> DataFrame:
    """BODIES for the contexts listed in ``docs`` (rep, tie, text, cuts): the bytes of each."""
    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for rep, tie, text, cuts in zip(*batch.columns):
                data = text.as_py().encode()
                rep, tie = rep.as_py(), tie.as_py()
                for c in cuts.as_py():
                    body = data[c["lo"]:c["lo"] + c["n"] - 1 + LENGTH]
                    for out, v in zip(cols, (c["gram"], c["context"], c["n"], c["lead"], body, rep, tie, c["lo"])):
                        out.append(v)
            types = [pa.int64(), pa.int64(), pa.int8(), pa.int8(), pa.binary(), *[pa.int64()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                             ["gram", "context", "n", "lead", "body", "rep", "tie", "lo"])

    return docs.select("rep", "tie", "text", "cuts").mapInArrow(run, BODIES)


def string_hashes(bodies: list[bytes], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all strings of the contexts, and the context of each."""
    buf = np.frombuffer(b"".join(bodies), np.uint8)
    start = np.concatenate([[0], np.cumsum([len(b) for b in bodies])])[:-1]
    of = np.repeat(np.arange(len(bodies)), n)
    step = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    a = start[of] + step
    return span_hashes(buf, a, a + LENGTH), of


def padded(parts: list[bytes], symbols: int) -> np.ndarray:
    """Rows of ``symbols * SYMBOL`` bytes, filled up with zeros."""
    wide = symbols * SYMBOL
    return np.frombuffer(b"".join(x.ljust(wide, b"\0") for x in parts), np.uint8).reshape(-1, wide)


def context_orders(right: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orders of the rows of ``right`` and of ``left``, from one suffix order of all their symbols."""
    cells = [np.ascontiguousarray(x).reshape(len(x), -1, SYMBOL) for x in (right, left)]
    every = np.concatenate([c.reshape(-1, SYMBOL) for c in cells])
    code = np.unique(every.view(f"V{SYMBOL}").ravel(), return_inverse=True)[1].reshape(-1)
    n, split = len(right), cells[0].shape[0] * cells[0].shape[1]
    text, heads = [], []
    for part, base in ((code[:split].reshape(n, -1), 0), (code[split:].reshape(n, -1), n)):
        ends = -1 - base - np.arange(n)[:, None]  # each sequence ends with a symbol of its own
        heads.append(sum(map(len, text)) + np.arange(n) * (part.shape[1] + 1))
        text.append(np.hstack([part, ends]).ravel())
    text = np.concatenate(text)
    owner = np.full(len(text), -1)
    owner[np.concatenate(heads)] = np.arange(2 * n)
    order = owner[np.array(suffix_order(text.tolist()))]
    return order[(order >= 0) & (order < n)], order[order >= n] - n


def common_prefixes(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row of ``order`` shares with the one before it (none: 0)."""
    out = np.zeros(len(order), np.int64)
    differ = rows[order[1:]] != rows[order[:-1]]
    out[1:] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return out


def resolve(batch: pa.Table) -> pa.RecordBatch:
    """(gram, context, m1, m2): strings of each class's first occurrence that start earlier elsewhere."""
    n, lead = (batch.column(c).to_numpy().astype(np.int64) for c in ("n", "lead"))
    bodies = batch.column("body").to_pylist()
    right = padded([b[k:] for b, k in zip(bodies, lead.tolist())], -(-LENGTH // SYMBOL))
    left = padded([b[:k][::-1] for b, k in zip(bodies, lead.tolist())], -(-(GRAMS - 1) // SYMBOL))
    by_right, by_left = context_orders(right, left)
    shared_right, shared_left = common_prefixes(right, by_right), common_prefixes(left, by_left)
    rank = np.empty(len(n), np.int64)
    rank[np.lexsort((batch.column("lo").to_numpy() + lead, batch.column("tie").to_numpy(),
                     batch.column("rep").to_numpy()))] = np.arange(len(n))
    kind, other = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
    m1, m2 = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    for before in range(GRAMS):  # bytes of a string before its anchor
        at = np.flatnonzero((lead >= before) & (lead - before < n))
        if len(at) < 2:
            continue
        kind[by_right] = np.cumsum(shared_right < LENGTH - before)
        other[by_left] = np.cumsum(shared_left < before)
        order = at[np.lexsort((rank[at], other[at], kind[at]))]
        again = order[1:][(kind[order][1:] == kind[order][:-1]) & (other[order][1:] == other[order][:-1])]
        step = lead[again] - before
        low = step < 40
        m1[again[low]] |= np.int64(1) << step[low]
        m2[again[~low]] |= np.int64(1) << (step[~low] - 40)
    return pa.RecordBatch.from_arrays(
        [batch.column("gram").combine_chunks(), batch.column("context").combine_chunks(), pa.array(m1), pa.array(m2)],
        ["gram", "context", "m1", "m2"])


def resolved(classes: DataFrame) -> DataFrame:
    """Masks of all classes; ``classes`` arrive sorted by gram within their partition."""
    names = ["gram", "context", "n", "lead", "body", "rep", "tie", "lo"]

    def run(batches):
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count < BATCH:
                continue
            t = pa.Table.from_batches(held)
            gram = t.column("gram").to_numpy()
            cut = int(np.searchsorted(gram, gram[-1]))  # the last gram may go on
            if cut:
                yield resolve(t.slice(0, cut))
            held = t.slice(cut).to_batches()
            count = t.num_rows - cut
        if count:
            yield resolve(pa.Table.from_batches(held))

    return classes.select(*names).mapInArrow(run, "gram long, context long, m1 long, m2 long")


def crowded(classes: DataFrame) -> DataFrame:
    """Masks of classes of crowded grams, by a distributed minimum per string."""
    def strings(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column(2).to_numpy().astype(np.int64)
            h, of = string_hashes(batch.column(3).to_pylist(), n)
            step = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            gram, context, rep, tie = (batch.column(i).take(pa.array(of)) for i in (0, 1, 4, 5))
            yield pa.RecordBatch.from_arrays(
                [gram, context, pa.array(h.view(np.int64)), rep, tie,
                 pa.array(batch.column(6).to_numpy()[of] + step), pa.array(step)],
                ["gram", "context", "h", "rep", "tie", "at", "step"])

    rows = classes.select("gram", "context", "n", "body", "rep", "tie", "lo").mapInArrow(
        strings, "gram long, context long, h long, rep long, tie long, at long, step long")
    place = F.struct("rep", "tie", "at")
    firsts = rows.groupBy("h").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1")
    gone = rows.join(firsts, "h").where(place != F.col("first"))
    return gone.groupBy("gram", "context").agg(
        F.expr("bit_or(CASE WHEN step < 40 THEN shiftleft(1L, cast(step AS int)) ELSE 0L END)").alias("m1"),
        F.expr("bit_or(CASE WHEN step >= 40 THEN shiftleft(1L, cast(step - 40 AS int)) ELSE 0L END)").alias("m2"))


def text_tie():
    return F.xxhash64("text")


def repeated_strings(documents: DataFrame) -> DataFrame:
    """(doc_id, tie, hits): where strings to remove start, as (lo, whole, m1, m2) per context.

    ``whole`` strings from ``lo`` on are repeated, or (-1) those marked in m1 and m2. A
    later copy of a whole text has one hit over all its strings. ``tie`` is ``text_tie``.
    """
    keyed = documents.select(F.col("doc_id").cast("long").alias("rep"), text_tie().alias("tie"), "text").where(
        F.col("rep").isNotNull() & (F.octet_length("text") >= LENGTH))
    digests = checkpointed(keyed.select("rep", "tie", F.md5(F.col("text").cast("binary")).alias("digest"),
                                        F.octet_length("text").alias("bytes")))
    firsts = digests.groupBy("digest").agg(F.min("rep").alias("first"))
    placed = checkpointed(digests.join(firsts, "digest").select("rep", "tie", "first", "bytes").distinct())
    own = placed.where("rep = first").select("rep", "tie").distinct()

    gram = Window.partitionBy("gram")
    rows = anchor_rows(keyed).select(
        "gram", "context", "n", "lead", "rep", "tie", "lo",
        (F.min("tie").over(gram) != F.max("tie").over(gram)).alias("many"), F.max("twice").over(gram).alias("twice"),
        (F.min("context").over(gram) != F.max("context").over(gram)).alias("mixed"))
    rows = stored(rows.where("many OR twice").drop("many", "twice").join(own, ["rep", "tie"]))

    classes = rows.groupBy("gram", "context", "n", "lead", "mixed").agg(F.min(F.struct("rep", "tie", "lo")).alias("f")) \
        .select("gram", "context", "n", "lead", "mixed", "f.rep", "f.tie", "f.lo")
    cuts = classes.where("mixed").groupBy("rep", "tie").agg(
        F.collect_list(F.struct("lo", "n", "lead", "gram", "context")).alias("cuts"))
    bodies = stored(class_bodies(keyed.join(cuts, ["rep", "tie"]).dropDuplicates(["rep", "tie"])))
    sizes = bodies.groupBy("gram").agg(F.count(F.lit(1)).alias("k"))
    some = bodies.join(sizes.where(F.col("k") <= BATCH).select("gram"), "gram", "left_semi")
    many = bodies.join(sizes.where(F.col("k") > BATCH).select("gram"), "gram", "left_semi")
    masks = checkpointed(resolved(some.repartition("gram").sortWithinPartitions("gram")).union(crowded(many))
                         .where("m1 <> 0 OR m2 <> 0"))

    first = classes.select("gram", "context", F.struct("rep", "tie", "lo").alias("first"))
    hits = rows.join(first, ["gram", "context"]).join(masks, ["gram", "context"], "left")
    is_first = F.struct("rep", "tie", "lo") == F.col("first")
    hits = hits.where(~is_first | F.col("m1").isNotNull()).select(
        "rep", "tie", "lo", F.when(is_first, F.lit(-1)).otherwise(F.col("n")).cast("long").alias("whole"), "m1", "m2")
    none = F.lit(None).cast("long")
    copies = placed.where("rep <> first").select(
        "rep", "tie", F.lit(0).cast("long").alias("lo"), (F.col("bytes") - LENGTH + 1).cast("long").alias("whole"),
        none.alias("m1"), none.alias("m2"))
    return hits.unionByName(copies).groupBy(F.col("rep").alias("doc_id"), "tie").agg(
        F.collect_list(F.struct("lo", "whole", "m1", "m2")).alias("hits"))


def merged_ranges(hits: list[dict] | None) -> list[list[int]]:
    """Merged byte ranges of one document's hits."""
    spans = []
    for r in hits or ():
        lo, whole = r["lo"], r["whole"]
        if whole >= 0:
            spans.append((lo, lo + whole - 1 + LENGTH))
        else:
            spans += [(lo + i, lo + i + LENGTH) for i in range(40) if r["m1"] >> i & 1]
            spans += [(lo + i, lo + i + LENGTH) for i in range(40, 80) if r["m2"] >> (i - 40) & 1]
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def without_ranges(data: bytes, ranges: list[list[int]]) -> bytes:
    at, parts = 0, []
    for a, b in ranges:
        parts.append(data[at:a])
        at = b
    parts.append(data[at:])
    return b"".join(parts)


def document_dedup(documents: DataFrame) -> DataFrame:
    """Digest columns of every document after the removal."""
    def run(batches):
        for batch in batches:
            total, gone, spans, digest = [], [], [], []
            for text, hits in zip(batch.column(1), batch.column(2)):
                data = (text.as_py() or "").encode()
                ranges = merged_ranges(hits.as_py())
                total.append(len(data))
                gone.append(sum(b - a for a, b in ranges))
                spans.append(len(ranges))
                digest.append(hashlib.sha256(without_ranges(data, ranges)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array(spans, pa.int64()), pa.array(digest, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return documents.select("doc_id", "text", text_tie().alias("tie")) \
        .join(repeated_strings(documents), ["doc_id", "tie"], "left").select("doc_id", "text", "hits").mapInArrow(
            run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated_texts(documents: DataFrame) -> DataFrame:
    """``documents`` with the repeated bytes cut out of ``text`` (and ``n_chars`` adjusted).

    Documents that lose all their text go. Bytes of a character cut in two are dropped.
    """
    names = documents.columns
    at = names.index("text")

    def run(batches):
        for batch in batches:
            columns = list(batch.columns[:-1])
            texts = []
            for text, hits in zip(columns[at], batch.column(len(names))):
                text = text.as_py()
                ranges = merged_ranges(hits.as_py())
                texts.append(without_ranges(text.encode(), ranges).decode("utf-8", "ignore") if ranges else text)
            columns[at] = pa.array(texts, pa.string())
            if "n_chars" in names:
                i = names.index("n_chars")
                columns[i] = pa.array([len(t) if t is not None else old.as_py()
                                       for t, old in zip(texts, columns[i])], pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names).filter(
                pa.array([t != "" or not len(h) for t, h in
                          zip(texts, [x.as_py() or () for x in batch.column(len(names))])], pa.bool_()))

    hits = repeated_strings(documents).withColumnsRenamed({"doc_id": "__id", "tie": "__tie", "hits": "__hits"})
    joined = documents.join(hits, (F.col("doc_id") == F.col("__id")) & (text_tie() == F.col("__tie")), "left") \
        .select(*[documents[c] for c in names], "__hits")
    return joined.mapInArrow(run, documents.schema)
