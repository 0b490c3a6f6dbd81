"""Packing of tokenized documents into sequences, best-fit by bin completion.

Documents are tokenized once and stored as pieces of at most ``capacity`` tokens. Only row
keys and lengths are packed: full pieces are sequences of their own, the others are dealt by
a hash of their key into shards of about ``SHARD_BINS`` sequences, each packed by
``bincompletion`` inside a task. A shard's ``REOPENED`` emptiest sequences are opened again
and their pieces packed together in a further round, with some 64 times fewer shards (never
more than half), until one shard is left, so the space that shards waste does not add up. A shard holds at most
``capacity * SHARD_BINS`` pieces on average, however many documents are empty.

White space and a change between ASCII letters, digits and signs always end a token of this
vocabulary, so every distinct unit between them is tokenized once per task, by the tokenizer
itself, and the ids are gathered; words with anything else in them are units as a whole.

Defined results: a NULL or empty text is the separator alone; repeated rows are packed each;
rows without an id are packed like any other; special-token strings in a text become their
ids, as the tokenizer does it; an empty table gives no rows; only the two named columns are
read.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adfunnel.llm.bincompletion import completed
from adfunnel.llm.common import shuffle_partitions, stored
from adfunnel.llm.textbytes import lowered, text_runs, words

CAPACITY = 2048
SEPARATOR = 0
SHARD_BINS = 512
REOPENED = 8
TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
RUN = 4_000_000  # bytes of text tokenized together
CACHED = 600_000  # distinct units whose ids a task keeps

PIECES = "doc_id {id}, piece int, start long, length long, ids binary, ids_crc32 long"
PLACED = "uid long, length long, sequence_id long, offset long, again boolean"


# Byte classes of the vocabulary's pre-tokenizer (white space, letter, digit, other);
# words with any other byte, an apostrophe or the start of a special token are left to the tokenizer.
_CLASS = np.full(256, 4, np.int8)
_CLASS[32:127] = 3
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[39] = 4
_LATIN, _SIGNS, _SHARP_S = 0xC3, (0x97, 0xB7), 0x9F  # lead byte of U+00C0 to U+00FF; second bytes in it
_PLAIN = "^([A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!-&(-/:-@\\[-`{-~]+)$"
WORD_END = "</w>"


class WordIds:
    """Token ids of text units, each tokenized once while at most ``CACHED`` are kept."""

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(tokenizer)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self._clear()

    def _clear(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.starts, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def rows(self, found: pa.LargeStringArray) -> np.ndarray:
        """Index of every unit of ``found`` (distinct) in ``starts``."""
        at = pc.index_in(found, self.known)
        if at.null_count and len(self.known) + at.null_count > CACHED:
            self._clear()
            at = pc.index_in(found, self.known)
        if at.null_count:
            new = found.filter(at.is_null())
            plain = pc.match_substring_regex(new, _PLAIN)
            missing, plain = np.flatnonzero(at.is_null()), plain.to_numpy(zero_copy_only=False)
            at = at.fill_null(0).to_numpy().astype(np.int64)
            for mask, encode in ((plain, self._joined), (~plain, self._one_by_one)):
                units = new.filter(pa.array(mask))
                at[missing[mask]] = len(self.known) + np.arange(len(units))
                sizes, flat = encode(units.to_pylist())
                self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
                self.ids = np.concatenate([self.ids, flat])
                self.known = pa.concat_arrays([self.known, units])
            return at
        return at.to_numpy(zero_copy_only=False).astype(np.int64)

    def _joined(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Units of one pre-token each, tokenized as one text: the last token of each ends a word."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(units)], add_special_tokens=False)[0].ids, np.uint32)
        sizes = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
        if len(sizes) != len(units):
            return self._one_by_one(units)
        return sizes, ids

    def _one_by_one(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return sizes, np.fromiter((x for i in ids for x in i), np.uint32, int(sizes.sum()))


def text_units(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and spans of the units of a buffer of texts: runs of letters up to U+00FF (made
    small), single digits, runs of other ASCII signs, and whole words that hold anything else."""
    kind, low = _CLASS[buf], lowered(buf)
    second = np.flatnonzero(buf == _LATIN) + 1
    second = second[(buf[second] != _SIGNS[0]) & (buf[second] != _SIGNS[1])]
    kind[second] = kind[second - 1] = 1
    low[second[buf[second] != _SHARP_S]] |= 0x20  # its small letters are 32 further on
    odd, special = kind == 4, (buf[:-1] == 60) & (buf[1:] == 124)  # "<|"
    if odd.any() or special.any():
        a, b = words(buf)
        odd = np.concatenate(([0], np.cumsum(odd)))
        special = np.concatenate(([0], np.cumsum(special), [special.sum()]))
        whole = np.flatnonzero((odd[b] > odd[a]) | (special[b - 1] > special[a]))
        inside = _gathered(a[whole], b[whole] - a[whole])
        kind[inside], low[inside] = 4, buf[inside]
    change = np.flatnonzero((kind[1:] != kind[:-1]) | (kind[1:] == 2)) + 1
    edge = np.concatenate(([0], change, [len(buf)]))
    used = kind[edge[:-1]] != 0
    return low, edge[:-1][used], edge[1:][used]


def _gathered(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions ``starts[i] ... starts[i] + sizes[i] - 1``, one range after another."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def tokenized_rows(column: pa.Array, table: WordIds, separator: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, ids, bounds)`` for runs of rows: ids of row ``first + i`` lie between its bounds."""
    for first, last, buf, starts in text_runs(column, RUN):
        low, a, b = text_units(buf)
        data = low[_gathered(a, b - a)]
        found = pa.LargeStringArray.from_buffers(
            len(a), pa.py_buffer(np.concatenate(([0], np.cumsum(b - a)))), pa.py_buffer(data)).dictionary_encode()
        at = table.rows(found.dictionary)[found.indices.to_numpy()] if len(a) else np.zeros(0, np.int64)
        ids = np.append(table.ids, np.uint32(separator))  # the separator as one word more
        begin, size = table.starts[at], table.starts[at + 1] - table.starts[at]
        row_ends = np.searchsorted(a, starts[1:])
        begin = np.insert(begin, row_ends, len(ids) - 1)
        size = np.insert(size, row_ends, 1)
        bounds = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], row_ends + np.arange(1, last - first + 1)))]
        yield first, ids[_gathered(begin, size)], bounds


def token_pieces(df: DataFrame, id_col: str, text_col: str, capacity: int = CAPACITY,
                 tokenizer: str = TOKENIZER, separator: int = SEPARATOR) -> DataFrame:
    """Documents as pieces of at most ``capacity`` tokens (PIECES; ``ids`` little-endian 32-bit).

    ``tokenizer`` is the path of a vocabulary file on the driver; tasks get its content.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches):
        table = None
        for batch in batches:
            table = table or WordIds(spec.value)
            for first, ids, bounds in tokenized_rows(batch.column(1), table, separator):
                pieces = -(-np.diff(bounds) // capacity)
                row = np.repeat(np.arange(len(pieces)), pieces)
                piece = _gathered(np.zeros(len(pieces), np.int64), pieces)
                begin = bounds[row] + piece * capacity
                end = np.minimum(begin + capacity, bounds[row + 1])
                data = ids.astype("<u4").view(np.uint8)
                crc = [zlib.crc32(data[4 * i:4 * j]) for i, j in zip(begin.tolist(), end.tolist())]
                binary = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(row), [None, pa.py_buffer(4 * np.append(begin, end[-1:])), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(first + row)), pa.array(piece.astype(np.int32)),
                     pa.array(piece * capacity), pa.array(end - begin), binary.cast(pa.binary()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids", "ids_crc32"])

    return rows.mapInArrow(run, PIECES.format(id=rows.schema["doc_id"].dataType.simpleString()))


def _pack(capacity: int, turn: int, reopened: int):
    """The packing of one shard: rows (uid, length, shard) to PLACED."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("uid", "ascending")])
        length = table["length"].to_numpy()
        bins = completed(dict(Counter(length.tolist())), capacity)
        fill = np.array([sum(b) for b in bins])
        emptiest = np.argsort(fill, kind="stable")[:reopened]
        again = np.zeros(len(bins), bool)
        again[emptiest[fill[emptiest] < capacity]] = True
        of = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        size = np.array([x for b in bins for x in b], np.int64)
        offset = np.cumsum(size) - size - np.repeat(np.cumsum(fill) - fill, [len(b) for b in bins])
        order = np.argsort(-size, kind="stable")  # equal lengths are interchangeable
        base = (table["shard"][0].as_py() << 28) + (turn << 24 << 28)
        return pa.table({"uid": table["uid"], "length": table["length"], "sequence_id": pa.array(base + of[order]),
                         "offset": pa.array(offset[order]), "again": pa.array(again[of[order]])})

    return run


def placements(items: DataFrame, capacity: int = CAPACITY, shard_bins: int = SHARD_BINS) -> DataFrame:
    """(uid, sequence_id, offset) for pieces (uid, length): every piece once, gapless sequences.

    ``uid`` is unique and not negative. Sequences of full pieces have negative ids.
    """
    shard_bins = max(shard_bins, 8)
    reopened = min(REOPENED, shard_bins // 8)
    full = items.where(F.col("length") >= capacity) \
        .select("uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left, out, turn, most = items.where(F.col("length") < capacity).select("uid", "length"), full, 0, None
    while True:
        tokens = left.agg(F.sum("length")).first()[0]
        if not tokens:
            return out
        shards = -(-tokens // (capacity * shard_bins))
        shards = max(1, min(shards, most or shards))
        dealt = left.withColumn("shard", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(shards)).cast("long"))
        # a shard is little data but a long search, so tasks are not merged by size
        tasks = min(shards, 4 * shuffle_partitions(items.sparkSession))
        placed = stored(dealt.repartition(tasks, "shard").groupBy("shard").applyInArrow(_pack(capacity, turn, reopened if shards > 1 else 0), PLACED))
        out = out.union(placed.where(~F.col("again")).select("uid", "sequence_id", "offset"))
        left, turn = placed.where("again").select("uid", "length"), turn + 1
        most = shards // 2


def packed_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                  tokenizer: str = TOKENIZER, shard_bins: int = SHARD_BINS) -> DataFrame:
    """Pieces with their tokens, sequence and place in it."""
    pieces = stored(token_pieces(df, id_col, text_col, capacity, tokenizer)
                    .withColumn("uid", F.monotonically_increasing_id()))
    return pieces.join(placements(pieces.select("uid", "length"), capacity, shard_bins), "uid").drop("uid")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids binary): the tokens of whole sequences, bounded by their capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts")) \
        .select("sequence_id", "length", F.aggregate("parts", F.lit(b""), lambda x, p: F.concat(x, p["ids"])).alias("ids"))


def document_packing(documents: DataFrame) -> DataFrame:
    """The packing of ``documents`` as digest columns."""
    return packed_pieces(documents).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
