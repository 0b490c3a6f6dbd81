"""Near duplicates by HyperMinHash.

Each text's set of word shingles (64-bit hashes) is sketched into ``BUCKETS`` registers:
the bucket is the top bits of a shingle's hash, and of the bucket's smallest value only the
count of leading zeros (6 bits) and the next 10 mantissa bits are stored. An empty bucket
borrows the register of a filled one picked by fixed random priorities, so registers of
short texts also agree with the sets' Jaccard similarity as probability. ``ROWS``
neighbouring registers make a band; texts that agree on a whole band are candidates. A
candidate pair is kept when its similarity estimated from all registers, corrected for
chance agreement of compressed registers, is within five standard deviations of the
threshold, and is then verified on the full sets.

No bucket is expanded into all its pairs. Equal sets are one class beforehand. Every
member of a band bucket is compared with the bucket's smallest id; after linked texts are
joined into components, only buckets that still hold several components compare members
across components: small ones pair by pair, crowded ones (a passage that many texts share
fills them with unlike texts) in pairs of bounded blocks, first on registers alone; full
sets are then compared only of members for which a block holds a likely partner. A pair at
the threshold shares no band with probability (1 - 0.75^4)^32 = 5e-6.

Defined results: no words (or NULL text): empty set, linked with nothing, own component;
fewer words than a shingle: the whole sequence as one shingle; a NULL doc_id takes no part
(component NULL, kept); rows repeated with one doc_id share its component; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adfunnel.llm.common import checkpointed
from adfunnel.llm.components import component_labels
from adfunnel.llm.textbytes import lowered, mix64, per_row, span_hashes, text_runs, words

SHINGLE = 5
BUCKET_BITS = 7
BUCKETS = 1 << BUCKET_BITS
ROWS = 4
BANDS = BUCKETS // ROWS
MANTISSA = 10
FEW = 64  # members of a bucket that are compared pair by pair
BLOCK = 512  # members of a block in a larger bucket
_PRIORITY = np.random.default_rng(7).permuted(
    np.tile(np.arange(BUCKETS, dtype=np.int16), (BUCKETS, 1)), axis=1)


def shingle_sets(column: pa.Array):
    """``(first row, [sorted distinct shingle hashes per row])`` per run of rows."""
    for first, last, buf, starts in text_runs(column):
        small = lowered(buf)
        a, b = words(small)
        w = span_hashes(small, a, b)
        of = per_row(starts, a)
        with np.errstate(over="ignore"):
            n = max(len(w) - SHINGLE + 1, 0)
            h = np.zeros(n, np.uint64)
            for i in range(SHINGLE):
                h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + w[i:n + i])
            sets = []
            for i in range(last - first):
                lo, hi = of[i], of[i + 1]
                if hi - lo >= SHINGLE:
                    sets.append(np.unique(h[lo:hi - SHINGLE + 1]))
                elif hi > lo:
                    whole = np.uint64(hi - lo)
                    for x in w[lo:hi]:
                        whole = mix64(whole * np.uint64(0xD6E8FEB86659FD93) + x)
                    sets.append(np.array([whole], np.uint64))
                else:
                    sets.append(np.zeros(0, np.uint64))
        yield first, sets


def registers(values: np.ndarray) -> np.ndarray:
    """The compressed registers (uint16) of a sorted, non-empty set of hashes."""
    bucket = (values >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    head = np.flatnonzero(np.diff(bucket, prepend=-1))
    filled = bucket[head]
    rest = values[head] << np.uint64(BUCKET_BITS)  # the smallest value of each bucket
    top = np.frexp(rest.astype(np.float64))[1]  # bits up to the leading one (rounding is harmless:
    zeros = np.clip(64 - top, 0, 63)            # equal values still give equal registers)
    mantissa = (rest << np.minimum(zeros + 1, 63).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    packed = (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)
    out = np.empty(BUCKETS, np.uint16)
    out[filled] = packed
    if len(filled) < BUCKETS:
        empty = np.ones(BUCKETS, bool)
        empty[filled] = False
        out[empty] = packed[np.argmin(_PRIORITY[empty][:, filled], axis=1)]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One key per band: rows x BUCKETS registers to rows x BANDS longs."""
    bands = np.ascontiguousarray(regs).view(np.uint64)  # ROWS registers of 16 bits
    with np.errstate(over="ignore"):
        salt = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return mix64(mix64(bands) ^ salt).view(np.int64)


def register_chances(n: np.ndarray) -> np.ndarray:
    """Probability of every leading-zero count for sets of ``n`` shingles, one row each."""
    edge = 0.5 ** np.arange(0, 40)
    load = np.maximum(n / BUCKETS, 1.0)[:, None]
    return np.diff((1 - edge[None, :]) ** load, axis=1)  # of P(smallest value > edge)


def chance_agreement(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that registers of unrelated sets of ``n`` and ``m`` shingles agree."""
    return (register_chances(n) * register_chances(m)).sum(1) / (1 << MANTISSA)


def estimated(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard similarity of register rows."""
    c = chance_agreement(n, m)
    return np.maximum(((a == b).mean(1) - c) / (1 - c), 0)


def sketch(documents: DataFrame) -> DataFrame:
    """(doc_id, n, d1, d2, regs): set size, 128-bit set digest, registers (NULL when empty)."""
    def run(batches):
        for batch in batches:
            for first, sets in shingle_sets(batch.column(1)):
                d1 = np.zeros(len(sets), np.int64)
                d2 = np.zeros(len(sets), np.int64)
                regs = []
                with np.errstate(over="ignore"):
                    for i, s in enumerate(sets):
                        if not len(s):
                            regs.append(None)
                            continue
                        x = mix64(s)  # the digests are sums of scrambled members
                        d1[i] = x.sum(dtype=np.uint64).view(np.int64)
                        d2[i] = mix64(x ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64).view(np.int64)
                        regs.append(registers(s).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(sets)), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(d1), pa.array(d2), pa.array(regs, pa.binary())],
                    ["doc_id", "n", "d1", "d2", "regs"])

    return documents.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n long, d1 long, d2 long, regs binary")


def band_rows(reps: DataFrame) -> DataFrame:
    """(key, rep, n): every class in each of its bands."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(-1, BUCKETS)
            keys = band_keys(regs)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)),
                 pa.array(np.repeat(batch.column(1).to_numpy(), BANDS))], ["key", "rep", "n"])

    return reps.select("rep", "n", "regs").mapInArrow(run, "key long, rep long, n long")


def likely_pairs(pairs: DataFrame, reps: DataFrame, share: float) -> DataFrame:
    """The pairs (a, b) whose estimated similarity can reach ``share``."""
    left = reps.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
    right = reps.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ra, rb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, BUCKETS)
                      for i in (4, 5))
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            ok = estimated(ra, rb, na, nb) >= least_estimate(share, na, nb)
            yield batch.select([0, 1]).filter(pa.array(ok))

    joined = pairs.join(left, "a").join(right, "b") \
        .where(F.least("na", "nb") >= F.lit(share) * F.greatest("na", "nb")) \
        .select("a", "b", "na", "nb", "ra", "rb")
    return joined.mapInArrow(run, "a long, b long")


def full_sets(reps: DataFrame, ids: DataFrame, documents: DataFrame) -> DataFrame:
    """(rep, members binary): full shingle sets of the classes named in ``ids`` (rep)."""
    def expand(batches):
        for batch in batches:
            for first, sets in shingle_sets(batch.column(1)):
                with np.errstate(over="ignore"):
                    d1 = [int(mix64(s).sum(dtype=np.uint64).view(np.int64)) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(sets)), pa.array(d1, pa.int64()),
                     pa.array([s.tobytes() for s in sets], pa.binary())], ["doc", "d1", "members"])

    wanted = reps.join(ids, "rep").select("rep", "doc", "d1")
    sets = documents.select(F.col("doc_id").alias("doc"), "text").join(wanted, "doc", "left_semi") \
        .mapInArrow(expand, "doc long, d1 long, members binary")
    return sets.join(wanted, ["doc", "d1"]).dropDuplicates(["rep"]).select("rep", "members")


def verified_pairs(pairs: DataFrame, documents: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union on their full shingle sets."""
    def compare(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    ids = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct()
    sets = full_sets(reps, ids, documents)
    left = sets.select(F.col("rep").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("rep").alias("b"), F.col("members").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y") \
        .mapInArrow(compare, "a long, b long")


def least_estimate(share: float, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The lowest estimate at which sets of ``n`` and ``m`` shingles may still reach ``share``."""
    used = np.minimum(np.minimum(n, m) / 2, BUCKETS)
    return share - 5 * np.sqrt(share * (1 - share) / np.maximum(used, 1))


def with_likely_partner(group: pa.Table, share: float) -> np.ndarray:
    """Which members of a pair of blocks have a likely partner in another component."""
    n, component = group.column("n").to_numpy(), group.column("component").to_numpy()
    block, lo, hi = (group.column(c).to_numpy() for c in ("block", "lo", "hi"))
    regs = np.frombuffer(b"".join(group.column("regs").to_pylist()), np.uint16).reshape(-1, BUCKETS)
    chances = register_chances(n)
    found = np.zeros(len(n), bool)
    for i in np.flatnonzero(block == lo):
        other = (component != component[i]) & ((lo == hi) | (block == hi))
        other &= np.minimum(n, n[i]) >= share * np.maximum(n, n[i])
        at = np.flatnonzero(other)
        chance = chances[at] @ chances[i] / (1 << MANTISSA)
        estimate = ((regs[at] == regs[i]).mean(1) - chance) / (1 - chance)
        near = at[estimate >= least_estimate(share, n[at], n[i])]
        if len(near):
            found[i] = True
            found[near] = True
    return found


def block_links(rows: DataFrame, documents: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Verified links inside crowded buckets, without a row per pair.

    ``rows`` (key, rep, n, component, m): members of buckets with ``m`` members. A bucket's
    largest component, its core, is dealt into blocks of about ``BLOCK`` members, and so are
    the others. Pairs inside the core are linked already; each other pair of blocks is one
    bounded group, in which all intersections come from one product of the blocks'
    incidence matrices. Full sets are sent only of members with a likely partner by the
    registers in that pair of blocks.
    """
    def likely(group: pa.Table) -> pa.Table:
        found = with_likely_partner(group, percent / 100)
        return group.select(["key", "rep", "block", "lo", "hi"]).filter(pa.array(found))

    def links(group: pa.Table) -> pa.Table:
        lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
        rep, block = group.column("rep").to_numpy(), group.column("block").to_numpy()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("members")]
        size = np.array([len(s) for s in sets])
        _, member, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), size)
        column = np.cumsum(held > 1) - 1  # only shingles of two members or more matter
        keep = held[member] > 1
        row, member = row[keep], column[member[keep]]
        order = np.argsort(member, kind="stable")
        row, member = row[order], member[order]
        both = np.zeros((len(sets), len(sets)), np.float32)
        for c in range(0, int(member[-1]) + 1 if len(member) else 0, 4096):
            at = slice(*np.searchsorted(member, [c, c + 4096]))
            inside = np.zeros((len(sets), 4096), np.float32)
            inside[row[at], member[at] - c] = 1
            both += inside @ inside.T
        union = size[:, None] + size[None, :] - both
        ok = (100 * both.astype(np.int64) >= percent * union.astype(np.int64)) & (rep[:, None] < rep[None, :])
        if lo != hi:
            ok &= block[:, None] != block[None, :]
        # a forest of the verified links is enough for components
        ok |= ok.T
        label = np.arange(len(rep))
        order = np.argsort(rep)
        ok = ok[order][:, order]
        while True:
            low = np.minimum(label, np.where(ok, label[None, :], len(rep)).min(1, initial=len(rep)))
            low = low[low]
            if (low == label).all():
                break
            label = low
        at = np.flatnonzero(label < np.arange(len(rep)))
        rep = rep[order]
        return pa.table({"a": rep[label[at]], "b": rep[at]})

    cores = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size")) \
        .groupBy("key").agg(F.max(F.struct("size", "component")).alias("core")) \
        .select("key", F.col("core.size").alias("size"), F.col("core.component").alias("core"))
    dealt = rows.join(cores, "key").select(
        "key", "rep", "n", "component", (F.col("component") == F.col("core")).alias("inside"),
        F.ceil((F.col("m") - F.col("size")) / BLOCK).cast("long").alias("outer"),
        F.ceil(F.col("size") / BLOCK).cast("long").alias("inner")) \
        .withColumn("block", F.expr("if(inside, outer + pmod(xxhash64(rep), inner), pmod(xxhash64(rep), outer))")) \
        .withColumn("other", F.explode(F.expr("sequence(0L, if(inside, outer, outer + inner) - 1)"))) \
        .select("key", "rep", "n", "component", "block", F.least("block", "other").alias("lo"),
                F.greatest("block", "other").alias("hi")).join(reps.select("rep", "regs"), "rep")
    left = checkpointed(dealt.groupBy("key", "lo", "hi").applyInArrow(
        likely, "key long, rep long, block long, lo long, hi long"))
    sets = full_sets(reps, left.select("rep").distinct(), documents)
    return left.join(sets, "rep").groupBy("key", "lo", "hi").applyInArrow(links, "a long, b long").distinct()


def mixed_buckets(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, rep, n, component, m): members of buckets that hold several components."""
    placed = shared.join(labels, F.col("rep") == F.col("node"), "left") \
        .select("key", "rep", "n", F.coalesce("component", "rep").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                      F.count(F.lit(1)).alias("m")).where("lo < hi").select("key", "m")
    return checkpointed(placed.join(mixed, "key"))


def near_duplicates(documents: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``documents``."""
    share = percent / 100
    docs = checkpointed(sketch(documents))
    some = docs.where("n > 0 AND doc_id IS NOT NULL")
    classes = some.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("doc"), F.first("regs").alias("regs"))
    # ids on rows of different sets: their classes are linked, and named by digest
    shared_ids = checkpointed(some.groupBy("doc_id").agg(
        F.min(F.struct("n", "d1", "d2")).alias("lo"), F.max(F.struct("n", "d1", "d2")).alias("hi"))
        .where("lo <> hi").select("doc_id"))
    repeated = not shared_ids.isEmpty()
    name = F.col("doc")
    if repeated:
        classes = classes.join(shared_ids.select(F.col("doc_id").alias("doc"), F.lit(True).alias("two")), "doc", "left")
        name = F.when(F.col("two"), F.xxhash64("n", "d1", "d2")).otherwise(F.col("doc"))
    classes = checkpointed(classes.select("n", "d1", "d2", "doc", "regs", name.alias("rep")))
    reps = classes
    bands = band_rows(reps)
    leaders = bands.groupBy("key").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("m")) \
        .where("m > 1").select("key", "leader")
    shared = checkpointed(bands.join(leaders, "key"))
    stars = checkpointed(shared.where("rep <> leader").select(
        F.col("leader").alias("a"), F.col("rep").alias("b")).distinct())
    links = checkpointed(verified_pairs(checkpointed(likely_pairs(stars, reps, share)), documents, reps, percent))
    if repeated:
        named = some.join(shared_ids, "doc_id").select("doc_id", "n", "d1", "d2").distinct() \
            .join(classes.select("n", "d1", "d2", "rep"), ["n", "d1", "d2"]).select("doc_id", "rep")
        first = named.groupBy("doc_id").agg(F.min("rep").alias("a"))
        links = checkpointed(links.union(named.join(first, "doc_id").where("rep <> a").select("a", F.col("rep").alias("b"))))
    labels = component_labels(links)

    open_rows = mixed_buckets(shared.drop("leader"), labels)
    few = open_rows.where(F.col("m") <= FEW)
    x = few.select("key", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"))
    y = few.select("key", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"))
    across = x.join(y, "key").where("a < b AND ca <> cb").where(
        F.least("na", "nb") >= F.lit(share) * F.greatest("na", "nb")).select("a", "b").distinct() \
        .join(stars, ["a", "b"], "left_anti")
    across = checkpointed(likely_pairs(across, reps, share))
    more = []
    if not across.isEmpty():
        more.append(verified_pairs(across, documents, reps, percent))
    crowded = open_rows.where(F.col("m") > FEW)
    if not crowded.isEmpty():
        more.append(block_links(crowded.select("key", "rep", "n", "component", "m"), documents, reps, percent))
    for found in more:
        links = links.union(found)
    if more:
        labels = component_labels(links)

    named = classes.join(labels, F.col("rep") == F.col("node"), "left").select(
        "n", "d1", "d2", "doc", F.coalesce("component", "rep").alias("component"))
    if repeated:  # components are named by their smallest id
        least = named.groupBy("component").agg(F.min("doc").alias("least"))
        named = named.join(least, "component").select("n", "d1", "d2", F.col("least").alias("component"))
    named = named.select("n", "d1", "d2", "component")
    out = docs.join(named, ["n", "d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
