"""SentencePiece encoding by Gumbel top-k without replacement, and decoding.

A text's segmentations into vocabulary pieces are the paths of a lattice; a path weighs
the product of its pieces' weights (the published merge order ``r`` as a Zipf weight,
``-alpha * log(r + 2)``; a character outside the vocabulary is one edge of its bytes'
fallback pieces). No piece reaches over the start of a word, so the lattice is a chain of
word lattices. Backward sums turn weights into exact conditional edge probabilities; they
are kept per distinct word while a task runs.

A perturbed A* search takes the ``k`` best paths by log probability plus Gumbel noise: a
queue holds disjoint sets of paths with their largest perturbed value. The best set is
opened: a path is drawn from it (it attains the set's value) and the rest falls apart into
one set per position, "the same edges so far, another edge here", whose values are
Gumbels truncated at the opened value, all drawn at once. Distinct paths come out in
descending perturbed order, which is sampling without replacement. With ``t`` the largest
value left in the queue a path of log probability p has the inclusion score
``1 - exp(-exp(p - t))``. All randomness is a hash of seed, row key, sample and position,
so a retried task or another partitioning gives the same samples.

Defined results: a NULL or empty text has one empty segmentation (inclusion 1); fewer than
``k`` segmentations give fewer rows, each with inclusion 1; a NULL key seeds as 0; rows
with equal key and text get equal samples; a U+2581 in a text decodes as a space; other
columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adfunnel.llm.textbytes import mix64

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNIT = re.compile(r" *[^ \n]+|\n| +")
ALPHA = 1.0
FALLBACK = -12.0  # weight of a byte piece
CACHE_EDGES = 1_500_000
RUN_BYTES = 600_000


@dataclass(frozen=True)
class Vocabulary:
    pieces: list[str]
    weights: dict[str, tuple[int, float]]  # piece -> (id, log weight)
    byte_ids: list[int]


def load_vocabulary(model: str = MODEL, alpha: float = ALPHA) -> Vocabulary:
    """Read on the driver and sent to the tasks (32,000 pieces)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    special = {*byte_ids, *(i for i in range(len(pieces)) if sp.is_control(i) or sp.is_unknown(i))}
    plain = [i for i in range(len(pieces)) if i not in special]
    weights = {pieces[i]: (i, -alpha * float(np.log(r + 2))) for r, i in enumerate(plain)}
    return Vocabulary(pieces, weights, byte_ids)


class Lattices:
    """Word lattices as flat arrays; the last edge of a node ends with cumulative probability 1.

    Per edge: cumulative and log probability, target node (-1 at the word's end), node, first
    piece, number of pieces, probability. Per node: first edge, character offset in its word,
    the word's length.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.longest = max(map(len, vocabulary.weights))
        pieces = list(vocabulary.weights)
        keys = np.zeros(len(pieces), np.uint64)
        size = np.array([len(p) for p in pieces])
        self.prefixes = np.zeros(1 << 20, bool)
        for m in range(self.longest):
            on = np.flatnonzero(size > m)
            keys[on] = extended(keys[on], np.array([ord(pieces[i][m]) for i in on], np.uint64))
            self.prefixes[keys[on] >> np.uint64(44)] = True
        ids = np.array([v[0] for v in vocabulary.weights.values()], np.int64)
        order = np.argsort(keys)
        self.keys, self.key_ids = np.append(keys[order], ~np.uint64(0)), np.append(ids[order], 0)
        self.by_id = np.zeros(len(vocabulary.pieces))
        self.by_id[ids] = [v[1] for v in vocabulary.weights.values()]
        self.slots = np.full(1 << 20, -1, np.int32)  # the first key of each slot
        self.slots[self.keys[-2::-1] >> np.uint64(44)] = np.arange(len(keys) - 1, -1, -1)
        self.of_edge = [np.zeros(1 << 16, t) for t in (float, float, np.int64, np.int64, np.int32, np.int32, float)]
        self.of_node = [np.zeros(1 << 16, np.int64) for _ in range(3)]
        self.reset()

    def reset(self) -> None:
        self.root: dict[str, int] = {}
        self.codes: dict[int, tuple[int, ...]] = {}  # pieces of fallback edges
        self.edges = self.nodes = 0  # the arrays keep their room

    def add_all(self, units: list[str]) -> None:
        """Lattices of words not seen before, all at once."""
        text = "".join(units).replace(" ", SPACE)
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n = len(chars)
        size = np.fromiter(map(len, units), np.int64, len(units))
        end = np.cumsum(size)
        left = np.repeat(end, size) - np.arange(n)  # characters to the word's end
        found = []  # (first character, piece) of the pieces of 1, 2, ... characters
        at, h = np.arange(n), np.zeros(n, np.uint64)
        for m in range(1, self.longest + 1):
            on = left[at] >= m
            at = at[on]
            h = extended(h[on], chars[at + m - 1])
            on = self.prefixes[h >> np.uint64(44)]  # no piece begins like the others
            at, h = at[on], h[on]
            place = self.slots[h >> np.uint64(44)]
            maybe = np.flatnonzero(place >= 0)
            place, wanted = place[maybe], h[maybe]
            more = np.flatnonzero(self.keys[place] < wanted)  # the slot's next keys
            while len(more):
                place[more] += 1
                more = more[self.keys[place[more]] < wanted[more]]
            hit = self.keys[place] == wanted
            maybe, place = maybe[hit], place[hit]
            found.append((at[maybe], self.key_ids[place]))
        known = np.zeros(n, bool)
        known[found[0][0]] = True
        other = np.flatnonzero(~known)
        spelled = [[self.vocabulary.byte_ids[b] for b in text[i].encode("utf-8", "surrogatepass")] for i in other]
        # nodes nearer to the word's end first, then by position; of a node longer pieces first
        nodes = np.argsort(left.astype(np.uint16) if n and left.max() < 1 << 16 else left, kind="stable")
        count = np.bincount(other, minlength=n)
        for at, _ in found:
            count[at] += 1
        count = count[nodes]
        heads = np.cumsum(count) - count
        first = np.empty(n, np.int64)
        first[nodes] = heads
        src = np.repeat(nodes, count)
        length, code, width = (np.ones(len(src), np.int32) for _ in range(3))
        free = first.copy()
        while found:
            m, (at, ids) = len(found), found.pop()
            to = free[at]
            length[to], code[to] = m, ids
            free[at] = to + 1
        to = free[other]
        code[to] = [c[0] for c in spelled]
        width[to] = [len(c) for c in spelled]
        weight = self.by_id[code]
        weight[to] = FALLBACK * width[to]
        self.codes.update(zip((to + self.edges).tolist(), map(tuple, spelled)))
        ends = length == left[src]
        target = np.where(ends, n, src + length)
        beta, cum, logp = np.zeros(n + 1), np.empty(len(src)), np.empty(len(src))
        cut = np.append(np.flatnonzero(np.diff(left[nodes], prepend=0)), n)
        steps = np.append(heads, len(src))[cut]
        for a, b, lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), steps[:-1].tolist(), steps[1:].tolist()):
            z = weight[lo:hi] + beta[target[lo:hi]]
            start, several, node = heads[a:b] - lo, count[a:b], nodes[a:b]
            top = np.maximum.reduceat(z, start)
            p = np.exp(z - np.repeat(top, several))
            total = np.add.reduceat(p, start)
            beta[node] = top + np.log(total)
            p /= np.repeat(total, several)
            run = np.cumsum(p)
            run -= np.repeat(run[start] - p[start], several)
            run[start + several - 1] = 1.0
            z -= np.repeat(beta[node], several)
            z[start[several == 1]] = 0.0
            cum[lo:hi], logp[lo:hi] = run, z
        first += self.edges
        offset = np.arange(n) - np.repeat(end - size, size)
        base = self.nodes
        del weight, length, free, beta
        target += base
        target[ends] = -1
        src += base
        self._append(self.of_edge, self.edges, (cum, logp, target, src, code, width, np.exp(logp)))
        self._append(self.of_node, self.nodes, (first, offset, np.repeat(size, size)))
        self.root.update(zip(units, (end - size + base).tolist()))
        self.edges += len(src)
        self.nodes += n

    def _append(self, held: list[np.ndarray], at: int, new: tuple[np.ndarray, ...]) -> None:
        for i, values in enumerate(new):
            need = at + len(values)
            if len(held[i]) < need:
                grown = np.empty(2 * need, held[i].dtype)
                grown[:at] = held[i][:at]
                held[i] = grown
            held[i][at:need] = values

    def arrays(self) -> tuple[np.ndarray, ...]:
        """Edge arrays, then node arrays."""
        return (*self.of_edge, *self.of_node)


def extended(h: np.ndarray, char: np.ndarray) -> np.ndarray:
    """Hashes of strings made longer by one character each."""
    with np.errstate(over="ignore"):
        return (h + char + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)


def hashed(*parts: np.ndarray, h=np.uint64(0x243F6A8885A308D3)) -> np.ndarray:
    """A hash of broadcastable integer parts; ``h``: the hash of parts before them."""
    with np.errstate(over="ignore"):
        for p in parts:
            h = mix64((h ^ np.asarray(p).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15))
    return h


def uniform(*parts: np.ndarray, **before) -> np.ndarray:
    """Uniform numbers in (0, 1) hashed from broadcastable integer parts."""
    return ((hashed(*parts, **before) >> np.uint64(11)).astype(float) + 0.5) * 2.0 ** -53


def draw(lat: tuple, node: np.ndarray, unit: np.ndarray, start: np.ndarray,
         state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Random paths from ``node`` to the ends of their words: (unit, edge), in unit order.

    ``unit``: ascending, each once. ``start``: character position of each unit in its text;
    ``state``: hash of its row's seed and the sample.
    """
    cum, _, target, _, _, _, _, first, offset, _ = lat
    at, count = np.arange(len(unit)), np.zeros(len(unit), np.int64)
    steps = []
    while len(node):
        u = uniform(start[at] + offset[node], h=state[at])
        e = first[node]
        on = np.flatnonzero(cum[e] < u)
        while len(on):
            e[on] += 1
            on = on[cum[e[on]] < u[on]]
        steps.append((at, e))
        count[at] += 1
        node = target[e]
        on = np.flatnonzero(node >= 0)
        node, at = node[on], at[on]
    end = np.cumsum(count)
    begin = end - count
    edge = np.empty(int(count.sum()), np.int64)
    for i, (at, e) in enumerate(steps):
        edge[begin[at] + i] = e
    return np.repeat(unit, count), edge


class Search:
    """The queue of one text: opened paths and the sets that remain beside them."""

    def __init__(self, key: int):
        self.key = key
        self.paths: list[tuple[np.ndarray, np.ndarray, float, float]] = []  # unit, edge, log p, value
        self.sides: list[tuple[np.ndarray, int]] = []  # values of the sets beside a path, first position
        self.taken: list[dict[int, set[int]]] = []  # per path: edges not to take at its first position

    def best(self) -> tuple[float, int, int]:
        """(value, path, position) of the best remaining set."""
        out = (-np.inf, -1, -1)
        for i, (side, first) in enumerate(self.sides):
            if len(side):
                j = int(np.argmax(side))
                if side[j] > out[0]:
                    out = (float(side[j]), i, first + j)
        return out


def open_all(lat: tuple, found: list[tuple], start: np.ndarray) -> None:
    """Adds a path to each search: (search, unit, edge, value, first position, barred there)."""
    _, logp, _, node, _, _, prob, _, offset, _ = lat
    size = np.array([len(f[2]) for f in found])
    end = np.cumsum(size)
    unit, edge = np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])
    lp = logp[edge]
    before = np.empty(len(lp))  # log probability of the path up to each position
    for (s, _, _, value, _, _), lo, hi in zip(found, (end - size).tolist(), end.tolist()):
        whole = np.cumsum(lp[lo:hi])
        before[lo], before[lo + 1:hi] = 0.0, whole[:-1]
        s.paths.append((unit[lo:hi], edge[lo:hi], float(whole[-1]), value))
    skip = np.array([f[4] for f in found])
    if skip.any():  # positions before the first
        on = np.flatnonzero(np.arange(len(lp)) >= np.repeat(end - size + skip, size))
        unit, edge, lp, before = unit[on], edge[on], lp[on], before[on]
        size = size - skip
        end = np.cumsum(size)
    left = 1 - prob[edge]
    for (_, _, _, _, _, barred), lo in zip(found, (end - size).tolist()):
        if barred:
            left[lo] -= sum(float(np.exp(logp[e])) for e in barred)
    left[lp == 0.0] = 0.0
    ok = left > 1e-12
    left[~ok] = 1.0
    mass = before + np.log(left)
    state = hashed(np.array([f[0].key for f in found], np.uint64),
                   np.array([len(f[0].paths) - 1 + 1_000_003 for f in found]))
    u = uniform(start[unit] + offset[node[edge]], h=np.repeat(state, size))
    value = np.repeat(np.array([f[3] for f in found]), size)
    with np.errstate(over="ignore"):
        side = mass - np.log(np.exp(np.minimum(mass - value, 700)) - np.log(u))
    side[~ok] = -np.inf
    for (s, _, _, _, first, barred), lo, hi in zip(found, (end - size).tolist(), end.tolist()):
        s.sides.append((side[lo:hi], first))
        s.taken.append({first: set(barred)})


def encode_run(lattices: Lattices, texts: list[str], keys: np.ndarray, k: int):
    """For each text a list of (ids, log p, value, inclusion)."""
    units, first = [], [0]
    for t in texts:
        units += UNIT.findall(" " + t) if t else []
        first.append(len(units))
    if lattices.edges > CACHE_EDGES:
        lattices.reset()
    root = lattices.root
    new = list(set(units).difference(root))
    if new:
        lattices.add_all(new)
    lat = lattices.arrays()
    node = np.fromiter(map(root.__getitem__, units), np.int64, len(units))
    length = lat[-1][node]
    first = np.array(first)
    start = np.cumsum(length) - length
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    start -= start[first[owner]] if len(owner) else 0
    searches = [Search(int(x)) for x in keys]
    unit, edge = draw(lat, node, np.arange(len(units)), start, hashed(keys, 0)[owner])
    cut = np.searchsorted(unit, first)
    g = -np.log(-np.log(uniform(keys, 999_983)))
    found = [(s, unit[cut[i]:cut[i + 1]], edge[cut[i]:cut[i + 1]], float(g[i]), 0, set())
             for i, s in enumerate(searches) if first[i + 1] > first[i]]
    if found:
        open_all(lat, found, start)
    _, logp, target, of, piece, width, _, head, offset, _ = lat
    for sample in range(1, k):
        todo = []
        for i, s in enumerate(searches):
            value, path, at = s.best() if s.paths else (-np.inf, -1, -1)
            if path < 0:
                continue
            pu, pe, _, _ = s.paths[path]
            side, begin = s.sides[path]
            side[at - begin] = -np.inf
            todo.append((i, value, path, at, s.taken[path].get(at, set()) | {int(pe[at])}))
        if not todo:
            break
        begun = [searches[i].paths[path] for i, _, path, _, _ in todo]
        forks = of[[p[1][t[3]] for p, t in zip(begun, todo)]]
        u = uniform(keys[[t[0] for t in todo]], sample, start[[p[0][t[3]] for p, t in zip(begun, todo)]] + offset[forks], 77)
        for j, (v, x) in enumerate(zip(forks.tolist(), u.tolist())):
            barred, options, e = todo[j][-1], [], int(head[v])
            while e < lattices.edges and of[e] == v:
                if e not in barred:
                    options.append(e)
                e += 1
            weights = np.exp(logp[options])
            chosen = options[min(int(np.searchsorted(np.cumsum(weights), x * weights.sum())), len(options) - 1)]
            todo[j] += (chosen,)
        # the rest of the word, and all later words of each text, in one draw
        nodes, us = [], []
        for i, _, path, at, _, chosen in todo:
            here = int(searches[i].paths[path][0][at])
            later = np.arange(here + 1, first[i + 1])
            rest = [] if target[chosen] < 0 else [here]
            us.append(np.concatenate([np.array(rest, np.int64), later]))
            nodes.append(np.concatenate([np.array([target[chosen]] if rest else [], np.int64), node[later]]))
        us, nodes = np.concatenate(us), np.concatenate(nodes)
        unit, edge = draw(lat, nodes, us, start[us], hashed(keys, sample)[owner[us]])
        cut = np.searchsorted(unit, [(searches[i].paths[path][0][at], first[i + 1]) for i, _, path, at, _, _ in todo])
        found = []
        for (i, value, path, at, barred, chosen), (a, b) in zip(todo, cut.tolist()):
            pu, pe, _, _ = searches[i].paths[path]
            found.append((searches[i], np.concatenate([pu[:at + 1], unit[a:b]]),
                          np.concatenate([pe[:at], [chosen], edge[a:b]]), value, at, barred))
        open_all(lat, found, start)
    for s in searches:
        if not s.paths:
            yield [(np.zeros(0, np.int32), 0.0, 0.0, 1.0)]
            continue
        threshold = s.best()[0]
        rows = []
        for _, e, p, value in s.paths:
            ids = piece[e]
            if (width[e] > 1).any():
                ids = np.array([x for j, c in zip(e.tolist(), ids.tolist())
                                for x in lattices.codes.get(j, (c,))], np.int32)
            with np.errstate(over="ignore"):
                included = 1.0 if threshold == -np.inf else -float(np.expm1(-np.exp(min(p - threshold, 700.0))))
            rows.append((ids, p, value, included))
        yield rows


def decode(ids, vocabulary: Vocabulary) -> str:
    """The text of a segmentation."""
    pieces, byte_of = vocabulary.pieces, {i: b for b, i in enumerate(vocabulary.byte_ids)}
    out = bytearray()
    for i in ids:
        if i in byte_of:
            out.append(byte_of[i])
        else:
            out += pieces[i].encode()
    return out.decode("utf-8", "replace").replace(SPACE, " ")[1:]


def sampled_segmentations(documents: DataFrame, key: str, text: str, k: int = 2, seed: int = 0,
                          vocabulary: Vocabulary | None = None) -> DataFrame:
    """(key, sample, ids, log_prob, value, inclusion, decoded_equal): ``k`` rows per row."""
    voc = vocabulary or load_vocabulary()
    # plain lists and dicts: executors may lack this package
    shared = documents.sparkSession.sparkContext.broadcast((voc.pieces, voc.weights, voc.byte_ids))

    def run(batches):
        voc = Vocabulary(*shared.value)
        lattices = Lattices(voc)
        table = [p.encode() for p in voc.pieces]
        for b, i in enumerate(voc.byte_ids):
            table[i] = bytes([b])
        table = np.array(table, object)
        for batch in batches:
            size = pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False)
            keys = mix64(batch.column(0).fill_null(0).to_numpy().view(np.uint64) ^ np.uint64(seed))
            lo = 0
            end = np.cumsum(size, dtype=np.int64)
            while lo < len(size):  # rows of about RUN_BYTES at a time
                hi = max(lo + 1, int(np.searchsorted(end, end[lo] - size[lo] + RUN_BYTES, "right")))
                texts = [t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                cols: list[list] = [[] for _ in range(7)]
                for i, rows in enumerate(encode_run(lattices, texts, keys[lo:hi], k)):
                    whole = texts[i].encode("utf-8", "surrogatepass")
                    for s, (ids, p, value, included) in enumerate(rows):
                        data = b"".join(table[ids].tolist()).replace(b"\xe2\x96\x81", b" ")[1:]
                        for c, v in zip(cols, (lo + i, s + 1, ids, p, value, included, data == whole)):
                            c.append(v)
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in cols[2]])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(cols[2]), pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(cols[0])), pa.array(cols[1], pa.int32()), ids,
                     pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.float64()),
                     pa.array(cols[5], pa.float64()), pa.array(cols[6], pa.bool_())],
                    [key, "sample", "ids", "log_prob", "value", "inclusion", "decoded_equal"])
                lo = hi

    rows = documents.select(F.col(key).cast("long").alias(key), F.col(text).alias(text))
    return rows.mapInArrow(run, f"`{key}` long, sample int, ids array<int>, log_prob double, value double, "
                                "inclusion double, decoded_equal boolean")


def document_segmentations(documents: DataFrame, k: int = 2) -> DataFrame:
    """Digest columns of the sampled segmentations of ``documents``."""
    return sampled_segmentations(documents, "doc_id", "text", k).select(
        "doc_id", "sample", F.size("ids").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"),
        "log_prob", "value", "inclusion", "decoded_equal")
