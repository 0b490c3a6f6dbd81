"""Packing of integer lengths into bins by bin completion (Spark-free helper of one task).

Lengths are kept as counts: equal lengths are interchangeable. The search fills one bin at a
time around the largest length left, trying the undominated fillings in order of the space
they waste, and gives up a branch when the waste no longer allows fewer bins than the best
solution known. Best-fit decreasing gives the first solution and is run again on what is
left at intervals of the search. ``nodes`` bounds the work, not the result: every length is
always packed, and the best solution found is returned.
"""

from __future__ import annotations

from collections.abc import Iterator

Counts = dict[int, int]
Bin = tuple[int, ...]

NODES = 1000
WIDTH = 8  # fillings tried at a node
TRIES = 128  # fillings looked at for them
AGAIN = 64  # nodes between best-fit solutions of what is left


def best_fit(counts: Counts, capacity: int) -> list[list[int]]:
    """Best-fit decreasing; equal lengths go into the best bin together while they fit."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r: some bin has r left
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            fits = rooms >> length
            if fits:
                room = length + (fits & -fits).bit_length() - 1
                at = by_room[room].pop()
                if not by_room[room]:
                    rooms &= ~(1 << room)
            else:
                room, at = capacity, len(bins)
                bins.append([])
            n = min(left, room // length)
            bins[at] += [length] * n
            left -= n
            room -= n * length
            by_room.setdefault(room, []).append(at)
            rooms |= 1 << room
    return bins


def least_bins(counts: Counts, capacity: int) -> int:
    """A lower bound (Martello and Toth): for each threshold, lengths too long to share a bin
    with any of at least the threshold, lengths over half a bin, and the rest by volume."""
    number, volume = [0] * (capacity + 2), [0] * (capacity + 2)  # of lengths from x up
    for x in range(capacity, -1, -1):
        n = counts.get(x, 0)
        number[x], volume[x] = number[x + 1] + n, volume[x + 1] + n * x
    half, least = capacity // 2 + 1, 0
    for small in range(capacity // 2 + 1):
        alone = capacity - small + 1
        over = number[half] - number[max(alone, half)]
        room = over * capacity - (volume[half] - volume[max(alone, half)])
        rest = volume[small] - volume[half] - room
        least = max(least, number[half] + max(0, -(-rest // capacity)))
    return least


def fillings(counts: Counts, room: int, waste: int) -> Iterator[Bin]:
    """Undominated fillings of ``room`` from ``counts`` that waste at most ``waste``, least waste first.

    Left out are fillings to which a length could be added, and those in which a length, or
    two together, could be exchanged for one larger (for two: as large) that is left over.
    """
    lengths = sorted((x for x, n in counts.items() if n and x <= room), reverse=True)
    full = (1 << (room + 1)) - 1
    reach = [1] * (len(lengths) + 1)  # bit s of reach[i]: lengths[i:] can sum to s
    for i in range(len(lengths) - 1, -1, -1):
        bits, n, step = reach[i + 1], min(counts[lengths[i]], room // lengths[i]), 1
        while n:
            take = min(step, n)
            bits |= (bits << (take * lengths[i])) & full
            n, step = n - take, step * 2
        reach[i] = bits

    def exact(i: int, need: int) -> Iterator[Bin]:
        if not need:
            yield ()
            return
        if i == len(lengths) or not reach[i] >> need & 1:
            return
        for n in range(min(counts[lengths[i]], need // lengths[i]), -1, -1):
            for rest in exact_from(i + 1, need - n * lengths[i]):
                yield (lengths[i],) * n + rest

    def exact_from(i: int, need: int) -> Iterator[Bin]:
        while i < len(lengths) and need and (lengths[i] > need or not counts[lengths[i]]):
            i += 1
        return exact(i, need)

    tries = 0
    for slack in range(min(waste, room) + 1):
        if reach[0] >> (room - slack) & 1:
            for filling in exact_from(0, room - slack):
                if not _dominated(filling, counts, lengths, slack):
                    yield filling
                tries += 1
                if tries == TRIES:
                    return


def _dominated(filling: Bin, counts: Counts, lengths: list[int], slack: int) -> bool:
    spare = 0  # bit x: length x is left over
    for x in lengths:
        if counts[x] > filling.count(x):
            spare |= 1 << x
    if slack and spare & ((1 << (slack + 1)) - 1):
        return True
    window = (1 << slack) - 1
    kinds = sorted(set(filling))
    if slack and any(spare >> (x + 1) & window for x in kinds):
        return True
    return any(spare >> (x + y) & (2 * window + 1) for i, x in enumerate(kinds) for y in kinds[i:]
               if x != y or filling.count(x) > 1)


def completed(counts: Counts, capacity: int, nodes: int = NODES) -> list[list[int]]:
    """The lengths of ``counts`` in as few bins of ``capacity`` as the search finds."""
    best = best_fit(counts, capacity)
    least = least_bins(counts, capacity)
    if len(best) <= least:
        return best
    left = {x: n for x, n in counts.items() if n}
    order = sorted(left, reverse=True)
    total = sum(x * n for x, n in left.items())
    path: list[Bin] = []
    options: list[Iterator[Bin]] = []
    wasted, used = 0, 0

    def largest() -> int:
        return next((x for x in order if left[x]), 0)

    def expand() -> Iterator[Bin]:
        top, n = largest(), 0
        left[top] -= 1
        allowed = (len(best) - 1) * capacity - total - wasted
        try:
            for filling in fillings(left, capacity - top, allowed) if allowed >= 0 else ():
                left[top] += 1
                yield (top, *filling)
                left[top] -= 1
                n += 1
                if n == WIDTH:
                    return
        finally:
            left[top] += 1

    options.append(expand())
    while options and used < nodes and len(best) > least:
        filling = next(options[-1], None)
        if filling is None:
            options.pop()
            if path:
                for x in (undone := path.pop()):
                    left[x] += 1
                wasted -= capacity - sum(undone)
            continue
        used += 1
        for x in filling:
            left[x] -= 1
        path.append(filling)
        wasted += capacity - sum(filling)
        if not largest() or used % AGAIN == 0:
            rest = best_fit({x: n for x, n in left.items() if n}, capacity)
            if len(path) + len(rest) < len(best):
                best = [list(b) for b in path] + rest
        within = wasted <= (len(best) - 1) * capacity - total
        options.append(expand() if largest() and within and len(path) < len(best) - 1 else iter(()))
    return best
