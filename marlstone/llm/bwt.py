"""Burrows-Wheeler transforms of shards, and their merge by interleave refinement.

A shard is a collection of segments, each closed by an end mark (code 0, the
bytes are 1 to 256; end marks of later segments are greater). Its transform
lists, for the shard's sorted suffixes, the codes before each, several at a
time, and where the suffix that begins with them stands in the shard's order.

The merge never compares suffixes of different shards, nor sorts them anew. It
holds an interleave: the shards' rows in the order of their first d codes, with
the intervals of rows that agree on all d. A pass reads the codes before each
row from the row's own transform, moves the rows stably behind what they have
read, and so has the interleave for d and as many codes more; an interval
splits where the codes differ. A row alone in its interval shares no longer
prefix with any other, and leaves. What is left at the wanted depth are the
repeated intervals: all rows with a common prefix of that many codes with
another one, in the merged order.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

U = np.uint64
#: Codes that a pass reads.
STEP = 8
#: Codes that the first sort of a shard compares at once: 9 bits each.
HEAD = 7


def joined(data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Codes of segments of bytes that lie one after another, each closed by its end mark."""
    out = np.zeros(len(data) + len(size), np.uint16)
    stay = np.ones(len(out), bool)
    stay[np.cumsum(size + 1) - 1] = False
    out[stay] = data.astype(np.uint16) + 1
    return out


def suffix_order(codes: np.ndarray) -> np.ndarray:
    """The shard's suffixes in order; equal up to the end mark, the earlier segment's comes first."""
    n = len(codes)
    padded = np.concatenate([codes, np.zeros(HEAD, np.uint16)])
    key = np.zeros(n, np.int64)
    open_ = np.ones(n, bool)
    for k in range(HEAD):
        code = padded[k : k + n]
        key <<= 9
        key += np.where(open_, code, 0)
        open_ &= code > 0
    order = np.argsort(key)
    short = np.flatnonzero(~open_[order])  # these have met their end mark: ties by place
    own = order[short]
    order[short] = own[np.lexsort((own, key[own]))]
    k = key[order]
    new = np.ones(n, bool)
    new[1:] = (k[1:] != k[:-1]) | ~open_[order[1:]]
    first = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))
    size = HEAD
    # of each group that is not yet settled: its places in the order
    alone = new & np.append(new[1:], True)
    at = np.flatnonzero(~alone)
    while len(at):
        own = order[at]
        key = rank[own] * n + rank[own + size]  # an open suffix has its end mark ahead, so own + size is inside
        move = np.argsort(key)
        own, key = own[move], key[move]
        order[at] = own  # groups keep their places
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        rank[own] = np.repeat(at[first], np.diff(np.append(first, len(at))))
        at = at[~(new & np.append(new[1:], True))]
        size *= 2
    return order


class Shard(NamedTuple):
    """A shard's transform: by sorted suffix its place, whether `depth` codes stand before it, and for each size of a pass the codes read and the row that begins with them."""

    place: np.ndarray
    deep: np.ndarray
    passes: list[tuple[np.ndarray, np.ndarray]]


def sizes(depth: int) -> list[int]:
    """Codes that the passes read: STEP as long as it goes, then the rest."""
    return [STEP] * (depth // STEP) + [depth % STEP] * (depth % STEP > 0)


def transform(codes: np.ndarray, depth: int) -> Shard:
    place = suffix_order(codes).astype(np.int32)
    n = len(codes)
    row = np.empty(n, np.int32)
    row[place] = np.arange(n, dtype=np.int32)
    ends = np.flatnonzero(codes == 0)
    begin = np.concatenate([[0], ends[:-1] + 1])
    before = np.arange(n) - np.repeat(begin, ends + 1 - begin)  # codes of its own segment before each place
    byte = (codes - 1).astype(np.uint8).astype(U)
    passes = []
    for size in dict.fromkeys(sizes(depth)):
        read = np.zeros(n, U)
        for k in range(1, min(size, n - 1) + 1):  # where fewer stand before, what is read is of no use and never asked for
            read[k:] |= byte[: n - k] << U(8 * (k - 1))
        passes.append((read[place], row[np.maximum(place - size, 0)]))
    return Shard(place, before[place] >= depth, passes)


def _stable(x: np.ndarray) -> np.ndarray:
    """The stable order: two sorts without a comparison of equals are faster than a stable one."""
    order = np.argsort(x)
    ordered = x[order]
    key = np.zeros(len(x), U)
    key[1:] = np.cumsum(ordered[1:] != ordered[:-1])
    key = (key << U(32)) | order.astype(U)
    key.sort()
    return (key & U(0xFFFFFFFF)).astype(np.int64)


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix, interval) along the merged order, of the suffixes that share their first `depth` codes, no end mark among them, with another.

    A suffix is its place in the shards' codes one after another.
    """
    base = np.cumsum([0] + [len(s.place) for s in shards])
    rows = np.flatnonzero(np.concatenate([s.deep for s in shards]))
    tables = {}
    for k, size in enumerate(dict.fromkeys(sizes(depth))):
        jump = np.concatenate([s.passes[k][1] for s in shards])
        for at, end in zip(base[:-1], base[1:], strict=True):
            jump[at:end] += np.int32(at)
        tables[size] = (np.concatenate([s.passes[k][0] for s in shards]), jump)
    interval = np.zeros(len(rows), np.int32)
    for size in sizes(depth):
        read, jump = tables[size]
        seen = read[rows]
        move = _stable(seen)
        seen, rows, moved = seen[move], jump[rows[move]], interval[move]
        new = np.ones(len(rows), bool)
        new[1:] = (seen[1:] != seen[:-1]) | (moved[1:] != moved[:-1])
        shared = ~(new & np.append(new[1:], True))
        interval = np.cumsum(new, dtype=np.int32)[shared]
        rows = rows[shared]
    place = np.concatenate([s.place + np.int64(at) for s, at in zip(shards, base, strict=False)])
    return place[rows], interval
