"""Suffix-array dedup: bytes covered by a LENGTH-byte string that occurs twice.

Every window of LENGTH bytes has an anchor: the GRAM bytes in it with the least
hash, the first of equals. Anchors depend on the window alone, so equal windows
have equal anchors. Windows with one anchor are neighbours and form a run; the
text that a run covers is its phrase (as in a prefix-free parse). Groups of
documents exchange (anchor, phrase) names once. A run whose anchor occurs
nowhere else holds no repeat. A run whose whole phrase occurs elsewhere holds
nothing but repeats: that settles the insides of long repeats. What is left are
the edges, phrases that share an anchor but not all of their text.

Edges, with one copy of each settled phrase that shares their anchors, travel to
the bucket of their anchor. There the edges of all groups are cut into shards,
each shard gets its Burrows-Wheeler transform, and the transforms are merged by
interleave refinement (see bwt) down to LENGTH codes: what shares so long a
prefix is in a repeated interval, and each group gets back one bit for each
window that it sent. The merge alone decides about edges.

An anchor with very many phrases (the rim of a passage in a third of all
documents) isn't sent to one bucket: its windows are sent one by one, once for
each group, and dealt by their own hash; they meet their equals in a merge too.

Defined cases: a null text is empty; texts under LENGTH bytes lose nothing;
windows never cross documents; equal rows, also of one id, are different places
and remove each other wholly if long enough; an empty table gives no rows;
other columns are ignored; doc_id is an integer.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bwt
from . import grouped as G
from . import kernel as K

LENGTH, GRAM = 200, 50
GROUP_BYTES = 2 << 20
#: Edge text of one shard of a merge.
SHARD_BYTES = 1 << 20
#: Text bytes for each bucket of edges.
EDGE_BYTES = 6 << 20
#: An anchor with more phrases than this is dealt out window by window.
HOT_PHRASES = 4096
#: Places of a group fit into this many bits; the hash's upper bits stand above them.
PLACE = 32
U = K.U


class Runs:
    """A group's bytes, and its runs of windows: first and last start, anchor name, phrase name."""

    def __init__(self, table: pa.Table, length: int, gram: int):
        self.table, self.length = G.ordered(table), length
        self.grp = table.column("grp")[0].as_py() if len(table) else 0
        self.data, self.at = K.buffers(self.table.column("text").combine_chunks())
        n = len(self.data)
        self.sums = K.prefix(K.byte_values()[self.data])
        empty = np.zeros(0, np.int64)
        self.first = self.last = empty
        self.anchor = self.phrase = empty.astype(U)
        if n < length:
            return
        inverse = K.powers(n + 1)[1][: n - gram + 1]
        h = K.mix((self.sums[gram:] - self.sums[: n - gram + 1]) * inverse + U(gram * 0xD6E8FEB86659FD93 & (1 << 64) - 1))
        key = (h >> U(PLACE) << U(PLACE)) | np.arange(len(h), dtype=U)  # the hash, then the place
        least = K.sliding_min(key, length - gram + 1) & U((1 << PLACE) - 1)
        sizes = np.diff(self.at)
        valid = np.zeros(n + 1, np.int8)
        long = sizes >= length
        np.add.at(valid, self.at[:-1][long], 1)
        np.add.at(valid, self.at[1:][long] - length + 1, -1)
        start = np.flatnonzero(np.cumsum(valid[:-1], dtype=np.int8))
        if not len(start):
            return
        anchor = least[start].astype(np.int64)
        new = np.ones(len(start), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
        begin = np.flatnonzero(new)
        self.first, self.last = start[begin], start[np.append(begin[1:], len(start)) - 1]
        self.anchor = h[anchor[begin]]
        self.phrase = K.hash_spans(self.sums, self.first, self.last + length)

    def pairs(self, buckets: int):
        """Different (anchor, phrase) names sorted by bucket, each run's index, and where each bucket's begin."""
        short = (G.bucket_of(self.anchor, buckets).astype(U) << U(32)) | (self.anchor & U(0xFFFFFFFF))
        order = np.lexsort((self.phrase, short))
        s, p = short[order], self.phrase[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (p[1:] != p[:-1])
        back = np.empty(len(s), np.int64)
        back[order] = np.cumsum(new) - 1
        s, p = s[new], p[new]
        return s, p, back, np.searchsorted(s, np.arange(buckets + 1).astype(U) << U(32))


def _send_pairs(table: pa.Table, buckets: int, length: int, gram: int) -> pa.Table:
    r = Runs(table, length, gram)
    a, p, _, at = r.pairs(buckets)
    some = np.flatnonzero(np.diff(at))
    return G.sent(r.grp, some, anchors=G.packs((a & U(0xFFFFFFFF)).astype("<u4").tobytes(), 4, at, some), phrases=G.packs(p.tobytes(), 8, at, some))


def _match_pairs(table: pa.Table, hot: int) -> pa.Table:
    """For each pair: is the phrase in another group; has the anchor another phrase, anywhere; is this the phrase's first group; has the anchor very many?"""
    anchor, n = G.column_arrays(table.column("anchors"), "<u4")
    phrase, _ = G.column_arrays(table.column("phrases"), "<u8")
    grp = np.repeat(table.column("grp").to_numpy(), n)
    order = np.lexsort((grp, phrase, anchor))
    a, p = anchor[order], phrase[order]
    new_a = np.ones(len(a), bool)
    new_a[1:] = a[1:] != a[:-1]
    new_p = new_a.copy()
    new_p[1:] |= p[1:] != p[:-1]
    id_a, id_p = np.cumsum(new_a) - 1, np.cumsum(new_p) - 1
    phrases = np.bincount(id_a[new_p])[id_a] if len(a) else np.zeros(0, np.int64)
    out = np.zeros((4, len(a)), bool)
    out[0, order] = np.bincount(id_p)[id_p] > 1 if len(a) else new_a
    out[1, order], out[2, order], out[3, order] = phrases > 1, new_p, phrases > hot
    return G.replied(table, n, "pairs", *out)


class Edges:
    """What a group sends to the merges: segments in the order of their buckets, and the windows in them."""

    def __init__(self, r: Runs, replies: pa.Table, pair_buckets: int, buckets: int):
        _, _, back, at = r.pairs(pair_buckets)
        shared, mixed, first, hot = (f[back] for f in G.unbits(replies, "pairs", at, 4))
        local = np.bincount(back, minlength=int(at[-1]))[back] > 1
        lead = np.zeros(len(back), bool)
        lead[np.unique(back, return_index=True)[1]] = True
        self.settled = shared | local
        chosen = mixed & (~self.settled | (first & lead))
        few, many = chosen & ~hot, chosen & hot
        start = _starts(r, many)  # each different window of a hot anchor once
        h = K.hash_spans(r.sums, start, start + r.length)
        _, once, self.same = np.unique(h, return_index=True, return_inverse=True)
        self.alike, self.often = start, np.bincount(self.same, minlength=len(once))[self.same] > 1
        a = np.concatenate([r.first[few], start[once]])
        b = np.concatenate([r.last[few], start[once]]) + r.length
        bucket = G.bucket_of(np.concatenate([r.anchor[few], h[once]]), buckets)
        order = np.argsort(bucket, kind="stable")
        self.begin, self.size = a[order], (b - a)[order]
        edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
        self.some = np.flatnonzero(np.diff(edge))
        self.edge = edge
        self.n_windows = self.size - r.length + 1
        self.at = np.concatenate([[0], np.cumsum(self.n_windows)])[edge]  # by bucket, in windows
        self.place = np.empty(len(a), np.int64)
        self.place[order] = np.arange(len(a))
        self.n_few = int(few.sum())

    def windows(self) -> np.ndarray:
        return _spread(self.begin, self.n_windows)

    def text(self, r: Runs) -> list[bytes]:
        raw = r.data[_spread(self.begin, self.size)].tobytes()
        at = np.concatenate([[0], np.cumsum(self.size)])[self.edge]
        return [raw[int(at[k]) : int(at[k + 1])] for k in self.some]

    def repeated(self, flags: np.ndarray) -> np.ndarray:
        """Starts of all repeated windows among the edges, from the flags of those sent."""
        found = self.windows()[flags]
        if len(self.alike):  # a window sent once stands for all its equals in the group
            first = np.concatenate([[0], np.cumsum(self.n_windows)])[self.place[self.n_few :]]
            found = np.concatenate([found, self.alike[self.often | flags[first][self.same]]])
        return found


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each of n places, one after another."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _starts(r: Runs, chosen: np.ndarray) -> np.ndarray:
    return _spread(r.first[chosen], r.last[chosen] - r.first[chosen] + 1)


def _send_edges(docs: pa.Table, replies: pa.Table, pair_buckets: int, buckets: int, length: int, gram: int) -> pa.Table:
    r = Runs(docs, length, gram)
    e = Edges(r, replies, pair_buckets, buckets)
    sizes = [e.size[e.edge[k] : e.edge[k + 1]].astype("<i4").tobytes() for k in e.some]
    return G.sent(r.grp, e.some, segments=pa.array(e.text(r), pa.binary()), sizes=pa.array(sizes, pa.binary()))


def _merge_edges(table: pa.Table, length: int, shard_bytes: int) -> pa.Table:
    """For each window of the segments: is it in a repeated interval of the merged transforms of all groups?"""
    data, _ = G.column_arrays(table.column("segments"), np.uint8)
    size, own = G.column_arrays(table.column("sizes"), "<i4")
    size = size.astype(np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    cuts = np.searchsorted(at, np.arange(0, int(at[-1]), shard_bytes))
    cuts = np.unique(np.append(cuts, len(size)))
    shards = [bwt.transform(bwt.joined(data[at[a] : at[b]], size[a:b]), length) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    again = np.zeros(int(at[-1]) + len(size), bool)
    if shards:
        again[bwt.merge(shards, length)[0]] = True
    begin = at[:-1] + np.arange(len(size))  # each segment has an end mark
    windows = size - length + 1
    n = np.diff(np.concatenate([[0], np.cumsum(windows)])[np.concatenate([[0], np.cumsum(own)])])
    return G.replied(table, n, "windows", again[_spread(begin, windows)])


def _keep(docs: pa.Table, replies: pa.Table, pair_buckets: int, buckets: int, length: int, gram: int) -> pa.Table:
    r = Runs(docs, length, gram)
    e = Edges(r, replies, pair_buckets, buckets)
    again, settled = e.repeated(G.unbits(replies, "windows", e.at)[0]), e.settled
    n = len(r.data)
    cover = np.zeros(n + length + 1, np.int32)
    np.add.at(cover, r.first[settled], 1)
    np.add.at(cover, r.last[settled] + length, -1)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + length, -1)
    gone = np.cumsum(cover[:n]) > 0
    # a span ends with its document
    step = np.zeros(n + 1, bool)
    step[0:n] = gone
    begin = gone.copy()
    begin[1:] &= ~gone[:-1]
    heads = r.at[:-1][np.diff(r.at) > 0]
    begin[heads] = gone[heads]
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[r.at])
    lost, spans = total(gone), total(begin)
    raw = r.data.tobytes()
    digests, removed = [], []
    for k, (lo, hi) in enumerate(zip(r.at[:-1].tolist(), r.at[1:].tolist(), strict=True)):
        if lost[k]:
            own = gone[lo:hi]
            digests.append(hashlib.sha256(r.data[lo:hi][~own].tobytes()).hexdigest())
            e = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
            removed.append([{"start": int(x), "end": int(y)} for x, y in zip(e[::2], e[1::2], strict=True)])
        else:
            digests.append(hashlib.sha256(raw[lo:hi]).hexdigest())
            removed.append([])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return pa.table([r.table.column("doc_id"), pa.array(np.diff(r.at)), pa.array(lost, pa.int64()), pa.array(spans, pa.int64()), pa.array(removed, kind), pa.array(digests)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "removed", "kept_sha256"])


def repeated_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group_bytes: int = GROUP_BYTES, buckets: int | None = None, shard_bytes: int = SHARD_BYTES, hot_phrases: int = HOT_PHRASES) -> DataFrame:
    """A row per row of docs: doc_id, n_bytes, n_removed, n_spans, removed (byte spans), kept_sha256."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    grouped, total = G.group(docs, group_bytes)
    p, q = (buckets or -(-total // size) or 1 for size in (G.BUCKET_BYTES, EDGE_BYTES))
    sent = grouped.groupBy("grp").applyInArrow(lambda t: _send_pairs(t, p, length, gram), "bucket int, grp int, anchors binary, phrases binary")
    pairs = sent.groupBy("bucket").applyInArrow(lambda t: _match_pairs(t, hot_phrases), "grp int, bucket int, pairs binary")
    edges = grouped.groupBy("grp").cogroup(pairs.groupBy("grp")).applyInArrow(lambda x, y: _send_edges(x, y, p, q, length, gram), "bucket int, grp int, segments binary, sizes binary")
    merged = edges.groupBy("bucket").applyInArrow(lambda t: _merge_edges(t, length, shard_bytes), "grp int, bucket int, windows binary")
    replies = pairs.withColumn("windows", F.lit(None).cast("binary")).unionByName(merged.withColumn("pairs", F.lit(None).cast("binary")))
    again = replies.select(F.col("grp").alias("of"), "bucket", "pairs", "windows")
    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, removed array<struct<start:int,end:int>>, kept_sha256 string"
    return grouped.groupBy("grp").cogroup(again.groupBy("of")).applyInArrow(lambda x, y: _keep(x, y, p, q, length, gram), schema)
