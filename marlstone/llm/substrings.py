"""Substring dedup over words by fixed-block anchors.

Every document's words are cut into non-overlapping blocks of BLOCK words at
every STRIDE-th place; these are the reference blocks. Every rolling window of
BLOCK words of every document probes them. A repeated window of WINDOW =
BLOCK + STRIDE - 1 words holds a whole reference block wherever it lies, so two
equal windows always meet in a hit. Hits are extended: all windows of WINDOW
words around a hit are candidates, and a candidate is a repeat if an equal one
starts earlier: groups send the least doc_id that holds it along with it. The union of repeats is the
union of the later sides of all maximal exact repeats of WINDOW words or more.

Block hashes are compared on 32 bits within their bucket, which can only add
candidates; windows are compared on 64-bit hashes of 64-bit word hashes.

Defined cases: a null text has no words; texts of fewer than WINDOW words keep
all of them; of equal rows, or rows of one id, the first in the order of text
keeps its words; null ids come first, in the order of group and text; an empty
table gives no rows; other columns are ignored; doc_id is an integer.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grouped as G
from . import kernel as K

WINDOW, BLOCK, STRIDE = 20, 10, 11
U = K.U


class Words:
    """A group's words: hashes, offsets by document, and hashes of rolling windows."""

    def __init__(self, table: pa.Table):
        self.table = G.ordered(table)
        self.grp = table.column("grp")[0].as_py() if len(table) else 0
        self.id = self.table.column("doc_id").cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy()
        hashes, count = [], []
        for _, _, data, offsets in K.pieces(self.table.column("text").combine_chunks()):
            starts, ends, at = K.words(data, offsets)
            hashes.append(K.hash_spans(K.prefix(K.byte_values()[data]), starts, ends))
            count.append(np.diff(at))
        self.word = np.concatenate(hashes) if hashes else np.zeros(0, U)
        self.count = np.concatenate(count) if count else np.zeros(0, np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.count)])
        self.sums = K.prefix(self.word)

    def windows(self, size: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all windows of `size` words in documents of `least` words or more, and their places in the document."""
        n = np.where(self.count >= least, self.count - size + 1, 0)
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(self.at[:-1], n) + place, place

    def document(self, place: np.ndarray) -> np.ndarray:
        """The document of each word place."""
        return np.searchsorted(self.at, place, "right") - 1

    def hashed(self, start: np.ndarray, size: int) -> np.ndarray:
        return K.hash_spans(self.sums, start, start + size)


def _anchors(w: Words, buckets: int):
    start, place = w.windows(BLOCK, WINDOW)
    h = w.hashed(start, BLOCK)
    h = (G.bucket_of(h, buckets).astype(U) << U(32)) | (h & U(0xFFFFFFFF))  # bucket and 32 bits
    is_block = place % STRIDE == 0
    u, back = np.unique(h, return_inverse=True)
    at = np.searchsorted(u, np.arange(buckets + 1).astype(U) << U(32))
    blocks = np.zeros(len(u), bool)
    blocks[back[is_block]] = True
    return start, is_block, u, back, at, blocks


def _send_blocks(table: pa.Table, buckets: int) -> pa.Table:
    """Per bucket: the group's different window hashes, and which of them are reference blocks."""
    w = Words(table)
    _, _, u, _, at, blocks = _anchors(w, buckets)
    some = np.flatnonzero(np.diff(at))
    flags = pa.array([G.bits(blocks[at[k] : at[k + 1]]) for k in some], pa.binary())
    return G.sent(w.grp, some, probes=G.packs((u & U(0xFFFFFFFF)).astype("<u4").tobytes(), 4, at, some), blocks=flags)


def _match_blocks(table: pa.Table) -> pa.Table:
    """For each group's hashes: does another group hold a block of it, or, for its own blocks, a window of it?"""
    probe, n = G.column_arrays(table.column("probes"), "<u4")
    flags = [np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=int(k)).astype(bool) for x, k in zip(table.column("blocks"), n, strict=True)]
    block = np.concatenate(flags) if flags else np.zeros(0, bool)
    u, back, holders = np.unique(probe, return_inverse=True, return_counts=True)
    indexed = np.bincount(back[block], minlength=len(u))
    return G.replied(table, n, "hits", (indexed[back] - block > 0) | (block & (holders[back] > 1)))


def _candidates(w: Words, replies: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows of WINDOW words that hold a hit."""
    start, is_block, u, back, at, blocks = _anchors(w, buckets)
    (hits,) = G.unbits(replies, "hits", at)
    often = np.bincount(back, minlength=len(u)) > 1
    hits |= blocks & often  # a block met again inside the group
    found = np.zeros(len(w.word) + 1, np.int64)
    found[start[hits[back]] + 1] = 1
    seen = np.cumsum(found)
    full, _ = w.windows(WINDOW, WINDOW)
    full = full[seen[full + WINDOW - BLOCK + 1] > seen[full]]
    return full, w.hashed(full, WINDOW)


def _send_windows(docs: pa.Table, replies: pa.Table, buckets: int) -> pa.Table:
    w = Words(docs)
    start, h = _candidates(w, replies, buckets)
    u, back, at = G.unique_by_bucket(h, buckets)
    some = np.flatnonzero(np.diff(at))
    return G.sent(w.grp, some, names=G.packs(u.tobytes(), 8, at, some), least=G.packs(w.id[w.document(_firsts(start, back, len(u)))].tobytes(), 8, at, some))


def _firsts(start: np.ndarray, back: np.ndarray, n: int) -> np.ndarray:
    """The first start of each different window; starts follow the order of documents."""
    first = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(first, back, start)
    return first


def _match_windows(table: pa.Table) -> pa.Table:
    """For each group's windows: does the group hold the first of all?"""
    name, n = G.column_arrays(table.column("names"), "<u8")
    least, _ = G.column_arrays(table.column("least"), "<i8")
    grp = np.repeat(table.column("grp").to_numpy(), n)
    order = np.lexsort((grp, least, name))
    own = np.zeros(len(name), bool)
    own[order] = np.concatenate([[True], name[order][1:] != name[order][:-1]])[: len(name)]
    return G.replied(table, n, "own", own)


def _keep(docs: pa.Table, replies: pa.Table, buckets: int) -> pa.Table:
    w = Words(docs)
    start, h = _candidates(w, replies, buckets)
    u, back, at = G.unique_by_bucket(h, buckets)
    (own,) = G.unbits(replies, "own", at)
    again = start[~own[back] | (_firsts(start, back, len(u))[back] < start)] if len(start) else start
    cover = np.zeros(len(w.word) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + WINDOW, -1)
    gone = np.cumsum(cover[:-1]) > 0
    lost = np.diff(np.concatenate([[0], np.cumsum(gone)])[w.at])
    digests, spans = [], []
    for k, text in enumerate(w.table.column("text")):
        words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
        own = gone[w.at[k] : w.at[k + 1]]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
        spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)])
        kept = words if not lost[k] else [x for x, g in zip(words, own.tolist(), strict=True) if not g]
        digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return pa.table([w.table.column("doc_id"), pa.array(w.count, pa.int64()), pa.array(lost, pa.int64()), pa.array(spans, kind), pa.array(digests)], names=["doc_id", "n_words", "n_removed", "removed", "kept_sha256"])


def repeated_words(docs: DataFrame, group_bytes: int = G.GROUP_BYTES, buckets: int | None = None) -> DataFrame:
    """A row per row of docs: doc_id, n_words, n_removed, removed (spans of word numbers), kept_sha256."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    grouped, total = G.group(docs, group_bytes)
    p = buckets or -(-total // G.BUCKET_BYTES) or 1
    sent = grouped.groupBy("grp").applyInArrow(lambda t: _send_blocks(t, p), "bucket int, grp int, probes binary, blocks binary")
    hits = sent.groupBy("bucket").applyInArrow(lambda t: _match_blocks(t), "grp int, bucket int, hits binary")
    named = grouped.groupBy("grp").cogroup(hits.groupBy("grp")).applyInArrow(lambda x, y: _send_windows(x, y, p), "bucket int, grp int, names binary, least binary")
    first = named.groupBy("bucket").applyInArrow(lambda t: _match_windows(t), "grp int, bucket int, own binary")
    replies = hits.withColumn("own", F.lit(None).cast("binary")).unionByName(first.withColumn("hits", F.lit(None).cast("binary")))
    again = replies.select(F.col("grp").alias("of"), "bucket", "hits", "own")
    return grouped.groupBy("grp").cogroup(again.groupBy("of")).applyInArrow(lambda x, y: _keep(x, y, p), f"doc_id {kind}, n_words bigint, n_removed bigint, removed array<struct<start:int,end:int>>, kept_sha256 string")
