"""Exchange of packed hashes between groups of documents.

Documents are dealt into groups of about GROUP_BYTES of text by a hash of
doc_id (rows without one by a hash of the text), so rows of one id are in one
group. A group sends each of its different hashes once, packed by bucket, and
gets back a few bits for each, in the same order; empty packs aren't sent, so
there are never more packs than hashes. A hash that a third of all documents
hold reaches its bucket once per group, not once per document, and positions
never travel. Groups work out again what they sent: the documents' exchange is
read again, not repeated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from . import kernel as K

GROUP_BYTES = 4 << 20
#: Text bytes for each bucket of hashes.
BUCKET_BYTES = 24 << 20


def group(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> tuple[DataFrame, int]:
    """(grp, doc_id, text) and the bytes of all texts; only that sum comes to the driver."""
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id must be an integer")
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    total = plain.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0))).first()[0]
    groups = max(1, -(-total // group_bytes))
    name = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    return plain.select(F.pmod(name, F.lit(groups)).cast("int").alias("grp"), "doc_id", "text"), total


def ordered(table: pa.Table) -> pa.Table:
    """A group's documents in the order of (doc_id, text), nulls first, however they arrived."""
    absent = table.column("doc_id").is_null()
    known = table.filter(table.column("doc_id").is_valid()).sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return pa.concat_tables([table.filter(absent).sort_by("text"), known]) if table.column("doc_id").null_count else known


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> K.U(32)) % K.U(buckets)).astype(np.int64)


def unique_by_bucket(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different hashes sorted by (bucket, hash), each input's index in them, and where each bucket's begin."""
    u, back = np.unique(h, return_inverse=True)
    b = bucket_of(u, buckets)
    order = np.argsort(b, kind="stable")
    place = np.empty(len(u), np.int64)
    place[order] = np.arange(len(u))
    return u[order], place[back.ravel()], np.searchsorted(b[order], np.arange(buckets + 1))


def packs(raw: bytes, width: int, at: np.ndarray, some: np.ndarray) -> pa.Array:
    """The packs of the buckets in some: bytes of `width` for each of the hashes from at[k] to at[k + 1]."""
    return pa.array([raw[width * a : width * b] for a, b in zip(at[some].tolist(), at[some + 1].tolist(), strict=True)], pa.binary())


def sent(grp: int, some: np.ndarray, **packs: pa.Array) -> pa.Table:
    return pa.table({"bucket": pa.array(some, pa.int32()), "grp": pa.array(np.full(len(some), grp), pa.int32()), **packs})


def replied(table: pa.Table, n: np.ndarray, name: str, *flags: np.ndarray) -> pa.Table:
    """For each pack its flags, one plane of bits after another."""
    edge = np.concatenate([[0], np.cumsum(n)]).tolist()
    raw = [b"".join(bits(x[lo:hi]) for x in flags) for lo, hi in zip(edge[:-1], edge[1:], strict=True)]
    return pa.table({"grp": table.column("grp"), "bucket": table.column("bucket"), name: pa.array(raw, pa.binary())})


def bits(mask: np.ndarray) -> bytes:
    return np.packbits(mask).tobytes()


def unbits(replies: pa.Table, name: str, at: np.ndarray, planes: int = 1) -> np.ndarray:
    """Flags (planes, hashes) for what was sent, from the replies by bucket; no reply means 0."""
    out = np.zeros((planes, int(at[-1])), bool)
    for row in replies.select(["bucket", name]).to_pylist():
        if row[name]:
            lo, hi = int(at[row["bucket"]]), int(at[row["bucket"] + 1])
            out[:, lo:hi] = np.unpackbits(np.frombuffer(row[name], np.uint8).reshape(planes, -1), axis=1, count=hi - lo)
    return out


def column_arrays(column: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """All packs of a binary column one after another, and each row's length."""
    parts = [np.frombuffer(x.as_buffer(), kind) if x.is_valid and len(x.as_buffer()) else np.zeros(0, kind) for chunk in column.chunks for x in chunk]
    return (np.concatenate(parts) if parts else np.zeros(0, kind)), np.array([len(p) for p in parts], np.int64)
