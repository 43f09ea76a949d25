"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0 to N - 1 in the order of (doc_id, text_crc32, size). A
keyed Feistel network permutes [0, a * b), with a * b the least such rectangle
over N; numbers that fall outside [0, N) walk on along their cycle. Position p
of the shuffle is in shard p % shards at slot p // shards, so both can be
computed for any row number without a table, counts are at most one apart, and
slots have no gap.

Defined cases: a null text has 0 bytes, crc32 0 and the size of its header;
null ids come first; equal rows get neighbouring numbers, in either order,
which can't be told apart; an empty table gives no rows; other columns pass by.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: Keys of the Feistel rounds; every result depends on them.
ROUND_KEYS = (40503, 30011, 52711, 61057)
HEADER_BYTES = 8
#: Steps of the cycle walk that are unrolled; above 4096 rows a longer walk has a chance below 1e-90, below it a walk can't be longer.
WALK = 130


def rectangle(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def round_value(key: int, side: Column | str, modulus: int):
    """The round function: products stay under 2**63, so that any SQL engine agrees."""
    if isinstance(side, str):
        return f"((((({side}) * {key} + {key * 7 + 1}) % 2147483647) * 48271 + ({side}) * 16807) % 2147483647) % {modulus}"
    return (((side * key + key * 7 + 1) % 2147483647) * 48271 + side * 16807) % 2147483647 % modulus


def feistel_py(x: int, n: int) -> int:
    """The permutation for one number, as plain integers (for tests and lookups)."""
    a, b = rectangle(n)
    while True:
        left, right = x // b, x % b
        for k, key in enumerate(ROUND_KEYS):
            s, m = (right, a) if k % 2 == 0 else (left, b)
            v = (((s * key + key * 7 + 1) % 2147483647) * 48271 + s * 16807) % 2147483647 % m
            left, right = ((left + v) % a, right) if k % 2 == 0 else (left, (right + v) % b)
        x = left * b + right
        if x < n:
            return x


def feistel(x: Column, n: int) -> Column:
    """One pass over [0, a * b), without the walk."""
    a, b = rectangle(n)
    pair = F.struct(F.floor(x / b).cast("bigint").alias("l"), (x % b).alias("r"))

    def even(key: int):  # a lambda's second parameter would be taken for an index
        return lambda p: F.struct(((p["l"] + round_value(key, p["r"], a)) % a).alias("l"), p["r"].alias("r"))

    def odd(key: int):
        return lambda p: F.struct(p["l"].alias("l"), ((p["r"] + round_value(key, p["l"], b)) % b).alias("r"))

    for k, key in enumerate(ROUND_KEYS):
        pair = F.transform(F.array(pair), odd(key) if k % 2 else even(key))[0]
    return F.transform(F.array(pair), lambda p: p["l"] * b + p["r"])[0]


def permuted(x: Column, n: int) -> Column:
    """The place of row number x in the shuffle of n rows."""
    first = F.transform(F.array(feistel(x, n)), lambda y: F.when(y < n, y).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), y, lambda acc, _: F.when(acc < n, acc).otherwise(feistel(acc, n)))))[0]
    return F.transform(F.array(first), lambda y: F.when(y < n, y).otherwise(F.raise_error(F.lit("the cycle walk did not end")).cast("bigint")))[0]


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with row_number 0 to N - 1 in the given order, without gathering them in one task.

    Rows are range-partitioned and sorted; partition sizes, one row for each
    partition, give each partition's first number. The sorted rows are
    checkpointed first, so that both readings see one and the same partitioning.
    """
    spread = cut(rows.sort(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("at"), 33)
    sizes = sorted(spread.groupBy(part.alias("part")).count().collect())  # a row for each partition
    starts, total = [], 0
    for p, n in sizes:
        starts += [F.lit(int(p)), F.lit(total)]
        total += n
    first = F.try_element_at(F.create_map(*starts), part) if starts else F.lit(0)
    return spread.withColumn("row_number", (first + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).cast("bigint")).drop("at")


def assign(docs: DataFrame, shards: int = 24) -> DataFrame:
    """A row per document: doc_id, size, text_crc32, row_number, place, shard, slot."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + HEADER_BYTES).cast("bigint").alias("size"), F.crc32(text.cast("binary")).cast("bigint").alias("text_crc32"))
    rows = numbered(narrow, [F.col("doc_id"), F.col("text_crc32"), F.col("size")])
    n = rows.count()
    placed = rows.withColumn("place", permuted(F.col("row_number"), max(1, n)))
    return placed.withColumns({"shard": (F.col("place") % shards).cast("int"), "slot": F.floor(F.col("place") / shards).cast("bigint")})
