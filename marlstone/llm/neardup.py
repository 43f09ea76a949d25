"""MinHash near-dedup with SuperMinHash signatures.

Each text's set holds its distinct shingles of SHINGLE words (a shorter text is
one shingle). Every element of a set walks a pseudo-random permutation of the
signature's places; its j-th step offers the value j + r, r in [0, 1), to one
place, and a place keeps the least offer. A text stops as soon as no place can
be lowered any more, which long texts reach after the first step. Signatures
are cut into bands; texts that agree on a whole band share a bucket.

Texts with equal sets are one class from the start. In each bucket every class
is compared with the bucket's least class first; confirmed links are joined
into components; then the classes in buckets that still hold several components
are searched for links across components by an exact prefix join. So no pair inside a component is listed
twice, copies are never paired, and no candidate is dropped. Links are always
confirmed on full shingle sets (64-bit shingle hashes).

With BANDS bands of ROWS rows a pair at similarity 0.85 misses every bucket
with probability 1.1e-5, and one at 0.9 with 1e-9.

Defined cases: a null text, or one without words, has an empty set, links with
nothing and is its own component; equal rows are one class; a repeated id is
taken as one document; null ids take no part in links; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from .shared import cut, meet, with_hot, written

SHINGLE = 5
BANDS, ROWS = 36, 8
#: A set's bitmap for the exact bound on differences, in words of 64 bits.
MARKS = 16
#: A pivot with more pairs than this is salted.
HOT = 2000
#: Elements of one pass over the steps, and the steps after which an element's permutation is written out.
STEP_ELEMENTS, EARLY = 1 << 15, 24
#: Links need percent * union <= 100 * intersection.
PERCENT = 85
U = K.U


def _shingles(word: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of rows of words, and each shingle's row."""
    count = np.diff(at)
    each = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    row = np.repeat(np.arange(len(count)), each)
    first = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each) + at[row]
    return K.hash_spans(K.prefix(word), first, np.minimum(first + size, at[row + 1])), row


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, at = K.words(data, offsets)
    return (K.hash_spans(K.prefix(K.byte_values()[K.LOWER[data]]), starts, ends) if len(starts) else np.zeros(0, U)), at


def _long_set(data: np.ndarray, size: int) -> np.ndarray:
    """The shingles of one long text, part by part; a part ends at white space and goes on with the last words of the one before."""
    found, held, words, lo = [], np.zeros(0, U), 0, 0
    while lo < len(data):
        hi = min(len(data), lo + K.CHUNK_BYTES)
        while hi < len(data) and not (gaps := np.flatnonzero(K.SPACE[data[lo:hi]])).size:
            hi = min(len(data), hi + K.CHUNK_BYTES)  # a word longer than a part
        hi = hi if hi == len(data) else lo + int(gaps[-1]) + 1
        word, _ = _words(data[lo:hi], np.array([0, hi - lo]))
        words += len(word)
        word = np.concatenate([held, word])
        if len(word) >= size:
            found.append(np.unique(_shingles(word, np.array([0, len(word)]), size)[0]))
        held, lo = word[max(0, len(word) - size + 1) :], hi
    if 0 < words < size:
        found.append(_shingles(held, np.array([0, words]), size)[0])
    return np.unique(np.concatenate(found)) if found else np.zeros(0, U)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted within it, and where each text's begin."""
    n_rows = len(offsets) - 1
    if n_rows == 1 and len(data) > 2 * K.CHUNK_BYTES:
        h = _long_set(data, size)
        return h, np.array([0, len(h)])
    word, at = _words(data, offsets)
    if not len(word):
        return np.zeros(0, U), np.zeros(n_rows + 1, np.int64)
    h, row = _shingles(word, at, size)
    order = np.argsort(h)
    order = order[np.argsort(row[order].astype(np.uint16) if n_rows < 65536 else row[order], kind="stable")]
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(n_rows + 1))


def _draw(h: np.ndarray, j: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Step j of every element: which place is swapped with place j, and the value offered to what stands there."""
    x = K.mix(h + U((2 * j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    return (((x >> U(44)) * U(m - j)) >> U(20)).astype(np.int16) + np.int16(j), (x & U((1 << 44) - 1)).astype(np.float64) * 2.0**-44 + j


def _offer(h: np.ndarray, row: np.ndarray, sig: np.ndarray) -> None:
    """Let elements (of rows in ascending order) lower the signatures sig in place."""
    m = sig.shape[1]
    flat = sig.reshape(-1)
    base = row * m
    swaps: list[np.ndarray] = []  # for each step, the place that was swapped with place j
    held: list[np.ndarray] = []  # and what it holds since
    checks = {0, 1, 2, 3, 4, 5, 6, 8, 10, 12, 15, 19} | set(range(EARLY - 1, m, 16))
    e = table = None
    for j in range(m):
        k, value = _draw(h, j, m)
        if j < EARLY:
            place, own = k.copy(), np.full(len(h), j, np.int16)
            for then, what in zip(swaps, held, strict=True):
                for want, into in ((k, place), (j, own)):
                    hit = np.flatnonzero(then == want)
                    into[hit] = what[hit]
            swaps.append(k)
            held.append(own)
        else:
            if table is None:  # the few texts that go on for long: a row of the permutation for each element
                table = np.tile(np.arange(m, dtype=np.int16), (len(h), 1))
                e = np.arange(len(h))
                for then, what in zip(swaps, held, strict=True):
                    table[e, then] = what
                e, table = e * m, table.reshape(-1)
            at = e + k
            place = table[at]
            table[at] = table[e + j]
        np.minimum.at(flat, base + place, value)
        if j in checks:
            lo, hi = int(row[0]), int(row[-1]) + 1
            going = (sig[lo:hi].max(axis=1) > j + 1)[row - lo]
            if not going.any():
                return
            if not going.all():
                h, row, base = h[going], row[going], base[going]
                if table is None:
                    swaps, held = [s[going] for s in swaps], [s[going] for s in held]
                else:
                    e = e[going]


def superminhash(h: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """Signatures, a row of m doubles for every text; texts without elements get infinities.

    A signature is a minimum over elements, so they are offered STEP_ELEMENTS
    at a time, whatever the length of texts.
    """
    n_rows = len(at) - 1
    sig = np.full((n_rows, m), np.inf)
    row = np.repeat(np.arange(n_rows), np.diff(at))
    for lo in range(0, len(h), STEP_ELEMENTS):
        _offer(h[lo : lo + STEP_ELEMENTS], row[lo : lo + STEP_ELEMENTS], sig)
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = sig.view(U).reshape(len(sig), bands, rows)
    key = np.zeros((len(sig), bands), U) + K.mix(np.arange(1, bands + 1, dtype=U))
    for r in range(rows):
        key = K.mix(key * U(0x9E3779B97F4A7C15) + bits[:, :, r])
    return key.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch], bands: int, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id")
        for lo, hi, data, offsets in K.pieces(batch.column("text")):
            h, at = shingle_sets(data, offsets, size)
            n = np.diff(at)
            total = lambda x: np.diff(np.concatenate([np.zeros(1, U), np.cumsum(x)])[at]).view(np.int64)
            one, two = total(K.mix(h)), total(K.mix(h * U(0xE7037ED1A0B428DB) + U(1)))
            keys = band_keys(superminhash(h, at, bands * rows), bands, rows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (hi - lo) * bands + 1, bands, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([ids[lo:hi], pa.array(n), pa.array(one), pa.array(two), lists], names=["doc_id", "n", "sum1", "sum2", "bands"])


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in K.pieces(batch.column("text")):
            h, at = shingle_sets(data, offsets, size)
            n_rows = hi - lo
            mark = np.zeros((n_rows, 64 * MARKS), bool)
            mark[np.repeat(np.arange(n_rows), np.diff(at)), (K.mix(h) % U(64 * MARKS)).astype(np.int64)] = True
            marks = np.packbits(mark, axis=1).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n_rows * MARKS + 1, MARKS, dtype=np.int32)), pa.array(marks.ravel()))
            elements = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], elements, lists], names=["rep", "elements", "marks"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of edges (a, b): label is the least node that can be reached.

    Rounds of contraction: every node moves to the neighbour, or itself, that
    comes first. In the first round that is the least id, which closes the stars
    around pivots; from then on it is the least hash, so that chains shrink by a
    constant factor whatever the order of ids, and rounds grow with the
    logarithm of the longest path. A round's moves are kept, and put together at
    the end. Nothing but the number of edges left comes to the driver.
    """
    edges = written(edges.select("a", "b").filter("a <> b").distinct())
    moves = []
    while not edges.isEmpty():
        rank = (lambda c: F.col(c)) if not moves else lambda c: F.struct(F.xxhash64(F.lit(len(moves)), c).alias("h"), F.col(c).alias("to"))
        both = edges.select("a", rank("b").alias("r")).union(edges.select(F.col("b").alias("a"), rank("a").alias("r")))
        least = F.least(F.min("r"), F.first(rank("a"))) if not moves else F.least(F.min("r"), rank("a"))["to"]
        moves.append(written(both.groupBy("a").agg(least.alias("to"))))
        x = edges.join(moves[-1].withColumnRenamed("to", "x"), "a")
        edges = written(x.join(moves[-1].select(F.col("a").alias("b"), F.col("to").alias("y")), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b").distinct())
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    label = moves[-1].select(F.col("a").alias("node"), F.col("to").alias("label"))
    for step in reversed(moves[:-1]):
        on = label.select(F.col("node").alias("to"), "label")
        label = step.join(on, "to", "left").select(F.col("a").alias("node"), F.coalesce("label", "to").alias("label"))
    label = written(label)
    low = label.groupBy("label").agg(F.min("node").alias("low"))
    return label.join(low, "label").select("node", F.col("low").alias("label"))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity.

    Every pair's second set travels to its first one. A first set with many
    pairs (a pivot's) is sent once for each HOT of its pairs, not for each pair,
    and they are dealt to as many tasks.
    """
    pairs = cut(pairs)
    often = cut(pairs.groupBy("a").agg(F.count("*").alias("c")).filter(F.col("c") > HOT).select(F.col("a").alias("hot"), F.ceil(F.col("c") / HOT).cast("int").alias("parts")))
    salted = with_hot(pairs, often, pairs["a"] == often["hot"]).select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")), F.lit(0)).cast("int").alias("part"))
    y = salted.join(sets.select(F.col("rep").alias("b"), F.col("elements").alias("y")), "b")
    first = with_hot(sets, often, sets["rep"] == often["hot"])
    x = first.select(F.col("rep").alias("a"), F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), F.col("elements").alias("x"))
    common = F.size(F.array_intersect("x", "y"))
    return y.join(x, ["a", "part"]).filter(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")


def cross_pairs(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): every pair of rows (rep, n, label) with different labels that may still reach the similarity.

    A prefix join, which is exact: with every set's elements in one common
    order, two sets that reach percent % share one of the first
    n - ceil(percent * n / 100) + 1 of each. Rare elements come first, so what
    an edited copy has for itself fills its prefix and meets nobody. Two more exact
    bounds are part of the join: how many common elements there can be around a
    common place, and how many differences the sets' bitmaps prove.
    """
    spread = sets.join(rows, "rep").select("rep", "n", "label", F.explode("elements").alias("key"))
    common = spread.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    rank = F.row_number().over(Window.partitionBy("rep").orderBy(F.coalesce("c", F.lit(1)), "key"))
    reach = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    # of two sets the smaller needs a shorter prefix: with t = percent / 100, n - ceil(2 t n / (1 + t)) + 1
    near = F.col("n") - F.ceil(F.col("n") * (2 * percent) / (100 + percent)) + 1
    ranked = spread.join(common, "key", "left").withColumn("rank", rank).filter((F.col("rank") <= reach) & F.col("c").isNotNull())
    prefix = cut(ranked.select("key", "rep", "n", "label", "rank", (F.col("rank") <= near).alias("near")))
    most = prefix.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "label"))["label"].alias("major"), F.count("*").alias("labels")).filter("labels > 1").drop("labels")
    most = cut(most)  # a plain join of two shuffles, whose large partitions Spark can split
    mixed = prefix.join(most, "key").join(sets.select("rep", "marks"), "rep")
    # the rows outside an element's most frequent component against all of its rows
    minor = mixed.filter("label <> major").select("key", F.col("rep").alias("p"), F.col("n").alias("pn"), F.col("label").alias("pl"), F.col("rank").alias("pr"), F.col("near").alias("pnear"), F.col("marks").alias("pmarks"))
    close = 100 * F.least("pn", "n") >= percent * F.greatest("pn", "n")
    smaller = (F.col("pn") < F.col("n")) | ((F.col("pn") == F.col("n")) & (F.col("p") < F.col("rep")))
    short = F.when(smaller, F.col("pnear")).otherwise(F.col("near"))
    # a common element at places i and j leaves room for so many common ones before and after it
    room = F.least("pr", "rank") + F.least(F.col("pn") - F.col("pr"), F.col("n") - F.col("rank"))
    enough = (100 + percent) * room >= percent * (F.col("pn") + F.col("n"))
    # every place where two bitmaps differ stands for an element that only one set has
    apart = sum((F.bit_count(F.get("pmarks", F.lit(k)).bitwiseXOR(F.get("marks", F.lit(k)))) for k in range(MARKS)), F.lit(0))
    enough &= (100 + percent) * apart <= (100 - percent) * (F.col("pn") + F.col("n"))
    once = (F.col("label") == F.col("major")) | (F.col("p") < F.col("rep"))
    met = minor.join(mixed, (minor["key"] == mixed["key"]) & (F.col("pl") != F.col("label")) & once & close & short & enough)
    return met.select(F.least("p", "rep").alias("a"), F.greatest("p", "rep").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """A row per row of docs: doc_id, n_shingles, component_id (the least id of its group)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    plain = docs.select("doc_id", "text")
    signed = cut(plain.mapInArrow(partial(_sign, bands=bands, rows=rows, size=size), f"doc_id {kind}, n bigint, sum1 bigint, sum2 bigint, bands array<bigint>"))
    same = ["n", "sum1", "sum2"]
    classes = cut(signed.filter("n > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")))
    banded = classes.select("rep", "n", F.explode("bands").alias("key"))
    buckets = cut(banded.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("pivot"), F.count("*").alias("c")).filter("c > 1"))
    member = cut(meet(banded, buckets, "key").select("key", "rep", "n", F.col("pivot.rep").alias("pivot"), F.col("pivot.n").alias("pivot_n")))
    close = lambda p, q: (100 * F.least(F.col(p), F.col(q)) >= percent * F.greatest(F.col(p), F.col(q)))
    wanted = member.select(F.col("rep").alias("doc_id")).distinct()
    sets = cut(plain.join(wanted, "doc_id", "left_semi").mapInArrow(partial(_sets, size=size), f"rep {kind}, elements array<bigint>, marks array<bigint>"))
    star = member.filter((F.col("rep") != F.col("pivot")) & close("n", "pivot_n")).select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    links = cut(confirm(star, sets, percent))
    found = components(links)
    # pairs across components: in each bucket, the members outside its most frequent component against all of its members
    placed = cut(member.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "n", F.coalesce("label", "rep").alias("label")))
    sizes = placed.groupBy("key", "label").agg(F.count("*").alias("c"))
    split = sizes.groupBy("key").agg(F.count("*").alias("labels")).filter("labels > 1").select("key")
    split = cut(split)
    open_ = cut(placed.join(split, "key", "left_semi").select("rep", "n", "label").distinct())
    more = cross_pairs(open_, sets, percent)
    links = links.unionByName(cut(confirm(more, sets, percent)))
    found = components(links)
    rep = classes.select(*same, "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select(*same, F.coalesce("label", "rep").alias("component_id"))
    out = signed.select("doc_id", *same).join(rep, same, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of docs that stay, with all their columns: the least doc_id of each group, once.

    Equal rows of one id and text leave one of them. Rows without an id are in
    no group; of those with equal texts one stays.
    """
    groups = near_duplicates(docs, percent, size, bands, rows)
    # only ids that go are joined
    gone = groups.filter("doc_id is not null and component_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti")
    again = cut(kept.groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1").select(F.col("doc_id").alias("again")))
    if again.isEmpty():
        return kept.select(*docs.columns)
    same = F.col("doc_id").eqNullSafe(F.col("again"))
    once = kept.join(again, same, "left_anti")
    return once.unionByName(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])).select(*docs.columns)
