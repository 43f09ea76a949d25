"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are scaled to length 1, projected on groups of principal axes (fitted
on a bounded sample), and ordered along one Hilbert curve for each group, every
curve with a shift of its own. One range-partitioned sort numbers the rows of
all curves. A query looks at the window of rows around its own place on every
curve, block by block; what the windows hold is reranked by the exact cosine in
double precision and merged.

A window is WINDOW_SHARE of the rows to either side. In data without low
dimensional structure the order along a curve says little about nearness, so a
constant number of rows would lose recall as the data grow; the share keeps it.
With share=1 every row is in every window and the search is exact: that is the
way for all that windows may miss. Below MIN_WINDOW rows it is so by itself.

Equal vectors are one entry: a search needs at most k + 1 of their ids, the
least ones, so thousands of copies crowd no window.

Defined cases: a vector that is null, zero, of another length than the first
kind met most often, or holds a null or non-finite component takes no part;
null ids take no part; repeated rows of one id and vector count once; with
fewer candidates than k all are returned; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut
from .sharding import numbered

CURVES, AXES, BITS = 16, 4, 12
WINDOW_SHARE = 0.04
MIN_WINDOW = 1024
BLOCK = 2048
#: The index is fitted on this many vectors at most, taken by a hash of their id; every vector is indexed.
FIT_ROWS = 10_000
SEED = 11
#: Scores of the matrix products differ from the exact ones by far less.
NEAR = 1e-9


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of each row of grid coordinates (fewer than 63 bits in all)."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[d - 1] >> level) & 1, (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit(v: np.ndarray) -> np.ndarray:
    top = np.abs(v).max(axis=1, keepdims=True)  # first to a safe range, for very large or small vectors
    v = v / top
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def fit(sample: np.ndarray, curves: int, axes: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(projection, least, width) of each curve; axes come in order of their variance, again from the first if they run out."""
    d = sample.shape[1]
    rng = np.random.default_rng(SEED)
    centred = sample - sample.mean(axis=0)
    basis = np.linalg.eigh(centred.T @ centred)[1].T[::-1]  # dimension x dimension, whatever the sample
    out = []
    for s in range(curves):
        p = basis[(np.arange(axes) + s * axes) % d].T
        y = sample @ p
        low, high = y.min(axis=0), y.max(axis=0)
        width = np.maximum(high - low, 1e-12) * 1.5
        out.append((p, low - rng.uniform(0, 1 / 3, axes) * width, width))
    return out


def _keys(batches: Iterator[pa.RecordBatch], curves, bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        u = _unit(_matrix(batch.column("vector")))
        for s, (p, low, width) in enumerate(curves.value):
            cells = np.clip((u @ p - low) / width * (1 << bits), 0, (1 << bits) - 1)
            key = hilbert(cells.astype(np.int64), bits)
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(np.full(len(u), s, np.int32)), pa.array(key)], names=["rep", "curve", "key"])


def _rerank(left: pa.Table, right: pa.Table, most: int) -> pa.Table:
    """The `most` best of a block's vectors for each of its queries, and those as good up to NEAR: which of them come first is settled exactly."""
    ids, queries = left.column("rep").to_numpy(), right.column("query").to_numpy()
    schema = pa.schema([("query", pa.int64()), ("rep", pa.int64()), ("score", pa.float64())])
    if not len(ids) or not len(queries):
        return schema.empty_table()
    u = _unit(_matrix(left.column("vector").combine_chunks()))
    q = _unit(_matrix(right.column("asked").combine_chunks()))
    keep = min(most, len(ids))
    out_q, out_r, out_s = [], [], []
    for lo in range(0, len(q), 512):
        score = q[lo : lo + 512] @ u.T
        last = np.partition(score, len(ids) - keep, axis=1)[:, len(ids) - keep]
        row, best = np.nonzero(score >= last[:, None] - NEAR)
        out_q.append(queries[lo + row])
        out_r.append(ids[best])
        out_s.append(score[row, best])
    return pa.table([pa.array(np.concatenate(x)) for x in (out_q, out_r, out_s)], schema=schema)


def _dot(x: Column, y: Column) -> Column:
    """Term by term from the first on: the same sum wherever it is taken."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


def cosine(x: Column, y: Column) -> Column:
    """The cosine of two arrays of doubles; vectors whose squares would leave the range of a double are scaled first."""
    plain = lambda a, b: _dot(a, b) / (F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))
    top = lambda v: F.array_max(F.transform(v, lambda e: F.abs(e)))
    by = lambda v: F.transform(F.array(top(v)), lambda m: F.transform(v, lambda e: e / m))[0]
    safe = lambda v: top(v).between(1e-100, 1e100)
    return F.when(safe(x) & safe(y), plain(x, y)).otherwise(plain(by(x), by(y)))


def entries(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(rows, entries): valid rows (id, rep), and a row per different vector: rep, vector, ids (the k + 1 least)."""
    sound = vectors.select(F.col("id").cast("bigint").alias("id"), F.col("vector").cast("array<double>").alias("vector")).filter(
        "id is not null and vector is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(vector, x -> x <> 0)"
    )
    common = sound.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    sound = sound.filter(F.size("vector") == (common[0][0] if common else 0))
    # -0.0 and 0.0 are one value
    hashed = sound.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0))).withColumn("mark", F.sha2(F.to_json(F.struct("vector")).cast("binary"), 256))
    first = Window.partitionBy("mark").orderBy("id")
    few = hashed.select("mark", "id").groupBy("mark", "id").agg(F.count("*").alias("n")).withColumn("at", F.row_number().over(first)).filter(F.col("at") <= k + 1)
    least = few.groupBy("mark").agg(F.min("id").alias("rep"), F.array_sort(F.collect_list("id")).alias("ids"))
    vector = hashed.groupBy("mark").agg(F.first("vector").alias("vector"))
    return hashed.select("id", "mark"), cut(least.join(vector, "mark"))


def search(vectors: DataFrame, wanted: DataFrame, k: int = 5, curves: int = CURVES, axes: int = AXES, bits: int = BITS, share: float = WINDOW_SHARE, block: int = BLOCK, least: int = MIN_WINDOW) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for every id of wanted (id) among vectors (id, vector)."""
    spark = vectors.sparkSession
    rows, distinct = entries(vectors, k)
    n = distinct.count()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not n:
        return spark.createDataFrame([], schema)
    sample = distinct.orderBy(F.xxhash64("rep"), "rep").limit(FIT_ROWS).select("vector").toArrow().column("vector").combine_chunks()
    sample = _unit(_matrix(sample))
    shared = spark.sparkContext.broadcast(fit(sample, curves, axes))  # curves matrices of dimension x axes
    keyed = distinct.select("rep", "vector").mapInArrow(partial(_keys, curves=shared, bits=bits), "rep bigint, curve int, key bigint")
    ranked = numbered(keyed, [F.col("curve"), F.col("key"), F.col("rep")])
    place = ranked.select("rep", "curve", (F.col("row_number") - F.col("curve").cast("bigint") * n).alias("place"))
    asked = cut(rows.join(wanted.select(F.col("id").cast("bigint").alias("id")).distinct(), "id", "left_semi").distinct().join(distinct.select("mark", "rep"), "mark").select("id", "rep"))
    reps = asked.select("rep").distinct()
    reach = max(least, int(np.ceil(share * n)))
    dealt = place.join(distinct.select("rep", "vector"), "rep").select("curve", F.floor(F.col("place") / block).alias("block"), "rep", "vector")
    spots = place.join(reps, "rep", "left_semi").join(distinct.select("rep", "vector"), "rep")
    first, last = F.floor(F.greatest(F.lit(0), F.col("place") - reach) / block), F.floor(F.least(F.lit(n - 1), F.col("place") + reach) / block)
    spots = spots.select(F.col("curve").alias("of"), F.explode(F.sequence(first, last)).alias("at"), F.col("rep").alias("query"), F.col("vector").alias("asked"))
    found = dealt.groupBy("curve", "block").cogroup(spots.groupBy("of", "at")).applyInArrow(partial(_rerank, most=k + 1), "query bigint, rep bigint, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.coalesce(F.nth_value("score", k + 1).over(best), F.lit(-2.0))
    few = found.groupBy("query", "rep").agg(F.max("score").alias("score")).withColumn("last", last).filter(F.col("score") >= F.col("last") - NEAR)
    x = few.select("query", "rep").join(distinct.select(F.col("rep").alias("query"), F.col("vector").alias("x")), "query")
    xy = x.join(distinct.select("rep", F.col("vector").alias("y")), "rep")
    exact = xy.select("query", "rep", cosine(F.col("x"), F.col("y")).alias("score"))
    each = exact.join(distinct.select("rep", "ids"), "rep").select("query", "score", F.explode("ids").alias("vec_id"))
    pairs = asked.withColumnRenamed("rep", "query").join(each, "query").filter("id <> vec_id")
    order = Window.partitionBy("id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(F.col("id").alias("query_id"), "rank", "vec_id", "score")
