"""Vector table operators: cosine, exhaustive top-k, checks, embedding of chunks."""

from __future__ import annotations

import hashlib
import math
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions import rules as R


class Embedder(Protocol):
    """What turns texts into vectors; one call for a batch."""

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """A stand-in that needs no service: signed hashed words, scaled to length 1."""

    def __init__(self, dimension: int = 768):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimension))
        for row, text in zip(out, texts, strict=True):
            for word in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % self.dimension] += 1 if h >> 63 else -1
            norm = math.sqrt(row @ row)
            if norm:
                row /= norm
        return out.astype(np.float32).tolist()


class HttpEmbedder:
    """Providers spoken to over HTTP. kind: ollama, openai or gemini."""

    def __init__(self, kind: str, url: str, model: str, dimension: int, key: str = "", timeout: float = 30.0, retries: int = 3, pause: float = 1.0):
        self.kind, self.url, self.model, self.dimension, self.key = kind, url.rstrip("/"), model, dimension, key
        self.timeout, self.retries, self.pause = timeout, retries, pause

    def _post(self, path: str, body: dict) -> dict:
        import json
        import urllib.error
        import urllib.request

        headers = {"Content-Type": "application/json"}
        if self.kind == "openai":
            headers["Authorization"] = f"Bearer {self.key}"
        if self.kind == "gemini":
            headers["x-goog-api-key"] = self.key
        request = urllib.request.Request(self.url + path, json.dumps(body).encode(), headers)
        for attempt in range(self.retries + 1):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    return json.load(answer)
            except urllib.error.HTTPError as e:
                if attempt == self.retries or e.code != 429 and e.code < 500:
                    raise
            except OSError:
                if attempt == self.retries:
                    raise
            time.sleep(self.pause * 2**attempt)
        raise AssertionError

    def embed(self, texts: list[str]) -> list[list[float]]:
        if self.kind == "openai":
            data = self._post("/embeddings", {"model": self.model, "input": texts})["data"]
            out = [d["embedding"] for d in sorted(data, key=lambda d: d["index"])]
        elif self.kind == "gemini":
            out = [self._post(f"/models/{self.model}:embedContent", {"content": {"parts": [{"text": t}]}})["embedding"]["values"] for t in texts]
        else:
            out = [self._post("/api/embeddings", {"model": self.model, "prompt": t})["embedding"] for t in texts]
        if len(out) != len(texts):
            raise ValueError(f"{len(texts)} texts, {len(out)} vectors")
        for v in out:
            if len(v) != self.dimension:
                raise ValueError(f"a vector of {len(v)} dimensions, not {self.dimension}")
        return out


def embed_chunks(chunks: DataFrame, embedder: Embedder, batch: int = 100) -> DataFrame:
    """chunks as vector records (id, text, embedding, metadata, error).

    A failing batch is tried again text by text; what still fails has a null
    embedding and its error. Ids depend on content alone.
    """
    identity = F.sha2(F.concat_ws("\0", "file", F.col("line_start").cast("string"), F.coalesce(F.col("chunk_index"), F.lit(-1)).cast("string"), F.col("chunk_no").cast("string")), 256)
    meta = F.struct("file", "symbol", "type", "language", "line_start", "line_end", "chunk_index")
    rows = chunks.select(identity.alias("id"), F.col("content").alias("text"), meta.alias("metadata"))
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType()), rows.schema["metadata"], T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), batch):
                part = frame.iloc[lo : lo + batch].copy()
                vectors, errors = safely(embedder.embed, part["text"].tolist())
                part["embedding"], part["error"] = vectors, errors
                yield part[[f.name for f in schema.fields]]

    return rows.mapInPandas(run, schema).select("id", "text", "embedding", "metadata", "error")


def safely(embed: Callable[[list[str]], list[list[float]]], texts: list[str]) -> tuple[list, list]:
    try:
        return embed(texts), [None] * len(texts)
    except Exception:  # noqa: BLE001  whatever a provider raises, the texts are tried alone
        vectors, errors = [], []
        for t in texts:
            try:
                vectors.append(embed([t])[0])
                errors.append(None)
            except Exception as e:  # noqa: BLE001
                vectors.append(None)
                errors.append(str(e)[:500])
        return vectors, errors


def cosine(a: Column, b: Column, length: Column | None = None) -> Column:
    """Cosine in double precision, summed from left to right; null for empty, unequal or zero vectors. length: that of b, if known."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * (F.sqrt(dot(b, b)) if length is None else length)
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm > 0), (dot(a, b) / norm).cast("float"))


def scored(vectors: DataFrame, query: list[float]) -> DataFrame:
    """id, file, text, score of vectors (id, text, embedding, metadata.file): the cosine with query, a literal of its dimension, or null."""
    q = [float(np.float32(x)) for x in query]
    length = 0.0
    for x in q:  # in the order of cosine's own sum
        length += x * x
    score = cosine(F.col("embedding"), F.array(*map(F.lit, q)), F.lit(math.sqrt(length)))
    return vectors.select("id", F.col("metadata.file").alias("file"), "text", score.alias("score"))


def top_k(vectors: DataFrame, query: list[float], k: int = R.SEARCH_TOP_K, by: Callable[[Column], Column] = lambda score: score) -> DataFrame:
    """id, file, text, score: the k nearest of vectors; ties by id. by(score) is what is compared: scores that it makes equal are ties.

    The plan is one pass and TakeOrderedAndProject.
    """
    return scored(vectors, query).filter("score is not null").orderBy(F.desc(by(F.col("score"))), F.asc_nulls_last("id")).limit(k if k > 0 else R.SEARCH_TOP_K)


def ranked_top_k(vectors: DataFrame, query: list[float], k: int = R.SEARCH_TOP_K, by: Callable[[Column], Column] = lambda score: score) -> DataFrame:
    """top_k's rows in its order, with the rank that each has among all vectors by whole score, then id.

    A second pass compares every score with the k rows, which are broadcast.
    """
    from pyspark.sql import Window

    hits = top_k(vectors, query, k, by).withColumn("copy", F.row_number().over(Window.partitionBy("id", "score").orderBy("file", "text")))  # k rows
    hits = hits.select(F.struct("id", "file", "text", "score").alias("hit"), "copy")
    level = F.col("score") == F.col("hit.score")
    above = (F.col("score") > F.col("hit.score")) | level & F.coalesce(F.col("id") < F.col("hit.id"), F.col("id").isNotNull())
    same = level & F.col("id").eqNullSafe(F.col("hit.id"))
    counted = scored(vectors, query).select("id", "score").join(F.broadcast(hits), above | same).groupBy("hit", "copy").agg(F.count_if(above).alias("before"))
    return counted.select("hit.*", (F.col("before") + F.col("copy")).alias("rank")).orderBy(F.desc(by(F.col("score"))), F.asc_nulls_last("id"), "rank")


def shown_score(score: Column) -> Column:
    """Four digits; halves go to the even digit, as C and Go print them."""
    whole = score.cast("double")
    return F.format_string("%.4f", F.coalesce(F.nullif(F.bround(whole, 4), F.lit(0.0)), whole))  # bround loses the sign of -0.0


def search_report(hits: DataFrame) -> DataFrame:
    """rank, file, score and text of hits as they are shown; hits without a rank are ranked by score, then id."""
    from pyspark.sql import Window

    from marlstone.functions.text import shown

    if "rank" not in hits.columns:
        hits = hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.asc_nulls_last("id"))))  # k rows
    return hits.select("rank", "file", shown_score(F.col("score")).alias("score"), shown(F.col("text")).alias("text"))


def check_dimension(vectors: DataFrame, dimension: int) -> DataFrame:
    """vectors, failing on any row of another dimension."""
    bad = F.when(F.size("embedding") != dimension, F.raise_error(F.concat(F.lit("wrong dimension in "), F.col("id").cast("string"))))
    return vectors.filter(F.coalesce(bad.cast("boolean"), F.lit(True)))


def expected_dimension(model: str) -> int:
    """The known dimension of a model, 0 if unknown."""
    return next((d for name, d in R.MODEL_DIMENSIONS.items() if name in model), 0)
