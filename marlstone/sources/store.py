"""Tables on disk: snapshots with an atomic commit, vector JSONL files, and JSON states.

A snapshot is a new folder with one Parquet table for each name; the commit is
a small file that names it, renamed into place last. Readers resolve the
pointer for each query, so a reader sees a whole snapshot or the one before.
Files go through Spark's own file systems, so any store that Spark knows works.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from typing import Any, Protocol

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VECTOR_SCHEMA = "id string, text string, embedding array<float>, metadata struct<file:string,symbol:string,type:string,language:string,line_start:int,line_end:int,chunk_index:int>"
#: Ranges of postings at least, and the text for which there is one.
SYMBOL_FILES, RANGE_BYTES = 32, 32 << 20


class VectorTable(Protocol):
    """What a vector backend offers; remote backends implement the same."""

    def read(self) -> DataFrame: ...
    def append(self, rows: DataFrame) -> None: ...
    def delete_files(self, files: DataFrame) -> None: ...
    def drop(self) -> None: ...
    def exists(self) -> bool: ...
    def count(self) -> int: ...


class Files:
    """Small files through Spark's file systems."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def exists(self, name: str = "") -> bool:
        fs, path = self._at(name)
        return fs.exists(path)

    def read(self, name: str) -> str | None:
        fs, path = self._at(name)
        if not fs.exists(path):
            return None
        with_stream = fs.open(path)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(with_stream)).decode("utf-8")
        finally:
            with_stream.close()

    def write(self, name: str, text: str) -> None:
        """Whole or not at all: a new file, then a rename over the old one."""
        fs, path = self._at(name)
        _, fresh = self._at(f"{name}.{uuid.uuid4().hex}.tmp")
        out = fs.create(fresh, True)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()
        self._over(fs, fresh, path, text)

    def _over(self, fs, fresh, path, text: str) -> None:
        """Put a new file in an old one's place, without a moment in which there is none."""
        jvm = self.spark._jvm
        try:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration())
            rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
            options = self.spark.sparkContext._gateway.new_array(rename, 1)
            options[0] = rename.OVERWRITE
            context.rename(fs.makeQualified(fresh), fs.makeQualified(path), options)
        except Py4JJavaError:  # a store without such a rename puts whole objects
            out = fs.create(path, True)
            try:
                out.write(bytearray(text.encode("utf-8")))
            finally:
                out.close()
            fs.delete(fresh, False)

    def delete(self, name: str = "") -> None:
        fs, path = self._at(name)
        fs.delete(path, True)


class SnapshotStore:
    """Named tables that change together."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.files = spark, Files(spark, base)
        self.base = base.rstrip("/")

    def current(self) -> str | None:
        return (self.files.read("CURRENT") or "").strip() or None

    def table(self, name: str) -> DataFrame | None:
        snapshot = self.current()
        return self.spark.read.parquet(f"{self.base}/{snapshot}/{name}") if snapshot else None

    def commit(self, tables: Mapping[str, DataFrame | Callable[[Callable[[str], DataFrame]], DataFrame]], state: Mapping[str, Any] | None = None, keep: int = 2) -> str:
        """Write all tables, then the pointer. Tables may read the snapshot that they replace.

        A table given as a function is made from those already written: it is
        called with a reader of them by name.
        """
        before = self.current()
        snapshot = f"snapshot-{int((before or 'snapshot-0').split('-')[1]) + 1:08d}-{uuid.uuid4().hex[:8]}"
        written = lambda name: self.spark.read.parquet(f"{self.base}/{snapshot}/{name}")
        for name, df in tables.items():
            df = df(written) if callable(df) and not isinstance(df, DataFrame) else df
            if "symbol" in df.columns and name == "postings":
                df = df.repartitionByRange(self._ranges(written("chunks") if "chunks" in tables else None), "symbol", "file").sortWithinPartitions("symbol", "file", "line")  # lookups prune by min and max
            df.write.parquet(f"{self.base}/{snapshot}/{name}")
        if state is not None:
            self.files.write(f"{snapshot}/state.json", json.dumps(state, indent=2, default=str))
        self.files.write("CURRENT", snapshot)
        history = [s for s in (self.files.read("HISTORY") or "").split() if s] + [snapshot]
        for old in history[:-keep]:
            self.files.delete(old)
        self.files.write("HISTORY", "\n".join(history[-keep:]))
        return snapshot

    def _ranges(self, chunks: DataFrame | None) -> int:
        """Ranges of postings: one for each RANGE_BYTES of text, and some for pruning. Ties are cut by file, so a symbol in every file isn't one range."""
        size = chunks.agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0))).first()[0] if chunks is not None else 0
        return max(SYMBOL_FILES, -(-size // RANGE_BYTES))

    def state(self) -> dict[str, Any] | None:
        """The committed state; None if there is none, ValueError if it can't be read."""
        snapshot = self.current()
        text = self.files.read(f"{snapshot}/state.json") if snapshot else None
        return json.loads(text) if text is not None else None

    def drop(self) -> None:
        self.files.delete()


class JsonlVectors:
    """Vector records as JSON lines in a folder; a missing folder is an empty table.

    A deletion writes a new folder inside and then moves the pointer to it, so a
    reader sees all of the old table or all of the new one, whenever it is cut off.
    """

    kind = "json"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)

    def exists(self) -> bool:
        return self.files.exists()

    def folder(self) -> str:
        version = (self.files.read("_CURRENT") or "").strip() if self.exists() else ""
        return f"{self.path}/{version}" if version else self.path

    def ensure(self) -> None:
        if not self.exists():
            self.append(self.spark.createDataFrame([], VECTOR_SCHEMA))

    def read(self) -> DataFrame:
        """All records; a line that can't be read fails the read."""
        if not self.exists():
            return self.spark.createDataFrame([], VECTOR_SCHEMA)
        return self.spark.read.schema(VECTOR_SCHEMA).option("mode", "FAILFAST").format(self.kind).load(self.folder())

    def append(self, rows: DataFrame) -> None:
        rows.select("id", "text", "embedding", "metadata").write.mode("append").format(self.kind).save(self.folder())

    def delete_files(self, files: DataFrame) -> None:
        kept = self.read().withColumn("file", F.col("metadata.file")).join(files.select("file").distinct(), "file", "left_anti").drop("file")
        before, fresh = self.folder(), f"_v{uuid.uuid4().hex}"
        kept.write.format(self.kind).save(f"{self.path}/{fresh}")
        self.files.write("_CURRENT", fresh)
        if before != self.path:  # what lies beside the pointer is no longer read; folders are cleared
            self.files.delete(before.rsplit("/", 1)[1])

    def drop(self) -> None:
        self.files.delete()

    def count(self) -> int:
        return self.read().count()


class ParquetVectors(JsonlVectors):
    """The same over Parquet: columns are read apart, and counts come from footers."""

    kind = "parquet"


def vector_table(spark: SparkSession, kind: str, path: str) -> VectorTable:
    """The backend of that name. A remote one is not part of this repository: hand in your own VectorTable."""
    if kind in ("local-jsonl", "jsonl", "local"):
        return JsonlVectors(spark, path)
    if kind == "parquet":
        return ParquetVectors(spark, path)
    raise ValueError(f"no vector backend named {kind}")
