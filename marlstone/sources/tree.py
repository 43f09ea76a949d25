"""A directory tree as a table: a Python data source that lists once and reads in parallel.

Spark's own file listing leaves out names that begin with a dot or underscore
and compares extensions by case, so it can't stand in here. Directories that
scans leave out are never entered. With contents=false no file is opened.

The tree must be visible to the executors. For a store that only Spark reads,
store_files() gives the same columns from Spark's binary reader.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from marlstone.functions import rules as R

SCHEMA = "file string, content string, length bigint, mtime string"
PART_BYTES = 64 << 20
PART_FILES = 5000


def stamp(ns: int) -> str:
    """RFC 3339 in UTC with as many digits as the time has."""
    seconds, rest = divmod(ns, 10**9)
    text = datetime.fromtimestamp(seconds, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S")
    return text + (f".{rest:09d}".rstrip("0") if rest else "") + "Z"


def walk(root: str, extensions: tuple[str, ...]) -> Iterator[tuple[str, int, int]]:
    """(relative path, bytes, mtime in ns) of the files with these extensions, in order."""
    for base, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d not in R.SKIP_DIRS)
        for name in sorted(names):
            if os.path.splitext(name)[1].lower() in extensions:
                path = os.path.join(base, name)
                try:
                    info = os.stat(path)
                except OSError:
                    continue
                yield os.path.relpath(path, root).replace(os.sep, "/"), info.st_size, info.st_mtime_ns


def listed(root: str, paths: list[str]) -> Iterator[tuple[str, int, int]]:
    """The given files; those that are gone or are directories are passed over."""
    for path in paths:
        full = os.path.join(root, path)
        if os.path.isfile(full):
            info = os.stat(full)
            yield path, info.st_size, info.st_mtime_ns


class Part(InputPartition):
    def __init__(self, files: list[tuple[str, int, int]]):
        super().__init__(None)
        self.files = files


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = os.path.abspath(options["path"])
        self.extensions = tuple(json.loads(options.get("extensions", json.dumps(R.SCAN_EXTENSIONS))))
        self.files = json.loads(options["files"]) if "files" in options else None
        self.contents = options.get("contents", "true").lower() == "true"

    def partitions(self) -> list[Part]:
        found = walk(self.root, self.extensions) if self.files is None else listed(self.root, self.files)
        parts: list[list[tuple[str, int, int]]] = [[]]
        size = 0
        for f in found:
            if self.contents and f[1] > R.MAX_FILE_BYTES:
                continue
            if parts[-1] and (size + f[1] > PART_BYTES or len(parts[-1]) >= PART_FILES):
                parts.append([])
                size = 0
            parts[-1].append(f)
            size += f[1] if self.contents else 0
        return [Part(p) for p in parts]

    def read(self, partition: Part) -> Iterator[tuple]:
        for path, size, mtime in partition.files:
            content = None
            if self.contents:
                try:
                    with open(os.path.join(self.root, path), "rb") as f:
                        content = f.read().decode("utf-8", "replace")
                except OSError:
                    continue
            yield path, content, size, stamp(mtime)


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def _read(spark: SparkSession, root: str, **options: str) -> DataFrame:
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").options(**options).load(root)


def scan(spark: SparkSession, root: str, extensions: tuple[str, ...] = R.SCAN_EXTENSIONS) -> DataFrame:
    """file, content, length, mtime of a tree, files of 10 MiB at most."""
    return _read(spark, root, extensions=json.dumps(extensions))


def scan_files(spark: SparkSession, root: str, files: list[str]) -> DataFrame:
    return _read(spark, root, files=json.dumps(files))


def read_files(files: DataFrame, root: str) -> DataFrame:
    """The files named by a table (file), read where its rows are; those that are gone, too large or directories are passed over."""
    base = os.path.abspath(root)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("file").to_pylist():
                for _, size, ns in listed(base, [path]):
                    if size <= R.MAX_FILE_BYTES:
                        with open(os.path.join(base, path), "rb") as f:
                            yield pa.RecordBatch.from_pylist([{"file": path, "content": f.read().decode("utf-8", "replace"), "length": size, "mtime": stamp(ns)}])

    return files.select("file").mapInArrow(read, SCHEMA)


def scan_mtimes(spark: SparkSession, root: str, extensions: tuple[str, ...] = R.SCAN_EXTENSIONS) -> DataFrame:
    """file and mtime of a tree, of any size, without opening files."""
    return _read(spark, root, extensions=json.dumps(extensions), contents="false").select("file", "mtime")


def store_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = R.SCAN_EXTENSIONS) -> DataFrame:
    """The same columns for a store that only Spark reads; names that begin with . or _ are not listed there."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), r"^[a-z]+:/*", "/")
    path = F.regexp_replace("path", r"^[a-z0-9]+:/*(?:[^/]+:\d+)?", "/")
    from marlstone.functions.text import extension, in_skipped_dir

    named = raw.withColumn("file", F.substr(path, F.length(base) + 2))
    kept = named.filter(extension(F.col("file")).isin(*extensions) & ~in_skipped_dir(F.col("file")) & (F.col("length") <= R.MAX_FILE_BYTES))
    return kept.select("file", F.decode("content", "UTF-8").alias("content"), "length", F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss.SSSX").alias("mtime"))


def read_inside(root: str, path: str) -> str:
    """A file's text; a path that leads out of root, by .. or by a link, is refused."""
    if ".." in os.path.normpath(path):
        raise ValueError("the path leaves the project")
    base = os.path.realpath(root)
    full = os.path.realpath(os.path.join(base, path))
    if full != base and not full.startswith(base + os.sep):
        raise ValueError("the path leaves the project")
    with open(full, "rb") as f:
        return f.read().decode("utf-8", "replace")
