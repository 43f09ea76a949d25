"""Change detection between two states of a tree, and snapshots made from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """file and status (added, changed, deleted, same) of two states (file, mtime): one full outer join."""
    a, b = old.select("file", F.col("mtime").alias("was")), new.select("file", F.col("mtime").alias("now"))
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("was") != F.col("now"), "changed").otherwise("same")
    return a.join(b, "file", "full_outer").select("file", status.alias("status"))


def fingerprint(state: DataFrame) -> DataFrame:
    """16 hex digits of SHA-256 over the sorted path:mtime lines.

    The digest is of one text by definition, so the last step is one task: it
    reads a line for each file, not the files.
    """
    line = F.concat("file", F.lit(":"), "mtime", F.lit("\n"))
    lines = state.select(F.struct("file", line.alias("line")).alias("r")).agg(F.array_sort(F.collect_list("r")).alias("rows"))
    return lines.select(F.left(F.sha2(F.array_join(F.col("rows.line"), "").cast("binary"), 256), F.lit(16)).alias("fingerprint"))


def apply(table: DataFrame, fresh: DataFrame, status: DataFrame, key: Column | str = "file") -> DataFrame:
    """table without the rows of files that changed or went, with the fresh rows of those that changed or came."""
    gone = status.filter("status in ('changed', 'deleted')").select("file")
    here = status.filter("status in ('changed', 'added')").select("file")
    return table.join(gone, "file", "left_anti").unionByName(fresh.join(here, "file", "left_semi"))
