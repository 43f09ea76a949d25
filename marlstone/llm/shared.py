"""Session helpers: the shared checkpoint folder, tables, and size checks."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's own spark.checkpoint.dir.

    Only a session in one process, as in tests, may do without: it gets a temporary one.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="marlstone-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same as a table in the shared folder, for small tables of many rounds.

    A checkpoint takes along the planner's estimate of its size, a product over
    all joins before it: within some ten rounds that number alone has millions
    of digits. A table has the size of its files.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that may be sent to all executors: a few numbers each, some 10 MB in all.
SENT_ROWS = 100_000
#: Keys with fewer rows are never hot.
LEAST_HOT = 256


def with_hot(rows: DataFrame, hot: DataFrame, on: Column) -> DataFrame:
    """A left join with a table of hot keys: broadcast if its counted size allows, else shuffled."""
    n = hot.count()
    return rows.join(F.broadcast(hot) if n <= SENT_ROWS else hot, on, "left")


def meet(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """rows joined with groups, one row for each key with c, the number of rows that it has.

    Keys with more rows than an even share are joined without a shuffle: their
    number is at most SENT_ROWS, as each takes 1 / SENT_ROWS of all rows. The
    other keys are shuffled, and no task gets more of one key than that.
    """
    total = groups.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    most = max(LEAST_HOT, -(-total // SENT_ROWS))
    hot, cold = groups.filter(F.col("c") > most), groups.filter(F.col("c") <= most)
    if hot.isEmpty():
        return rows.join(groups, key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rest.join(cold, key).unionByName(rows.join(F.broadcast(hot), key))
