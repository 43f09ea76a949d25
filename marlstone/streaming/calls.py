"""Tool calls as a stream: the daily statistics, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import rules as R
from marlstone.operators import stats
from marlstone.sources.store import SnapshotStore


def daily_stream(calls: DataFrame, retention_days: int = R.RETENTION_DAYS) -> DataFrame:
    """Sums by day of a stream of calls, as stats.daily() gives them.

    Days are tumbling event-time windows. The watermark is the retention: in
    update mode (start_updates) the state holds that many days and calls older
    than it are dropped. Complete mode (start) keeps every day.
    """
    rows = stats.measured(calls.withColumn("ts", F.col("ts").cast("timestamp")))
    days = rows.withWatermark("ts", f"{retention_days} days").groupBy(F.window("ts", "1 day").alias("w"))
    sums = [F.count("*").alias("calls"), *[F.sum(c).cast("bigint").alias(c) for c in stats.SUMS]]
    return days.agg(*sums).select(F.to_date("w.start").alias("day"), "calls", *stats.SUMS)


def start(days: DataFrame, name: str, checkpoint: str, every: str | None = "30 seconds"):
    """Run it into an in-memory table; without `every`, over what is there now, then stop."""
    writer = days.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def start_updates(days: DataFrame, sink, checkpoint: str, every: str | None = "30 seconds"):
    """Run it into sink(batch, id): changed days only, for a table that is merged by day, as DailyTable does."""
    writer = days.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


class DailyTable:
    """The days as a stored table: a batch's days replace the ones before. A batch that comes twice changes nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.store = SnapshotStore(spark, path)

    def rows(self) -> DataFrame | None:
        return self.store.table("days")

    def merge(self, batch: DataFrame, number: int) -> None:
        old, state = self.rows(), self.store.state()
        if state is not None and number <= state["batch"]:
            return
        merged = batch if old is None else old.join(batch.select("day"), "day", "left_anti").unionByName(batch)
        self.store.commit({"days": merged.coalesce(1)}, {"batch": number})  # a row for each day
