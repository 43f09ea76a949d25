"""Usage statistics over an append-only table of tool calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import rules as R
from marlstone.functions.text import tokens

SUMS = ("output_tokens", "saved_tokens", "wasted_tokens")


def result_quality(tool: Column, text: Column) -> Column:
    """system if the text tells a missing index, empty if the tool found nothing, else valid."""
    has = lambda phrases: F.forall(F.array(*[F.lit(p) for p in phrases]), lambda p: ~F.contains(text, p))
    out = F.when(~has(R.SYSTEM_PHRASES), "system")
    for name, phrases in R.EMPTY_PHRASES.items():
        out = out.when((tool == name) & ~has(phrases), "empty")
    return out.otherwise("valid")


def wanted_rows(top_k: Column) -> Column:
    """top_k as a number of 1 to 10; 5 if it is missing, no number, or not above 0."""
    return F.when(top_k.isNull() | F.isnan(top_k) | (top_k <= 0), 5).otherwise(F.least(F.lit(10), top_k.cast("bigint"))).cast("bigint")


def baseline(tool: Column, top_k: Column, mode: Column, values: dict[str, int] = R.BASELINES) -> Column:
    return (
        F.when(tool == "code_search", wanted_rows(top_k) * values["code_search"])
        .when((tool == "file_context") & (mode == "summary"), values["file_context"])
        .when(tool == "symbol_search", values["symbol_search"])
        .when(tool == "impact_analysis", values["impact_analysis"])
        .otherwise(0)
        .cast("bigint")
    )


def measured(calls: DataFrame, chars_per_token: float = 4.0, values: dict[str, int] = R.BASELINES) -> DataFrame:
    """calls (tool, top_k, mode, output_text, duration_ms, ts, error) that count, with quality, day and tokens.

    Untracked tools and failed calls are left out.
    """
    kept = calls.filter(~F.col("tool").isin(*R.UNTRACKED_TOOLS) & F.col("error").isNull())
    out = kept.withColumns({"quality": result_quality(F.col("tool"), F.col("output_text")), "day": F.to_date("ts"), "output_tokens": tokens(F.col("output_text"), chars_per_token)})
    valid = F.col("quality") == "valid"
    saved = F.greatest(F.lit(0), baseline(F.col("tool"), F.col("top_k"), F.col("mode"), values) - F.col("output_tokens"))
    return out.withColumns({"saved_tokens": F.when(valid, saved).otherwise(0).cast("bigint"), "wasted_tokens": F.when(valid, 0).otherwise(F.col("output_tokens")).cast("bigint")})


def _sums() -> list[Column]:
    return [F.count("*").alias("calls"), *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in SUMS]]


def totals(rows: DataFrame) -> DataFrame:
    return rows.agg(*_sums())


def by_tool(rows: DataFrame) -> DataFrame:
    out = rows.groupBy("tool").agg(*_sums(), F.sum("duration_ms").cast("bigint").alias("duration_ms"))
    return out.withColumn("average_ms", F.expr("duration_ms div calls"))


def daily(rows: DataFrame, retention_days: int | None = None) -> DataFrame:
    """Sums by day; with retention_days only the days within so many of the latest call."""
    out = rows.groupBy("day").agg(*_sums())
    if retention_days is None:
        return out
    last = rows.agg(F.max("day").alias("last"))
    return out.join(F.broadcast(last)).filter(F.col("day") >= F.date_sub("last", retention_days)).drop("last")  # last: one row


def period(days: DataFrame) -> DataFrame:
    return days.agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def last_days(days: DataFrame, n: int = 7) -> DataFrame:
    return days.orderBy(F.desc("day")).limit(n).withColumn("short", F.date_format("day", "MM-dd")).orderBy("day")


def report(rows: DataFrame, retention_days: int = R.RETENTION_DAYS) -> str:
    """The usage report as text: totals, by tool, and the last seven days."""
    t = totals(rows).first()
    days = daily(rows, retention_days)
    span = period(days).first()
    n = lambda x: f"{x or 0:,}"
    out = ["=== Token usage ==="]
    if span.first_day:
        out.append(f"Period: {span.first_day} ~ {span.last_day}")
    out += [f"Calls: {t.calls}", f"Output tokens: {n(t.output_tokens)}", f"Saved tokens (estimate): {n(t.saved_tokens)}", f"Wasted tokens: {n(t.wasted_tokens)}", "", "By tool:"]
    out += [f"{r.tool:<16}  {r.calls:>8}  {n(r.output_tokens):>10}  {n(r.saved_tokens):>10}  {n(r.wasted_tokens):>10}  {r.average_ms:>8}ms" for r in by_tool(rows).orderBy("tool").collect()]  # a row for each tool
    out += ["", "Last 7 days:"] + [f"{r.short}    {r.calls:>8}  {n(r.saved_tokens):>10}  {n(r.wasted_tokens):>10}" for r in last_days(days).collect()]
    return "\n".join(out) + "\n"
