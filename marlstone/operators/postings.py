"""Symbol postings, and the queries over them.

Postings come from chunks without a shuffle. Queries filter them by symbol
first, so a table written sorted or bucketed by symbol prunes to a few files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import rules as R
from marlstone.functions.text import expand_name


def postings(chunks: DataFrame) -> DataFrame:
    """symbol, file, line, type, context, chunk_no, pos for chunks (file, chunk_no, symbol, line_start, content)."""
    reach = R.CONTEXT_LINES

    def around(lines: Column) -> Column:
        def one(line: Column, i: Column) -> Column:
            first = F.greatest(F.lit(0), i - reach)
            text = F.array_join(F.slice(lines, first + 1, F.least(F.size(lines), i + reach + 1) - first), "\n")
            short = F.when(F.char_length(text) > R.CONTEXT_CHARS, F.concat(F.left(text, F.lit(R.CONTEXT_CHARS)), F.lit("..."))).otherwise(text)
            return F.struct(F.filter(F.regexp_extract_all(line, F.lit(R.IDENTIFIER), F.lit(0)), lambda s: (F.length(s) > 1) & ~s.isin(*R.STOP_WORDS)).alias("ids"), short.alias("context"))

        return F.transform(lines, one)

    each = F.transform(F.array(F.split("content", "\n")), around)[0]
    lines = chunks.select("file", "chunk_no", F.col("symbol").alias("own"), F.coalesce("line_start", F.lit(1)).alias("line_start"), F.posexplode(each).alias("at", "l"))
    ids = lines.select("file", "chunk_no", "own", (F.col("line_start") + F.col("at")).cast("int").alias("line"), "l.context", F.posexplode("l.ids").alias("pos", "symbol"))
    return ids.select("symbol", "file", "line", F.when(F.col("symbol") == F.col("own"), "definition").otherwise("reference").alias("type"), "context", "chunk_no", "pos")


def replace_files(table: DataFrame, fresh: DataFrame, files: DataFrame) -> DataFrame:
    """table without the rows of files (file), with the fresh rows instead."""
    return table.join(files.select("file").distinct(), "file", "left_anti").unionByName(fresh)


def symbol_count(table: DataFrame) -> DataFrame:
    return table.agg(F.countDistinct("symbol").alias("symbols"))


def file_symbols(table: DataFrame) -> DataFrame:
    return table.select("file", "symbol").distinct().groupBy("file").agg(F.sort_array(F.collect_list("symbol")).alias("symbols"))


def occurrences(table: DataFrame, query: str) -> DataFrame:
    """All places of a symbol in any of its spellings; of one (file, line, symbol) the first."""
    names = expand_name(query)
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("symbol"))
    first = Window.partitionBy("file", "line", "symbol").orderBy(rank, "chunk_no", "pos")
    hits = table.filter(F.col("symbol").isin(*names))
    return hits.withColumn("at", F.row_number().over(first)).filter("at = 1").select("symbol", "file", "line", "type", "context")


def symbol_search(table: DataFrame, query: str, search_type: str = "all", top_k: int = R.SYMBOL_TOP_K) -> DataFrame:
    if not query:
        raise ValueError("query must not be empty")
    hits = occurrences(table, query)
    if search_type in ("definition", "reference"):
        hits = hits.filter(F.col("type") == search_type)
    return hits.orderBy("file", "line", "symbol").limit(top_k if top_k > 0 else R.SYMBOL_TOP_K)


def impact_kind(kind: Column, context: Column) -> Column:
    return F.when(kind == "definition", "definition").when(F.contains(context, F.lit(R.JSON_TAG)), "api_payload").otherwise("reference")


def suggestion(action: str, symbol: str, new_name: str, kind: Column) -> Column:
    if action == "rename":
        return F.lit(R.RENAME_TEXT[0] + symbol + R.RENAME_TEXT[1] + new_name)
    known = {k: v for (a, k), v in R.SUGGESTIONS.items() if a == action}
    if not known:
        return F.lit("")
    return F.when(kind == "definition", known["definition"]).otherwise(known["reference"])


def impact_analysis(table: DataFrame, symbol: str, action: str, new_name: str = "") -> DataFrame:
    """file, line, type, context, suggestion for every place that a change touches."""
    if not symbol or not action:
        raise ValueError("symbol and action must not be empty")
    if action == "rename" and not new_name:
        raise ValueError("rename needs new_name")
    hits = occurrences(table, symbol)
    return hits.select("file", "line", F.col("symbol").alias("found"), impact_kind(F.col("type"), F.col("context")).alias("type"), "context", suggestion(action, symbol, new_name, F.col("type")).alias("suggestion")).orderBy("file", "line", "found")


def impact_summary(items: DataFrame) -> DataFrame:
    """One row: total_files, total_references, categories."""
    counts = items.groupBy("type").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("categories"))
    totals = items.agg(F.countDistinct("file").alias("total_files"), F.count("*").alias("total_references"))
    return totals.join(counts)  # one row each


def impact_categories(items: DataFrame) -> DataFrame:
    return items.groupBy("type").agg(F.count("*").alias("n"))


def search_report(hits: DataFrame) -> DataFrame:
    """One text for each file, its places in order."""
    line = F.concat(F.lit("  L"), F.col("line").cast("string"), F.lit(": ["), F.col("type"), F.lit("] "), F.col("context"))
    rows = hits.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("line", "symbol", line.alias("text")))).alias("rows"))
    return rows.select("file", F.concat(F.lit("--- "), F.col("file"), F.lit(" ---\n"), F.array_join(F.col("rows.text"), "\n")).alias("report"))
