"""Secret scans over an incremental blob ledger, in DataFrame expressions only.

Every version of every text is content-addressed by the SHA-256 of its bytes. A
rule's version is a digest of the rule itself, so an edited rule is a new one.
The ledger is a stored table: a row says which rule versions have read a blob,
and what they found. A scan reads a blob only with the rules whose pair with it
is unseen, appends to the ledger, and joins the findings of the rules in force
back to all paths that hold the blob.

Offsets are code points, end exclusive. A rule's matches are leftmost and
non-overlapping, found before the length filter, so a short match still uses
up its characters.

Defined cases: a null text is the empty blob; equal texts are scanned once and
reported for every path; repeated rows and rows with a null id are each
reported; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_folder

#: Kind, pattern, the group that is measured, its least length. The first three are the base rules, in their order.
RULES = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
)
BASE = 3
Rule = tuple[str, str, int, int]

SPAN = "struct<start:int,kind:int,end:int>"
FINDING = f"array<{SPAN}>"


LEDGER = "blob_id string, rule_versions array<string>, findings array<struct<rule_version:string,start:int,end:int>>"


def version(rule: Rule) -> str:
    return hashlib.sha256("\0".join(map(str, rule)).encode()).hexdigest()[:16]


class Ledger:
    """The ledger as a Parquet table that scans append to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def append(self, new: DataFrame) -> None:
        new.write.mode("append").parquet(self.path)

    @classmethod
    def fresh(cls, spark: SparkSession) -> "Ledger":
        """An empty ledger in the shared folder."""
        made = cls(spark, f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}")
        made.append(spark.createDataFrame([], LEDGER))
        return made


def rule_spans(text: Column, kind: int, rules: tuple[Rule, ...] = RULES) -> Column:
    """Spans of one rule. Splitting at the matches gives the text between them, and with it every offset."""
    _, pattern, group, least = rules[kind]
    length = lambda c: F.char_length(c)
    gaps = F.transform(F.split(text, pattern, -1), length)
    whole = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), length)
    measured = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), length) if group else whole
    each = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"), whole.alias("size"), measured.alias("least"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(FINDING).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["0"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + x["1"]).alias("end"))
        return F.struct((start + x["1"]).alias("at"), F.when(x["2"] >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    named = F.transform(each, lambda x: F.struct(x["gap"].alias("0"), x["size"].alias("1"), x["least"].alias("2")))
    return F.when(text.rlike(pattern), F.aggregate(named, zero, step, lambda acc: acc["out"])).otherwise(F.array().cast(FINDING))


def render(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(r[0]) for r in RULES])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def unseen(paths: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob_id, doc_id, todo): for every blob the path it is read from, the least, and the rule versions that have not read it."""
    every = F.array(*[F.lit(version(r)) for r in rules])
    first = paths.groupBy("blob_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first"))
    turn = first.select("blob_id", F.col("first.doc_id").alias("doc_id"))
    if ledger is None:
        return turn.withColumn("todo", every)
    seen = ledger.groupBy("blob_id").agg(F.flatten(F.collect_list("rule_versions")).alias("seen"))
    turn = turn.join(seen, "blob_id", "left")
    return turn.select("blob_id", "doc_id", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo")).filter(F.size("todo") > 0)


def read_blobs(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows for the unseen pairs. Only ids and digests are grouped; texts are shuffled once, to meet their turn."""
    texts = versions.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob_id", F.sha2(F.col("text").cast("binary"), 256))
    turn = unseen(texts.select("doc_id", "blob_id"), ledger, rules).select("blob_id", F.col("doc_id").alias("of"), "todo")
    same = F.col("t.doc_id").eqNullSafe(F.col("u.of")) & (F.col("t.blob_id") == F.col("u.blob_id"))
    due = texts.alias("t").join(turn.alias("u"), same).select("t.blob_id", "t.text", "u.todo")
    parts = []
    for k, rule in enumerate(rules):
        named = _named(version(rule))
        spans = F.transform(rule_spans(F.col("text"), k, rules), named)
        parts.append(F.when(F.array_contains("todo", version(rule)), spans).otherwise(F.array().cast("array<struct<rule_version:string,start:int,end:int>>")))
    scanned = due.select("blob_id", F.col("todo").alias("rule_versions"), F.concat(*parts).alias("findings"))
    return scanned.groupBy("blob_id").agg(F.any_value("rule_versions").alias("rule_versions"), F.any_value("findings").alias("findings"))


def _named(name: str):
    return lambda s: F.struct(F.lit(name).alias("rule_version"), s["start"].alias("start"), s["end"].alias("end"))


def scan(versions: DataFrame, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, blob_id and findings (start, kind, end; by start, then kind) of every version, old ones included.

    versions: doc_id and text. The ledger is appended to; without one, a fresh
    one in the shared folder is used. Findings come from the stored table, so a
    blob that very many paths hold is an ordinary skewed join.
    """
    spark = versions.sparkSession
    new_ledger = ledger is None
    ledger = ledger or Ledger.fresh(spark)
    ledger.append(read_blobs(versions, None if new_ledger else ledger.rows(), rules))
    kinds = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(version(r)), F.lit(k))])
    known = ledger.rows().filter(F.size("findings") > 0)
    if not new_ledger:  # several scans may have read a blob, each with other rules
        known = known.groupBy("blob_id").agg(F.flatten(F.collect_list("findings")).alias("findings"))
    spans = F.transform("findings", lambda s: F.struct(s["start"].alias("start"), F.try_element_at(kinds, s["rule_version"]).alias("kind"), s["end"].alias("end")))
    known = known.select("blob_id", F.array_sort(F.filter(spans, lambda s: s["kind"].isNotNull())).alias("findings"))
    paths = versions.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("blob_id"))
    found = paths.join(known, "blob_id", "left")
    return found.select("doc_id", "blob_id", F.coalesce("findings", F.array().cast(FINDING)).alias("findings"))
