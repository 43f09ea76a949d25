"""Text functions as column expressions: trimming, naming styles, token estimates, display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R

_TRIM = r"\A[\t-\r\x85\p{Z}]+|[\t-\r\x85\p{Z}]+\z"


def trim_space(x: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(x, _TRIM, "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)\z", 1))


def camel_to_snake(x: Column) -> Column:
    """_ before each capital but the first letter, then lower case."""
    return F.lower(F.regexp_replace(x, r"(?<!\A)([A-Z])", "_$1"))


def snake_to_camel(x: Column) -> Column:
    return F.array_join(F.transform(F.split(x, "_"), lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substring(p, 2, 1 << 30))), "")


def expand(x: Column) -> Column:
    """A symbol and its two other spellings, without repeats."""
    return F.array_distinct(F.array(x, camel_to_snake(x), snake_to_camel(x)))


def expand_name(x: str) -> list[str]:
    """expand() for one name on the driver."""
    snake = "".join(("_" if k and "A" <= c <= "Z" else "") + c for k, c in enumerate(x)).lower()
    camel = "".join(p[:1].upper() + p[1:] for p in x.split("_"))
    return list(dict.fromkeys([x, snake, camel]))


def tokens(x: Column, chars_per_token: float = 4.0) -> Column:
    """Estimated tokens: ASCII characters by chars_per_token, others by 1.5, rounded up; 0 for nothing."""
    ascii_ = F.char_length(F.regexp_replace(x, r"[^\x00-\x7F]", ""))
    return F.ceil(ascii_ / chars_per_token + (F.char_length(x) - ascii_) / 1.5).cast("bigint")


def shown(x: Column) -> Column:
    """Text for display: over DISPLAY_BYTES bytes it is cut at the last whole character within them."""
    cut = F.transform(F.array(F.substring(x, 1, R.DISPLAY_BYTES)), lambda t: F.when(F.octet_length(t) <= R.DISPLAY_BYTES, t).otherwise(_fit(t)))[0]
    return F.when(F.octet_length(x) > R.DISPLAY_BYTES, F.concat(cut, F.lit("\n... (已截断)"))).otherwise(x)


def _fit(t: Column) -> Column:
    """The longest prefix of t within DISPLAY_BYTES bytes, by halving."""
    start = F.struct(F.lit(0).alias("lo"), F.char_length(t).alias("hi"))

    def step(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"] + 1) / 2).cast("int")
        ok = F.octet_length(F.substr(t, F.lit(1), mid)) <= R.DISPLAY_BYTES
        return F.struct(F.when(ok, mid).otherwise(acc["lo"]).alias("lo"), F.when(ok, acc["hi"]).otherwise(mid - 1).alias("hi"))

    return F.substr(t, F.lit(1), F.aggregate(F.sequence(F.lit(1), F.lit(12)), start, step, lambda acc: acc["lo"]))


def grouped_digits(n: Column) -> Column:
    return F.format_number(n, 0)


def collection_name(x: Column) -> Column:
    """A legal collection name: other signs become _, a leading digit gets c_, nothing becomes code_context, at most 255."""
    plain = F.regexp_replace(x, "[^A-Za-z0-9_]", "_")
    led = F.when(plain.rlike(r"\A[0-9]"), F.concat(F.lit("c_"), plain)).otherwise(plain)
    return F.left(F.when(led == "", F.lit("code_context")).otherwise(led), F.lit(255))


def store_alias(x: Column) -> Column:
    return F.when(F.lower(trim_space(x)).isin("zilliz", "milvus"), "zilliz").otherwise("local-jsonl")


def in_skipped_dir(path: Column) -> Column:
    """Whether a directory on the path is one that scans leave out."""
    parts = F.split(path, "/")
    return F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda d: d.isin(*R.SKIP_DIRS))
