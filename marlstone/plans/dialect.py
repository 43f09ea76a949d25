"""Small SQL spellings in two dialects, so that one rule table renders plans and their oracles."""

from __future__ import annotations

import re

from marlstone.functions.rules import Language, spark_pattern

#: White space in the Unicode sense that chunk trimming uses.
SPACE_CLASS = {"spark": r"[\t-\r\x85\p{Z}]", "duckdb": r"[\t-\r\x{85}\p{Z}]"}


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def pattern(dialect: str, value: str) -> str:
    return "r'" + spark_pattern(value).replace("'", r"\x27") + "'" if dialect == "spark" else text(value)


def matches(dialect: str, x: str, value: str) -> str:
    return f"{'regexp_like' if dialect == 'spark' else 'regexp_matches'}({x}, {pattern(dialect, value)})"


def extract(dialect: str, x: str, value: str, group: int) -> str:
    return f"regexp_extract({x}, {pattern(dialect, value)}, {group})"


def trim(dialect: str, x: str) -> str:
    space = SPACE_CLASS[dialect]
    if dialect == "spark":
        return rf"regexp_replace({x}, r'\A{space}+|{space}+\z', '')"
    return rf"regexp_replace({x}, '\A{space}+|{space}+\z', '', 'g')"


def fill(dialect: str, sql: str, t: str, group: str = "", top: str = "true", open_: str = "true") -> str:
    """Resolve the marks of a rule's SQL."""
    sql = re.sub(r"\{extract:(.*?):(\d+)\}", lambda m: extract(dialect, t, m[1], int(m[2])), sql)
    sql = sql.replace("{g}", group).replace("{t}", t).replace("{top}", top).replace("{open}", open_)
    return re.sub(r"\{trim:(.*)\}", lambda m: trim(dialect, m[1]), sql)


def mark(dialect: str, language: Language, t: str, top: str = "true", open_: str = "true") -> tuple[str, str]:
    """CASE expressions for the kind and the symbol of a line; null where no chunk begins."""
    kinds, symbols = [], []
    if language.skip:
        skip = fill(dialect, language.skip, t)
        kinds.append(f"when {skip} then null")
        symbols.append(f"when {skip} then null")
    for rule in language.rules:
        test = matches(dialect, t, rule.pattern)
        guard = fill(dialect, rule.guard, t, top=top, open_=open_) if rule.guard else ""
        group = extract(dialect, t, rule.pattern, rule.group)
        kind = fill(dialect, rule.kind, t) if rule.kind.startswith("case") else text(rule.kind)
        symbol = fill(dialect, rule.symbol, t, group=group) if rule.symbol else group
        full = f"{test} and ({guard})" if guard else test
        kinds.append(f"when {full} then {kind}")
        symbols.append(f"when {full} then {symbol}")
        if guard and rule.stop:
            kinds.append(f"when {test} then null")
            symbols.append(f"when {test} then null")
    return f"case {' '.join(kinds)} end", f"case {' '.join(symbols)} end"
