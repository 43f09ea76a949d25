"""Per-file summaries: imports, functions with their last line, types.

Positions and names are array expressions over a file's lines. Where a block
ends depends on comments and strings, which takes a character-level state
machine; that one step is an Arrow UDF over whole batches of files.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions import rules as R
from marlstone.plans import dialect as D

from .split import language_of, let

_V = r"(pub(\s*\([^)]*\))?\s+)?"
#: Fixed values: (patterns of imports, functions, types) by language, each (pattern, group) or (pattern, group, kind).
PATTERNS = {
    "go": ([(r'^import\s+"([^"]+)"', 1)], [(r"^func\s+(\(\w+\s+\*?\w+\)\s+)?(\w+)", 2)], [(r"^type\s+(\w+)\s+struct", 1, "struct"), (r"^type\s+(\w+)\s+interface", 1, "interface")]),
    "js": ([(r"""^import\s+.+\s+from\s+['"]([^'"]+)['"]""", 1)], [(r"(async\s+)?function\s+(\w+)", 2), (r"(const|let|var)\s+(\w+)\s*=\s*(async\s+)?\(", 2)], [(r"class\s+(\w+)", 1, "class")]),
    "md": ([], [(r"^(#{1,6})\s+(.+)", 2)], []),
    "py": ([(r"^(import|from)\s+(\w+)", 2)], [(r"^(async\s+)?def\s+(\w+)", 2)], [(r"^class\s+(\w+)", 1, "class")]),
    "rust": ([(r"^use\s+([\w:]+(?:\{[^}]+\})?)", 1)], [("^" + _V + r"(async\s+)?fn\s+(\w+)", 4)], [("^" + _V + r"struct\s+(\w+)", 3, "struct"), ("^" + _V + r"enum\s+(\w+)", 3, "enum"), ("^" + _V + r"trait\s+(\w+)", 3, "trait")]),
}
GROUP_IMPORT = r'"([^"]+)"'
SUMMARY = "struct<imports:array<string>,functions:array<struct<name:string,line_start:int,line_end:int>>,types:array<struct<name:string,kind:string,line:int>>>"


def block_end(lines: list[str], start: int) -> int:
    """Line number at which the block that opens at or after lines[start] closes; the last line if it doesn't."""
    depth, opened, state = 0, False, ""
    for number in range(start, len(lines)):
        line, k = lines[number], 0
        while k < len(line):
            c, two = line[k], line[k : k + 2]
            if state == "*":
                if two == "*/":
                    state, k = "", k + 1
            elif state == "`":
                state = "" if c == "`" else state
            elif state == '"':
                if c == "\\":
                    k += 1
                elif c == '"':
                    state = ""
            elif two == "//":
                break
            elif two == "/*":
                state, k = "*", k + 1
            elif c in '"`':
                state = c
            elif c == "{":
                depth, opened = depth + 1, True
            elif c == "}":
                depth -= 1
            k += 1
        if opened and depth == 0:
            return number + 1
    return len(lines)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _block_ends(content: pd.Series, starts: pd.Series) -> pd.Series:
    def one(text: str, at) -> list[int]:
        lines = text.split("\n") if len(at) else []
        return [block_end(lines, int(k) - 1) for k in at]

    return pd.Series([one(t, a) for t, a in zip(content, starts, strict=True)])


def _found(name: str, kind: str) -> str:
    """Arrays of the lines that match, for one language: imports, functions or types in line order."""
    imports, functions, types = PATTERNS[name]
    case = lambda rows, value: "case " + " ".join(f"when {D.matches('spark', 't', r[0])} then {value(r)}" for r in rows) + " end"
    name_of = lambda r: D.extract("spark", "t", r[0], r[1])
    grouped = name == "go"
    free = "not get(inside, i)" if grouped else "true"
    line = lambda body: f"transform(ls, (raw, i) -> {let(D.trim('spark', 'raw') if name != 'md' else 'raw', 't', body)})"
    if kind == "imports":
        if not imports:
            return "cast(array() as array<string>)"
        one = case(imports, name_of)
        if grouped:
            one = f"if(get(inside, i), if(t like 'import (%' or t = ')', null, nullif({D.extract('spark', 't', GROUP_IMPORT, 1)}, '')), {one})"
        return f"filter({line(one)}, x -> x is not null)"
    if kind == "functions":
        value = (lambda r: D.trim("spark", name_of(r))) if name == "md" else name_of
        level = ", 'level', length(" + D.extract("spark", "t", r"^(#{1,6})\s+(.+)", 1) + ")" if name == "md" else ", 'level', length(regexp_extract(raw, r'^[ \\t]*', 0))" if name == "py" else ", 'level', 0"
        return f"filter({line(f'named_struct(\"name\", if({free}, {case(functions, value)}, null), \"line\", i + 1{level})')}, x -> x.name is not null)"
    rows = [f"filter({line(f'named_struct(\"name\", if({free} and {D.matches("spark", "t", r[0])}, {name_of(r)}, null), \"kind\", \"{r[2]}\", \"line\", i + 1)')}, x -> x.name is not null)" for r in types]
    empty = "cast(array() as array<struct<name:string,kind:string,line:int>>)"
    return f"array_sort(concat({', '.join(rows)}), (a, b) -> a.line - b.line)" if rows else empty


def _inside() -> str:
    """Per line, whether it is in an import group or opens or closes one."""
    step = "if(acc.open, named_struct('open', t <> ')', 'out', array_append(acc.out, true)), named_struct('open', t like 'import (%', 'out', array_append(acc.out, t like 'import (%')))"
    return f"aggregate(ls, named_struct('open', false, 'out', cast(array() as array<boolean>)), (acc, raw) -> {let(D.trim('spark', 'raw'), 't', step)}, acc -> acc.out)"


def _parts(name: str, content: str) -> str:
    body = f"named_struct('imports', {_found(name, 'imports')}, 'functions', {_found(name, 'functions')}, 'types', {_found(name, 'types')})"
    if name == "go":
        body = let(_inside(), "inside", body)
    return let(f"split({content}, '\\n')", "ls", body)


def summaries(files: DataFrame, language: str | None = None) -> DataFrame:
    """file, lines, language, imports, functions, types for files (file, content); empty lists are null."""
    lang = D.text(language) if language else language_of("file")
    base = files.select("file", "content", F.expr(lang).alias("language")).withColumn("code", F.when(F.col("language") == "vue", F.expr(D.extract("spark", "content", R.SCRIPT_BODY, 1))).otherwise(F.col("content")))
    names = [language] if language else ["go", "js", "ts", "vue", "md", "py", "rust"]
    raw = "struct<imports:array<string>,functions:array<struct<name:string,line:int,level:int>>,types:array<struct<name:string,kind:string,line:int>>>"
    cases = " ".join(f"when '{n}' then cast({_parts('js' if n in ('ts', 'vue') else n, 'code')} as {raw})" for n in names if n in PATTERNS or n in ("ts", "vue"))
    found = base.withColumn("p", F.expr(f"case language {cases} else cast(null as {raw}) end") if cases else F.expr(f"cast(null as {raw})"))
    starts = F.coalesce(F.transform(F.when(F.col("language").isin("md", "py"), F.array().cast("array<int>")).otherwise(F.col("p.functions.line")), lambda x: x), F.array().cast("array<int>"))
    ended = found.withColumn("starts", starts).withColumn("ends", _block_ends("code", "starts"))
    functions = F.transform("p.functions", lambda f, k: F.struct(f["name"].alias("name"), f["line"].alias("line_start"), F.when(F.col("language") == "md", _next_heading(f)).when(F.col("language") == "py", _dedent(f)).otherwise(F.get(F.col("ends"), k)).cast("int").alias("line_end")))
    null_if_empty = lambda c: F.when(F.size(c) > 0, c)
    total = F.size(F.split("content", "\n"))
    return ended.select("file", total.cast("int").alias("lines"), "language", null_if_empty(F.col("p.imports")).alias("imports"), null_if_empty(functions).alias("functions"), null_if_empty(F.col("p.types")).alias("types"))


def _next_heading(f: Column) -> Column:
    after = F.filter(F.col("p.functions"), lambda g: (g["line"] > f["line"]) & (g["level"] <= f["level"]))
    return F.coalesce(F.get(after, F.lit(0))["line"] - 1, F.size(F.split(F.col("code"), "\n")))


def _dedent(f: Column) -> Column:
    """The line before the next non-blank one that is indented no deeper; the last line if none."""
    lines = F.split(F.col("code"), "\n")
    rest = F.transform(F.slice(lines, f["line"] + 1, F.greatest(F.lit(0), F.size(lines) - f["line"])), lambda x, i: F.struct(i.alias("i"), F.length(F.regexp_extract(x, r"^[ \t]*", 0)).alias("indent"), (F.regexp_replace(x, r"\A[\t-\r\x85\p{Z}]+|[\t-\r\x85\p{Z}]+\z", "") == "").alias("blank")))
    stop = F.filter(rest, lambda r: ~r["blank"] & (r["indent"] <= f["level"]))
    return F.coalesce(F.get(stop, F.lit(0))["i"] + f["line"], F.size(lines))
