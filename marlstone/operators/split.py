"""Structural splitters: from source files to chunks, without a shuffle.

A file's lines are an array inside its row; boundaries, headers, oversize
pieces and fixed windows are array expressions over it. So a corpus is split
where it is read, and only chunks leave the task. Every splitter yields
(line_start, line_end, symbol, type, content), lines counted from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import rules as R
from marlstone.plans import dialect as D

CHUNK = "struct<line_start:int,line_end:int,symbol:string,type:string,content:string,chunk_index:int>"
NONE = f"cast(array() as array<{CHUNK}>)"
_LINE = "'\\n'"


def let(value: str, name: str, body: str) -> str:
    """body with name bound to value, worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def chunk(start: str, end: str, symbol: str, kind: str, content: str, index: str = "cast(null as int)") -> str:
    return f"named_struct('line_start', cast({start} as int), 'line_end', cast({end} as int), 'symbol', {symbol}, 'type', {kind}, 'content', {content}, 'chunk_index', {index})"


def joined(lines: str, first: str, count: str) -> str:
    return f"array_join(slice({lines}, {first}, {count}), {_LINE})"


def not_blank(x: str) -> str:
    return f"{D.trim('spark', x)} <> ''"


def _tops(lines: str, skip: str) -> str:
    """Per line, whether it begins outside all brackets; depths never fall under 0, and skipped lines don't count."""
    count = lambda c: f"(length(t) - length(replace(t, '{c}', '')))"
    new = lambda d, a, b: f"greatest(0, acc.{d} + {count(a)} - {count(b)})"
    out = "array_append(acc.out, acc.p = 0 and acc.b = 0)"
    step = f"if({skip}, named_struct('p', acc.p, 'b', acc.b, 'out', {out}), named_struct('p', {new('p', '(', ')')}, 'b', {new('b', '{', '}')}, 'out', {out}))"
    return f"aggregate({lines}, named_struct('p', 0, 'b', 0, 'out', cast(array() as array<boolean>)), (acc, raw) -> {let(D.trim('spark', 'raw'), 't', step)}, acc -> acc.out)"


def structural(name: str, content: str) -> str:
    """Chunks of one language as an array; empty if nothing is found."""
    language = R.LANGUAGES[name]
    before = D.trim("spark", "coalesce(get(ls, i - 1), 'x')")
    open_ = f"(i = 0 or not ({before} like '%,' or {before} like '%(' or {before} = ''))"
    kind, symbol = D.mark("spark", language, "t", top="get(tops, i)", open_=open_)
    line = D.trim("spark", "raw") if language.trimmed else "raw"
    marks = f"transform(ls, (raw, i) -> {let(line, 't', f'named_struct(\"kind\", {kind}, \"symbol\", {symbol})')})"
    ends = "coalesce(get(bs, j + 1), size(ls))"
    body = f"transform(bs, (b, j) -> {chunk('b + 1', ends, 'get(marks, b).symbol', 'get(marks, b).kind', joined('ls', 'b + 1', ends + ' - b'))})"
    imports = "coalesce(array_max(transform(filter(idx, i -> get(marks, i).kind = '@import'), i -> i + 1)), 0)"
    first = "coalesce(get(bs, 0), size(ls))"
    head = {"first": "coalesce(get(bs, 0), 0)", "below_imports": f"if(size(bs) = 0 and {imports} = 0, 0, if({first} > {imports}, {first}, 0))", "through_imports": f"if(size(bs) = 0 and {imports} = 0, 0, greatest({first}, {imports}))"}[language.header]
    header = chunk("1", "hd", D.text(language.header_symbol), D.text(language.header_type), joined("ls", "1", "hd"))
    both = f"filter(concat(if(hd > 0, array({header}), {NONE}), {body}), c -> {not_blank('c.content')})"
    inner = let("filter(idx, i -> get(marks, i).kind is not null and get(marks, i).kind <> '@import')", "bs", let(head, "hd", both))
    inner = let("sequence(0, size(ls) - 1)", "idx", let(marks, "marks", inner))
    if language.depth:
        inner = let(_tops("ls", D.fill("spark", language.skip, "t")), "tops", inner)
    return let(f"split({content}, {_LINE})", "ls", inner)


def components(content: str, file: str) -> str:
    """Chunks of a single-file component: template, script and style blocks, scripts split again."""
    kind = "case " + " ".join(f"when {D.matches('spark', 'line', p)} then '{k}'" for k, p in R.VUE_OPEN.items()) + " end"
    tag = f"lower({D.extract('spark', 'line', R.VUE_CLOSE, 1)})"
    state = lambda k, s, out: f"named_struct('i', acc.i + 1, 'kind', {k}, 's', {s}, 'out', {out})"
    done = "array_append(acc.out, named_struct('kind', acc.kind, 's', acc.s, 'e', acc.i + 1))"
    step = f"if(acc.kind is null, {state(kind, 'acc.i', 'acc.out')}, if({tag} = acc.kind, {state('cast(null as string)', '0', done)}, {state('acc.kind', 'acc.s', 'acc.out')}))"
    finish = "if(acc.kind is null, acc.out, array_append(acc.out, named_struct('kind', acc.kind, 's', acc.s, 'e', acc.i)))"
    blocks = f"aggregate(ls, named_struct('i', 0, 'kind', cast(null as string), 's', 0, 'out', cast(array() as array<struct<kind:string,s:int,e:int>>)), (acc, line) -> {step}, acc -> {finish})"
    name = rf"regexp_replace(element_at(split({file}, '/'), -1), r'\.[^.]*\z', '')"
    whole = f"array({chunk('b.s + 1', 'b.e', name, 'b.kind', 'text')})"
    moved = f"transform({structural('js', 'script')}, c -> {chunk('c.line_start + b.s', 'c.line_end + b.s', 'c.symbol', 'c.type', 'c.content')})"
    script = let(D.extract("spark", "text", R.SCRIPT_BODY, 1), "script", f"if(b.kind = 'script' and script <> '', {moved}, {whole})")
    each = let(joined("ls", "b.s + 1", "b.e - b.s"), "text", f"if({not_blank('text')}, {script}, {NONE})")
    head = joined("ls", "1", "get(blk, 0).s")
    header = f"if(get(blk, 0).s > 0 and {not_blank(head)}, array({chunk('1', 'get(blk, 0).s', D.text('header'), D.text('header'), head)}), {NONE})"
    body = f"if(size(blk) = 0, {NONE}, concat({header}, flatten(transform(blk, b -> {each}))))"
    return let(f"split({content}, {_LINE})", "ls", let(blocks, "blk", body))


def fixed_windows(content: str, file: str, size: int) -> str:
    """Windows of `size` characters; those of fewer than 10 bytes after trimming are left out, and lines are counted by newlines.

    One pass of a pattern cuts the text, and a fold counts lines: linear in its length.
    """
    newlines = lambda x: f"(length({x}) - length(replace({x}, {_LINE}, '')))"
    inner = newlines("left(w, length(w) - 1)")
    piece = chunk("1 + acc.nl", f"1 + acc.nl + {inner}", f"element_at(split({file}, {D.text('/')}), -1)", D.text("file"), "w")
    kept = f"if(octet_length({D.trim('spark', 'w')}) >= {R.MIN_WINDOW_BYTES}, array_append(acc.out, {piece}), acc.out)"
    step = f"named_struct('nl', acc.nl + {newlines('w')}, 'out', {kept})"
    return f"aggregate(regexp_extract_all({content}, r'(?s).{{1,{size}}}', 0), named_struct('nl', 0, 'out', {NONE}), (acc, w) -> {step}, acc -> acc.out)"


def packed(chunks: str, size: int) -> str:
    """Chunks of more than `size` characters, repacked by whole lines; the others as they are."""
    cost = "(length(line) + 1)"
    piece = chunk("acc.s", "acc.s + acc.n - 1", "c.symbol", "c.type", "acc.text", "size(acc.out)")
    flush = f"if({not_blank('acc.text')}, array_append(acc.out, {piece}), acc.out)"
    state = lambda i, s, n, used, t, out: f"named_struct('i', {i}, 's', {s}, 'n', {n}, 'used', {used}, 'text', {t}, 'out', {out})"
    zero = state("0", "c.line_start", "0", "0", "''", NONE)
    more = state("acc.i + 1", "acc.s", "acc.n + 1", f"acc.used + {cost}", f"if(acc.n = 0, line, concat(acc.text, {_LINE}, line))", "acc.out")
    fresh = state("acc.i + 1", "c.line_start + acc.i", "1", cost, "line", flush)
    fold = f"aggregate(split(c.content, {_LINE}), {zero}, (acc, line) -> if(acc.n > 0 and acc.used + {cost} > {size}, {fresh}, {more}), acc -> {flush})"
    return f"flatten(transform({chunks}, c -> if(length(c.content) <= {size}, array(c), {fold})))"


def language_of(file: str) -> str:
    ext = rf"lower(regexp_extract({file}, r'(\.[^./]*)\z', 1))"
    return f"case {ext} " + " ".join(f"when '{e}' then '{lang}'" for e, lang in R.EXTENSIONS.items()) + " else '' end"


def detect_language(file: Column | str) -> Column:
    name = file if isinstance(file, str) else None
    if name is None:
        return F.transform(F.array(file), lambda f: F.coalesce(*[F.when(F.lower(F.regexp_extract(f, r"(\.[^./]*)\z", 1)) == e, lang) for e, lang in R.EXTENSIONS.items()], F.lit("")))[0]
    return F.expr(language_of(name))


def split_files(files: DataFrame, language: str | None = None, max_chunk: int = R.MAX_CHUNK, size_limit: bool = True) -> DataFrame:
    """file, chunk_no, language and the chunk's columns, for files (file, content).

    A blank file has no chunk; a file in which no boundary is found is one
    chunk named after itself; one in no known language is cut in fixed windows.
    Chunks over max_chunk characters are repacked by lines.
    """
    lang = D.text(language) if language else language_of("file")
    base = files.select("file", "content", F.expr(lang).alias("language")).filter(F.expr(not_blank("content")))
    own = {k: structural(k, "content") for k in ("go", "js", "py", "md", "rust", "kotlin")}
    cases = {**own, "vue": components("content", "file")}
    if language:
        found = cases["js" if language == "ts" else language] if language in (*cases, "ts") else NONE
    else:
        found = "case language " + " ".join(f"when '{k}' then {v}" for k, v in {**cases, "ts": own["js"]}.items()) + f" else {NONE} end"
    whole = f"array({chunk('1', 'size(split(content, ' + _LINE + '))', 'element_at(split(file, ' + D.text('/') + '), -1)', D.text('file'), 'content')})"
    chunks = let(found, "found", packed(f"if(size(found) = 0, {whole}, found)", max_chunk) if size_limit else f"if(size(found) = 0, {whole}, found)")
    chosen = f"if(language = '', {fixed_windows('content', 'file', max_chunk)}, {chunks})"
    out = base.select("file", "language", F.posexplode(F.expr(chosen)).alias("chunk_no", "c"))
    return out.select("file", "chunk_no", "language", "c.line_start", "c.line_end", "c.symbol", "c.type", "c.content", "c.chunk_index")
