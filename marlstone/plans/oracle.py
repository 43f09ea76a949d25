"""DuckDB SQL for the registered queries: window formulations, independent of the array plans."""

from __future__ import annotations

from marlstone.functions import rules as R

from . import corpus as C
from . import dialect as D

_TRIM = lambda x: D.trim("duckdb", x)
_NL = "chr(10)"


def lines(files: str) -> str:
    return f"select file, unnest(range(1, len(l) + 1)) as n, unnest(l) as line from (select file, string_split(content, {_NL}) as l from ({files}))"


def chunks(language: str, files: str) -> str:
    """file, line_start, line_end, symbol, type, content by running sums over lines."""
    spec = R.LANGUAGES[language]
    t = "t" if spec.trimmed else "line"
    open_ = "coalesce(not (before like '%,' or before like '%(' or before = ''), true)"
    kind, symbol = D.mark("duckdb", spec, t, top="top", open_=open_)
    skip = D.fill("duckdb", spec.skip, "t") if spec.skip else "false"
    delta = lambda a, b: f"case when {skip} then 0 else (length(t) - length(replace(t, '{a}', ''))) - (length(t) - length(replace(t, '{b}', ''))) end"
    up_to = "over (partition by file order by n rows between unbounded preceding and current row)"
    first = "coalesce(first_at - 1, total)"
    head = {"first": "coalesce(first_at - 1, 0)", "below_imports": f"case when first_at is null and imports = 0 then 0 when {first} > imports then {first} else 0 end", "through_imports": f"case when first_at is null and imports = 0 then 0 else greatest({first}, imports) end"}[spec.header]
    joined = f"string_agg(line, {_NL} order by n)"
    return f"""
with l0 as (select *, {_TRIM('line')} as t from ({lines(files)})),
l1 as (select *, lag(t) over (partition by file order by n) as before, sum({delta('(', ')')}) {up_to} as sp, sum({delta('{', '}')}) {up_to} as sb from l0),
l2 as (select *, sp - least(0, min(sp) {up_to}) as dp, sb - least(0, min(sb) {up_to}) as db from l1),
l3 as (select *, coalesce(lag(dp) over (partition by file order by n), 0) = 0 and coalesce(lag(db) over (partition by file order by n), 0) = 0 as top from l2),
m as (select file, n, line, {kind} as kind, {symbol} as symbol from l3),
b as (select *, case when kind is not null and kind <> '@import' then 1 else 0 end as starts from m),
g as (select *, sum(starts) {up_to} as chunk_no from b),
f as (select file, min(case when starts = 1 then n end) as first_at, coalesce(max(case when kind = '@import' then n end), 0) as imports, count(*) as total from b group by file),
h as (select file, {head} as hd from f),
heads as (select file, cast(1 as integer) as line_start, cast(max(n) as integer) as line_end, '{spec.header_symbol}' as symbol, '{spec.header_type}' as type, {joined} as content from b join h using (file) where n <= hd group by file),
bodies as (select file, cast(min(n) as integer) as line_start, cast(max(n) as integer) as line_end, max(case when starts = 1 then symbol end) as symbol, max(case when starts = 1 then kind end) as type, {joined} as content from g where chunk_no > 0 group by file, chunk_no)
select * from (select * from heads union all select * from bodies) where {_TRIM('content')} <> ''"""


def fixed(files: str, size: int = R.MAX_CHUNK) -> str:
    nl = lambda x: f"(length({x}) - length(replace({x}, {_NL}, '')))"
    end = f"least(i + {size}, length(content))"
    return f"""
with w as (select file, content, unnest(range(0, length(content), {size})) as i from ({files}) where {_TRIM('content')} <> ''),
c as (select file, cast(1 + {nl('substr(content, 1, i)')} as integer) as line_start, cast(1 + {nl(f'substr(content, 1, {end} - 1)')} as integer) as e, list_last(string_split(file, '/')) as symbol, 'file' as type, substr(content, i + 1, {size}) as content from w)
select file, line_start, greatest(line_start, e) as line_end, symbol, type, content from c where octet_length(encode({_TRIM('content')})) >= {R.MIN_WINDOW_BYTES}"""


def packed(chunk_sql: str, size: int) -> str:
    """Greedy repacking by a recursion over each chunk's lines."""
    return f"""
with recursive c as (select *, row_number() over (order by file, line_start, line_end) as id from ({chunk_sql})),
l as (select id, unnest(range(1, len(x) + 1)) as n, unnest(x) as line from (select id, string_split(content, {_NL}) as x from c where length(content) > {size})),
r as (
  select id, n, line, length(line) + 1 as used, 0 as piece from l where n = 1
  union all
  select l.id, l.n, l.line, case when r.used + length(l.line) + 1 > {size} then length(l.line) + 1 else r.used + length(l.line) + 1 end, case when r.used + length(l.line) + 1 > {size} then r.piece + 1 else r.piece end
  from r join l on l.id = r.id and l.n = r.n + 1
),
p as (select id, piece, min(n) as a, max(n) as z, string_agg(line, {_NL} order by n) as content from r group by id, piece),
k as (select *, row_number() over (partition by id order by piece) - 1 as chunk_index from p where {_TRIM('content')} <> '')
select file, cast(line_start + a - 1 as integer) as line_start, cast(line_start + z - 1 as integer) as line_end, symbol, type, k.content, cast(chunk_index as integer) as chunk_index from k join c using (id)
union all select file, line_start, line_end, symbol, type, content, cast(null as integer) from c where length(content) <= {size}"""


def postings(chunk_sql: str) -> str:
    stop = ", ".join(f"'{w}'" for w in R.STOP_WORDS)
    ctx = f"array_to_string(x[greatest(1, ix - {R.CONTEXT_LINES}):least(len(x), ix + {R.CONTEXT_LINES})], {_NL})"
    return f"""
with c as (select file, symbol as own, line_start, line_end, string_split(content, {_NL}) as x from ({chunk_sql})),
l as (select file, own, line_start, line_start + ix - 1 as line, x[ix] as text, {ctx} as ctx from (select *, unnest(range(1, len(x) + 1)) as ix from c)),
i as (select file, own, line_start, line, ctx, unnest(range(1, len(ids) + 1)) as pos, unnest(ids) as symbol from (select *, regexp_extract_all(text, '{R.IDENTIFIER}') as ids from l))
select symbol, file, cast(line as integer) as line, case when symbol = own then 'definition' else 'reference' end as type,
  case when length(ctx) > {R.CONTEXT_CHARS} then concat(substr(ctx, 1, {R.CONTEXT_CHARS}), '...') else ctx end as context, line_start as chunk_no, pos
from i where length(symbol) > 1 and symbol not in ({stop})"""


def occurrences(posting_sql: str, names: list[str]) -> str:
    listed = ", ".join(D.text(n) for n in names)
    rank = f"list_position([{listed}], symbol)"
    return f"select symbol, file, line, type, context from (select *, row_number() over (partition by file, line, symbol order by {rank}, chunk_no, pos) as ix from ({posting_sql}) where symbol in ({listed})) where ix = 1"


def impact_type() -> str:
    return f"case when type = 'definition' then 'definition' when contains(context, '{R.JSON_TAG}') then 'api_payload' else 'reference' end"


def tokens(x: str, cpt: str = "4.0") -> str:
    ascii_ = rf"length(regexp_replace({x}, '[^\x00-\x7F]', '', 'g'))"
    return f"cast(ceil({ascii_} / cast({cpt} as double) + (length({x}) - {ascii_}) / cast(1.5 as double)) as bigint)"


def quality() -> str:
    system = " or ".join(f"contains(output_text, '{p}')" for p in R.SYSTEM_PHRASES)
    empty = " or ".join(f"(tool = '{t}' and contains(output_text, '{p}'))" for t, ps in R.EMPTY_PHRASES.items() for p in ps)
    return f"case when {system} then 'system' when {empty} then 'empty' else 'valid' end"


def baseline() -> str:
    b = R.BASELINES
    k = "case when top_k is null or top_k <= 0 then 5 else least(10, cast(trunc(top_k) as bigint)) end"
    return f"cast(case when tool = 'code_search' then ({k}) * {b['code_search']} when tool = 'file_context' and mode = 'summary' then {b['file_context']} when tool = 'symbol_search' then {b['symbol_search']} when tool = 'impact_analysis' then {b['impact_analysis']} else 0 end as bigint)"


def measured() -> str:
    out = ", ".join(f"'{t}'" for t in R.UNTRACKED_TOOLS)
    return f"""select *, case when quality = 'valid' then greatest(0, base - output_tokens) else 0 end as saved_tokens, case when quality = 'valid' then 0 else output_tokens end as wasted_tokens
from (select *, {quality()} as quality, cast(ts as date) as day, {tokens('output_text')} as output_tokens, {baseline()} as base from ({C.CALLS}) where tool not in ({out}) and error is null)"""


SUMS = "count(*) as calls, cast(sum(output_tokens) as bigint) as output_tokens, cast(sum(saved_tokens) as bigint) as saved_tokens, cast(sum(wasted_tokens) as bigint) as wasted_tokens"


def cosine(a: str, b: str) -> str:
    dot = lambda x, y: f"list_sum(list_transform(list_zip({x}::double[], {y}::double[]), lambda z: z[1] * z[2]))"
    return f"cast({dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)})) as float)"


def block_end(files: str, starts: str) -> str:
    """For (file, n) of starts the first line from n at which braces opened since n are closed again; the last line if none."""
    return f"""
select s.file, s.n, coalesce(min(x.n), max(s.total)) as line_end from (select q.*, t.total from ({starts}) q join (select file, count(*) as total from ({lines(files)}) group by file) t using (file)) s
left join (
  select s2.file, s2.n as start, l.n, sum(d) over w as depth, sum(o) over w as opened from ({starts}) s2
  join (select file, n, (length(line) - length(replace(line, '{{', ''))) - (length(line) - length(replace(line, '}}', ''))) as d, (length(line) - length(replace(line, '{{', ''))) as o from ({lines(files)})) l on l.file = s2.file and l.n >= s2.n
  window w as (partition by s2.file, s2.n order by l.n rows between unbounded preceding and current row)
) x on x.file = s.file and x.start = s.n and x.depth = 0 and x.opened > 0
group by s.file, s.n"""
