"""DuckDB SQL for the operators that SQL can express: exact results by plain means."""

from __future__ import annotations

from .secret_scan import BASE, RULES
from .sharding import HEADER_BYTES, ROUND_KEYS, WALK, round_value

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
_NORMAL = r"regexp_extract_all(coalesce({}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_LENGTHS = "coalesce(list_sum(list_transform({}, lambda v: length(v))), 0)"

DECONTAMINATION = f"""
with d as (select doc_id, {_NORMAL.format(_LOWER.format('text'))} as w, string_split_regex(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as g from documents),
b as (select cast(item_id as varchar) as item, {_NORMAL.format(_LOWER.format('text'))} as w from benchmark where item_id is not null),
p as (select item, least(len(w), 10) as m, array_to_string(w[k:k + 9], ' ') as win from (select *, unnest(range(1, greatest(1, len(w) - 9) + 1)) as k from b where len(w) > 0)),
sizes as (select distinct m from p),
dw as (select doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') as win from (select *, unnest(range(1, len(w) - m + 2)) as i from d, sizes where len(w) >= m)),
h as (select doc_id, i, dw.m, item from dw join p on dw.m = p.m and dw.win = p.win),
x as (select distinct doc_id, ix from (select doc_id, unnest(range(i, i + m)) as ix from (select distinct doc_id, i, m from h))),
n as (select doc_id, count(*) as n_hit from x group by doc_id),
runs as (select doc_id, min(ix) as a, max(ix) as z from (select *, ix - row_number() over (partition by doc_id order by ix) as run from x) group by doc_id, run),
sp as (select doc_id, string_agg(concat({_LENGTHS.format('g[1:a]')} + {_LENGTHS.format('w[1:a - 1]')}, ':', {_LENGTHS.format('g[1:z]')} + {_LENGTHS.format('w[1:z]')}), ',' order by a) as spans from runs join d using (doc_id) group by doc_id),
it as (select doc_id, count(distinct item) as n_items, array_to_string(list_sort(list(distinct item)), ',') as items from h group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(spans, '') as spans
from d left join n using (doc_id) left join it using (doc_id) left join sp using (doc_id)"""

SUBSTRINGS = f"""
with d as (select doc_id, {_WORDS.format('text')} as w from documents),
x as (select doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) as k from (select *, unnest(range(1, len(w) - 18)) as i from d where len(w) >= 20)),
again as (select doc_id, i from (select *, row_number() over (partition by k order by doc_id, i) as ix from x) where ix > 1),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as ix from again),
kept as (select q.doc_id, string_agg(word, ' ' order by q.ix) as text from (select doc_id, unnest(range(1, len(w) + 1)) as ix, unnest(w) as word from d) q left join gone g on g.doc_id = q.doc_id and g.ix = q.ix where g.ix is null group by q.doc_id),
n as (select doc_id, count(*) as n from gone group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n.n, 0) as bigint) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256 from d left join n using (doc_id) left join kept using (doc_id)"""

NEAR_DUPLICATES = f"""
with recursive d as (select doc_id, {_WORDS.format(_LOWER.format('text'))} as w from documents),
s as (select distinct doc_id, k from (select doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [concat(len(w), ':', array_to_string(w, ' '))] else [] end) as k from d)),
n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.k = b.k and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 85 * (x.n + y.n - shared)),
sym as (select a, b from links union select b, a from links),
reach as (select doc_id as a, doc_id as b from d union select reach.a, sym.b from reach join sym on reach.b = sym.a)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, min(reach.b) as component_id, d.doc_id = min(reach.b) as kept from d left join n using (doc_id) join reach on reach.a = d.doc_id group by d.doc_id, n.n"""

SUFFIXES = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
x as (select doc_id, i, md5(substr(h, 2 * i + 1, 400)) as k from (select *, unnest(range(0, n - 199)) as i from d where n >= 200)),
again as (select doc_id, i from (select *, count(*) over (partition by k) as c from x) where c > 1),
run as (select doc_id, i, sum(case when i <= before + 200 then 0 else 1 end) over (partition by doc_id order by i) as g from (select *, coalesce(lag(i) over (partition by doc_id order by i), -1000) as before from again)),
span as (select doc_id, min(i) as a, max(i) + 200 as z from run group by doc_id, g),
gap as (select doc_id, coalesce(lag(z) over (partition by doc_id order by a), 0) as f, a as t from span union all select doc_id, max(z), null from span group by doc_id),
kept as (select g.doc_id, string_agg(substr(h, 2 * f + 1, 2 * (coalesce(t, n) - f)), '' order by f) as h from gap g join d using (doc_id) group by g.doc_id),
s as (select doc_id, count(*) as n_spans, sum(z - a) as lost from span group by doc_id)
select d.doc_id, cast(n as bigint) as n_bytes, cast(coalesce(lost, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans, sha256(unhex(coalesce(kept.h, d.h))) as kept_sha256 from d left join s using (doc_id) left join kept using (doc_id)"""


#: Every query against every row, sums taken term by term as in ann.cosine. Windows hold all rows up to 1,024 of them; above, op8 is approximate and this is what it approximates.
NEIGHBOURS = """
with v as (select vec_id, cast(embedding as double[]) as x from embeddings where vec_id is not null and embedding is not null),
s as (select distinct vec_id, x from v where len(x) > 0 and len(list_filter(x, lambda e: e is null or isnan(e) or isinf(e))) = 0 and len(list_filter(x, lambda e: e <> 0)) > 0),
m as (select len(x) as d from s group by 1 order by count(*) desc, 1 limit 1),
n as (select vec_id, x, sqrt(list_reduce(list_transform(x, lambda e: e * e), lambda a, b: a + b)) as size from s, m where len(x) = d),
p as (select q.vec_id as query_id, c.vec_id, list_reduce(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i]), lambda a, b: a + b) / (q.size * c.size) as score from n q join n c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from p)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5"""


def _feistel(x: str) -> str:
    """One pass over the rectangle, as SQL over columns a and b of the scope."""
    pair = f"{{'l': ({x}) // b, 'r': ({x}) % b}}"
    for k, key in enumerate(ROUND_KEYS):
        f = round_value(key, "p.r" if k % 2 == 0 else "p.l", "a" if k % 2 == 0 else "b")
        new = f"{{'l': (p.l + {f}) % a, 'r': p.r}}" if k % 2 == 0 else f"{{'l': p.l, 'r': (p.r + {f}) % b}}"
        pair = f"list_transform([{pair}], lambda p: {new})[1]"
    return f"list_transform([{pair}], lambda p: p.l * b + p.r)[1]"


#: The polynomial's table is built by rule; a text's bytes are folded one by one.
SHARDING = f"""
with recursive tab as (select list(v order by n) as t from (select n, list_reduce(range(8), lambda c, i: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, n) as v from (select unnest(range(256)) as n))),
d as (select doc_id, octet_length(encode(coalesce(text, ''))) as n_bytes, hex(encode(coalesce(text, ''))) as h from documents),
c as (select doc_id, cast(n_bytes + {HEADER_BYTES} as bigint) as size, cast(xor(list_reduce(list_transform(regexp_extract_all(h, '..'), lambda v: cast(concat('0x', v) as integer)), lambda c, x: xor(t[xor(c % 256, x) + 1], c // 256), 4294967295), 4294967295) as bigint) as text_crc32 from d, tab),
r as (select *, row_number() over (order by doc_id nulls first, text_crc32, size) - 1 as x, count(*) over () as n from c),
s as (select *, a, cast(ceil(n / a) as bigint) as b from (select *, cast(floor(sqrt(n - 1)) as bigint) + 1 as a from r)),
f as (select *, {_feistel('x')} as y from s),
walk as (select doc_id, size, text_crc32, n, a, b, y, 0 as step from f union all select doc_id, size, text_crc32, n, a, b, {_feistel('y')}, step + 1 from walk where y >= n and step < {WALK})
select doc_id, size, text_crc32, 'rows' as law, cast(y % 24 as integer) as shard, cast(y // 24 as bigint) as slot, cast(null as integer) as grown_shard from walk where y < n"""


def _secrets() -> str:
    """Gaps between matches give offsets here too; letters in either case are spelt out, as (?i) would fold beyond ASCII."""
    parts = []
    for k, (_, pattern, group, least) in enumerate(RULES):
        if pattern.startswith("(?i)"):
            head, _, rest = pattern[4:].partition(")")
            pattern = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in head) + ")" + rest
        p = pattern.replace("'", "''")
        parts.append(
            f"select doc_id, {k} as kind, string_split_regex(text, '{p}') as g, regexp_extract_all(text, '{p}') as w, list_transform(regexp_extract_all(text, '{p}', {group}), lambda v: length(v) >= {least}) as ok from d where regexp_matches(text, '{p}')"
        )
    names = ", ".join(f"'{r[0]}'" for r in RULES)
    total = lambda x: f"coalesce(list_sum(list_transform({x}, lambda v: length(v))), 0)"
    shown = "concat(([{}])[kind + 1], ':', s, ':', e)".format(names)
    count = lambda k: f"cast(count(*) filter (kind = {k}) as bigint)"
    return f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
m as ({' union all '.join(parts)}),
i as (select *, unnest(range(1, len(w) + 1)) as n from m),
s as (select doc_id, kind, {total('g[1:n]')} + {total('w[1:n - 1]')} as s, {total('g[1:n]')} + {total('w[1:n]')} as e from i where ok[n]),
a as (select doc_id, {count(0)} as n_assign, {count(1)} as n_access, {count(2)} as n_hex, string_agg({shown}, ',' order by s, kind) as spans, string_agg(case when kind < {BASE} then {shown} end, ',' order by s, kind) as base from s group by doc_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join a using (doc_id)"""


SECRETS = _secrets()
