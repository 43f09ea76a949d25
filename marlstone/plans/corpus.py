"""Deterministic engine inputs made from the star-schema tables, in SQL that both engines read alike."""

from __future__ import annotations

import re

#: One small file for each part: {k} its key, {m} the key modulo 7, {s} its size, {name} its name.
TEMPLATES = {
    "go": ("pkg/part_{k}.go", """package p{s}

import "fmt"

type Part{k} struct {
  name string `json:"name"`
}
var Max{k} = {s}

func Load{k}(x int) {
  var tmp = Load{m}(x)
  fmt.Println("{name}", tmp)
}

func (p *Part{k}) Run() error {
  return nil
}"""),
    "js": ("web/part_{k}.js", """import x from 'lib{m}'

export default function load_part_{k}(a) {
  return a
}
export class Part{k} {
  run() { return load_part_{m}(1) }
}
export const size{k} = {s}
async function later{k}() {
  const inner = 2
}
const arrow{k} = (a) => {
  return a
}
"""),
    "py": ("py/part_{k}.py", """import os
from lib{m} import thing

class Part{k}:
    def run(self):
        def deep():
            return 1
        return deep()

async def load_part_{k}(a):
    return load_part_{m}(a)
"""),
    "md": ("docs/part_{k}.md", """About {name}.

# Part {k}
Text.
## Size  
{s}
### Details
more
# Other {m}
end"""),
    "rust": ("rs/part_{k}.rs", """use std::fmt;
// part {k}

pub struct Part{k} {
    size: u32,
}

pub(crate) async fn load_part_{k}(x: u32) -> u32 {
    load_part_{m}(x)
}
impl Part{k} {
    fn run(&self) {}
}
impl Show for Part{k} {
}
enum Kind{k} { A, B }
trait Show{k} {
    fn show(&self);
}
const SIZE{k}: u32 = {s};
macro_rules! part{k} {
}"""),
    "kotlin": ("kt/Part{k}.kt", """package p{m}
import a.b

data class Part{k}(
    val size: Int
) {
    val inner = {s}
    fun run(): Int {
        return 1
    }
    companion object {
    }
}
// a comment (
sealed class Kind{k}
enum class Color{k} { A }
object Single{k}
interface Shape{k}
typealias Name{k} = String
val top{k} = {s}
suspend fun <T> load{k}(x: T) {
}"""),
    "vue": ("vue/Part{k}.vue", """<!-- {name} -->
<template>
  <p>{s}</p>
</template>
<script>
export default function load{k}() {
  return {m}
}
const state{k} = 1
</script>
<style>
p {}
</style>"""),
}
_FIELDS = {"k": "cast(p_partkey as string)", "m": "cast(p_partkey % 7 as string)", "s": "cast(p_size as string)", "name": "p_name"}


def _concat(template: str) -> str:
    parts = []
    for piece in re.split(r"(\{(?:k|m|s|name)\}|\n)", template):
        if piece == "\n":
            parts.append("chr(10)")
        elif piece[:1] == "{" and piece[1:-1] in _FIELDS:
            parts.append(_FIELDS[piece[1:-1]])
        elif piece:
            parts.append("'" + piece.replace("'", "''") + "'")
    return f"concat({', '.join(parts)})"


def files_sql(language: str) -> str:
    path, text = TEMPLATES[language]
    return f"select {_concat(path)} as file, {_concat(text)} as content from part"


#: Documents as files of no known language.
DOCUMENT_FILES = "select concat(source, '/', cast(doc_id as string), '.txt') as file, text as content from documents"
PAGE_FILES = "select concat('pages/', cast(page_id as string), '.vue') as file, html as content from pages"
#: Tool calls: events, with every turn of every conversation as an output, and some outputs that tell nothing was found.
CALLS = """
select event_id,
  case event_type when 'view' then 'code_search' when 'click' then 'symbol_search' when 'purchase' then 'impact_analysis' when 'signup' then 'file_context' else 'token_stats' end as tool,
  case when event_id % 5 = 0 then null else cast(event_id % 14 - 1 as double) end as top_k,
  case when event_id % 3 = 0 then 'summary' else 'full' end as mode,
  case when event_id % 11 = 0 then '未找到符号 x' when event_id % 13 = 0 then '请先索引项目' else coalesce(c.text, '') end as output_text,
  cast(floor(value) as bigint) as duration_ms, ts, case when event_id % 17 = 0 then 'failed' end as error
from (select *, event_id % (select count(*) from conversations) as place from events) e
left join (select text, row_number() over (order by conv_id, turn) - 1 as place from conversations) c on c.place = e.place
"""
#: A tree: the Go files, some of them in directories that scans leave out, and files of other kinds.
TREE_PATH = "concat(case p_partkey % 8 when 1 then 'node_modules/' when 2 then 'a/.git/' when 3 then 'dist/x/' when 4 then '.github/' else 'src/' end, 'f', cast(p_partkey as string), case p_partkey % 5 when 0 then '.GO' when 1 then '.css' when 2 then '.Md' else '.go' end)"


def tree_sql(changed: bool = False) -> str:
    """(file, content); changed: some files gone, some with another text, some new."""
    _, text = TEMPLATES["go"]
    where = " where p_partkey % 11 <> 0" if changed else " where p_partkey % 13 <> 0"
    body = f"case when p_partkey % 7 = 0 then concat('package other', chr(10), chr(10), 'func Load', cast(p_partkey as string), '() {{', chr(10), '}}') else {_concat(text)} end" if changed else _concat(text)
    body = f"concat(case when p_partkey % 5 = 2 then concat('# Part ', cast(p_partkey as string), chr(10)) else '' end, {body})"
    return f"select {TREE_PATH} as file, {body} as content from part{where}"


OLD_STATE = "select concat(source, '/', cast(doc_id as string)) as file, cast(n_chars as string) as mtime from documents where doc_id % 5 <> 0"
NEW_STATE = "select concat(source, '/', cast(doc_id as string)) as file, cast(n_chars + case when doc_id % 7 = 0 then 1 else 0 end as string) as mtime from documents where doc_id % 3 <> 0"
