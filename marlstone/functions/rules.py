"""Fixed values that results depend on: word lists, patterns, phrases and defaults.

Patterns are written for RE2; spark_pattern() turns one into a Java pattern
with the same meaning (an ASCII white-space class without vertical tab, and a
dot that stops at newline only).
"""

from __future__ import annotations

from dataclasses import dataclass

#: Language by lower-case extension.
EXTENSIONS = {".go": "go", ".vue": "vue", ".js": "js", ".ts": "ts", ".md": "md", ".py": "py", ".rs": "rust", ".kt": "kotlin", ".kts": "kotlin"}
#: Extensions that are scanned by default.
SCAN_EXTENSIONS = (".go", ".vue", ".js", ".ts", ".py", ".md", ".rs")
#: Directories that a scan leaves out.
SKIP_DIRS = ("node_modules", ".git", "dist", ".venv", "vendor", "__pycache__", "target")
#: Size limits and defaults.
MAX_FILE_BYTES = 10 * 1024 * 1024
MAX_CHUNK = 1500
MIN_WINDOW_BYTES = 10
CONTEXT_LINES = 2
CONTEXT_CHARS = 200
SEARCH_TOP_K = 5
SYMBOL_TOP_K = 20
DISPLAY_BYTES = 1000
RETENTION_DAYS = 90

#: Words that are never symbols.
STOP_WORDS = tuple(
    """
func type struct interface package range go defer chan map nil bool byte float64 int int8 int16 int32 int64
uint uint8 uint16 uint32 uint64 uintptr rune complex64 complex128 make new len cap append
function class export async await null undefined this throw try catch finally typeof instanceof void delete yield while
def self None raise with as lambda elif pass
var const import return if else for switch case default break continue true false
get set not and or do end then when is has can use
""".split()
)
#: What an identifier is.
IDENTIFIER = "[a-zA-Z_][a-zA-Z0-9_]*"


@dataclass(frozen=True)
class Rule:
    """A line that matches begins a chunk of this kind; its name is a group of the pattern.

    kind, symbol and guard are SQL, with {t} for the line and {g} for the group,
    where a plain value doesn't do. stop: a match whose guard fails ends the search.
    """

    kind: str
    pattern: str
    group: int
    guard: str = ""
    symbol: str = ""
    stop: bool = False


@dataclass(frozen=True)
class Language:
    rules: tuple[Rule, ...]
    trimmed: bool = True
    skip: str = ""
    header: str = "first"
    header_symbol: str = "header"
    header_type: str = "header"
    depth: bool = False


_V = r"(pub(\s*\([^)]*\))?\s+)?"
_LEAD = r"{extract:^\s*:0}"
#: An indent of four or less, a tab counting four.
_INDENT = f"length({_LEAD}) + 3 * (length({_LEAD}) - length(replace({_LEAD}, chr(9), ''))) <= 4"
#: What begins a chunk, by language, in the order of tests.
_JS = (
    Rule("function", r"export\s+(default\s+)?function\s+(\w+)", 2),
    Rule("class", r"export\s+class\s+(\w+)", 1),
    Rule("export", r"export\s+(const|let|var)\s+(\w+)", 2),
    Rule("function", r"(async\s+)?function\s+(\w+)", 2),
    Rule("class", r"class\s+(\w+)", 1),
    Rule("variable", r"^(const|let|var)\s+(\w+)\s*=", 2),
)
LANGUAGES = {
    "go": Language(
        (
            Rule("function", r"^func\s+(\(\w+\s+\*?\w+\)\s+)?(\w+)", 2),
            Rule("struct", r"^type\s+(\w+)\s+struct", 1),
            Rule("interface", r"^type\s+(\w+)\s+interface", 1),
            Rule("variable", r"^(var|const)\s+", 2, guard="{open}", symbol=r"coalesce(nullif({extract:^(var|const)\s+(\w+):2}, ''), 'variables')"),
        )
    ),
    "js": Language(_JS),
    "ts": Language(_JS),
    "py": Language((Rule("function", r"^(\s*)(async\s+)?def\s+(\w+)", 3, guard=_INDENT, stop=True), Rule("class", r"^(\s*)(class\s+(\w+))", 3, guard=_INDENT, stop=True)), trimmed=False),
    "md": Language((Rule("section", r"^(#{1,6})\s+(.+)", 2, symbol="{trim:{g}}"),), trimmed=False, header_symbol="preamble", header_type="section"),
    "rust": Language(
        (
            Rule("@import", r"^use\s+", 0),
            Rule("function", "^" + _V + r"(async\s+)?fn\s+(\w+)", 4),
            Rule("struct", "^" + _V + r"struct\s+(\w+)", 3),
            Rule("enum", "^" + _V + r"enum\s+(\w+)", 3),
            Rule("trait", "^" + _V + r"trait\s+(\w+)", 3),
            Rule("impl", r"^impl(\s+[\w<>,\s]+)?(\s+for\s+[\w<>,\s]+)?", 0, symbol=r"coalesce(nullif({extract:^impl\s+(?:[\w<>,\s]+\s+for\s+)?(\w+):1}, ''), 'impl')"),
            Rule("module", "^" + _V + r"mod\s+(\w+)", 3),
            Rule("type", "^" + _V + r"type\s+(\w+)", 3),
            Rule("constant", "^" + _V + r"(const|static)\s+(\w+)", 4),
            Rule("macro", r"^macro_rules!\s+(\w+)", 1),
        ),
        skip="{t} = '' or {t} like '//%' or {t} like '/*%'",
        header="below_imports",
    ),
    "kotlin": Language(
        (
            Rule("@import", r"^\s*(?:package|import)\s+", 0, guard="{top}"),
            Rule("companion_object", r"^\s*companion\s+object(?:\s+(\w+))?", 1, symbol="coalesce(nullif({g}, ''), 'Companion')"),
            Rule("case when contains({t}, 'data') then 'data_object' else 'object' end", r"^\s*(?:data\s+)?object\s+(\w+)", 1, guard="not contains({t}, 'companion')"),
            Rule("enum", r"^\s*enum\s+class\s+(\w+)", 1),
            Rule("annotation", r"^\s*annotation\s+class\s+(\w+)", 1),
            Rule("value_class", r"^\s*(?:value|inline)\s+class\s+(\w+)", 1),
            Rule("interface", r"^\s*(?:(?:public|private|internal|protected)\s+)?(?:expect|actual)?\s*interface\s+(\w+)", 1),
            Rule(
                "case when contains({t}, 'data') then 'data_class' when contains({t}, 'sealed') then 'sealed_class' else 'class' end",
                r"^\s*(?:(?:public|private|internal|protected|open|abstract)\s+)?(?:expect|actual)?\s*(?:data\s+)?(?:sealed\s+)?(?:abstract\s+)?(?:open\s+)?(?:inner\s+)?class\s+(\w+)",
                1,
            ),
            Rule("typealias", r"^\s*typealias\s+(\w+)", 1, guard="{top}", stop=True),
            Rule("function", r"^\s*(?:(?:public|private|internal|protected|open|override|expect|actual)\s+)?(?:(?:suspend|inline|tailrec|operator|infix|external)\s+)*fun\s+(?:<[^>]+>\s*)?(\w+)", 1),
            Rule("property", r"^\s*(?:(?:private|internal|public|protected)\s+)?(?:const\s+)?(?:val|var)\s+(\w+)", 1, guard="{top}"),
        ),
        skip="{t} = '' or {t} like '//%' or {t} like '/*%' or {t} like '*%'",
        header="through_imports",
        depth=True,
    ),
}
#: Block tags of single-file components.
VUE_OPEN = {"template": "(?i)<template[^>]*>", "script": "(?i)<script[^>]*>", "style": "(?i)<style[^>]*>"}
VUE_CLOSE = r"(?i)</(template|script|style)\s*>"
SCRIPT_BODY = r"(?is)<script[^>]*>(.*?)</(?:template|script|style)\s*>"

#: Phrases in tool output that tell a missing index, and an empty result by tool.
SYSTEM_PHRASES = ("符号索引尚未构建", "请先索引项目", "使用 index_project 工具")
EMPTY_PHRASES = {"symbol_search": ("未找到符号",), "impact_analysis": ("未找到符号", "任何出现位置")}
#: Suggestion texts.
SUGGESTIONS = {("delete", "definition"): "删除该定义", ("delete", "reference"): "删除该引用", ("modify", "definition"): "更新定义以匹配新签名", ("modify", "reference"): "更新调用以匹配新签名"}
RENAME_TEXT = ("将 ", " 替换为 ")
#: Tokens that a tool's answer is held against.
BASELINES = {"code_search": 2000, "file_context": 3000, "symbol_search": 8000, "impact_analysis": 12000}
UNTRACKED_TOOLS = ("index_project", "token_stats")
JSON_TAG = 'json:"'
#: Dimensions of embedding models.
MODEL_DIMENSIONS = {"nomic-embed-text": 768, "text-embedding-ada-002": 1536, "text-embedding-3-small": 1536, "text-embedding-3-large": 3072, "embedding-001": 768}


def spark_pattern(pattern: str) -> str:
    return "(?d)" + pattern.replace(r"\s", r"[\t\n\f\r ]")
