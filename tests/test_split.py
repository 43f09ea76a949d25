from __future__ import annotations

import random

import pytest

from marlstone.functions import rules as R
from marlstone.operators import split


def cut(spark, text, file, language=None, **more):
    rows = split.split_files(spark.createDataFrame([(file, text)], "file string, content string"), language, **more)
    return [(r.line_start, r.line_end, r.symbol, r.type) for r in rows.orderBy("chunk_no").collect()]


CASES = {
    "go_blank_before_var": ("a.go", "var a = 1\nvar b = 2\n\nvar c = 3", [(1, 1, "a", "variable"), (2, 4, "b", "variable")]),
    "go_group": ("a.go", "package p\nvar (\n x = 1\n)", [(1, 1, "header", "header"), (2, 4, "variables", "variable")]),
    "js_comment_is_boundary": ("a.js", "// class of things\nlet x = 1", [(1, 1, "of", "class"), (2, 2, "x", "variable")]),
    "python_depth": ("a.py", "class A:\n    def f(self):\n        def g(): pass\n\tdef t(): pass", [(1, 1, "A", "class"), (2, 3, "f", "function"), (4, 4, "t", "function")]),
    "markdown": ("a.md", "x\n# A \n####### no\n#no\n## B", [(1, 1, "preamble", "section"), (2, 4, "A", "section"), (5, 5, "B", "section")]),
    "rust_header_over_boundary": ("a.rs", "use a;\nfn f() {}", [(2, 2, "f", "function")]),
    "rust_only_use": ("a.rs", "// x\nuse a;", [(1, 2, "a.rs", "file")]),
    "kotlin_nested_property": ("a.kt", "class A {\n val x = 1\n}\nval y = 2", [(1, 3, "A", "class"), (4, 4, "y", "property")]),
    "kotlin_late_import": ("a.kt", "class A\nimport b\nval y = 2", [(1, 2, "header", "header"), (1, 2, "A", "class"), (3, 3, "y", "property")]),
    "vue_script_without_boundary": ("a/B.vue", "<script>\nexport default {}\n</script>\n<style>\nx\n</style>", [(4, 6, "B", "style")]),
    "vue_one_line_template": ("a/B.vue", "<template>x</template>\n<style>\n</style>", [(1, 3, "B", "template")]),
    "whole_file": ("a.go", "// nothing here", [(1, 1, "a.go", "file")]),
    "unknown": ("a.txt", "short one here", [(1, 1, "a.txt", "file")]),
    "too_short": ("a.txt", "short", []),
    "blank": ("a.go", " \n\t\u00a0\n", []),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    file, text, want = CASES[name]
    assert cut(spark, text, file) == want


def pack_model(lines, size):
    out, held, used, start = [], [], 0, 1
    for number, line in enumerate(lines, 1):
        if held and used + len(line) + 1 > size:
            out.append((start, start + len(held) - 1, "\n".join(held)))
            held, used, start = [], 0, number
        held.append(line)
        used += len(line) + 1
    return [x for x in [*out, (start, start + len(held) - 1, "\n".join(held))] if x[2].strip()]


def test_packing_against_a_model(spark):
    rng = random.Random(5)
    files = [(f"{i}.go", "\n".join("x" * rng.choice([0, 3, 20, 70]) for _ in range(rng.randint(2, 40))) + "\n// end") for i in range(40)]
    got = split.split_files(spark.createDataFrame(files, "file string, content string"), max_chunk=60).collect()
    for file, text in files:
        want = pack_model(text.split("\n"), 60) if len(text) > 60 else [(1, text.count("\n") + 1, text)]
        assert sorted((r.line_start, r.line_end, r.content) for r in got if r.file == file) == sorted(want)


def test_windows_against_a_model(spark):
    rng = random.Random(6)
    files = [(f"{i}.txt", "".join(rng.choice("ab\n é😀") for _ in range(rng.randint(1, 300)))) for i in range(40)]
    got = split.split_files(spark.createDataFrame(files, "file string, content string"), max_chunk=37).collect()
    for file, text in files:
        want = []
        for lo in range(0, len(text), 37):
            w = text[lo : lo + 37]
            if len(w.strip("\t\n\v\f\r ").encode()) >= R.MIN_WINDOW_BYTES and text.strip():
                first = 1 + text[:lo].count("\n")
                want.append((first, max(first, 1 + text[: lo + len(w) - 1].count("\n")), w))
        assert sorted((r.line_start, r.line_end, r.content) for r in got if r.file == file) == sorted(want)


def test_plan_has_no_shuffle(spark):
    rows = split.split_files(spark.createDataFrame([("a.go", "x")], "file string, content string"))
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
