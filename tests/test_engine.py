from __future__ import annotations

import json
import os

import pytest

from marlstone.config import EngineConfig, collection_name
from marlstone.engine import Engine, answer, integer, serve
from marlstone.functions import text as X
from marlstone.operators import stats, summary, vectors
from marlstone.sources import tree
from marlstone.sources.store import JsonlVectors, ParquetVectors, SnapshotStore, vector_table
from marlstone.streaming import calls as S


@pytest.fixture
def project(tmp_path):
    root = tmp_path / "project"
    for path, text in {
        "main.go": "package p\n\nfunc LoadConfig() {\n  Save()\n}\n",
        "a/b/deep.go": "package q\n\nfunc Other() {\n  LoadConfig()\n}\n",
        "pkg/__init__.py": "def load_config():\n    pass\n",
        ".github/x.md": "# Title\ntext",
        "UP.GO": "package u\n",
        "node_modules/lib.go": "package no",
        "style.css": "x {}",
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return root


def test_scan_rules(spark, project):
    (project / "big.go").write_bytes(b"x" * (10 * 1024 * 1024 + 1))
    names = {r.file for r in tree.scan(spark, str(project)).collect()}
    assert names == {"main.go", "a/b/deep.go", "pkg/__init__.py", ".github/x.md", "UP.GO"}
    assert "big.go" in {r.file for r in tree.scan_mtimes(spark, str(project)).collect()}
    some = tree.scan_files(spark, str(project), ["main.go", "gone.go", "a"]).collect()
    assert [r.file for r in some] == ["main.go"] and "LoadConfig" in some[0].content


def test_read_inside(project, tmp_path):
    assert "LoadConfig" in tree.read_inside(str(project), "main.go")
    (tmp_path / "out.txt").write_text("x")
    os.symlink(tmp_path / "out.txt", project / "link.go")
    for bad in ("../out.txt", "link.go", "a..b"):
        with pytest.raises(ValueError):
            tree.read_inside(str(project), bad)


def test_index_search_update(spark, project, tmp_path):
    config = EngineConfig(dimension=64, project_path=str(project), stats_enabled=True)
    engine = Engine(spark, str(tmp_path / "index"), config)
    with pytest.raises(LookupError):
        engine.symbol_search("LoadConfig")
    assert engine.index_project(str(project))["total_files"] == 5
    found = [(r.file, r.line, r.type) for r in engine.symbol_search("LoadConfig").collect()]
    assert found == [("a/b/deep.go", 4, "reference"), ("main.go", 3, "definition"), ("pkg/__init__.py", 1, "definition")]
    assert engine.code_search("func LoadConfig Save", "1").first().file == "main.go"
    before = engine.store.current()
    assert engine.update(str(project)) and engine.store.current() == before
    (project / "main.go").write_text("package p\n\nfunc Renamed() {}\n")
    (project / "UP.GO").unlink()
    engine.update(str(project))
    assert engine.store.current() != before
    assert {r.file for r in engine.symbol_search("LoadConfig").collect()} == {"a/b/deep.go", "pkg/__init__.py"}
    assert {r.file for r in engine.store.table("files").collect()} == {"main.go", "a/b/deep.go", "pkg/__init__.py", ".github/x.md"}
    assert engine.store.table("vectors").filter("metadata.file = 'main.go'").filter("text like '%LoadConfig%'").count() == 0
    impact = json.loads(engine.call("impact_analysis", {"symbol": "LoadConfig", "action": "delete"}))
    assert impact["summary"]["total_files"] == 2
    assert "未找到符号" in engine.call("symbol_search", {"query": "Nothing"})
    assert json.loads(engine.call("file_context", {"file_path": "main.go", "mode": "summary"}))["functions"][0]["name"] == "Renamed"
    report = engine.call("token_stats")
    assert "Calls: 3" in report and "symbol_search" in report
    listed = answer(engine, {"id": 1, "method": "tools/list"})["result"]["tools"]
    assert len(listed) == 6
    assert answer(engine, {"id": 1, "method": "x"})["error"]["code"] == -32601
    assert answer(engine, {"id": 1, "method": "tools/call"})["error"]["code"] == -32602
    assert answer(engine, {"id": 1, "method": "tools/call", "params": {"name": "none"}})["result"]["isError"]


def test_arguments():
    assert [integer(x, 5) for x in (5.0, "7", None, "x", True)] == [5, 7, 5, 5, 5]


@pytest.mark.parametrize("kind", [JsonlVectors, ParquetVectors])
def test_vector_tables(spark, tmp_path, kind):
    table = kind(spark, str(tmp_path / "v"))
    assert not table.exists() and table.count() == 0
    table.ensure()
    schema = "id string, text string, embedding array<float>, metadata struct<file:string,symbol:string,type:string,language:string,line_start:int,line_end:int,chunk_index:int>"
    rows = spark.createDataFrame([(f"d{i}", "t", [1.0, float(i)], (f"{i % 2}.go", None, None, None, None, None, None)) for i in range(4)], schema)
    table.append(rows)
    assert table.count() == 4
    table.delete_files(spark.createDataFrame([("1.go",)], "file string"))
    assert {r.id for r in table.read().collect()} == {"d0", "d2"}
    table.drop()
    assert not table.exists()
    with pytest.raises(ValueError):
        vector_table(spark, "remote", "x")


def test_bad_line_fails_the_read(spark, tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "a.json").write_text('{"id":"a"}\nnot json\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        JsonlVectors(spark, str(tmp_path / "v")).read().collect()


def test_snapshots_keep_the_last_two(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    assert store.current() is None and store.state() is None
    for k in range(3):
        store.commit({"t": spark.range(k + 1)}, {"k": k})
    assert store.table("t").count() == 3 and store.state() == {"k": 2}
    assert len([p for p in os.listdir(tmp_path / "s") if p.startswith("snapshot")]) == 2


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0, 0.0], [-1.0, 0.0], -1.0), ([], [], None), ([1.0], [1.0, 2.0], None), ([0.0], [0.0], None)], "a array<float>, b array<float>, want float")
    from pyspark.sql import functions as F

    assert all(r.got == r.want for r in rows.withColumn("got", vectors.cosine(F.col("a"), F.col("b"))).collect())


def test_ranks_among_all_vectors(spark):
    rows = [("a", 0.0), ("b", 0.001), ("b", 0.001), (None, 0.001), (None, 0.0), ("c", 1.0)]
    table = spark.createDataFrame([(i, "t", [1.0, y], ("f",)) for i, y in rows] + [("d", "t", [0.0, 0.0], ("f",))], "id string, text string, embedding array<float>, metadata struct<file:string>")
    hits = vectors.ranked_top_k(table, [1.0, 0.0], 4, by=vectors.shown_score)
    *known, last = [(r.id, r["rank"]) for r in hits.collect()]
    assert known == [("a", 1), ("b", 3), ("b", 4)] and last in [(None, 2), (None, 5)]  # either of the null ids, which tie


def test_failing_texts_are_left_out():
    def embed(texts):
        if "bad" in texts:
            raise RuntimeError("no")
        return [[1.0] for _ in texts]

    assert vectors.safely(embed, ["a", "bad"]) == ([[1.0], None], [None, "no"])


def test_scalars(spark):
    from pyspark.sql import functions as F

    names = spark.createDataFrame([("HTTPServer", "h_t_t_p_server"), ("loadConfig", "load_config"), ("x", "x"), ("", "")], "a string, want string")
    assert all(r.got == r.want for r in names.withColumn("got", X.camel_to_snake(F.col("a"))).collect())
    assert X.expand_name("config") == ["config", "Config"] and X.expand_name("") == [""] and X.expand_name("a_b_c") == ["a_b_c", "ABC"]
    t = spark.createDataFrame([("hello world", 4.0, 3), ("hello世界", 4.0, 3), ("abcdefghij", 3.5, 3), ("你好世界", 4.0, 3), ("", 4.0, 0)], "s string, c double, want int")
    for r in t.collect():
        assert spark.range(1).select(X.tokens(F.lit(r.s), r.c)).first()[0] == r.want
    k = spark.createDataFrame([(None, 5), (0.0, 5), (-1.0, 5), (3.0, 3), (10.0, 10), (20.0, 10), (2.9, 2)], "k double, want int")
    assert all(r.got == r.want for r in k.withColumn("got", stats.wanted_rows(F.col("k"))).collect())
    assert [collection_name(x) for x in ("a-b", "1x", "", "x" * 300)] == ["a_b", "c_1x", "code_context", "x" * 255]
    long = "é" * 700
    shown = spark.range(1).select(X.shown(F.lit(long))).first()[0]
    assert shown == "é" * 500 + "\n... (已截断)"


@pytest.mark.parametrize(("lines", "start", "want"), [(["f {", " if {", " }", "}"], 0, 4), (["f {", "x"], 0, 2), (['f { // }', '"}" `}` /* } */', "}"], 0, 3), ([r'f { "\"}"', "}"], 0, 2), (["a", "f() {}"], 0, 2)])
def test_block_end(lines, start, want):
    assert summary.block_end(lines, start) == want


def test_summaries_of_mixed_files(spark):
    files = [("a.go", 'package p\nimport (\n "fmt"\n x "os"\n)\ntype T struct {\n}\nfunc F() {\n}\n'), ("b.kt", "class A"), ("c.vue", "<script>\nfunction go() {\n}\n</script>"), ("d.py", "import os\ndef f():\n    x\n\ny = 1\n")]
    got = {r.file: r for r in summary.summaries(spark.createDataFrame(files, "file string, content string")).collect()}
    assert got["a.go"].imports == ["fmt", "os"] and [tuple(f) for f in got["a.go"].functions] == [("F", 8, 9)] and got["a.go"].lines == 10
    assert got["b.kt"].functions is None and got["b.kt"].language == "kotlin"
    assert [tuple(f) for f in got["c.vue"].functions] == [("go", 2, 3)]
    assert [tuple(f) for f in got["d.py"].functions] == [("f", 2, 4)]


def test_config():
    c = EngineConfig.load({"EMBEDDING_PROVIDER": "openai", "VECTOR_STORE": " Milvus ", "SCAN_EXTENSIONS": ".go, .kt", "MAX_CHUNK_SIZE": "x"})
    assert (c.provider, c.vector_store, c.extensions, c.max_chunk) == ("openai", "zilliz", (".go", ".kt"), 1500)
    assert c.dimension_warning()[0] == 1536 and EngineConfig.load({}).dimension_warning() == (0, "")


def test_stream_gives_the_batch_result(spark, tmp_path):
    schema = "tool string, top_k double, mode string, output_text string, duration_ms bigint, ts timestamp, error string"
    from datetime import datetime

    rows = [("code_search", 3.0, None, "text " * k, 10, datetime(2024, 1, 1 + k % 3, 5), None) for k in range(9)] + [("token_stats", None, None, "x", 1, datetime(2024, 1, 1), None), ("code_search", None, None, "x", 1, datetime(2024, 1, 1), "failed")]
    df = spark.createDataFrame(rows, schema)
    df.write.parquet(str(tmp_path / "calls"))
    days = S.daily_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "calls")))
    S.start(days, "daily_calls", str(tmp_path / "cp"), every=None).awaitTermination()
    assert sorted(map(tuple, spark.table("daily_calls").collect())) == sorted(map(tuple, stats.daily(stats.measured(df)).collect()))


@pytest.fixture
def engine(spark, project, tmp_path):
    return Engine(spark, str(tmp_path / "index"), EngineConfig(dimension=16, project_path=str(project), stats_enabled=True))


def test_the_index_is_checked_at_start(spark, project, engine, monkeypatch):
    root = str(project)
    assert engine.stale and engine.begin(root) == "built" and not engine.stale
    assert engine.begin(root) == "fresh"
    (project / "main.go").write_text("package p\n\nfunc Renamed() {}\n")
    assert engine.begin(root) == "updated" and engine.symbol_search("Renamed").count() == 1
    # a failing update falls back to a full build
    (project / "UP.GO").unlink()
    with monkeypatch.context() as m:
        m.setattr(tree, "read_files", None)
        m.setattr(Engine, "update", lambda self, root: 1 / 0)
        with pytest.warns(UserWarning, match="built anew"):
            assert engine.begin(root) == "built"
    assert engine.store.table("files").count() == 4
    # a state that can't be read is built anew, by begin as by update
    for go in (engine.begin, engine.update):
        engine.store.files.write(f"{engine.store.current()}/state.json", "{no json")
        assert engine.committed() is None and go(root) and engine.committed()["total_files"] == 4
    # a tree that can't be read leaves the index as it is, but stale
    engine.stale = True
    with pytest.warns(UserWarning, match="could not be compared"), monkeypatch.context() as m:
        m.setattr(tree, "scan_mtimes", lambda *a: 1 / 0)
        assert engine.begin(root) == "stale" and engine.stale
    assert Engine(spark, "x", EngineConfig(auto_index=False)).begin(root) == "off"


def test_one_background_update_at_a_time(project, engine):
    assert engine.refresh(str(project)) is None  # nothing to refresh yet
    engine.index_project(str(project))
    assert engine.refresh(str(project)) is None  # not stale
    (project / "new.go").write_text("package p\n\nfunc Fresh() {}\n")
    engine.stale = True
    with engine._building:  # held up: queries go on, and no second job starts
        job = engine.refresh(str(project))
        assert job.is_alive() and engine.refresh(str(project)) is None
        assert engine.symbol_search("Fresh").count() == 0
    job.join(60)
    assert not engine.stale and engine.symbol_search("Fresh").count() == 1
    engine.stale = True
    assert "new.go" in engine.call("symbol_search", {"query": "Fresh"})  # a search starts the update by itself
    with engine._refreshing:
        assert not engine.stale


def test_work_is_stopped_in_time(spark, engine):
    from pyspark.sql import functions as F

    slow = lambda: spark.range(4).select(F.expr("java_method('java.lang.Thread', 'sleep', 20000L + id)")).collect()
    with pytest.raises(TimeoutError):
        engine._within(1, slow)
    assert engine._within(30, lambda: spark.range(3).count()) == 3
    with pytest.raises(ZeroDivisionError):
        engine._within(30, lambda: 1 / 0)


def test_calls_are_held_and_written_together(project, engine):
    engine.index_project(str(project))
    for _ in range(3):
        engine.call("symbol_search", {"query": "LoadConfig"})
    assert not os.path.exists(engine.calls_path) and engine.calls().count() == 3
    engine.flush()
    engine.flush()
    assert len([f for f in os.listdir(engine.calls_path) if f.endswith(".parquet")]) == 1 and engine.calls().count() == 3
    (bad := os.path.join(engine.calls_path, "bad.parquet"))
    with open(bad, "wb") as f:
        f.write(b"PAR1 no table PAR1")
    with pytest.warns(UserWarning, match="recorded calls"):
        assert engine.calls().count() == 3


def test_texts_without_a_vector_are_counted(spark, project, tmp_path):
    class Half:
        dimension = 2

        def embed(self, texts):
            if any("LoadConfig" in t for t in texts):
                raise RuntimeError("no")
            return [[1.0, 0.0] for _ in texts]

    engine = Engine(spark, str(tmp_path / "i"), EngineConfig(dimension=2), Half())
    with pytest.warns(UserWarning, match="2 texts could not be embedded"):
        out = engine.index_project(str(project))
    assert out["failed_chunks"] == 2 and engine.store.table("vectors").count() == out["total_chunks"] - 2


def test_a_remote_vector_table(spark, project, tmp_path):
    config = EngineConfig(dimension=16, vector_store="zilliz")
    with pytest.raises(ValueError, match="zilliz"):
        Engine(spark, str(tmp_path / "i"), config)
    remote = ParquetVectors(spark, str(tmp_path / "remote"))
    engine = Engine(spark, str(tmp_path / "i"), config, remote=remote)
    total = engine.index_project(str(project))["total_chunks"]
    assert remote.count() == total and engine.code_search("func LoadConfig Save", 1).first().file == "main.go"
    (project / "main.go").unlink()
    total = engine.update(str(project))["total_chunks"]
    assert remote.count() == total and remote.read().filter("metadata.file = 'main.go'").isEmpty()


def test_a_deletion_that_is_cut_off_loses_nothing(spark, tmp_path, monkeypatch):
    table = JsonlVectors(spark, str(tmp_path / "v"))
    schema = "id string, text string, embedding array<float>, metadata struct<file:string,symbol:string,type:string,language:string,line_start:int,line_end:int,chunk_index:int>"
    table.append(spark.createDataFrame([(f"d{i}", "t", [1.0], (f"{i % 3}.go", None, None, None, None, None, None)) for i in range(6)], schema))
    one, two = (spark.createDataFrame([(f,)], "file string") for f in ("1.go", "2.go"))
    with monkeypatch.context() as m:
        m.setattr(table.files, "write", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            table.delete_files(one)
    assert table.count() == 6
    table.delete_files(one)
    table.delete_files(two)
    assert {r.id for r in table.read().collect()} == {"d0", "d3"}
    table.append(table.read().filter("id = 'd0'"))
    assert table.count() == 3


def test_lines_are_served(project, engine):
    engine.index_project(str(project))
    out = []
    serve(engine, ['{"id": 1, "method": "initialize"}\n', "\n", "no json\n", '{"method": "notifications/initialized"}\n', '{"id": 2, "method": "ping"}\n', '{"id": 3, "method": "tools/call", "params": {"name": "symbol_search", "arguments": {"query": "LoadConfig"}}}\n'], out.append)
    replies = [json.loads(x) for x in out]
    assert [r.get("id") for r in replies] == [1, None, 2, 3] and replies[1]["error"]["code"] == -32700
    assert replies[0]["result"]["serverInfo"]["name"] == "marlstone" and "main.go" in replies[3]["result"]["content"][0]["text"]


def test_days_are_merged_from_updates(spark, tmp_path):
    from datetime import datetime

    schema = "tool string, top_k double, mode string, output_text string, duration_ms bigint, ts timestamp, error string"
    days = S.DailyTable(spark, str(tmp_path / "days"))
    everything = []
    for part in range(3):
        rows = [("code_search", 3.0, None, "text " * k, 10, datetime(2024, 1, 1 + (k + part) % 3, 5), None) for k in range(5)]
        everything += rows
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "calls"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "calls"))
        S.start_updates(S.daily_stream(stream), days.merge, str(tmp_path / "cp"), every=None).awaitTermination()
    want = stats.daily(stats.measured(spark.createDataFrame(everything, schema)))
    assert sorted(map(tuple, days.rows().select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    days.merge(days.rows().limit(0), 0)  # an old batch that comes again
    assert days.rows().count() == 3


def test_a_store_that_only_spark_reads(spark, project):
    got = {r.file: r.content for r in tree.store_files(spark, f"file://{project}").collect()}
    assert {"main.go", "a/b/deep.go", "UP.GO"} == set(got) and "node_modules/lib.go" not in got and "style.css" not in got
