"""The engine's tools: index a tree, search it, and report on the tools' use.

An index is one snapshot of four tables (files, chunks, postings, vectors) and
a state. Building and updating are batch jobs; every query reads the snapshot
that is current when it starts. At start the state is compared with the tree; an
index found stale later is brought up to date by one background job at a time,
while queries go on with what is there.
"""

from __future__ import annotations

import atexit
import json
import os
import subprocess
import threading
import time
import uuid
import warnings
from collections.abc import Callable
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from marlstone.config import EngineConfig
from marlstone.functions import rules as R
from marlstone.operators import changes, postings, split, stats, summary, vectors
from marlstone.sources import tree
from marlstone.sources.store import Files, SnapshotStore, VectorTable

CALL_SCHEMA = "tool string, top_k double, mode string, output_text string, duration_ms bigint, ts timestamp, error string"
#: The tools and their arguments: name, (argument, type, required, default).
TOOLS = {
    "code_search": (("query", "string", True, None), ("top_k", "integer", False, R.SEARCH_TOP_K)),
    "file_context": (("file_path", "string", True, None), ("mode", "string", False, "full")),
    "index_project": (("path", "string", True, None),),
    "symbol_search": (("query", "string", True, None), ("search_type", "string", False, "all"), ("top_k", "integer", False, R.SYMBOL_TOP_K)),
    "impact_analysis": (("symbol", "string", True, None), ("action", "string", True, None), ("new_name", "string", False, "")),
    "token_stats": (),
}


def integer(value: Any, default: int) -> int:
    """An integer argument given as a number or as text; anything else is the default."""
    try:
        return int(float(value)) if value is not None and not isinstance(value, bool) else default
    except (TypeError, ValueError):
        return default


def git_head(root: str) -> str | None:
    """The commit of a clean work tree, else nothing."""
    try:
        ask = lambda *a: subprocess.run(["git", *a], cwd=root, capture_output=True, text=True, timeout=5, check=True).stdout.strip()
        head = ask("rev-parse", "HEAD")
        return None if ask("status", "--porcelain") else head or None
    except (OSError, subprocess.SubprocessError):
        return None


#: Calls that are held before they are written as one file, and for how long.
HELD_CALLS, HELD_SECONDS = 64, 30.0


class Engine:
    def __init__(self, spark: SparkSession, index: str, config: EngineConfig | None = None, embedder: vectors.Embedder | None = None, remote: VectorTable | None = None):
        self.spark, self.config = spark, config or EngineConfig()
        if self.config.vector_store != "local-jsonl" and remote is None:
            raise ValueError(f"vector store {self.config.vector_store} is not part of this repository: hand in a VectorTable")
        self.store, self.remote = SnapshotStore(spark, index), remote
        self.embedder = embedder or vectors.HashingEmbedder(self.config.dimension)
        self.calls_path = f"{index.rstrip('/')}/tool_calls"
        self.stale = True
        self._building, self._refreshing = threading.Lock(), threading.Lock()
        self._held: list[tuple] = []
        self._held_since, self._holding = 0.0, threading.Lock()

    # --- building

    def _commit(self, files: DataFrame, mtimes: DataFrame, state: dict[str, Any], gone: DataFrame | None = None) -> int:
        """Write a snapshot from the files read, and with gone what is kept of the one before; gives the number of texts without a vector.

        The tree is read once, for the chunks; postings and vectors are made
        from the chunks as written.
        """
        failed = Observation()
        fresh = "chunks" if gone is None else "fresh_chunks"

        def embedded(written: Callable[[str], DataFrame]) -> DataFrame:
            rows = vectors.embed_chunks(written(fresh), self.embedder).observe(failed, F.count_if(F.col("embedding").isNull()).alias("n"))
            return rows.filter("embedding is not null").drop("error")

        def kept(name: str, of: Callable[[DataFrame], DataFrame]):
            return lambda written: postings.replace_files(self.store.table(name), of(written(fresh)), gone)

        split_ = split.split_files(files, max_chunk=self.config.max_chunk)
        if gone is None:
            tables = {"files": mtimes, "chunks": split_, "postings": lambda written: postings.postings(written("chunks")), "vectors": embedded}
        else:
            tables = {"files": mtimes, "fresh_chunks": split_, "chunks": kept("chunks", lambda c: c), "postings": kept("postings", postings.postings)}
            old = self.store.table("vectors") if self.remote is None else None
            tables["vectors"] = embedded if old is None else lambda written: old.withColumn("file", F.col("metadata.file")).join(gone, "file", "left_anti").drop("file").unionByName(embedded(written))
        self.store.commit(tables, state)
        if self.remote is not None:  # the snapshot holds the new vectors only
            self.remote.drop() if gone is None else self.remote.delete_files(gone)
            self.remote.append(self.store.table("vectors"))
        n = failed.get["n"]
        if n:
            warnings.warn(f"{n} texts could not be embedded and are not found by search", stacklevel=3)
        return n

    def _state(self, root: str, mtimes: DataFrame, files: int) -> dict[str, Any]:
        return {"last_indexed_at": datetime.now(timezone.utc).isoformat(), "fingerprint": self._mark(root, mtimes), "total_files": files, "project_path": root}

    def _mark(self, root: str, mtimes: DataFrame) -> str:
        return git_head(root) or changes.fingerprint(mtimes).first()[0]

    def committed(self) -> dict[str, Any] | None:
        """The state of the index; none if there is none, or if it can't be read."""
        try:
            return self.store.state()
        except ValueError:
            return None

    def begin(self, root: str) -> str:
        """At start: build, update or nothing, as the state asks; tells which. A tree that can't be read leaves the index stale."""
        if not self.config.auto_index:
            return "off"
        state = self.committed()
        if state is None:
            self.index_project(root)
            return "built"
        try:
            mark = self._mark(root, tree.scan_mtimes(self.spark, root, self.config.extensions))
        except Exception as e:  # noqa: BLE001
            warnings.warn(f"the tree could not be compared with its index: {e}", stacklevel=2)
            return "stale"
        if mark == state["fingerprint"] and state["project_path"] == root:
            self.stale = False
            return "fresh"
        return self._update_or_build(root)

    def _update_or_build(self, root: str) -> str:
        try:
            self.update(root)
            return "updated"
        except Exception as e:  # noqa: BLE001
            warnings.warn(f"the update failed, the index is built anew: {e}", stacklevel=2)
            self.index_project(root)
            return "built"

    def refresh(self, root: str) -> threading.Thread | None:
        """If the index is stale, one background update at a time; a failing one leaves it stale, for the next call."""
        if not self.stale or self.committed() is None or not self._refreshing.acquire(blocking=False):
            return None

        def run() -> None:
            try:
                self.update(root)
            except Exception as e:  # noqa: BLE001
                warnings.warn(f"the background update failed: {e}", stacklevel=2)
            finally:
                self._refreshing.release()

        job = threading.Thread(target=run, daemon=True)
        job.start()
        return job

    def _within(self, seconds: int, work: Callable[[], Any]) -> Any:
        """work, its Spark jobs cancelled after so many seconds."""
        context, group, late = self.spark.sparkContext, uuid.uuid4().hex, threading.Event()

        def stop() -> None:
            late.set()
            context.cancelJobGroup(group)

        timer = threading.Timer(seconds, stop)
        context.setJobGroup(group, "marlstone", interruptOnCancel=True)
        timer.start()
        try:
            return work()
        except Exception as e:
            if late.is_set():
                raise TimeoutError(f"stopped after {seconds} seconds") from e
            raise
        finally:
            timer.cancel()
            context.setLocalProperty("spark.jobGroup.id", None)

    def index_project(self, root: str) -> dict[str, Any]:
        """Build the index of a tree from nothing."""
        if not root:
            raise ValueError("path must not be empty")
        with self._building:
            files = tree.scan(self.spark, root, self.config.extensions)
            mtimes = tree.scan_mtimes(self.spark, root, self.config.extensions)
            failed = self._commit(files, mtimes, self._state(root, mtimes, mtimes.count()))
            self.stale = False
        return {**self.statistics(), "failed_chunks": failed}

    def update(self, root: str) -> dict[str, Any]:
        """Bring the index up to date: only changed files are read again, the rest of the tables is carried over."""
        state, old = self.committed(), self.store.table("files")
        if state is None or old is None or state["project_path"] != root:
            return self.index_project(root)
        with self._building:
            mtimes = tree.scan_mtimes(self.spark, root, self.config.extensions).cache()
            fresh_state = self._state(root, mtimes, mtimes.count())
            status = changes.diff(old, mtimes).filter("status <> 'same'").cache()
            failed = 0
            if not status.isEmpty():
                files = tree.read_files(status.filter("status <> 'deleted'").repartition("file"), root)
                failed = self._commit(files, mtimes, fresh_state, status.select("file"))
            elif fresh_state["fingerprint"] != state["fingerprint"]:
                self.store.files.write(f"{self.store.current()}/state.json", json.dumps(fresh_state, indent=2))
            status.unpersist()
            mtimes.unpersist()
            self.stale = False
        return {**self.statistics(), "failed_chunks": failed}

    def statistics(self) -> dict[str, Any]:
        return {"total_files": self.store.state()["total_files"], "total_chunks": self.store.table("chunks").count()}

    # --- queries

    def _table(self, name: str) -> DataFrame:
        table = self.store.table(name)
        if table is None:
            raise LookupError(f"{R.SYSTEM_PHRASES[0]}: {R.SYSTEM_PHRASES[2]}")
        return table

    def code_search(self, query: str, top_k: Any = None) -> DataFrame:
        if not query:
            raise ValueError("query must not be empty")
        table = self._table("vectors")
        return vectors.top_k(table if self.remote is None else self.remote.read(), self.embedder.embed([query])[0], integer(top_k, R.SEARCH_TOP_K))

    def symbol_search(self, query: str, search_type: str = "all", top_k: Any = None) -> DataFrame:
        return postings.symbol_search(self._table("postings"), query, search_type, integer(top_k, R.SYMBOL_TOP_K))

    def impact_analysis(self, symbol: str, action: str, new_name: str = "") -> DataFrame:
        return postings.impact_analysis(self._table("postings"), symbol, action, new_name)

    def file_context(self, file_path: str, mode: str = "full") -> str:
        if not file_path:
            raise ValueError("file_path must not be empty")
        text = tree.read_inside(self.config.project_path or ".", file_path)
        if mode != "summary":
            return text
        row = summary.summaries(self.spark.createDataFrame([(file_path, text)], "file string, content string")).first()
        return json.dumps(row.asDict(recursive=True), ensure_ascii=False, indent=2)

    # --- calls by name, recorded

    def call(self, tool: str, args: dict[str, Any] | None = None) -> str:
        """Run a tool by name and give its text; calls that succeed are recorded if statistics are on."""
        if tool not in TOOLS:
            raise ValueError(f"no tool named {tool}")
        args = dict(args or {})
        for name, _, required, default in TOOLS[tool]:
            if required and not args.get(name):
                raise ValueError(f"{name} must not be empty")
            args.setdefault(name, default)
        begun = time.monotonic()
        if tool in ("code_search", "symbol_search", "impact_analysis") and self.config.auto_index and self.config.project_path:
            self.refresh(self.config.project_path)
        limit = self.config.index_timeout if tool == "index_project" else self.config.search_timeout
        text = self._within(limit, lambda: getattr(self, f"_say_{tool}")(args))
        if self.config.stats_enabled and tool not in R.UNTRACKED_TOOLS:
            top_k = args.get("top_k")
            row = (tool, float(top_k) if isinstance(top_k, (int, float)) and not isinstance(top_k, bool) else None, args.get("mode"), text, int(1000 * (time.monotonic() - begun)), datetime.now(timezone.utc).replace(tzinfo=None), None)
            with self._holding:
                self._held_since = self._held_since if self._held else time.monotonic()
                self._held.append(row)
                full = len(self._held) >= HELD_CALLS or time.monotonic() - self._held_since > HELD_SECONDS
            if full:
                self.flush()
        return text

    def flush(self) -> None:
        """Write the calls that are held, as one file."""
        with self._holding:
            rows, self._held = self._held, []
            if rows:
                self.spark.createDataFrame(rows, CALL_SCHEMA).coalesce(1).write.mode("append").parquet(self.calls_path)

    def _say_code_search(self, args: dict[str, Any]) -> str:
        rows = vectors.search_report(self.code_search(args["query"], args["top_k"])).orderBy("rank").collect()  # top_k rows
        return "\n".join(f"--- {r.rank} ({r.score}) ---\n{r.file}\n\n{r.text}\n" for r in rows) or "未找到相关代码"

    def _say_symbol_search(self, args: dict[str, Any]) -> str:
        rows = postings.search_report(self.symbol_search(args["query"], args["search_type"], args["top_k"])).orderBy("file").collect()  # top_k rows
        return "\n".join(r.report for r in rows) or f"未找到符号 \"{args['query']}\" 的匹配。"

    def _say_impact_analysis(self, args: dict[str, Any]) -> str:
        items = self.impact_analysis(args["symbol"], args["action"], args["new_name"]).cache()
        total = postings.impact_summary(items).first()
        if not total.total_references:
            return f"未找到符号 \"{args['symbol']}\" 的任何出现位置。"
        impacts = [r.asDict() for r in items.toLocalIterator()]
        items.unpersist()
        return json.dumps({"symbol": args["symbol"], "action": args["action"], "impacts": impacts, "summary": total.asDict()}, ensure_ascii=False, indent=2)

    def _say_file_context(self, args: dict[str, Any]) -> str:
        return self.file_context(args["file_path"], args["mode"])

    def _say_index_project(self, args: dict[str, Any]) -> str:
        return json.dumps(self.index_project(args["path"]))

    def _say_token_stats(self, args: dict[str, Any]) -> str:
        if not self.config.stats_enabled:
            return "statistics are off: set TOKEN_STATS_ENABLED"
        return stats.report(stats.measured(self.calls(), self.config.chars_per_token, dict(self.config.baselines)), self.config.retention_days)

    def calls(self) -> DataFrame:
        """All recorded calls, those held too; files that can't be read count as empty, with a warning."""
        with self._holding:
            held = self.spark.createDataFrame(list(self._held), CALL_SCHEMA)
        if not Files(self.spark, self.calls_path).exists():
            return held
        stored = self.spark.read.schema(CALL_SCHEMA).option("ignoreCorruptFiles", "true").parquet(self.calls_path)
        try:
            self.spark.read.schema(CALL_SCHEMA).option("ignoreCorruptFiles", "false").parquet(self.calls_path).agg(F.max("ts")).first()
        except Exception as e:  # noqa: BLE001
            warnings.warn(f"recorded calls could not all be read: {str(e)[:200]}", stacklevel=2)
        return stored.unionByName(held)


def answer(engine: Engine, request: dict[str, Any]) -> dict[str, Any] | None:
    """One JSON-RPC 2.0 request to its response; a notification has none."""
    method, id_ = request.get("method"), request.get("id")
    reply = lambda **x: {"jsonrpc": "2.0", "id": id_, **x}
    if id_ is None and str(method).startswith("notifications/"):
        return None
    if method == "initialize":
        return reply(result={"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "marlstone", "version": "1"}})
    if method == "ping":
        return reply(result={})
    if method == "tools/list":
        listed = [{"name": n, "inputSchema": {"type": "object", "properties": {a: {"type": t, **({"default": d} if d is not None else {})} for a, t, _, d in args}, "required": [a for a, _, r, _ in args if r]}} for n, args in TOOLS.items()]
        return reply(result={"tools": listed})
    if method == "tools/call":
        params = request.get("params")
        if not isinstance(params, dict) or not isinstance(params.get("name"), str):
            return reply(error={"code": -32602, "message": "bad parameters"})
        try:
            return reply(result={"content": [{"type": "text", "text": engine.call(params["name"], params.get("arguments"))}]})
        except Exception as e:  # noqa: BLE001  a tool's failure is its answer
            return reply(result={"content": [{"type": "text", "text": str(e)}], "isError": True})
    return reply(error={"code": -32601, "message": f"no method {method}"})


def serve(engine: Engine, lines, write) -> None:
    """Answer JSON-RPC requests, one on each line."""
    for line in lines:
        if line.strip():
            try:
                out = answer(engine, json.loads(line))
            except ValueError:
                out = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "no JSON"}}
            if out is not None:
                write(json.dumps(out, ensure_ascii=False) + "\n")


def main() -> None:
    import argparse
    import sys

    parser = argparse.ArgumentParser(prog="marlstone")
    parser.add_argument("-index", metavar="DIR", help="index a tree and stop")
    parser.add_argument("-store", default="marlstone-index", help="where the index is kept")
    parser.add_argument("-version", action="store_true")
    args = parser.parse_args()
    if args.version:
        print("marlstone 1")
        return
    spark = SparkSession.builder.appName(f"marlstone-{uuid.uuid4().hex[:6]}").getOrCreate()
    config = EngineConfig.load()
    remote = None  # without a provider in the environment the hashing embedder stands in
    if os.environ.get("EMBEDDING_PROVIDER"):
        remote = vectors.HttpEmbedder(config.provider, config.urls[config.provider], config.models[config.provider], config.dimension, config.keys.get(config.provider, ""))
    engine = Engine(spark, args.store, config, remote)
    if args.index:
        print(json.dumps(engine.index_project(args.index)))
        return
    if config.project_path:
        threading.Thread(target=engine.begin, args=(config.project_path,), daemon=True).start()
    atexit.register(engine.flush)
    serve(engine, sys.stdin, lambda s: (sys.stdout.write(s), sys.stdout.flush()))


if __name__ == "__main__":
    main()
